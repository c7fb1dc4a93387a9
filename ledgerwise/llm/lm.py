"""Language-model scores from counts of all words, pairs and triples of the training rows.

Words and one end token per text are counted over all training rows, and so are all pairs and
triples of them; none is left out, whatever its count. The model interpolates with absolute
discounting: p(w | u v) is the discounted share of w after u v, plus the discounted mass times
p(w | v), which is made the same way and ends in the add-one estimate of the base score. So each
context's probabilities sum to one, and without any pair the score is the base score.

As a backoff automaton: each context seen in training is a state, each n-gram seen an arc with its
interpolated probability, and a state's failure arc, weighted with its discounted mass, leads to
the state of its shorter context. Reading a text from left to right, a state without an arc for
the next token fails until one has it; the root has an arc for every token.

Counts stay distributed. Texts are written once as portions of token codes. A portion sends each
of its distinct n-grams, with how often its training rows hold it, to the task that the n-gram's
context is dealt to; that task adds up what all portions sent and returns the counts to each. Then
a portion's texts run through the part of the automaton that its own n-grams reach. Pairs after
one of the ``known`` most frequent tokens are dealt by the pair, so that no frequent word lands in
one task; the totals of these contexts, `known` rows at most, go to every executor.

Tokens are told apart by 63-bit hashes, or by rank where they are among the ``known`` most
frequent. Defined cases: a null text is the empty text, one end token; a null doc_id counts as
the empty string in the split; rows are scored each, equal texts alike; a very long text is a
portion of its own; without training rows all tokens are unknown; no rows give no result; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._store import release, stash
from ._words import SPACED, mix, pieces, portions

KNOWN, DISCOUNT, LANE = 1 << 19, 0.75, 256
PORTION, GATHERED, TASK = 8 << 20, 4 << 20, 1_000_000
END = np.uint64(0x656E64206F662074)


def _hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' hashes of all texts, each with its end, and where each text's begin."""
    flat, count = [], []
    for i, j, w in pieces(text, SPACED):
        n = np.diff(w.first)
        out = np.full(len(w) + j - i, END, np.uint64)
        out[np.arange(len(w)) + w.text_of()] = w.hash
        flat.append(out)
        count.append(n + 1)
    return (np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(count))])) if flat else (np.zeros(0, np.uint64), np.zeros(1, np.int64))


def _counted(h: np.ndarray, name: str) -> pa.RecordBatch:
    h, n = np.unique(h, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=[name, "n"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (p for b in batches for p in portions(b, 0, PORTION)):
        yield _counted(_hashes(b.column(0))[0], "h")


def _place(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(h), -1)
    p = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[p] == h, p, -1)


class Vocabulary:
    """The most frequent tokens: sorted hashes, with the count and the rank of each."""

    def __init__(self, h: np.ndarray, n: np.ndarray, tokens: int, distinct: int):
        order = np.lexsort((h, -n))
        h, n = h[order].view(np.uint64), n[order]
        self.total = tokens + distinct + 1  # what add-one counts divide by
        self.hash, order = np.sort(h), np.argsort(h)
        self.rank = order + 1
        self.by_rank = np.concatenate([[0], n])


_ZSTD = pa.Codec("zstd")
_UNSEEN, _A, _MASK = np.uint64(1 << 63), np.uint64(0x9E3779B97F4A7C15), (1 << 32) - 1


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of integers as compressed bytes: of each as many bytes as its values need, all first bytes before all second ones."""
    head, body = [len(columns)], []
    for x in columns:
        x = np.ascontiguousarray(x, np.int64)
        width = 0 if not len(x) or not x.any() else 8 if x.min() < 0 else (int(x.max()).bit_length() + 7) // 8
        head += [len(x), width]
        body.append(x.view(np.uint8).reshape(-1, 8).T[:width].tobytes())
    return np.array(head, "<i4").tobytes() + _ZSTD.compress(b"".join(body), asbytes=True)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, "<i4", 2 * int(np.frombuffer(raw, "<i4", 1)[0]), 4).astype(np.int64).reshape(-1, 2)
    body, out, at = np.frombuffer(_ZSTD.decompress(raw[4 + 8 * len(sizes) :], int(sizes.prod(1).sum())), np.uint8), [], 0
    for n, width in sizes.tolist():
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = body[at : at + n * width].reshape(width, n).T
        out.append(x.view(np.int64).ravel())
        at += n * width
    return out


def _coded(vocabulary):
    """(doc_id, held_out, text) batches to portions: a number, how many tokens, and ids, nulls among them, splits, where texts begin, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, made = vocabulary.value, TaskContext.get().partitionId() << 32
        for b in (p for b in batches for p in portions(b, 2, GATHERED)):
            h, first = _hashes(b.column(2))
            if not len(h):
                continue
            at = _place(v.hash, h)
            w = np.where(at >= 0, v.rank[at] if len(v.hash) else 0, (h | _UNSEEN).view(np.int64))
            raw = _packed(b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), first, w)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((made, pa.int64()), (len(h), pa.int64()), (raw, pa.binary()))], names=["portion", "tokens", "data"])
            made += 1

    return run


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and for each value given its place among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], place


class Grams:
    """Distinct n-grams of one order in a portion, by context: contexts c, the context `of` and the token w of each n-gram; the n-gram at position where[i] is place[i]. They are dealt to tasks by context, or by themselves."""

    def __init__(self, c: np.ndarray, of: np.ndarray, w: np.ndarray, where: np.ndarray, place: np.ndarray, by_pair: bool, tasks: int):
        self.c, self.of, self.w, self.where, self.place = c, of, w, where, place
        key = mix(c.view(np.uint64) + _A)[of]
        if by_pair:
            key = np.where(c[of] >= 0, mix(key ^ w.view(np.uint64)), key)
        order = np.sort((key % np.uint64(tasks)).astype(np.int64) << 32 | np.arange(len(of)))
        self.task, self.order = order >> 32, order & _MASK

    def dealt(self, task: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of a task, their contexts and how many each has."""
        own = self.order[slice(*np.searchsorted(self.task, [task, task + 1]))]
        lead = np.flatnonzero(np.diff(self.of[own], prepend=-1))
        return own, self.of[own[lead]], np.diff(lead, append=len(own))


def _orders(w: np.ndarray, first: np.ndarray, tasks: int) -> list[Grams]:
    """Unseen tokens, pairs and triples of a portion. The start of a text is code 0."""
    codes, token = _distinct(w)
    unseen, at = int(np.searchsorted(codes, 0)), np.flatnonzero(w < 0)
    one = Grams(codes[:unseen], np.arange(unseen), np.zeros(unseen, np.int64), at, token[at], False, tasks)
    before = np.concatenate([[0], token[:-1] + 1])
    before[first[:-1]] = 0
    key, place = _distinct(before << 32 | token)
    context, of = _distinct(key >> 32)
    two = Grams(np.concatenate([[0], codes])[context], of, codes[key & _MASK], np.arange(len(w)), place, True, tasks)
    at = np.flatnonzero(before)
    key, place3 = _distinct(place[at - 1] << 32 | token[at])  # the pair before a token is its context
    pair, of = _distinct(key >> 32)
    u, v = two.c[two.of[pair]], two.w[pair]
    both = np.where((u >= 0) & (v >= 0), u << 31 | v, (mix(mix(u.view(np.uint64)) * _A ^ v.view(np.uint64)) | _UNSEEN).view(np.int64))
    rank = np.empty(len(both), np.int64)
    rank[order := np.argsort(both)] = np.arange(len(both))
    of = np.sort(rank[of] << 32 | np.arange(len(of)))  # by the contexts' codes, as in the other orders
    moved = np.empty(len(of), np.int64)
    moved[of & _MASK] = np.arange(len(of))
    return [one, two, Grams(both[order], of >> 32, codes[key & _MASK][of & _MASK], at, moved[place3], False, tasks)]


def _steps(x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Ascending runs as differences: the first value of each run, which begin at lead, then what each adds to the one before (modulo 2**64)."""
    out = np.diff(x, prepend=0)
    out[lead] = x[lead]
    return out


def _climbed(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What _steps() made, with the sizes of its runs."""
    total = np.cumsum(steps)
    lead = np.cumsum(size) - size
    return total - np.repeat(total[lead] - steps[lead], size)


_ONE = np.zeros(1, np.int64)


def _asked(tasks: int):
    """Portions to what each asks of each task, an order apart: contexts, their numbers of n-grams, tokens and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, raw in ((p, d) for b in batches for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            _, _, held, first, w = _unpacked(raw)
            train = np.repeat(1 - held, np.diff(first)).astype(float)
            orders = _orders(w, first, tasks)
            count = [np.bincount(g.place, train[g.where], len(g.w)).astype(np.int64) for g in orders]
            task, data = np.unique(np.concatenate([g.task for g in orders])), []
            for t in task.tolist():
                parts = []
                for g, n in zip(orders, count):
                    own, context, size = g.dealt(t)
                    parts.append(_packed(_steps(g.c[context], _ONE[: len(context)]), size, _steps(g.w[own], np.cumsum(size) - size), n[own]))
                data.append(np.array([*map(len, parts)], "<i4").tobytes() + b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array([portion] * len(task), pa.int64()), pa.array(data, pa.binary())], names=["task", "portion", "data"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is asked, sorted by task, to the answers: counts, and the total and number of kinds of each context; to portion -1, both for ranks as contexts of pairs."""

    def order(raw: bytes, k: int) -> tuple[np.ndarray, ...]:
        at = np.cumsum([12, *np.frombuffer(raw, "<i4", 3)])
        c, size, w, n = _unpacked(raw[at[k] : at[k + 1]])
        return np.cumsum(c), size, _climbed(w, size) if len(w) else w, n

    def answer(task: int, portion: list[int], asked: list[bytes]) -> Iterator[pa.RecordBatch]:
        out, near = [[] for _ in portion], []
        for k in range(3):  # one order at a time is unpacked
            got = [order(a, k) for a in asked]
            ends, grams = (np.cumsum([0, *(len(a[j]) for a in got)]) for j in (0, 2))
            c, size, w, count = (np.concatenate(x) for x in zip(*got))
            del got
            c, of = _distinct(c)
            _, w = _distinct(w)
            key, place = _distinct(np.repeat(of, size) << 32 | w)
            n = np.bincount(place, count, len(key)).astype(np.int64)
            total, kinds = (np.bincount(key >> 32, x, len(c)).astype(np.int64) for x in (n, n > 0))
            if k == 1:
                i = np.flatnonzero(c >= 0)
                near = [c[i], total[i], kinds[i]]
                total[i] = kinds[i] = 0
            for j, o in enumerate(out):
                p, q = place[grams[j] : grams[j + 1]], of[ends[j] : ends[j + 1]]
                o += [n[p], total[q], kinds[q]] if k else [n[p]]
        rows = [*zip(portion, out), (-1, near)]
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.int64()), pa.array([task] * len(part), pa.int64()), pa.array([_packed(*x) for _, x in part], pa.binary())], names=["portion", "task", "data"])

    at, portion, asked = None, [], []
    for b in batches:
        for t, p, d in zip(*(b.column(c).to_pylist() for c in range(3))):
            if t != at:
                if portion:
                    yield from answer(at, portion, asked)
                at, portion, asked = t, [], []
            portion.append(p)
            asked.append(d)
    if portion:
        yield from answer(at, portion, asked)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for d in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(d)], names=["c", "total", "kinds"])


class Automaton:
    """The part of the backoff automaton that a portion's n-grams reach.

    State 0 is the root, then come contexts of one token and of two. fail, weight: of each state's
    failure arc. source, logp, to: of each arc, pairs before triples, source -1 where training has no
    such n-gram. before: the state in which each position is read, which two tokens determine.
    """

    def __init__(self, first: np.ndarray, orders: list[Grams], p1: np.ndarray, got: list[list[np.ndarray]]):
        """p1: the root's probability of each position's token; got: counts of the distinct pairs and triples, and totals and kinds of their contexts."""
        _, two, three = orders
        (n2, t2, k2), (n3, t3, k3) = got
        live2, state2 = self._states(t2, 1)
        live3, state3 = self._states(t3, 1 + len(live2))
        own = two.of[two.place]  # the context of one token before each position
        shorter = np.zeros(len(three.c), np.int64)
        shorter[three.of[three.place]] = state2[own[three.where]]
        self.fail = np.concatenate([np.zeros(1 + len(live2), np.int64), shorter[live3]])
        self.weight = np.log10(np.concatenate([[1.0], DISCOUNT * k2[live2] / t2[live2], DISCOUNT * k3[live3] / t3[live3]]))
        self.before = state2[own]
        self.before[three.where] = np.where(state3 > 0, state3, shorter)[three.of[three.place]]

        lower = np.zeros(len(two.w))
        lower[two.place] = p1
        p2 = self._mixed(n2, t2[two.of], k2[two.of], lower)
        lower = np.zeros(len(three.w))
        lower[three.place] = p2[two.place[three.where]]
        self.logp1, self.logp = np.log10(p1), np.log10(np.concatenate([p2, self._mixed(n3, t3[three.of], k3[three.of], lower), [1.0]]))
        self.source = np.concatenate([np.where(n2 > 0, state2[two.of], -1), np.where(n3 > 0, state3[three.of], -1), [-1]])
        self.arc2, self.arc3 = two.place, np.full(len(two.place), len(self.source) - 1)
        self.arc3[three.where] = len(two.w) + three.place
        inner = np.ones(len(own), bool)
        inner[first[1:] - 1] = False  # after a text's end comes nothing
        inner = np.flatnonzero(inner)
        self.to, self.to1 = np.zeros(len(self.source), np.int64), np.append(state2[own[1:]], 0)
        self.to[self.arc2[inner]] = self.to[self.arc3[inner]] = self.before[inner + 1]
        self.first = first

    @staticmethod
    def _states(total: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """The contexts that training holds, and the state of each context, 0 without one."""
        live, state = np.flatnonzero(total > 0), np.zeros(len(total), np.int64)
        state[live] = base + np.arange(len(live))
        return live, state

    @staticmethod
    def _mixed(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
        t = np.maximum(total, 1)
        return np.where(total > 0, np.maximum(n - DISCOUNT, 0) / t + DISCOUNT * kinds / t * lower, lower)

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of the token at each lane's position, and the lane's next state."""
        arc = self.arc3[at]
        hit = self.source[arc] == state
        gain, new = np.where(hit, self.logp[arc], 0.0), self.to[arc]
        left = np.flatnonzero(~hit)
        at, state = at[left], state[left]
        long = self.fail[state] > 0  # a state of two tokens
        gain[left] += np.where(long, self.weight[state], 0.0)
        state = np.where(long, self.fail[state], state)
        arc = self.arc2[at]
        hit = self.source[arc] == state
        gain[left] += np.where(hit, self.logp[arc], self.weight[state] + self.logp1[at])
        new[left] = np.where(hit, self.to[arc], self.to1[at])
        return gain, new

    def scores(self) -> np.ndarray:
        """The log10 probability of each text, from left to right; a long text runs as several lanes, each from the state that the one before it ends in."""
        size = np.diff(self.first)
        runs = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), runs)
        begin = self.first[:-1][text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs))
        size = np.minimum(LANE, self.first[1:][text] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, text = begin[order], size[order], text[order]
        active = np.searchsorted(-size, -np.arange(size.max(initial=0)))
        score, state = np.zeros(len(text)), self.before[begin]
        for t, n in enumerate(active.tolist()):
            gain, state[:n] = self.step(state[:n], begin[:n] + t)
            score[:n] += gain
        return np.bincount(text, score, len(self.first) - 1)


def _scored(vocabulary, near, tasks: int):
    """Portions, each followed by its answers in the order of tasks, to the scores of its texts."""

    def scores(data: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        v, (near_total, near_kinds) = vocabulary.value, near.value
        ids, null, held, first, w = _unpacked(data)
        orders = _orders(w, first, tasks)
        got = [[np.zeros(len(g.w), np.int64), *np.zeros((2, len(g.c)), np.int64)] for g in orders]
        for t, raw in answers:
            a = _unpacked(raw)
            for g, x, columns in zip(orders, got, (a[:1], a[1:4], a[4:])):
                grams, context, _ = g.dealt(t)
                for part, i, column in zip(x, (grams, context, context), columns):
                    part[i] = column
        count = np.where(w > 0, v.by_rank[np.maximum(w, 0)], 0)
        count[orders[0].where] = got[0][0][orders[0].place]
        p1 = (count + 1.0) / v.total
        c = orders[1].c
        for x, known in zip(got[1][1:], (near_total, near_kinds)):
            x[c >= 0] = known[c[c >= 0]]
        own = Automaton(first, orders, p1, got[1:])
        text = np.repeat(np.arange(len(ids)), np.diff(first))
        add = lambda x: np.bincount(text, x, len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null > 0), pa.array(held > 0), pa.array(np.diff(first)), pa.array(add(count > 0).astype(np.int64)), pa.array(add(own.logp1)), pa.array(own.scores())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, answers = None, []
        for b in batches:
            for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t < 0:
                    if data is not None:
                        yield scores(data, answers)
                    data, answers = d, []
                else:
                    answers.append((t, d))
        if data is not None:
            yield scores(data, answers)

    return run


def split_of(column: str, mod: int) -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % mod


def _most_frequent(counts: DataFrame, key: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts n of all rows from the least count on that leaves at most `bound`; counts differ in steps of a 32nd power of two."""
    rank = F.floor(F.log2("n") * 32).cast("int")
    least, left = 0, bound
    for r in counts.groupBy(rank.alias("r")).agg(F.count("*").alias("k")).orderBy(F.desc("r")).collect():  # 2,048 rows at most
        left -= r.k
        if left < 0:
            least = r.r + 1
            break
    got = counts.where(rank >= least).select(key, "n").toArrow()
    return got.column(key).to_numpy(), got.column("n").to_numpy()


def score(docs: DataFrame, held_out: F.Column, known: int = KNOWN) -> DataFrame:
    """One row per row of docs (doc_id, text), scored by a model of the rows that aren't held out."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = docs.where("NOT held_out").select("text")
    counts = stash(train.mapInArrow(_tokens, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    v = Vocabulary(*_most_frequent(counts, "h", known), tokens, distinct)
    release(counts)
    shared = spark.sparkContext.broadcast(v)
    kept = stash(docs.mapInArrow(_coded(shared), "portion bigint, tokens bigint, data binary"), "portions")  # written, so that a portion keeps its number
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (kept.agg(F.sum("tokens")).first()[0] or 0) // TASK + 1)
    asked = kept.select("portion", "data").mapInArrow(_asked(tasks), "task bigint, portion bigint, data binary")
    answers = stash(asked.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(_answers, "portion bigint, task bigint, data binary"), "answers")
    totals = answers.where("portion < 0").select("data").mapInArrow(_near, "c bigint, total bigint, kinds bigint").groupBy("c").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).toArrow()  # known + 1 rows at most
    near = np.zeros((2, len(v.by_rank) + 1), np.int64)
    near[:, totals.column("c").to_numpy()] = [totals.column(c).to_numpy() for c in ("total", "kinds")]
    both = answers.where("portion >= 0").unionByName(kept.select("portion", F.lit(-1).cast("bigint").alias("task"), "data"))
    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    rows = both.repartition(tasks, "portion").sortWithinPartitions("portion", "task").mapInArrow(_scored(shared, spark.sparkContext.broadcast(near), tasks), kind)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
