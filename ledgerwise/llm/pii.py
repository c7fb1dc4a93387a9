"""Personal data by weak supervision.

Base spans come from fixed patterns with their tests. The method adds spans of other kinds:
loose candidates are labelled by voters that look at their form, their checks, word lists,
the words around them and what else stands near; expectation-maximisation over how often each
set of votes occurs estimates each voter's hit and false-alarm rates without labels. A logistic
span classifier over the votes and over features of the span and its context (length, shares of
digits and capitals, separators, the characters and words beside it) is fitted to the resulting
posteriors; its weights are drawn to what the reliabilities alone say. Candidates of ``SURE`` or
more are added. Votes and features have few values, so what is counted over all documents is a
table of bounded size.

Base kinds: email, ip, card, phone. Added: contact (spelt-out addresses, national phone
numbers), iban, secret (keys, tokens, passwords), ssn. Added spans overlap no base span and no
earlier added one. Work is in proportion to a text's length and spans.

Defined cases: null is the empty text, without spans; positions are code points, ends
exclusive; repeated rows are searched each, equal texts alike; a very long text is searched
whole; a corpus without candidates, or an empty one, adds nothing. Other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "iban", "secret", "ssn")
SURE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A start inside a run of digits matches only if the run's first digit does, and matches end with their run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as in BASE, then by start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", a, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _NUMBER.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NUMBER.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


_LOOSE = {
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])", re.A),
    "contact": re.compile(r"(?<![\w+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/=.-]{0,64}[0-9])[A-Za-z0-9_+/-][A-Za-z0-9_+/.-]{14,254}[A-Za-z0-9_+/-]={0,2}(?![A-Za-z0-9_+/=@-])"),
}
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{2,63})+", re.I)
#: Word lists of the gazetteer and context voters.
_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split())
_ENDINGS = frozenset("com org net edu gov info io de fr es uk eu co us".split())
_CUES = re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|contact|mail|email|e-mail|ssn|social security|iban|account|bank|write|telefon|konto|courriel|compte|correo|cuenta)\b", re.I)
_OTHER = re.compile(r"\b(?:isbn|issn|order|invoice|version|serial|model|part|no|nr|id|ref|page|figure|table)\b\W*$", re.I)
_KEY = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?|signature)\w*\W{0,4}$", re.I)
_HASH = re.compile(r"\b(?:sha[0-9]*|md5|commit|checksum|digest|etag|uuid|revision|href|src|url)\w*\W{0,4}$", re.I)
_ISSUED = re.compile(r"AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abprs]-|eyJ|AIza|glpat-")
_HEX, _AT = re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[(\[]at[)\]]", re.I)


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _secret(s: str, before: str) -> tuple[int, int, int]:
    """Votes of form, check and list: random characters of several classes, many different ones, a known issuer or key name."""
    classes = sum(any(f(c) for c in s) for f in (str.islower, str.isupper, str.isdigit))
    form = 1 if _HEX.fullmatch(s) and len(s) >= 32 or classes == 3 and not re.search(r"[./]", s) else -1
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    check = 1 if len(set(s)) >= min(12, len(s) // 2) and 6 * changes >= len(s) else -1
    return form, check, 1 if _ISSUED.match(s) or _KEY.search(before) else -1


def _length(n: int) -> int:
    return bisect_right((10, 14, 20, 32, 48), n)


def _beside(c: str) -> int:
    """The class of a neighbouring character: none, white space, digit, letter, bracket or quote, assignment, other."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "()[]{}\"'<>`" else 5 if c in "=:" else 6


#: How many values each feature of _features has.
SIZES = (6, 5, 3, 4, 7, 7, 4)


def _features(text: str, a: int, b: int, before: str, around: str) -> tuple[int, ...]:
    """Length, share of digits, case, separators, the characters before and after, and the words before."""
    s = text[a:b]
    digits = sum(map(str.isdigit, s))
    upper, lower = any(map(str.isupper, s)), any(map(str.islower, s))
    separators = len(set(re.findall(r"[^A-Za-z0-9]", s)))
    word = 3 if _KEY.search(before) else 2 if _OTHER.search(before) or _HASH.search(before) else 1 if _CUES.search(around) else 0
    return _length(b - a), min(4, 5 * digits // (b - a)), upper + lower, min(3, separators), _beside(text[a - 1 : a] if a else ""), _beside(text[b : b + 1]), word


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, votes, features): votes are 1 for, -1 against, 0 abstaining; in the order form, check, gazetteer, context, company."""
    found, taken = [], []  # disjoint (start, end) in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    digits = bool(_DIGIT.search(text))
    for kind, pattern in (*((k, p) for k, p in _LOOSE.items() if digits), ("contact", _SPELT)):
        if pattern is _SPELT and not _AT.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            at = bisect_left(taken, (b,))  # the first taken span that starts at b or later
            if at and taken[at - 1][1] > a:
                continue
            s, before, around = m[0], text[max(0, a - 30) : a], text[max(0, a - 60) : b + 30]
            if kind == "iban":
                form, test, listed = 1 if " " not in s or all(len(p) == 4 for p in s.split(" ")[:-1]) else -1, 1 if _iban(s) else -1, 1 if s[:2] in _COUNTRIES else -1
            elif kind == "ssn":
                form, test, listed = 1 if "-" in s else -1, -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[-4:] == "0000" else 1, 0
            elif kind == "secret":
                form, test, listed = _secret(s, before)
                if form < 0 and listed < 0 or test < 0:
                    continue  # a long word, name or number
            elif pattern is _SPELT:
                form, test, listed = 1 if re.search("dot", s, re.I) else -1, 0, 1 if re.split(r"\W+", s.lower().rstrip(")]"))[-1] in _ENDINGS else -1
            else:
                d = _NUMBER.sub("", s)
                form, test, listed = 1 if s[0] == "(" or len(set(re.findall(r"[ .-]", s))) == 1 else -1, -1 if d[0] in "01" or d[3] in "01" else 1, 0
            if kind == "secret":
                context = -1 if _HASH.search(before) else 1 if re.search(r"[=:]\W{0,3}$", before) else 0
            else:
                context = -1 if _OTHER.search(before) else 1 if _CUES.search(around) else 0
            near = at and taken[at - 1][1] > a - 200 or at < len(taken) and taken[at][0] < b + 200
            found.append((kind, a, b, (form, test, listed, context, 1 if near else 0 if kind == "secret" else -1), _features(text, a, b, before, around)))
            insort(taken, (a, b))
    return found


@dataclass
class Voters:
    """The span classifier's weights by kind."""

    kinds: dict[str, np.ndarray]

    def chance(self, kind: str, votes: tuple[int, ...], features: tuple[int, ...]) -> float:
        b = self.kinds.get(kind)
        return 0.0 if b is None else float(1 / (1 + np.exp(-np.clip(_inputs(np.array([votes]), np.array([features]))[0] @ b, -30, 30))))


def _inputs(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A one, each vote for and against, and each feature's value."""
    shown = [features[:, [i]] == np.arange(n)[None, :] for i, n in enumerate(SIZES)]
    return np.hstack([np.ones((len(votes), 1)), votes == 1, votes == -1, *shown]).astype(float)


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each set of votes, P(vote | class) as [class, voter, vote + 1], and the share of true spans; starts from the majority."""
    post = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    rates, share = np.zeros((2, votes.shape[1], 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * count, post * count])
        for v in range(3):
            rates[:, :, v] = weight @ (votes == v - 1) + 0.5
        rates /= rates.sum(2, keepdims=True)
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        share = float(prior[1])
        logs = np.log(prior)[:, None] + np.stack([np.log(rates[c][np.arange(votes.shape[1])[None, :], votes + 1]).sum(1) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, rates, share


def _classifier(votes: np.ndarray, features: np.ndarray, post: np.ndarray, count: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression of the posteriors on votes and features, by Newton steps; the ridge draws it to the voters' own log-odds."""
    x, odds = _inputs(votes, features), np.log(rates[1] / rates[0])
    start = np.zeros(x.shape[1])
    start[0] = np.log(share / (1 - share)) + odds[:, 1].sum()
    start[1 : 1 + votes.shape[1]] = odds[:, 2] - odds[:, 1]
    start[1 + votes.shape[1] : 1 + 2 * votes.shape[1]] = odds[:, 0] - odds[:, 1]
    b = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (count * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        b += np.clip(np.linalg.solve(h, x.T @ (count * (post - p)) - (b - start)), -5, 5)
    return b


def _strings(column: pa.Array) -> Iterator[str]:
    return (t or "" for t in column.to_pylist())


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [c for t in _strings(b.column(0)) for c in candidates(t, base_spans(t))]
        few = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[3] for r in rows], few), pa.array([r[4] for r in rows], few)], names=["kind", "votes", "features"])


def fit(docs: DataFrame) -> Voters:
    """Voters of all documents' candidates; what comes back is counts of the sets of votes and features that occur, which have few values."""
    rows = docs.select("text").where("text RLIKE '[0-9]' OR text RLIKE '(?i)[(\\\\[]at[)\\\\]]'").mapInArrow(_votes, "kind string, votes array<int>, features array<int>").groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in {r.kind for r in rows}:
        own = sorted((tuple(r.votes), tuple(r.features), r.n) for r in rows if r.kind == kind)
        votes, features, count = np.array([r[0] for r in own]), np.array([r[1] for r in own]), np.array([r[2] for r in own], float)
        sets, place = np.unique(votes, axis=0, return_inverse=True)
        post, rates, share = expectation_maximisation(sets, np.bincount(place.ravel(), count))
        out[kind] = _classifier(votes, features, post[place.ravel()], count, rates, share)
    return Voters(out)


def spans(text: str, voters: Voters) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and added spans by kind and start."""
    base = base_spans(text)
    return base, sorted((k, a, b) for k, a, b, v, f in candidates(text, base) if voters.chance(k, v, f) >= SURE)


def find(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, and all spans of docs (doc_id, text) as arrays of kind, start and end, base spans first."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans(t, shared.value) for t in _strings(b.column(1))]
            to = lambda s: [{"kind": k, "start": a, "end": z} for k, a, z in s]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to(x) for x, _ in got], kind), pa.array([to(y) for _, y in got], kind)], names=["doc_id", "base", "added"])

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, base {one}, added {one}")


def masker(spark, voters: Voters):
    """A column function: text with each span, or run of overlapping spans, replaced by its first one's kind in brackets."""
    shared = spark.sparkContext.broadcast(voters)

    def mask(text: str | None) -> str | None:
        if not text:
            return text
        base, added = spans(text, shared.value)
        out, at, end = [], 0, 0
        for k, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
            if a < end:
                end = max(end, b)
                continue
            if end:
                at = end
            out += [text[at:a], f"[{k.upper()}]"]
            end = b
        return "".join(out) + text[end:] if out else text

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return text.map(mask)

    return masked
