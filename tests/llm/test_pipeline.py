import os
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import random  # noqa: E402

from ledgerwise.llm.queries import table  # noqa: E402
from test_decontam import brute as contamination  # noqa: E402
from test_setsketch import brute as groups  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = [f"term{i}" for i in range(400)]
    item = " ".join(r.choice(vocab) for _ in range(30))
    rows, labels = [], []
    for i in range(210):
        words = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        if i % 7 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilest", "grotty", "mucklike"]))
        if i % 10 == 1:
            words += item.split()
        if i % 10 == 2:
            words.insert(4, f"name{i}@mail.example.com")
        text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 7 == 0)))
    rows += [(1000 + i, rows[i][1] + " end", "en", "s", 1) for i in range(3, 60, 9)] + [rows[4], (2000, None, None, None, None), (2001, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        was = rows(docs)
        out = stage(spark, docs, sf_dir)
        path = os.path.join(sf_dir, f"stage-{name}.parquet")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            bad = re.compile("vilest|grotty|mucklike")
            assert Counter(rows(docs)) == Counter(r for r in was if not bad.search(r[1] or ""))
        elif name == "near_dedup":
            want = {d for d, _, _, keep in groups(was) if keep}
            assert Counter(d for d, _ in rows(docs)) == Counter(want)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            bad = {d for d, *_, c in contamination(was, items) if c}
            assert bad and Counter(rows(docs)) == Counter(r for r in was if r[0] not in bad)
        elif name == "pii":
            masked = {d: re.sub(r"\S+@\S+\.com", "[EMAIL]", t) if t else t for d, t in was}
            assert dict(rows(docs)) == masked and any("[EMAIL]" in (t or "") for t in masked.values())
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text)
        kept[name] = rows(docs) if k < 4 else None
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in kept["pii"]}
    assert Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter((r.doc_id, r.piece) for r in docs.collect())


def test_near_dedup_by_five_words_and_four_fifths(spark):
    """A block added at 96/116 of five words is a copy; two words changed at 66/86 aren't, though 72/84 of three words are shared."""
    a, b = ([f"{x}{i}" for i in range(100)] for x in "ab")
    longer, changed = a + [f"tail{i}" for i in range(20)], [f"new{i}" if i in (25, 55) else w for i, w in enumerate(b[:80])]
    rows = [(i, " ".join(w)) for i, w in enumerate((a, longer, b[:80], changed))]
    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 3]


def test_null_and_repeated_ids_blanks_clashes_and_empty_tables(spark, tmp_path):
    """Only copies go: ids that are null or repeat keep their texts, blanks stay, other columns come through."""
    r = random.Random(2)
    a, b, c, d = (" ".join(f"{x}{r.randint(0, 999)}" for _ in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (5, c), (5, d), (5, d), (7, c + " end"), (None, None), (6, ""), (6, " ")]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, low string, comp string, md5 string"
    tables = {"documents": ([(i, t, "en", "s", None, 1, "x", "y", "z") for i, t in rows], kind), "labels": ([], "doc_id bigint, quality int, toxic int"), "benchmark": ([], "item_id bigint, text string")}
    for at, keep in ((tmp_path / "some", True), (tmp_path / "none", False)):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data if keep else [], schema).write.parquet(f"{at}/{name}.parquet")
        docs = table(spark, str(at), "documents")
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(at))
            assert out.columns == docs.columns, name
            out.write.parquet(f"{at}/{name}.parquet")
            docs = spark.read.parquet(f"{at}/{name}.parquet")
        got = corpus_pipeline.run(spark, str(at)).collect()
        if not keep:
            assert got == []
        else:
            want = Counter([(None, a), (None, b), (5, c), (5, d), (None, None), (6, ""), (6, " ")])
            assert Counter((x.doc_id, x.text) for x in docs.collect()) == want and {(x.id, x.low, x.md5) for x in docs.collect()} == {(1, "x", "z")}
            assert Counter(x.doc_id for x in got if not x.piece) == Counter(i for i, _ in want.elements())
