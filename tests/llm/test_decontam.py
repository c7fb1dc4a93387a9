import re

from ledgerwise.llm.decontam import contaminated, decontaminate, keep_clean

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[p : p + window]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for v, ids in wins.items():
            for p in range(len(w) - len(v) + 1):
                if tuple(w[p : p + len(v)]) == v:
                    hit.update(range(p, p + len(v)))
                    got |= ids
        out.append((d, len(w), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, docs, rows):
    ws = words(rows[12][1]) * 2
    long = words(rows[66][1])
    items = [(1, rows[67][1]), (2, "two WORDS"), (3, "one"), (4, " ".join(long[5:40])), (5, " ".join(long[1000:1013])), (6, " ".join(long[1000:1013])), (7, None), (8, "..."), (None, "null id text here"), (10, " ".join(ws[:14])), (11, "the of"), (12, "x1 " * 20)]
    more = [(900, "x1 " * 13), (901, "x1 " * 12), (902, "x1 " * 40), (903, "two words two words"), (904, " ".join(long[1001:1013]))]
    all_docs = docs.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(*m, "c") for m in more], "doc_id bigint, text string, n_words string"))
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, md5 string")
    got = decontaminate(all_docs, bench).withColumn("c", contaminated()).collect()
    assert sorted([(g.doc_id, g.n_words, g.n_hit, list(g["items"]), g.c) for g in got], key=str) == brute([(r[0], r[1]) for r in rows] + more, items)
    clean = keep_clean(all_docs, bench)
    assert clean.columns == all_docs.columns
    assert clean.count() == sum(not g.c for g in got)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate(docs, none)
    assert got.where("n_hit > 0").count() == 0 and got.count() == docs.count()
    assert decontaminate(docs.limit(0), none).count() == 0
