from ledgerwise.operators import dictionary, retrieval
from ledgerwise.plans import sites as S
from ledgerwise.plans.statements import describe, split_statements

SQL = "UPDATE a SET x = 0; IF k > 1 THEN UPDATE a t SET t.x = t.x + t.y WHERE t.z = 2; END IF; UPDATE a SET y = 3; SELECT m INTO v FROM b; UPDATE a SET x = v;"


def test_sites():
    found = [describe(s, i) for i, s in enumerate(split_statements(SQL))]
    got = S.sites(found, "X")
    assert [s.statement_indices for s in got] == [(0,), (1, 2), (6,)] and got[1].raw_sql.startswith("IF k > 1 THEN\nUPDATE")
    assert [S.guarded_update(s, "x") for s in found if S.writes(s, "x")] == [False, True, False]
    assert S.reads_itself_later(found, "x") and not S.reads_itself_later(found, "y")
    assert {"A", "T", "X", "Y", "Z", "B", "P"} <= S.known_names(found, frozenset({"p"}))
    assert S.breadcrumbs("P", got)[1] == "P: UPDATE at statement 1, 2"
    assert S.hints("UPDATE a SET x = 1 WHERE y = 2") == {"values": ["x = 1 "], "guards": ["y = 2"], "targets": ["a"]}


def test_formula_edits():
    text = 'IF("T"."x">"T"."var"."BUSINESS_DATE")THEN("U"."y")ELSE("T"."x")'
    assert S.with_tables(text, {"T": "ACCT"}) == 'IF("ACCT"."x">"T"."var"."BUSINESS_DATE")THEN("U"."y")ELSE("ACCT"."x")'
    assert S.without_trailing_self(text, "t", "X").endswith("ELSE(NULL)") and S.without_trailing_self(text, "t", "y") == text
    assert S.with_tables("(((", {}) == S.without_trailing_self("(((", "a", "b") == "((("
    assert S.answer_kind('```json\n{"rules": []}\n```') == ("Decision Table", '{"rules": []}')
    assert S.answer_kind("```\n1+1\n```") == ("Formula Expression", "1+1") and S.answer_kind("[1]")[0] == "Formula Expression"


def test_context_and_entities(spark):
    docs = retrieval.ingest(spark.createDataFrame([("guide.md", "alpha beta\n\n" + "gamma " * 200)], "file string, text string"), "platform")
    assert {r.id for r in docs.collect()} == {"platform-guide-0", "platform-guide-1"}
    q = spark.createDataFrame([("q", "beta alpha")], "id string, document string")
    assert retrieval.context(q, docs, docs, (1, 1)).first().context == "alpha beta\n\nalpha beta"
    numbered = spark.createDataFrame([("LogTable", 1), ("B", 2), ("A", 3), ("B", 4)], "entity_name string, first int")
    assert [(r.entity_name, r["first"]) for r in dictionary.by_entity(numbered).collect()] == [("B", 2), ("B", 4), ("A", 3), ("LogTable", 1)]
