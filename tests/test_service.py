import datetime as dt

import pytest
from ledgerwise.functions.compile import formula
from ledgerwise.plans import compose, procedure, service, statements

SQL = """CREATE OR REPLACE PROCEDURE PRO.Calc(p_TIMEKEY INT) AS BEGIN
UPDATE Acc SET dpd = 0, band = NULL;
UPDATE Acc A SET A.dpd = CASE WHEN A.since IS NOT NULL THEN (A.due - 3) * 2 ELSE 1 END WHERE A.kind IN ('F','G') AND NVL(A.due, 0) BETWEEN 1 AND 90;
IF p_TIMEKEY > 100 THEN UPDATE Acc SET band = 'late' WHERE dpd > 30 OR kind = 'G'; ELSE UPDATE Acc SET band = 'old' WHERE dpd <> 0; END IF;
END;"""


@pytest.mark.parametrize("key", [50, 150])
def test_composed_formulas_give_what_the_procedure_gives(spark, key):
    acc = spark.createDataFrame([(1, 9, None, "F", "s", 5), (2, 9, "x", "G", None, 80), (3, 9, None, "H", "s", 50), (4, 9, None, None, "s", None)], "k int, dpd int, band string, kind string, since string, due int")
    done = procedure.run(spark, SQL, {"Acc": acc}, {"p_TIMEKEY": key})["acc"]
    found = [statements.describe(s, i) for i, s in enumerate(statements.split_statements(SQL))]
    out = acc
    for c in ("dpd", "band"):
        text, used, problems = compose.compose(found, "Acc", c, frozenset({"P_TIMEKEY"}))
        assert not problems and used
        out = out.withColumn(c, formula(out, text, {"p_TIMEKEY": key}))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, done.collect()))


@pytest.mark.parametrize(
    "sql,want",
    [
        ("CASE a WHEN 1 THEN 'x' WHEN 2 THEN 'y' END", 'IF("E"."a"==1)THEN("x")ELSEIF("E"."a"==2)THEN("y")ELSE(NULL)'),
        ("a || '-' || b", 'CONCAT(CONCAT("E"."a","-"),"E"."b")'),
        ("SYSDATE - 3", '"E"."var"."BUSINESS_DATE"-3'),
        ("DATEADD(DAY, 3, x.d)", 'ADDDAY("x"."d",3)'),
        ("-a / (b + 1)", '-"E"."a"/("E"."b"+1)'),
    ],
)
def test_values(sql, want):
    assert compose.Translator(sql, "E").all(False) == want


def test_conditions():
    say = lambda s: compose.Translator(s, "E").all(True)
    assert say("a = 1 AND (b = 2 OR c IS NULL)") == '"E"."a"==1 AND ("E"."b"==2 OR ISEMPTY("E"."c"))'
    assert say("a NOT IN (1,2) OR NOT b > 3 AND c LIKE 'x%'") == '"E"."a" NOTIN [1,2] OR (NOT("E"."b">3) AND "E"."c" BEGINSWITH ["x"])'
    for bad in ("a = (SELECT 1)", "FOO(a) = 1", "a LIKE '%x%y'", "a =", "a ? b"):
        with pytest.raises(compose.Untranslatable):
            say(bad)


def test_merge_value():
    s = statements.describe("MERGE INTO Acc T USING (SELECT k, MAX(v) AS v FROM Src WHERE z = 1 GROUP BY k) S ON (T.k = S.k) WHEN MATCHED THEN UPDATE SET T.x = S.v WHERE T.y > 2")
    got = compose.stage_of(s, "x")
    assert (got.guard, got.value) == ('("Src"."z"==1) AND ("Acc"."y">2)', 'MAX("Src"."v")')


def test_job(spark):
    got = service.generate(spark, {"a.sql": SQL, "b.sql": "", "c.txt": "x", "d.sql": "CREATE PROCEDURE R AS BEGIN INSERT INTO Out (n) SELECT dpd FROM Acc WHERE dpd > 1; UPDATE Out SET w = BOGUS(1); END;"}, "Co", "P", {"acc": "ACCOUNT"}, {100: dt.date(2021, 12, 1)}, dt.date(2026, 1, 1))
    bad = {r.file: len(r.errors) for r in got.errors.collect()}
    assert bad == {"a.sql": 0, "b.sql": 1, "c.txt": 1, "d.sql": 0}
    rows = {(r.entity_name, r.column_name): r for r in got.rows.collect()}
    assert set(rows) == {("ACCOUNT", "dpd"), ("ACCOUNT", "band"), ("Out", "n"), ("Out", "w")}
    band = rows["ACCOUNT", "band"]
    assert band.effective_start_date == dt.date(2021, 12, 1) and band.status == "ACTIVE" and band.data_type == "number"
    assert rows["Out", "w"].status == "PENDING_REVIEW" and rows["Out", "n"].effective_start_date == dt.date(2026, 1, 1)
    assert {r.chain: r.order for r in got.chains.collect()} == {"a.sql#0": ["a.sql#0", "d.sql#0"]}
    assert "BR-001" in got.report and got.chunks.count() > 3
    again = service.generate(spark, {"d.sql": "CREATE PROCEDURE R AS BEGIN UPDATE Out SET w = BOGUS(1); END;"}, model=lambda p: "1+1")
    assert again.rows.first().display_derivation_expression == "1+1" and again.rows.first().status == "ACTIVE"
