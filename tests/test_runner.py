import datetime as dt

import pytest
from ledgerwise.operators import dictionary
from ledgerwise.plans import compose, runner, service, sites, statements
from test_service import SQL


def described(sql):
    return [statements.describe(s, i) for i, s in enumerate(statements.split_statements(sql))]


def test_job_life(spark, tmp_path):
    r = runner.Runner(spark, runner.Settings(folder=str(tmp_path)))
    with pytest.raises(ValueError, match="Platform required"):
        r.submit({}, "Co", " ")
    one, done = r.submit({"a.sql": SQL}, "Co", "P", today=dt.date(2026, 1, 1))
    done.result()
    assert r.status(one)["status"] == "COMPLETED" and r.status(one)["total"] == 2 and "BR-001" in r.report(one)
    two, done = r.submit({"a.sql": SQL}, "Co", "P", nothing=1)
    done.result()
    assert r.status(two)["status"] == "FAILED" and r.status(two)["error"]
    assert r.store.read("audit_log").first().job_id == two
    with pytest.raises(ValueError, match="FAILED"):
        r.report(two)
    with pytest.raises(KeyError):
        r.status("nobody")
    assert [(j.job_id, j.run_number) for j in r.jobs().collect()] == [(two, 2), (one, 1)]
    ids = {x.column_name: x.id for x in r.store.read("dd_rows").collect()}
    r.decide(spark.createDataFrame([(ids["dpd"], 1, "EDIT", "1+2"), (ids["band"], 2, "REJECT", None)], "row_id string, decision_id bigint, action string, edited_expression string"))
    assert [tuple(x)[4] if len(x) > 4 else x for x in r.export(one).collect()] and r.export(one).count() == 1
    r.write_report(one, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report"), wholetext=True).first().value.startswith("# Co P derivations")


def test_chain_folds_over_objects_and_cuts_by_its_own_thresholds(spark):
    a = "CREATE PROCEDURE A(p_TIMEKEY INT) AS BEGIN UPDATE Acc SET x = 1; CALL B(1); END;"
    b = "CREATE PROCEDURE B(p_TIMEKEY INT) AS BEGIN IF p_TIMEKEY > 100 THEN UPDATE Acc SET x = 2 WHERE k = 'F'; END IF; UPDATE Acc SET y = 5; END;"
    got = {(r.column_name, r.effective_start_date): r for r in service.generate(spark, {"a.sql": a, "b.sql": b}, today=dt.date(2026, 1, 1)).rows.collect()}
    x = next(r for (c, _), r in got.items() if c == "x")
    assert x.effective_start_date == dt.date(2000, 4, 10) and '"k"=="F"' in x.display_derivation_expression and x.display_derivation_expression.endswith("ELSE(1)")
    assert ("y", dt.date(2026, 1, 1)) in got


def test_findings_hold_rows_back(spark):
    sql = "CREATE PROCEDURE A AS BEGIN UPDATE Acc SET x = 0; UPDATE Acc SET x = x + z WHERE q = 1; UPDATE Acc SET w = 3 WHERE v = 1; EXCEPTION WHEN OTHERS THEN UPDATE Acc SET w = 0 WHERE v = 1; END;"
    rows = {r.column_name: r for r in service.generate(spark, {"a.sql": sql}).rows.collect()}
    assert rows["x"].status == rows["w"].status == "PENDING_REVIEW" and rows["x"].display_derivation_expression == ""
    assert any("later write" in e for e in rows["x"].validation_errors) and any("same guard" in e for e in rows["w"].validation_errors)
    table = service.generate(spark, {"a.sql": "UPDATE Acc SET x = BOGUS(1)"}, model=lambda p: '{"rules": [1]}' if "Writes of x" in p else "").rows.first()
    assert table.derivation_option == "Decision Table" and table.decision_table_json == '{"rules": [1]}' and table.status == "ACTIVE"


def test_site_helpers():
    found = described("BEGIN SELECT a INTO v FROM t; EXCEPTION WHEN NO_DATA_FOUND THEN v := 1; END; UPDATE Acc SET x = 4;")
    assert compose.compose(found, "Acc", "x")[0] == "4"
    assert sites.inventory(described("UPDATE Acc A SET A.x = A.y; SELECT S.y FROM Src S")) == {"X": {"ACC"}, "Y": {"ACC", "SRC"}}
    known = {"X": {"ACC"}, "Y": {"ACC", "SRC"}}
    assert sites.grounded('"Q"."x"+"Q"."y"+"SRC"."x"', known) == '"ACC"."x"+"Q"."y"+"SRC"."x"'
    text = sites.context("x", sites.sites(described("UPDATE a SET x = 0; UPDATE a SET x = 1"), "x"), "s" * 20_000)
    assert "1. [INITIAL_RESET]" in text and "\n...\n" in text and len(text) < 11_000
    assert dictionary.process_name("in/PRO_DPD_Calc.sql") == "PRO DPD Calc" and dictionary.slug("A b, c!") == "a-b-c" and dictionary.first_sentence("One. Two.") == "One."


def test_settings(monkeypatch):
    monkeypatch.setenv("LEDGERWISE_ATTEMPTS", "5")
    assert runner.Settings.from_environment() == runner.Settings(attempts=5)
