import pytest
from ledgerwise.plans import procedure
from ledgerwise.plans.procedure import ProcedureError
from ledgerwise.plans.spoken import conjuncts, joined_text, limited, to_spark
from test_operators import rows_of


@pytest.fixture(scope="module")
def tables(spark):
    return {"PRO.Acc": spark.createDataFrame([(1, 0, "Y"), (2, 0, "N")], "k int, x int, f string"), "Src": spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")}


def x_of(spark, tables, sql, **more):
    return rows_of(procedure.run(spark, sql, tables, **more)["acc"].select("k", "x"), "k")


@pytest.mark.parametrize(
    "sql,want",
    [
        ("MERGE INTO PRO.Acc T USING Src S ON (T.k = S.k AND T.f = 'Y') WHEN MATCHED THEN UPDATE SET T.x = S.v", [(1, 10), (2, 0)]),
        ("MERGE INTO Acc T USING Src S ON (T.k = S.k AND S.v <= 10) WHEN MATCHED THEN UPDATE SET x = v", [(1, 10), (2, 0)]),
        ("MERGE INTO Acc T USING Src S ON (T.k = S.k AND T.k * 10 < S.v + 5) WHEN MATCHED THEN UPDATE SET T.x = S.v", [(1, 10), (2, 20)]),
        ("MERGE INTO Acc T USING Src S ON (T.k = S.k) WHEN MATCHED AND S.v > 15 THEN UPDATE SET T.x = S.v", [(1, 0), (2, 20)]),
        ("MERGE INTO Acc T USING Src S ON (T.k = S.k) WHEN MATCHED AND T.f = 'N' THEN DELETE", [(1, 0)]),
        ("MERGE INTO Acc T USING (SELECT k + 1 AS k, v FROM Src) S ON (T.k = S.k) WHEN MATCHED THEN UPDATE SET T.x = T.k WHERE S.v > 99 WHEN NOT MATCHED THEN INSERT (k, x) VALUES (S.k, S.v) WHERE S.v > 15", [(1, 0), (2, 0), (3, 20)]),
        ("MERGE INTO Acc T USING (SELECT A.ROWID AS RID, 5 AS n FROM Acc A WHERE A.f = 'N') S ON (T.ROWID = S.RID) WHEN MATCHED THEN UPDATE SET T.x = S.n", [(1, 0), (2, 5)]),
        ("UPDATE Acc SET x = (SELECT MAX(v) FROM Src WHERE ROWNUM = 1 AND k = 2) WHERE k = 1", [(1, 20), (2, 0)]),
        ("UPDATE Acc SET x = 7 WHERE k IN (SELECT k FROM Src WHERE v > 15)", [(1, 0), (2, 7)]),
        ("TRUNCATE TABLE PRO.Acc", []),
        ("DELETE FROM Acc WHERE EXISTS (SELECT 1 FROM Src WHERE Src.k = Acc.k AND Src.v = 10)", [(2, 0)]),
    ],
)
def test_writes(spark, tables, sql, want):
    assert x_of(spark, tables, sql) == want


def test_blocks_and_loops(spark, tables):
    nested = """CREATE PROCEDURE p AS n NUMBER; BEGIN UPDATE Acc SET x = 1;
    BEGIN SELECT v INTO n FROM Src WHERE k = 9; EXCEPTION WHEN NO_DATA_FOUND THEN n := 3; END;
    BEGIN SELECT v INTO n FROM Src; EXCEPTION WHEN NO_DATA_FOUND THEN n := 0; WHEN TOO_MANY_ROWS THEN n := n + 1; END;
    UPDATE Acc SET x = x + n; END;"""
    assert x_of(spark, tables, nested) == [(1, 5), (2, 5)]
    failing = "CREATE PROCEDURE p AS BEGIN UPDATE Acc SET x = 4; UPDATE Acc SET x = 1 / (k - k); EXCEPTION WHEN OTHERS THEN UPDATE Acc SET f = 'E'; END;"
    got = procedure.run(spark, failing, tables)["acc"]
    assert rows_of(got, "k") == [(1, 4, "E"), (2, 4, "E")]
    with pytest.raises(ProcedureError, match="NO_DATA_FOUND"):
        procedure.run(spark, "DECLARE n NUMBER; BEGIN SELECT v INTO n FROM Src WHERE k = 9; END;", tables)
    assert x_of(spark, tables, "DECLARE i NUMBER := 0; BEGIN WHILE i < 2 LOOP i := i + 1; CONTINUE WHEN i = 1; UPDATE Acc SET x = x + i; END LOOP; FOR j IN REVERSE 1..2 LOOP UPDATE Acc SET x = x * 2 + j; END LOOP; END;") == [(1, 13), (2, 13)]
    tsql = "DECLARE @i INT = 0\nWHILE @i < 3\nBEGIN\nSET @i = @i + 1\nIF @i = 2\nBEGIN\nUPDATE Acc SET x = 20\nEND\nELSE\nUPDATE Acc SET x = x + 1\nEND"
    assert x_of(spark, tables, tsql, dialect="sqlserver") == [(1, 21), (2, 21)]


@pytest.mark.parametrize(
    "sql",
    [
        "EXECUTE IMMEDIATE 'DELETE FROM Acc'",
        "FOR r IN (SELECT k FROM Src) LOOP UPDATE Acc SET x = 1; END LOOP",
        "CALL Nobody(1)",
        "ALTER TABLE Acc ADD y INT",
        "UPDATE Acc SET nothing = 1",
        "UPDATE Missing SET x = 1",
        "SELECT * FROM Src",
        "IF 1 = 1 THEN UPDATE Acc SET x = 1",
        "UPDATE Acc SET x = (SELECT MAX(v) FROM Src WHERE ROWNUM > 1)",
        "MERGE INTO Acc T USING Src S ON (T.k = S.k) WHEN MATCHED THEN UPDATE SET T.x = 1 DELETE WHERE T.x = 1",
    ],
)
def test_what_is_not_understood_raises(spark, tables, sql):
    with pytest.raises((ProcedureError, ValueError)):
        procedure.run(spark, sql, tables)


def test_a_source_that_matches_a_row_twice_raises(spark, tables):
    for on in ("T.k = S.k", "T.k = S.k AND T.k < S.v"):
        with pytest.raises(Exception, match="repeats a key"):
            x_of(spark, tables, f"MERGE INTO Acc T USING (SELECT * FROM Src UNION ALL SELECT * FROM Src) S ON ({on}) WHEN MATCHED THEN UPDATE SET T.x = S.v")
    assert x_of(spark, tables, "MERGE INTO Acc T USING (SELECT * FROM Src UNION ALL SELECT 9, 9 UNION ALL SELECT 9, 9) S ON (T.k = S.k) WHEN MATCHED THEN UPDATE SET T.x = S.v") == [(1, 10), (2, 20)]


def test_spoken_sql():
    assert conjuncts("(a = 1 AND b BETWEEN 1 AND 2 AND (c OR d))") == ["a = 1", "b BETWEEN 1 AND 2", "(c OR d)"]
    assert conjuncts("a = 1 OR b = 2") == ["(a = 1 OR b = 2)"]
    assert limited("SELECT a FROM t WHERE x = 'ROWNUM' AND ROWNUM <= 3") == "SELECT a FROM t WHERE x = 'ROWNUM' LIMIT 3"
    assert "LIMIT 0" in limited("SELECT a FROM t WHERE ROWNUM = 2")
    assert joined_text("a || 'x||y' || f(b)").count("concat(") == 2
    assert to_spark('SELECT "COUNT", \'"q"\' FROM PRO.Acc', ["acc"], "oracle") == "SELECT `COUNT`, '\"q\"' FROM Acc"
