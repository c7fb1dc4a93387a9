"""Registered queries that run procedure text over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import procedure
from .queries import B, DAY, query, table


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.col("o_totalprice").alias("price"), F.lit(0).cast("double").alias("top"), F.lit("").alias("note"))


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("bal"), F.lit("N").alias("flag"), F.lit(0).cast("double").alias("top"))


# --- MERGE ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND m >= 20 THEN m ELSE 0 END AS top FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS m FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def m_merge_on_residual(spark, sf):
    """ON with an equality, a constant test of the target and one of the source."""
    sql = "MERGE INTO PRO.ord T USING (SELECT l_orderkey, MAX(l_quantity) AS m FROM PRO.line GROUP BY l_orderkey) S ON (T.o_orderkey = S.l_orderkey AND (T.o_orderstatus = 'F') AND S.m >= 20) WHEN MATCHED THEN UPDATE SET T.top = S.m;"
    return procedure.run(spark, sql, {"ord": _orders(spark, sf), "line": table(spark, sf, "lineitem")})["ord"].selectExpr("o_orderkey", "coalesce(top, 0) AS top")


@query("SELECT o_orderkey, y - 1990 AS band FROM (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders) JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def m_merge_range(spark, sf):
    """ON with an equality and a range between the two sides: versions in force at a date."""
    c = table(spark, sf, "customer").select("c_custkey").crossJoin(F.broadcast(spark.range(1990, 2010).select(F.col("id").alias("y"))))
    ver = c.select(F.col("c_custkey").alias("k"), F.make_date(F.col("y").cast("int"), F.lit(1), F.lit(1)).alias("lo"), F.make_date(F.col("y").cast("int"), F.lit(12), F.lit(31)).alias("hi"), (F.col("y") - 1990).alias("band"))
    sql = "MERGE INTO ord T USING ver S ON (T.o_custkey = S.k AND T.o_orderdate >= S.lo AND T.o_orderdate <= S.hi) WHEN MATCHED THEN UPDATE SET T.band = S.band;"
    return procedure.run(spark, sql, {"ord": _orders(spark, sf).withColumn("band", F.lit(-1).cast("bigint")), "ver": ver})["ord"].select("o_orderkey", "band")


@query("SELECT c_custkey, CASE WHEN n > 15 THEN 'many' WHEN n > 5 THEN 'some' ELSE 'N' END AS flag FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def m_merge_when_and(spark, sf):
    """The first WHEN MATCHED AND that holds applies."""
    sql = "MERGE INTO cust T USING (SELECT o_custkey, COUNT(*) AS n FROM ord GROUP BY o_custkey) S ON (T.c_custkey = S.o_custkey) WHEN MATCHED AND S.n > 15 THEN UPDATE SET T.flag = 'many' WHEN MATCHED AND S.n > 5 THEN UPDATE SET T.flag = 'some';"
    return procedure.run(spark, sql, {"cust": _customers(spark, sf), "ord": table(spark, sf, "orders")}, dialect="sqlserver")["cust"].select("c_custkey", "flag")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false) OR c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal < 0")
def m_merge_delete(spark, sf):
    """WHEN MATCHED THEN DELETE beside rows to insert."""
    source = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit(0.0).alias("b")).distinct().unionByName(table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_acctbal").alias("b")))
    sql = "MERGE INTO cust T USING src S ON (T.c_custkey = S.k) WHEN MATCHED AND T.bal < 0 THEN DELETE WHEN NOT MATCHED AND S.b < 0 THEN INSERT (c_custkey, bal) VALUES (S.k, S.b);"
    return procedure.run(spark, sql, {"cust": _customers(spark, sf), "src": source}, dialect="sqlserver")["cust"].select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN o_orderstatus = 'F' THEN greatest(l_quantity, l_extendedprice / 1000) ELSE 0 END AS top FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def m_merge_rowid(spark, sf):
    """A MERGE on ROWID, over rows that no column tells apart."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(0.0).alias("top"))
    sql = """MERGE INTO PRO.line A USING (SELECT A.ROWID AS RID, CASE WHEN A.l_quantity >= A.l_extendedprice / 1000 THEN A.l_quantity ELSE A.l_extendedprice / 1000 END AS m
    FROM PRO.line A INNER JOIN PRO.ord C ON C.o_orderkey = A.l_orderkey WHERE NVL(C.o_orderstatus, 'N') = 'F') SRC ON (A.ROWID = SRC.RID) WHEN MATCHED THEN UPDATE SET A.top = SRC.m;"""
    return procedure.run(spark, sql, {"line": line, "ord": _orders(spark, sf)})["line"]


@query("SELECT c_custkey, CASE WHEN (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') THEN coalesce(m, 0) ELSE 0 END AS top FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS m FROM orders JOIN nation ON n_nationkey <= 20 AND n_nationkey = o_custkey % 25 AND n_name <> 'x' GROUP BY ALL) ON o_custkey = c_custkey")
def w_join_parameter_range(spark, sf):
    """A join whose ON holds a parameter's range, an equality and a constant; an OR in the ON of the MERGE."""
    sql = """CREATE PROCEDURE p(p_KEY NUMBER) AS BEGIN
    MERGE INTO cust C USING (SELECT A.o_custkey, MIN(A.price) AS m FROM ord A INNER JOIN nat D ON D.n_nationkey <= p_KEY AND D.n_nationkey = A.o_custkey % 25 AND D.n_name <> 'x' GROUP BY A.o_custkey) SRC
    ON (C.c_custkey = SRC.o_custkey AND (C.bal > 5000 OR C.c_mktsegment = 'BUILDING')) WHEN MATCHED THEN UPDATE SET C.top = NVL(SRC.m, C.top); END;"""
    return procedure.run(spark, sql, {"cust": _customers(spark, sf), "ord": _orders(spark, sf), "nat": table(spark, sf, "nation")}, {"p_KEY": 20})["cust"].select("c_custkey", "top")


# --- variables, blocks, loops, calls --------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN (SELECT max(n_regionkey) FROM nation WHERE n_nationkey = 3)::DOUBLE ELSE (SELECT max(o_orderkey) FROM orders WHERE o_orderkey = 7)::DOUBLE END AS top FROM customer")
def w_select_into_rownum(spark, sf):
    """SELECT INTO with ROWNUM, also inside a subquery that isn't the outermost; no row of the target is lost."""
    sql = """CREATE PROCEDURE p AS v_K NUMBER; BEGIN
    BEGIN SELECT o_orderkey INTO v_K FROM ord WHERE o_orderkey = 7 AND ROWNUM = 1; EXCEPTION WHEN NO_DATA_FOUND THEN v_K := NULL; END;
    UPDATE cust SET top = v_K;
    UPDATE cust SET top = (SELECT MAX(n_regionkey) FROM nat WHERE n_nationkey = 3 AND ROWNUM <= 1) WHERE c_nationkey = 3; END;"""
    return procedure.run(spark, sql, {"cust": _customers(spark, sf), "ord": _orders(spark, sf), "nat": table(spark, sf, "nation")})["cust"].select("c_custkey", "top")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'none' END AS flag, c_acctbal + 1 AS bal FROM customer")
def w_exception_block(spark, sf):
    """An inner handler ends its own block only; what failed has no effect, what came before it stays."""
    sql = """CREATE PROCEDURE p AS v_K VARCHAR2(9); v_error VARCHAR2(4000); BEGIN
    BEGIN SELECT n_name INTO v_K FROM nat WHERE n_nationkey = -1; UPDATE cust SET flag = 'lost'; EXCEPTION WHEN NO_DATA_FOUND THEN v_K := 'none'; END;
    UPDATE cust SET flag = v_K;
    BEGIN UPDATE cust SET flag = 'neg' WHERE bal < 0; SELECT n_name INTO v_K FROM nat; UPDATE cust SET flag = 'lost'; EXCEPTION WHEN NO_DATA_FOUND THEN UPDATE cust SET bal = 0; WHEN TOO_MANY_ROWS THEN UPDATE cust SET bal = bal + 1; WHEN OTHERS THEN UPDATE cust SET flag = 'other'; END;
    EXCEPTION WHEN OTHERS THEN v_error := SQLERRM; UPDATE cust SET flag = v_error; END;"""
    return procedure.run(spark, sql, {"cust": _customers(spark, sf), "nat": table(spark, sf, "nation")})["cust"].select("c_custkey", "flag", "bal")


@query("SELECT s_suppkey, s_acctbal * 8 + 6 AS bal, 6 AS steps FROM supplier")
def w_loop(spark, sf):
    """FOR, WHILE and LOOP with EXIT."""
    sql = """CREATE PROCEDURE p AS v_I NUMBER := 0; BEGIN
    FOR i IN 1..3 LOOP UPDATE sup SET bal = bal * 2; END LOOP;
    WHILE v_I < 3 LOOP v_I := v_I + 1; UPDATE sup SET bal = bal + v_I - 1, steps = v_I; END LOOP;
    LOOP v_I := v_I + 1; EXIT WHEN v_I > 6; UPDATE sup SET bal = bal + 1, steps = v_I; END LOOP; END;"""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"), F.lit(0).alias("steps"))
    return procedure.run(spark, sql, {"sup": rows})["sup"]


@query("SELECT o_orderkey, CASE WHEN d > 90 THEN 'NPA' WHEN d > 30 THEN 'SMA' ELSE 'STANDARD' END AS note FROM (SELECT o_orderkey, (o_orderkey % 120) AS d FROM orders)")
def w_function_band(spark, sf):
    """A FUNCTION of IF, ELSIF and ELSE, called in an UPDATE."""
    sql = """CREATE OR REPLACE FUNCTION PRO.Band(p_dpd IN NUMBER) RETURN VARCHAR2 AS v_band VARCHAR2(20); BEGIN
    IF p_dpd > 90 THEN v_band := 'NPA'; ELSIF p_dpd > 30 THEN v_band := 'SMA'; ELSE v_band := 'STANDARD'; END IF; RETURN v_band; END PRO.Band;
    /
    CREATE OR REPLACE PROCEDURE PRO.Mark AS BEGIN UPDATE ord A SET A.note = PRO.Band(A.o_orderkey % 120); END PRO.Mark;
    /"""
    return procedure.run(spark, sql, {"ord": _orders(spark, sf)})["ord"].select("o_orderkey", "note")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'low' ELSE 'Y' END AS flag FROM customer WHERE c_nationkey <> 24")
def w_call(spark, sf):
    """A procedure that calls another with arguments; only the outer one is an entry."""
    sql = """CREATE PROCEDURE Mark(p_FROM NUMBER, p_TO NUMBER, p_FLAG VARCHAR2) AS BEGIN UPDATE cust SET flag = p_FLAG WHERE c_nationkey >= p_FROM AND c_nationkey < p_TO; END;
    CREATE PROCEDURE Main AS BEGIN CALL Mark(0, 99, 'Y'); Mark(0, 2 + 3, 'low'); DELETE FROM cust WHERE c_nationkey IN (SELECT MAX(n_nationkey) FROM nat); COMMIT; END;"""
    return procedure.run(spark, sql, {"cust": _customers(spark, sf), "nat": table(spark, sf, "nation")})["cust"].select("c_custkey", "flag")


@query("SELECT o_orderkey, nullif(concat_ws('', CASE WHEN o_orderstatus = 'F' THEN 'F,' END, o_orderpriority), '') AS note, CASE WHEN o_orderstatus = 'F' THEN least(o_totalprice, 9e4) END AS price FROM orders")
def w_concat_least(spark, sf):
    """|| with NULL as the empty text, and LEAST with NULL as NULL."""
    sql = "UPDATE ord SET note = CASE WHEN o_orderstatus = 'F' THEN o_orderstatus || ',' END || pri, price = LEAST(price, CASE WHEN o_orderstatus = 'F' THEN 90000 END);"
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("pri"), F.col("o_totalprice").alias("price"), F.lit("").alias("note"))
    return procedure.run(spark, sql, {"ord": rows})["ord"].select("o_orderkey", "note", "price")


@query("SELECT o_orderkey, CASE WHEN first THEN 'first' ELSE '' END AS note FROM (SELECT o_orderkey, o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) AS first FROM orders)")
def w_self_join(spark, sf):
    """UPDATE ... FROM a join of a temporary table with the target itself, in T-SQL."""
    sql = """SELECT o_custkey, MIN(o_orderdate) AS d INTO #first FROM ord GROUP BY o_custkey
    UPDATE a SET a.note = 'first' FROM ord a JOIN ord b ON a.o_orderkey = b.o_orderkey JOIN #first f ON f.o_custkey = b.o_custkey WHERE f.d = a.o_orderdate
    DROP TABLE #first"""
    return procedure.run(spark, sql, {"ord": _orders(spark, sf)}, dialect="sqlserver")["ord"].select("o_orderkey", "note")


@query("SELECT r_regionkey, n, top FROM region JOIN (SELECT n_regionkey, count(*) AS n, max(bal) AS top FROM nation JOIN (SELECT c_nationkey, sum(c_acctbal::DECIMAL(18,2)) AS bal FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey GROUP BY ALL) ON n_regionkey = r_regionkey")
def w_insert_cte(spark, sf):
    """INSERT ... SELECT of a common table expression."""
    sql = "INSERT INTO res (r_regionkey, n, top) WITH b AS (SELECT c_nationkey, SUM(CAST(bal AS DECIMAL(18,2))) AS bal FROM cust GROUP BY c_nationkey) SELECT n_regionkey, COUNT(*), MAX(b.bal) FROM nat JOIN b ON b.c_nationkey = nat.n_nationkey GROUP BY n_regionkey;"
    res = spark.createDataFrame([], "r_regionkey int, n bigint, top decimal(28,2)")
    return procedure.run(spark, sql, {"res": res, "cust": _customers(spark, sf), "nat": table(spark, sf, "nation")})["res"]


@query(f"SELECT o_orderkey, (date_diff('day', o_orderdate::DATE, {B}) + 1)::INT AS days, CASE WHEN o_orderdate::DATE < DATE '1996-06-01' THEN NULL ELSE o_orderdate::DATE END AS since FROM orders")
def w_dates(spark, sf):
    """SYSDATE, days between dates, and a date of a format of its own."""
    sql = "UPDATE ord SET days = DATEDIFF(SYSDATE, since) + 1; UPDATE ord SET since = NULL WHERE since < TO_DATE('06/01/1996', 'MM/DD/YYYY');"
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit(0).alias("days"), F.col("o_orderdate").cast("date").alias("since"))
    return procedure.run(spark, sql, {"ord": rows}, business_date=DAY)["ord"]


# --- the same propagation as DataFrames and as procedures -----------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END) OVER (PARTITION BY o_custkey) END AS since FROM orders")
def w_group_propagation(spark, sf):
    """A minimum to the group's table and back to its members, as two merges."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("d"), F.lit(None).cast("date").alias("since"))
    groups = table(spark, sf, "orders").select("o_custkey").distinct().withColumn("low", F.lit(None).cast("date"))
    sql = """CREATE PROCEDURE p AS BEGIN MERGE INTO grp G USING (SELECT o_custkey, MIN(CASE WHEN o_orderstatus = 'F' THEN d END) AS low FROM ord GROUP BY o_custkey) S ON (G.o_custkey = S.o_custkey) WHEN MATCHED THEN UPDATE SET G.low = S.low;
    MERGE INTO ord A USING (SELECT o_custkey, low FROM grp WHERE low IS NOT NULL) S ON (A.o_custkey = S.o_custkey AND A.o_orderstatus = 'F') WHEN MATCHED THEN UPDATE SET A.since = S.low; END;"""
    return procedure.run(spark, sql, {"ord": rows, "grp": groups})["ord"].select("o_orderkey", "since")


@query("SELECT l_orderkey, max(v) AS top FROM (SELECT l_orderkey, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_discount * 500 FROM lineitem UNION ALL SELECT l_orderkey, l_tax * 500 FROM lineitem) GROUP BY l_orderkey")
def w_union_max(spark, sf):
    """UNION ALL of columns as rows, grouped, as the source of a MERGE."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    sql = """MERGE INTO ord T USING (SELECT k, MAX(v) AS v FROM (SELECT l_orderkey AS k, l_quantity AS v FROM line UNION ALL SELECT l_orderkey, l_discount * 500 FROM line UNION ALL SELECT l_orderkey, l_tax * 500 FROM line) X GROUP BY k) S ON (T.l_orderkey = S.k)
    WHEN MATCHED THEN UPDATE SET T.top = S.v;"""
    return procedure.run(spark, sql, {"ord": line.select("l_orderkey").distinct().withColumn("top", F.lit(0.0)), "line": line})["ord"]


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS reasons, max(CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE CASE n_regionkey WHEN 1 THEN 'one' ELSE 'odd' END END) AS kind FROM nation GROUP BY ALL")
def w_listagg_case(spark, sf):
    """LISTAGG, and CASE in its searched, simple and nested forms."""
    sql = "INSERT INTO res SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name), MAX(CASE WHEN MOD(n_nationkey, 2) = 0 THEN 'even' ELSE CASE n_regionkey WHEN 1 THEN 'one' ELSE 'odd' END END) FROM nat GROUP BY n_regionkey;"
    return procedure.run(spark, sql, {"res": spark.createDataFrame([], "n_regionkey int, reasons string, kind string"), "nat": table(spark, sf, "nation")})["res"]
