"""Registered queries over the driver's tables, each with an SQL twin where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions.compile import formula
from .functions.prune import prune
from .operators import dictionary, guards, jobs, lineage, periods, retrieval, steps
from .plans import procedure, statements
from .sources import dictionary_csv

DAY = dt.date(2001, 12, 31)
B = "DATE '2001-12-31'"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_formulas(df: DataFrame, keys: list[str], formulas: dict[str, str], **bound) -> DataFrame:
    return df.select(*keys, *(formula(df, text, business_date=DAY, **bound).alias(name) for name, text in formulas.items()))


# --- formulas -------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate IS NOT NULL THEN date_diff('day', o_orderdate::DATE, {B}) + 1 ELSE 0 END AS dpd FROM orders")
def f_if_datediff(spark, sf):
    return with_formulas(table(spark, sf, "orders"), ["o_orderkey"], {"dpd": 'IF(ISNOTEMPTY("orders"."o_orderdate"))THEN(DATEDIFF("orders"."var"."BUSINESS_DATE","orders"."o_orderdate","d")+1)ELSE(0)'})


@query(
    f"SELECT o_orderkey, CASE WHEN d BETWEEN 0 AND 365 THEN 'SMA0' WHEN d BETWEEN 366 AND 1000 THEN 'SMA1' WHEN d > 2000 THEN 'LOSS' ELSE 'STANDARD' END AS band FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, {B}) AS d FROM orders)"
)
def f_elseif_band(spark, sf):
    days = 'DATEDIFF("o"."var"."BUSINESS_DATE","o"."o_orderdate","d")'
    return with_formulas(table(spark, sf, "orders"), ["o_orderkey"], {"band": f'IF({days} BETWEEN [0,365])THEN("SMA0")ELSEIF({days} BETWEEN [366,1000])THEN("SMA1")ELSEIF({days}>2000)THEN("LOSS")ELSE("STANDARD")'})


@query("SELECT l_returnflag, l_linestatus, sum(CASE WHEN (l_returnflag = 'R' AND l_quantity > 10) OR NOT (l_linestatus = 'O') THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) AS n FROM lineitem GROUP BY ALL")
def f_bool_calls(spark, sf):
    df = table(spark, sf, "lineitem")
    hit = formula(df, 'IF(OR(AND("l"."l_returnflag"=="R","l"."l_quantity">10),NOT("l"."l_linestatus"=="O")))THEN(1)ELSE(0)')
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))


@query(
    "SELECT p_partkey, p_size IN (1, 5, 10) AS a, p_brand NOT IN ('Brand#11', 'Brand#12') AS b, contains(p_type, 'STEEL') OR contains(p_type, 'e') AS c, starts_with(p_name, 'a') OR starts_with(p_name, 'p') AS d, ends_with(p_name, 'e') OR ends_with(p_name, '1') AS e, NOT (contains(p_name, '1')) AS f FROM part"
)
def f_membership(spark, sf):
    return with_formulas(
        table(spark, sf, "part"), ["p_partkey"],
        {"a": '"p"."p_size" IN [1,5,10]', "b": '"p"."p_brand" NOTIN ["Brand#11","Brand#12"]', "c": '"p"."p_type" CONTAINS ["STEEL","e"]', "d": '"p"."p_name" BEGINSWITH ["a","p"]', "e": '"p"."p_name" ENDSWITH ["e","1"]', "f": '"p"."p_name" DOESNOTCONTAINS ["1"]'},
    )


@query("SELECT d.doc_id, l.toxic IS NULL AS unlabelled, l.toxic IS NOT NULL AS labelled, coalesce(l.toxic, -1)::INT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def f_coalesce_empty(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return with_formulas(df, ["doc_id"], {"unlabelled": 'ISEMPTY("d"."toxic")', "labelled": 'ISNOTEMPTY("d"."toxic")'}).join(df.select("doc_id", formula(df, 'COALESCE("d"."toxic",-1)').cast("int").alias("toxic")), "doc_id")


@query(
    "SELECT c_custkey, substring(c_name, 1, 4) AS a, lower(c_mktsegment) AS b, upper(c_name) AS c, length(c_mktsegment) AS d, c_name || '-' || c_mktsegment AS e, trim('  ' || c_name || ' ') AS f, replace(c_name, 'Customer', 'C') AS g FROM customer"
)
def f_text_funcs(spark, sf):
    return with_formulas(
        table(spark, sf, "customer"), ["c_custkey"],
        {"a": 'SUBSTR("c"."c_name",1,4)', "b": 'LOWER("c"."c_mktsegment")', "c": 'UPPER("c"."c_name")', "d": 'LEN("c"."c_mktsegment")', "e": 'CONCAT("c"."c_name","-","c"."c_mktsegment")', "f": 'TRIM(CONCAT("  ","c"."c_name"," "))', "g": 'REPLACE("c"."c_name","Customer","C")'},
    )


@query("SELECT event_id, regexp_matches(event_type, '^(p|s)') AS a, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS b, try_cast(event_type AS BIGINT) AS c FROM events")
def f_regex_convert(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return with_formulas(df, ["event_id"], {"a": 'REGEX("e"."event_type","^(p|s)")', "b": 'CONVERT("e"."k","INT")', "c": 'CONVERT("e"."event_type","INT")'})


@query(
    """SELECT o_orderkey, date_trunc('month', d)::DATE AS som, last_day(d) AS eom, date_trunc('year', d)::DATE AS soy, make_date(year(d), 12, 31) AS eoy, date_trunc('quarter', d)::DATE AS soq,
    last_day((date_trunc('quarter', d) + INTERVAL 2 MONTH)::DATE) AS eoq, make_date(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END, 4, 1) AS sofy, make_date(year(d) + CASE WHEN month(d) < 4 THEN 0 ELSE 1 END, 3, 31) AS eofy
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"""
)
def f_period_bounds(spark, sf):
    return with_formulas(table(spark, sf, "orders"), ["o_orderkey"], {n.lower(): f'{n}("o"."o_orderdate")' for n in ("SOM", "EOM", "SOY", "EOY", "SOQ", "EOQ", "SOFY", "EOFY")})


@query(
    f"""SELECT o_orderkey, date_part('quarter', d)::INT AS q, date_part('week', d)::INT AS w, (d + 10) AS plus, (d - 3) AS minus, (d + INTERVAL 2 MONTH)::DATE AS shifted, date_sub('month', d, {B}) AS months
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"""
)
def f_datepart_addday(spark, sf):
    return with_formulas(
        table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")), ["o_orderkey"],
        {"q": 'DATEPART("o"."o_orderdate","QUARTER")', "w": 'DATEPART("o"."o_orderdate","WEEK")', "plus": 'ADDDAY("o"."o_orderdate","10")', "minus": 'ADDDAY("o"."o_orderdate",-3)', "shifted": 'PERIOD("MONTH",2,"o"."o_orderdate")', "months": 'DATEDIFF("o"."var"."BUSINESS_DATE","o"."o_orderdate","M")'},
    )


@query(
    """SELECT l_returnflag, count(*) AS n, sum(round(q * 3, 2)) AS a, sum(abs(q - 25)) AS b, sum((floor(q / 7) * 7)::DECIMAL(18,2)) AS c, sum((ceil(q / 7) * 7)::DECIMAL(18,2)) AS d, sum(CASE WHEN q = 25 THEN 0 ELSE 1 END)::BIGINT AS e
    FROM (SELECT l_returnflag, l_quantity::DECIMAL(18,2) AS q FROM lineitem) GROUP BY ALL"""
)
def f_math(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    one = {"a": 'ROUND("l"."q"*3,2)', "b": 'ABS("l"."q"-25)', "c": 'FLOOR("l"."q",7)', "d": 'CEIL("l"."q",7)'}
    parts = [F.sum(formula(df, t).cast("decimal(18,2)")).cast("decimal(38,2)").alias(n) for n, t in one.items()]
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), *parts, F.count(formula(df, '1/("l"."q"-25)')).alias("e"))


@query("SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE AS b, NULL::DATE AS c FROM orders")
def f_todate(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("x"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("y"))
    return with_formulas(df, ["o_orderkey"], {"a": 'TODATE("o"."x","DD/MM/YYYY")', "b": 'DATE("o"."y")', "c": 'TODATE("o"."x","YYYY-MM-DD")'})


@query("SELECT l_partkey, max(l_quantity) AS top, min(l_quantity) AS low, count(*) AS n FROM lineitem GROUP BY l_partkey")
def f_group_max_min(spark, sf):
    df = table(spark, sf, "lineitem")
    each = with_formulas(df, ["l_partkey"], {"top": 'MAX("l"."l_quantity","l"."l_partkey")', "low": 'MIN("l"."l_quantity","l"."l_partkey")'})
    return each.groupBy("l_partkey").agg(F.max("top").alias("top"), F.min("low").alias("low"), F.count("*").alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region),
    t AS (SELECT 'ASIA' AS id UNION SELECT c FROM e JOIN t ON p = t.id)
    SELECT n_nationkey, CASE WHEN n_name IN (SELECT id FROM t) THEN 'inside' ELSE 'outside' END AS place FROM nation"""
)
def f_hierarchy_in(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    edges = edges.unionByName(r.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent")))
    return steps.derive(n, "place", 'IF("n"."n_name" HRCHYIN ["ASIA"])THEN("inside")ELSE("outside")', hierarchies={"n_name": edges}).select("n_nationkey", "place")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'debit' WHEN c_acctbal BETWEEN 0 AND 2500 THEN 'low' WHEN c_acctbal BETWEEN 2500 AND 7500 THEN 'mid' WHEN c_acctbal >= 7500 THEN 'high' END AS tier FROM customer")
def f_decision_table(spark, sf):
    buckets = [{"max": 0.0, "value": "debit"}, {"min": 0.0, "max": 2500.0, "value": "low"}, {"min": 2500.0, "max": 7500.0, "value": "mid"}, {"min": 7500.0, "value": "high"}]
    return steps.decision_table(table(spark, sf, "customer"), "c_acctbal", buckets, "tier").select("c_custkey", "tier")


# --- updates and merges ---------------------------------------------------------------------


@query("SELECT o_orderkey, 0 AS dpd, NULL::DATE AS since FROM orders")
def u_reset_all(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.lit(7).alias("dpd"), F.lit(DAY).alias("since"))
    return steps.update(df, {"dpd": F.lit(0), "since": F.lit(None).cast("date")})


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment NOT IN ('BUILDING') THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def u_guarded_fixup(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return procedure.run(spark, "UPDATE cust SET c_acctbal = 0 WHERE c_acctbal < 0 AND c_mktsegment NOT IN ('BUILDING');", {"cust": df})["cust"].drop("c_mktsegment")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'none' END AS label FROM orders")
def u_fold_last_wins(spark, sf):
    df = table(spark, sf, "orders")
    label = lambda x: {"label": F.lit(x)}
    done = steps.fold(df, [(None, label("none")), (F.col("o_orderstatus") == "F", label("done")), (F.col("o_orderpriority") == "1-URGENT", label("urgent")), (F.col("o_totalprice") > 300000, label("big"))])
    return done.select("o_orderkey", "label")


@query("SELECT o_orderkey, CASE WHEN d = DATE '1996-01-02' THEN NULL ELSE d END AS since FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def u_sentinel_null(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("since"))
    return procedure.run(spark, "UPDATE o SET since = NULL WHERE since = DATE'1996-01-02';", {"o": df})["o"]


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done FROM customer")
def u_exists_semi(spark, sf):
    return steps.exists(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'F'"), {"c_custkey": "o_custkey"}, "done")


@query("SELECT user_id, count(*) AS n, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) + 1)::BIGINT AS total FROM events GROUP BY user_id")
def u_counter(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return steps.update(df, {"k": F.coalesce("k", F.lit(0)) + 1}).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT o_orderkey, coalesce(m, 0)::INT AS dpd_max FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity)::INT AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def m_merge_agg(spark, sf):
    sql = """MERGE INTO ord T USING (SELECT l_orderkey, CAST(MAX(l_quantity) AS INT) AS m FROM line WHERE l_returnflag = 'R' GROUP BY l_orderkey) S
    ON (T.o_orderkey = S.l_orderkey) WHEN MATCHED THEN UPDATE SET T.dpd_max = S.m;"""
    return procedure.run(spark, sql, {"ord": table(spark, sf, "orders").select("o_orderkey", F.lit(0).alias("dpd_max")), "line": table(spark, sf, "lineitem")})["ord"]


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT p_partkey, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def m_merge_insert(spark, sf):
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    source = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("bal"))
    return steps.merge(target, source, ["id"], {}, {"id": "id", "bal": "bal"})


@query("SELECT event_id FROM events WHERE NOT coalesce(event_type = 'click' AND value > 10, false)")
def m_delete(spark, sf):
    return steps.delete(table(spark, sf, "events"), (F.col("event_type") == "click") & (F.col("value") > 10)).select("event_id")


# --- propagation ----------------------------------------------------------------------------

MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


@query("SELECT l_orderkey, max(v) AS top FROM (SELECT l_orderkey, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem UNION ALL SELECT l_orderkey, l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_tax FROM lineitem) GROUP BY l_orderkey")
def p_max_stream(spark, sf):
    """The union of measures as rows, in one scan: unpivoted, then reduced."""
    df = table(spark, sf, "lineitem").select("l_orderkey", *MEASURES.values())
    return df.unpivot("l_orderkey", list(MEASURES.values()), "measure", "v").groupBy("l_orderkey").agg(F.max("v").alias("top"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= greatest(l_extendedprice / 1000, l_discount * 500, l_tax * 500) THEN 'quantity' WHEN l_extendedprice / 1000 >= greatest(l_discount * 500, l_tax * 500) THEN 'price' WHEN l_discount * 500 >= l_tax * 500 THEN 'discount' ELSE 'tax' END AS label FROM lineitem) GROUP BY label")
def p_argmax_label(spark, sf):
    df = table(spark, sf, "lineitem")
    label = steps.arg_max({"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice") / 1000, "discount": F.col("l_discount") * 500, "tax": F.col("l_tax") * 500})
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END) OVER (PARTITION BY o_custkey) END AS since FROM orders")
def p_min_propagation(spark, sf):
    df = table(spark, sf, "orders")
    done = F.col("o_orderstatus") == "F"
    return df.select("o_orderkey", F.when(done, F.min(F.when(done, F.col("o_orderdate").cast("date"))).over(Window.partitionBy("o_custkey"))).alias("since"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS reasons FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def p_listagg_reason(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("reasons"))


@query(
    """WITH p AS (SELECT y AS version, make_date(y::INT, 4, 1) AS low, make_date(y::INT + 1, 3, 31) AS high FROM range(1994, 2000) t(y))
    SELECT o_orderkey, version FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) LEFT JOIN p ON d BETWEEN low AND high"""
)
def p_effective_range_join(spark, sf):
    ranges = spark.range(1994, 2000).select(F.col("id").alias("version"), F.make_date(F.col("id").cast("int"), F.lit(4), F.lit(1)).alias("low"), F.make_date((F.col("id") + 1).cast("int"), F.lit(3), F.lit(31)).alias("high"))
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return steps.range_join(df, ranges, "d", "low", "high", 90).select("o_orderkey", "version")


PIPELINE_SQL = f"""WITH a AS (SELECT l_orderkey AS k, max(v) AS m FROM (
  SELECT l_orderkey, date_diff('day', l_shipdate::DATE, {B})::INT AS v FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, l_quantity::INT FROM lineitem WHERE l_quantity::INT > 0) GROUP BY l_orderkey),
b AS (SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, 'N') AS s, (date_diff('day', o_orderdate::DATE, {B}) + 1)::INT AS dpd_since, coalesce(m, 0)::INT AS dpd_max FROM orders LEFT JOIN a ON k = o_orderkey),
c AS (SELECT *, CASE WHEN dpd_max > 90 AND s = 'F' THEN {B} - dpd_max END AS d FROM b)
SELECT o_orderkey, dpd_since, dpd_max, CASE WHEN d IS NOT NULL THEN min(d) OVER (PARTITION BY o_custkey) END AS npa_dt FROM c"""


@query(PIPELINE_SQL)
def p_pipeline_end_to_end(spark, sf):
    """Days past due, their maximum over two streams, the status date, and its minimum for each customer."""
    orders, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    acc = orders.select("o_orderkey", "o_custkey", "o_orderstatus", formula(orders, 'DATEDIFF("o"."var"."BUSINESS_DATE","o"."o_orderdate","d")+1', business_date=DAY).cast("int").alias("dpd_since"))
    late = F.greatest(F.max(F.when(F.col("l_returnflag") == "R", F.datediff(F.lit(DAY), F.col("l_shipdate").cast("date")))), F.max(F.when(F.col("l_quantity").cast("int") > 0, F.col("l_quantity").cast("int"))))
    top = line.groupBy("l_orderkey").agg(late.alias("m"))
    acc = acc.join(top, acc["o_orderkey"] == top["l_orderkey"], "left").withColumn("dpd_max", F.coalesce("m", F.lit(0)))
    acc = steps.update(acc.withColumn("npa_dt", F.lit(None).cast("date")), {"npa_dt": F.date_sub(F.lit(DAY), F.col("dpd_max"))}, formula(acc, 'AND("a"."dpd_max">90,COALESCE("a"."o_orderstatus","N")=="F")'))
    low = F.min("npa_dt").over(Window.partitionBy("o_custkey"))
    return acc.select("o_orderkey", "dpd_since", "dpd_max", F.when(F.col("npa_dt").isNotNull(), low).alias("npa_dt"))


# --- versions, lineage, structure -----------------------------------------------------------

@query("SELECT k AS value, CASE WHEN o_orderdate IS NOT NULL THEN o_orderdate::DATE ELSE DATE '2000-01-01' + k::INT END AS effective_date, o_orderdate IS NOT NULL AS is_real FROM range(0, 3000, 7) t(k) LEFT JOIN orders ON o_orderkey = k")
def t_timekey_to_date(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderkey").alias("time_key"), F.col("o_orderdate").cast("date").alias("date"))
    return periods.dated(spark.range(0, 3000, 7).withColumnRenamed("id", "value"), days)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'mid' ELSE 'open' END AS pruned, CASE WHEN o_orderstatus = 'F' THEN 'mid' ELSE 'open' END AS bound FROM orders")
def t_prune_equivalence(spark, sf):
    df = table(spark, sf, "orders")
    text = 'IF("o"."o_orderstatus"=="F")THEN(IF(p_TIMEKEY > 300)THEN("late")ELSEIF(p_TIMEKEY > 200)THEN("mid")ELSE("early"))ELSE("open")'
    return df.select("o_orderkey", formula(df, prune(text, "p_TIMEKEY", 250)).alias("pruned"), formula(df, text, {"p_TIMEKEY": 250}).alias("bound"))


#: Objects of five stages in each region, the last region a cycle, the first ones with one output, and a call between regions.
NODE_SQL = """WITH RECURSIVE n AS (SELECT 'o' || n_nationkey AS object_id, n_nationkey AS pos, n_name AS name, ['S' || (n_nationkey % 5) || '_' || (n_nationkey // 5)] AS r,
    ['s' || (n_nationkey % 5) || '_' || CASE WHEN n_nationkey % 5 = 4 THEN (n_nationkey // 5 + 1) % 5 ELSE n_nationkey // 5 + 1 END, CASE WHEN n_nationkey IN (20, 21) THEN 'OUT' ELSE 'own' || n_nationkey END] AS w,
    CASE WHEN n_nationkey = 2 THEN [(SELECT n_name FROM nation WHERE n_nationkey = 13)] ELSE []::VARCHAR[] END AS called FROM nation), w AS (SELECT object_id, pos, lower(unnest(w)) AS t FROM n), r AS (SELECT object_id, lower(unnest(r)) AS t FROM n)"""
EDGE_SQL = (
    NODE_SQL
    + """, s AS (SELECT w.object_id AS src, r.object_id AS dst, 1 AS p FROM w JOIN r USING (t) WHERE w.object_id <> r.object_id UNION ALL SELECT a.object_id, b.object_id, 2 FROM (SELECT object_id, unnest(called) AS c FROM n) a JOIN n b ON lower(c) = lower(b.name) WHERE a.object_id <> b.object_id),
    g AS (SELECT src, dst, max(p) AS p FROM s GROUP BY ALL),
    e AS (SELECT src, dst, CASE p WHEN 2 THEN 'explicit_call' ELSE 'read_after_write' END AS reason FROM g UNION ALL SELECT DISTINCT a.object_id, b.object_id, 'shared_write_target_weak' FROM w a JOIN w b USING (t) WHERE a.pos < b.pos AND NOT EXISTS (SELECT 1 FROM g WHERE (src, dst) IN ((a.object_id, b.object_id), (b.object_id, a.object_id))))"""
)


def _nodes(spark, sf):
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    step = F.floor(k / 5)
    after = F.when(k % 5 == 4, (step + 1) % 5).otherwise(step + 1)
    callee = n.where("n_nationkey = 13").select("n_name").first().n_name
    none = F.array().cast("array<string>")
    return n.select(
        F.concat(F.lit("o"), k).alias("object_id"), k.alias("pos"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("S"), k % 5, F.lit("_"), step)).alias("tables_read"),
        F.array(F.concat(F.lit("s"), k % 5, F.lit("_"), after), F.when(k.isin(20, 21), "OUT").otherwise(F.concat(F.lit("own"), k))).alias("tables_written"), F.when(k == 2, F.array(F.lit(callee))).otherwise(none).alias("called"), F.lit(0.9).alias("confidence"),
    )


@query(EDGE_SQL + " SELECT * FROM e")
def l_edges(spark, sf):
    return lineage.edges(_nodes(spark, sf))


@query(
    EDGE_SQL
    + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c AS (SELECT object_id AS id, object_id AS x FROM n UNION SELECT c.id, u.b FROM c JOIN u ON c.x = u.a), k AS (SELECT id, min(x) AS chain FROM c GROUP BY id),
    l AS (SELECT object_id AS id, 0 AS d FROM n UNION SELECT e.dst, d + 1 FROM l JOIN e ON e.src = l.id WHERE d < 10), t AS (SELECT id, max(d) AS d FROM l GROUP BY id), y AS (SELECT chain, max(d) >= 10 AS cycle FROM t JOIN k USING (id) GROUP BY chain)
    SELECT chain, id AS object_id, CASE WHEN NOT cycle THEN d END AS level, CASE WHEN cycle THEN 'low' ELSE 'high' END AS confidence FROM t JOIN k USING (id) JOIN y USING (chain)"""
)
def l_components_order(spark, sf):
    nodes = _nodes(spark, sf)
    return lineage.orders(nodes, lineage.edges(nodes)).drop("pos")


def _marks(c: str, marks: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches({c}, '(?i){m.replace(chr(39), chr(39) * 2)}')::INT" for m in marks)


@query(
    f"WITH s AS (SELECT doc_id, {_marks('text', statements.ORACLE)} AS o, {_marks('text', statements.MYSQL)} AS m, {_marks('text', statements.SQLSERVER)} AS s FROM documents) SELECT CASE WHEN s > o AND s >= m THEN 'sqlserver' WHEN m > o THEN 'mysql' ELSE 'oracle' END AS dialect, count(*) AS n FROM s GROUP BY ALL"
)
def s_dialect_score(spark, sf):
    return table(spark, sf, "documents").groupBy(statements.dialect_of("text").alias("dialect")).agg(F.count("*").alias("n"))


#: Writes of each role, as parts of Spark's concat().
ROLE_TEXTS = (
    "'EXCEPTION WHEN OTHERS THEN UPDATE ', c_mktsegment, ' SET x = 0'",
    "'MERGE INTO a USING (SELECT CASE WHEN k > ', c_custkey, ' THEN 2 END AS v FROM t) s ON (a.k = s.k) WHEN MATCHED THEN UPDATE SET x = s.v'",
    "'MERGE INTO a USING (SELECT k, max(v) AS v FROM ', c_mktsegment, ' GROUP BY k) s ON (a.k = s.k) WHEN MATCHED THEN UPDATE SET x = CASE WHEN 1 = 1 THEN s.v END'",
    "'MERGE INTO a USING ', c_mktsegment, ' s ON (a.k = s.k) WHEN MATCHED THEN UPDATE SET x = 1'",
    "'UPDATE a SET x = 0 WHERE k = ', c_custkey",
    "'UPDATE ', c_mktsegment, ' SET x = NULL'",
    "'UPDATE a SET x = y WHERE z = 0 AND k > ', c_custkey",
    "'UPDATE a SET x = y + ', c_custkey",
    "'SELECT CASE WHEN a THEN ', c_custkey, ' END INTO #t FROM b'",
    "'SELECT sum(x), COUNT(*) FROM ', c_mktsegment, ' GROUP BY k'",
    "'UPDATE a SET x = \\'CASE WHERE\\' WHERE k = ', c_custkey",
)


@query(
    """SELECT c_custkey, ['EXCEPTION_HANDLER', 'MERGE_USING_CASE_VALUE', 'MERGE_USING', 'MERGE', 'INITIAL_RESET', 'NULL_RESET', 'SEQUENTIAL_FIXUP', 'UPDATE', 'CASE_VALUE_SELECTION', 'SEQUENTIAL_ASSIGNMENT', 'SEQUENTIAL_FIXUP'][(c_custkey % 11)::INT + 1] AS role, CASE c_custkey % 11 WHEN 2 THEN 'MAX' WHEN 9 THEN 'COUNT,SUM' ELSE '' END AS aggregates FROM customer"""
)
def d_roles(spark, sf):
    """The role and the grouped aggregates of a write for each customer."""
    return table(spark, sf, "customer").select("c_custkey", F.get(F.array(*(F.expr(f"concat({t})") for t in ROLE_TEXTS)), (F.col("c_custkey") % len(ROLE_TEXTS)).cast("int")).alias("s")).select("c_custkey", dictionary.role("s").alias("role"), F.array_join(dictionary.aggregates("s"), ",").alias("aggregates"))


@query(
    """WITH j AS (SELECT n_regionkey AS chain, n_nationkey AS pos, 'S' || (n_nationkey % 2) AS t, unnest(['A', 'B' || (n_nationkey % 3)]) AS c FROM nation), m AS (SELECT *, CASE WHEN t = 'S1' THEN 'ENTITY' ELSE t END AS e FROM j)
    SELECT e AS entity, c AS col, chain, object FROM (SELECT e, c, chain, 'o' || pos AS object, row_number() OVER (PARTITION BY e, c ORDER BY chain, pos) AS r FROM m) WHERE r = 1"""
)
def d_expand_jobs(spark, sf):
    n = table(spark, sf, "nation")
    chains = n.groupBy(F.col("n_regionkey").alias("chain")).agg(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("o"), k)).alias("order"))
    wrote = n.select(F.concat(F.lit("o"), "n_nationkey").alias("object_id"), F.concat(F.lit("S"), F.col("n_nationkey") % 2).alias("table"), F.array(F.lit("A"), F.concat(F.lit("B"), F.col("n_nationkey") % 3)).alias("columns"))
    names = spark.createDataFrame([("s1", "ENTITY")], "table string, entity string")
    return dictionary.expand_jobs(chains, wrote, names).select("entity", F.col("column").alias("col"), "chain", F.col("object_id").alias("object"))


@query(
    """WITH u AS (SELECT 'N' || c_nationkey AS c, 'T' || (c_nationkey % 2) AS q FROM customer UNION SELECT 'N' || 2 * s_nationkey, 'S' FROM supplier), inv AS (SELECT c, list(DISTINCT q) AS q FROM u GROUP BY ALL)
    SELECT c_custkey, CASE WHEN len(q) = 1 AND NOT list_contains(q, 'X' || (c_custkey % 3)) THEN q[1] ELSE 'X' || (c_custkey % 3) END AS qualifier FROM customer LEFT JOIN inv ON c = 'N' || c_nationkey"""
)
def d_grounded(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    named = lambda k: F.concat(F.lit("N"), k).alias("column")
    uses = c.select(F.concat(F.lit("T"), F.col("c_nationkey") % 2).alias("qualifier"), named("c_nationkey")).unionByName(s.select(F.lit("S").alias("qualifier"), named(F.col("s_nationkey") * 2)))
    refs = c.select("c_custkey", F.concat(F.lit("X"), F.col("c_custkey") % 3).alias("qualifier"), named("c_nationkey"))
    return dictionary.grounded(refs, dictionary.reference_inventory(uses)).select("c_custkey", "qualifier")


@query("SELECT arg_min(event_type || ' ', event_id) AS term, arg_max(user_id::VARCHAR, event_id) AS definition, min(event_id) AS first FROM events GROUP BY upper(trim(event_type))")
def e_glossary(spark, sf):
    e = table(spark, sf, "events").select(F.concat("event_type", F.lit(" ")).alias("term"), F.col("user_id").cast("string").alias("definition"), F.col("event_id").alias("pos"))
    return dictionary.glossary(e)


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN NULL ELSE least(s_acctbal, s_suppkey * 50.0) END AS low FROM supplier")
def w_least_guard(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") <= 5000, F.col("s_acctbal")).alias("a"), (F.col("s_suppkey") * 50.0).alias("b"))
    return df.select("s_suppkey", steps.least_known("a", "b").alias("low"))


@query("SELECT * FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'BIG' WHEN p_size > 20 THEN 'MID' ELSE 'LOW' END AS band, p_retailprice * CASE WHEN p_brand = 'Brand#13' THEN 2 ELSE 1 END AS price FROM part) WHERE NOT (band = 'LOW' AND price < 950)")
def w_procedure(spark, sf):
    """IF branches, guarded updates, a self-reading update and a delete of one procedure."""
    sql = """CREATE PROCEDURE p(p_KEY INT) AS BEGIN UPDATE part SET band = 'LOW'; IF p_KEY > 5 THEN UPDATE part SET band = 'MID' WHERE p_size > 20; UPDATE part SET band = 'BIG' WHERE p_size > 40; ELSE UPDATE part SET band = 'NONE'; END IF;
    UPDATE part SET price = price * 2 WHERE p_brand = 'Brand#13'; DELETE FROM part WHERE band = 'LOW' AND price < 950; END;"""
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", F.lit("").alias("band"), F.col("p_retailprice").alias("price"))
    return procedure.run(spark, sql, {"part": df}, {"p_KEY": 7})["part"].select("p_partkey", "band", "price")


# --- dictionary -----------------------------------------------------------------------------


def _dictionary(df: DataFrame, entity: str, column: str, expression: str, date: str, pos: str, chain: str = "''") -> DataFrame:
    return df.select(*(F.expr(e).alias(n) for e, n in (
        (entity, "entity_name"), (column, "column_name"), ("'Physical'", "column_type"), ("'Formula Expression'", "derivation_option"), (expression, "display_derivation_expression"), (date, "effective_start_date"), ("'ACTIVE'", "status"),
        ("'string'", "data_type"), ("''", "decision_table_json"), ("''", "conditional_json"), (pos, "pos"), (chain, "source_chain_id"), ("0.9D", "confidence"),
    )))


@query(
    """WITH o AS (SELECT upper(c_mktsegment) AS e, upper(c_name) AS c, DATE '2020-01-01' + (c_custkey % 3)::INT AS d, 'old' AS x FROM customer), n AS (SELECT upper(c_mktsegment) AS e, upper(c_name) AS c, DATE '2020-01-01' + (c_custkey % 2)::INT AS d, 'new' AS x FROM customer)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE (e, c, d) NOT IN (SELECT e, c, d FROM n)"""
)
def e_merge_upsert(spark, sf):
    df = table(spark, sf, "customer")
    make = lambda text, n: _dictionary(df, "c_mktsegment", "c_name", f"'{text}'", f"date_add(DATE'2020-01-01', CAST(c_custkey % {n} AS INT))", "c_custkey")
    out = dictionary.upsert(make("old", 3), make("new", 2))
    return out.select(F.upper("entity_name").alias("e"), F.upper("column_name").alias("c"), F.col("effective_start_date").alias("d"), F.col("display_derivation_expression").alias("x"))


#: An expression without blanks and case outside double quotes.
KEY_SQL = """array_to_string(list_transform(string_split(text, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN lower(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))
    WHEN regexp_matches(coalesce(string_split(text, '"')[i - 1], ''), '\\.\\s*$') OR regexp_matches(coalesce(string_split(text, '"')[i + 1], ''), '^\\s*\\.') THEN lower(x) ELSE x END), '"')"""


@query(f"SELECT min(doc_id) AS doc_id, DATE '2020-01-01' + min(doc_id % 9)::INT AS effective FROM documents GROUP BY lang, {KEY_SQL}")
def e_dedupe_signature(spark, sf):
    rows = _dictionary(table(spark, sf, "documents"), "lang", "'text'", "text", "date_add(DATE'2020-01-01', CAST(doc_id % 9 AS INT))", "doc_id")
    return dictionary.dedupe(rows).select(F.col("pos").alias("doc_id"), F.col("effective_start_date").alias("effective"))


@query(
    """WITH r AS (SELECT upper(o_orderpriority) AS e, upper(o_orderstatus) AS c, lower('x' || o_orderstatus) AS x, min(o_orderkey) AS first, string_agg(DISTINCT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d'), ', ' ORDER BY strftime(date_trunc('year', o_orderdate), '%Y-%m-%d')) AS dates FROM orders GROUP BY ALL)
    SELECT printf('BR-%03d', row_number() OVER (ORDER BY first)) AS rule_id, e, c, dates FROM r"""
)
def e_rule_ids(spark, sf):
    rows = _dictionary(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "concat('x', o_orderstatus)", "CAST(trunc(o_orderdate, 'YEAR') AS DATE)", "o_orderkey")
    return dictionary.rules(rows).select("rule_id", F.upper("entity_name").alias("e"), F.upper("column_name").alias("c"), F.col("effective_dates").alias("dates"))


@query("SELECT doc_id, CASE WHEN n > 1 THEN 'PENDING_REVIEW' ELSE 'ACTIVE' END AS status, CASE WHEN n > 1 THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang, n_chars) AS n FROM documents)")
def e_duplicate_flag(spark, sf):
    rows = _dictionary(table(spark, sf, "documents"), "lang", "CAST(n_chars AS STRING)", "'x'", "DATE'2020-01-01'", "doc_id", "source")
    return dictionary.duplicates(rows).select(F.col("pos").alias("doc_id"), "status", "confidence")


@query("SELECT c_custkey, upper(c_mktsegment) AS e, strftime(DATE '2020-02-01' + (c_custkey % 28)::INT, '%d-%m-%Y') AS d, 'number' AS t FROM customer")
def e_external_form(spark, sf):
    rows = _dictionary(table(spark, sf, "customer"), "c_mktsegment", "'balance'", "'x'", "date_add(DATE'2020-02-01', CAST(c_custkey % 28 AS INT))", "c_custkey")
    out = dictionary_csv.from_external(dictionary_csv.to_external(rows.withColumn("column_type", F.col("pos").cast("string"))))
    return out.select(F.col("column_type").cast("bigint").alias("c_custkey"), F.upper("entity_name").alias("e"), F.date_format("effective_start_date", "dd-MM-yyyy").alias("d"), dictionary.inferred_type("column_name").alias("t"))


# --- guardrails -----------------------------------------------------------------------------


@query("SELECT id, array_to_string(list_filter([CASE WHEN NOT ends_with(lower(source), '.sql') THEN 'Unsupported file type: ' || source END, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'File is empty' END, CASE WHEN contains(lower(text), 'system prompt') THEN 'Suspicious content detected: ''system prompt''' END], lambda x: x IS NOT NULL), '|') AS errors FROM (SELECT 'd' || doc_id AS id, source, text FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, CASE WHEN turn % 2 = 0 THEN 'turn.SQL' ELSE role END, text FROM conversations)")
def g_input_guardrail(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), F.when(F.col("turn") % 2 == 0, "turn.SQL").otherwise(F.col("role")).alias("source"), "text")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "source", "text").unionByName(c)
    return rows.select("id", F.array_join(guards.input_errors("source", "text"), "|").alias("errors"))


@query("WITH b AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents) SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM d WHERE w NOT IN (SELECT w FROM b) GROUP BY ALL) USING (doc_id)")
def g_invented_tokens(spark, sf):
    """The words of each document that no benchmark item holds."""
    bench = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return guards.unknown_words(table(spark, sf, "documents"), "doc_id", "text", bench)


# --- retrieval ------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations),
    p AS (SELECT id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> '') AS ps FROM t),
    f AS (SELECT id, list_reduce(list_transform(ps, lambda x: {'done': []::VARCHAR[], 'open': x}), lambda a, b: CASE WHEN length(a.open) + length(b.open) <= 800 THEN {'done': a.done, 'open': a.open || chr(10) || b.open} ELSE {'done': list_append(a.done, a.open), 'open': b.open} END) AS r FROM p WHERE len(ps) > 0),
    c AS (SELECT id, unnest(list_append(r.done, r.open)) AS chunk, generate_subscripts(list_append(r.done, r.open), 1) - 1 AS n FROM f)
    SELECT id, n::INT AS chunk_no, length(chunk)::INT AS n_chars, sha256(chunk) AS sha FROM c"""
)
def r_chunk_paragraphs(spark, sf):
    """Documents and conversation turns as chunks of lines."""
    c = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(c)
    return retrieval.chunks(rows, "id", cut=r"\n", glue="\n").select("id", "chunk_no", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("sha"))


VECTOR_SQL = """w AS (SELECT id, unnest(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) AS w FROM d), c AS (SELECT id, (('0x' || substr(sha256(w), 1, 8))::BIGINT % 256)::INT AS dim, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
v AS (SELECT id, dim, n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY id)) AS weight FROM c)"""


@query(f"WITH d AS (SELECT item_id AS id, text FROM benchmark), {VECTOR_SQL} SELECT id, dim, round(weight, 9) AS weight FROM v")
def r_hash_embed(spark, sf):
    return retrieval.sparse_vectors(table(spark, sf, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 9))


@query(
    f"""WITH d AS (SELECT 'q' || item_id AS id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents), {VECTOR_SQL},
    s AS (SELECT a.id AS query_id, b.id, round(sum(a.weight * b.weight), 6) AS score FROM v a JOIN v b USING (dim) WHERE a.id[1] = 'q' AND b.id[1] = 'd' GROUP BY ALL)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 4"""
)
def r_topk_text(spark, sf):
    """Benchmark items against all documents."""
    q = table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), "text")
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return retrieval.nearest_texts(retrieval.sparse_vectors(q, "id", "text"), retrieval.sparse_vectors(d, "id", "text"), 4)


@query(
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""
)
def r_topk_vectors(spark, sf):
    """The query set is every row whose id is divisible by 100, against all rows."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.nearest_vectors(v.where("id % 100 = 0"), v, 5)


# --- jobs -----------------------------------------------------------------------------------


def _jobs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), (F.col("event_id") % 97).alias("run_number"), F.col("ts").alias("updated_at"))


@query("SELECT coalesce(max(event_id % 97), 0) + 1 AS next_run FROM events")
def q_next_run(spark, sf):
    return jobs.next_run(_jobs(spark, sf))


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id")
def q_upsert_latest(spark, sf):
    return jobs.latest(_jobs(spark, sf), "job_id", "event_id").select("job_id", "status", "event_id")


@query("SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS pending FROM events GROUP BY user_id")
def q_status_counts(spark, sf):
    return jobs.status_counts(_jobs(spark, sf).replace({"error": "PENDING_REVIEW"}, subset=["status"]))


@query(
    """WITH d AS (SELECT event_id % 500 AS row_id, arg_max(event_type, event_id) AS a FROM events WHERE event_type IN ('view', 'error', 'purchase') GROUP BY ALL)
    SELECT c_custkey AS id, CASE WHEN a = 'error' THEN 'INACTIVE' WHEN a IS NOT NULL THEN 'ACTIVE' ELSE 'PENDING_REVIEW' END AS status, CASE WHEN a = 'purchase' THEN 'edited' ELSE c_name END AS expression FROM customer LEFT JOIN d ON row_id = c_custkey"""
)
def q_review_transition(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("PENDING_REVIEW").alias("status"), F.col("c_name").alias("expression"))
    e = table(spark, sf, "events").where("event_type IN ('view', 'error', 'purchase')")
    action = F.when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "purchase", "EDIT").otherwise("APPROVE")
    return jobs.decided(rows, e.select((F.col("event_id") % 500).alias("row_id"), F.col("event_id").alias("decision_id"), action.alias("action"), F.lit("edited").alias("edited_expression")))


@query("SELECT user_id AS job_id, event_id, row_number() OVER (ORDER BY ts, user_id, event_id) AS run_number FROM events WHERE event_type = 'signup'")
def q_jobs_backfill(spark, sf):
    rows = _jobs(spark, sf).where("status = 'signup'").withColumns({"created_at": F.struct("updated_at", "job_id", "event_id")})
    return jobs.backfilled(rows).select("job_id", "event_id", "run_number")


@query("SELECT user_id AS job_id, coalesce(event_id % 97, 0) AS run_number, event_id FROM events")
def q_jobs_sorted(spark, sf):
    return jobs.listed(_jobs(spark, sf)).select("job_id", "run_number", "event_id")


@query("SELECT c_custkey, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS bal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def q_patch(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return jobs.patched(c, s, "c_custkey")


from . import queries_procedures, queries_texts  # noqa: E402, F401  register their own
