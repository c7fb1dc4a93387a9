"""Registered queries over formulas, statements and dictionary rows that are built from the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, functions as F

from .functions import explain, lint, syntax
from .functions.arrow import each
from .functions.compile import formula
from .functions.repair import repair
from .operators import dictionary, guards, jobs, periods, retrieval
from .plans import compose, service, sites, statements
from .queries import DAY, B, _dictionary, query, table

# --- near-formulas: what a repaired text computes -------------------------------------------

#: name: (table, key, near-formula, SQL of what it means)
NEAR = {
    "n_flatten": ("customer", "c_custkey", 'IF( "c"."c_mktsegment"\n == "BUILDING"  )THEN(\t"two  blanks")ELSE(  \'a  b\' )', "CASE WHEN c_mktsegment = 'BUILDING' THEN 'two  blanks' ELSE 'a  b' END"),
    "n_ternary": ("orders", "o_orderkey", '("o"."o_totalprice" > 100000) ? "big" : "small"', "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END"),
    "n_sql_style": ("orders", "o_orderkey", "IF(\"o\".\"o_orderstatus\" = 'F' AND \"o\".\"o_orderpriority\" <> '1-URGENT')THEN('it''s')ELSE('no')", "CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 'it''s' ELSE 'no' END"),
    "n_nvl": ("labels", "doc_id", 'NVL("l"."toxic",0)+IFNULL("l"."quality",0)+ISNULL("l"."toxic",5)', "(coalesce(toxic, 0) + coalesce(quality, 0) + coalesce(toxic, 5))::INT"),
    "n_comma_if": ("part", "p_partkey", 'IF("p"."p_size" > 20, "long", IF("p"."p_size" > 10, "mid", "short"))', "CASE WHEN p_size > 20 THEN 'long' WHEN p_size > 10 THEN 'mid' ELSE 'short' END"),
    "n_placeholder": ("part", "p_partkey", 'IF("p"."p_size" > <limit>)THEN(1)ELSE(0)', "(p_size > 25)::INT"),
    "n_not_in": ("orders", "o_orderkey", '"o"."o_orderstatus" NOT IN ["F","P"]', "o_orderstatus NOT IN ('F', 'P')"),
    "n_else_if": ("part", "p_partkey", 'IF("p"."p_size"<10)THEN("a")ELSE IF("p"."p_size"<20)THEN("b")ELSE("c")', "CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' ELSE 'c' END"),
    "n_is_empty": ("labels", "doc_id", 'IF("l"."toxic" IS NOT EMPTY)THEN(1)ELSE(0)', "(toxic IS NOT NULL)::INT"),
    "n_postfix": ("labels", "doc_id", 'IF("l"."quality" ISNOTEMPTY)THEN(1)ELSE(0)', "(quality IS NOT NULL)::INT"),
    "n_bare_not": ("customer", "c_custkey", 'IF(NOT ISEMPTY("c"."c_name"))THEN("named")ELSE("none")', "CASE WHEN c_name IS NOT NULL AND c_name <> '' THEN 'named' ELSE 'none' END"),
    "n_many_empty": ("labels", "doc_id", 'ISEMPTY("l"."toxic","l"."quality")', "toxic IS NULL AND quality IS NULL"),
    "n_angle_unequal": ("orders", "o_orderkey", '"o"."o_orderstatus" <> "O"', "o_orderstatus <> 'O'"),
    "n_is_null": ("labels", "doc_id", 'IF("l"."toxic" IS NULL)THEN("unknown")ELSE("known")', "CASE WHEN toxic IS NULL THEN 'unknown' ELSE 'known' END"),
    "n_exists": ("supplier", "s_suppkey", 'IF(EXISTS(SELECT 1 FROM x WHERE "s"."s_acctbal" > 0))THEN(1)ELSE(0)', "(s_acctbal > 0)::INT"),
    "n_date_literal": ("orders", "o_orderkey", "IF(\"o\".\"o_orderdate\" > DATE'1998-01-01')THEN(1)ELSE(0)", "(o_orderdate > DATE '1998-01-01')::INT"),
    "n_str_to_date": ("orders", "o_orderkey", "IF(\"o\".\"o_orderdate\" < STR_TO_DATE('31/12/1996','%d/%m/%Y'))THEN(1)ELSE(0)", "(o_orderdate < DATE '1996-12-31')::INT"),
    "n_to_date": ("orders", "o_orderkey", "DATEDIFF(\"o\".\"o_orderdate\",TO_DATE('2001-01-01','YYYY-MM-DD'),\"d\")", "date_diff('day', DATE '2001-01-01', o_orderdate::DATE)::INT"),
    "n_date_call": ("orders", "o_orderkey", 'DATEDIFF(DATE("2002-01-01"),"o"."o_orderdate","d")', "date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INT"),
    "n_in_where": ("customer", "c_custkey", '"c"."c_mktsegment" IN ["c"."c_mktsegment" WHERE "c"."c_acctbal" > 0]', "c_acctbal > 0"),
    "n_dotted": ("orders", "o_orderkey", "IF(o.o_totalprice > 50000)THEN(o.o_orderstatus)ELSE(\"-\")", "CASE WHEN o_totalprice > 50000 THEN o_orderstatus ELSE '-' END"),
    "n_business_date": ("orders", "o_orderkey", 'DATEDIFF("o"."var_BUSINESS_DATE","o"."o_orderdate","d")', f"date_diff('day', o_orderdate::DATE, {B})::INT"),
    "n_process_date": ("orders", "o_orderkey", 'DATEDIFF(v_ProcessDate,"o"."o_orderdate","d")', f"date_diff('day', o_orderdate::DATE, {B})::INT"),
    "n_parentheses": ("part", "p_partkey", 'IF(("p"."p_size">20 AND "p"."p_size"<30)THEN("in")ELSE("out")', "CASE WHEN p_size > 20 AND p_size < 30 THEN 'in' ELSE 'out' END"),
    "n_extra_parenthesis": ("part", "p_partkey", 'IF("p"."p_size">20))THEN("in")ELSE("out")', "CASE WHEN p_size > 20 THEN 'in' ELSE 'out' END"),
}


def _near(name: str) -> None:
    source, key, text, sql = NEAR[name]

    def run(spark, sf):
        df = table(spark, sf, source)
        value = formula(df, repair(text), {"limit": 25}, DAY)
        kind = df.select(value.alias("x")).dtypes[0][1]
        return df.select(key, (value.cast("int") if kind.startswith(("decimal", "bigint")) else value).alias("x"))

    run.__name__ = name
    run.__doc__ = f"What {text!r} computes after its repair."
    query(f"SELECT {key}, {sql} AS x FROM {source}")(run)


for _name in NEAR:
    _near(_name)


# --- checks of formulas ---------------------------------------------------------------------

#: Formulas over a key, each with what it is wrong in.
FLAWS = {
    "fine": "IF(\"c\".\"bal\">{k})THEN(\"A\")ELSE(\"B\")",
    "empty": "  ",
    "ended": "IF(\"c\".\"bal\">{k})THEN(",
    "unknown_function": "FOO(\"c\".\"bal\",{k})",
    "text_sum": "\"c\".\"bal\"+\"text\"",
    "own": "IF(\"c\".\"flag\">{k})THEN(1)ELSE(2)",
    "invented_name": "\"c\".\"ghost{k}\"",
    "invented_number": "\"c\".\"bal\"*77{k}",
    "constant": "IF({k}>5)THEN(\"c\".\"bal\")ELSE(0)",
    "same": "IF(\"c\".\"bal\">{k})THEN(\"A\")ELSE(\"A\")",
    "repeated": "IF(\"c\".\"bal\">{k})THEN(IF(\"c\".\"bal\">{k})THEN(1)ELSE(0))ELSE(2)",
    "mixed": "IF(\"c\".\"bal\">{k} OR \"c\".\"bal\"<0 AND \"c\".\"bal\">1)THEN(1)ELSE(0)",
    "unguarded": "\"c\".\"bal\"",
}
#: A word of the finding for each flaw.
FINDINGS = {"empty": "Empty", "ended": "%", "unknown_function": "Unknown function", "text_sum": "Text in", "own": "own target", "invented_name": "Unknown name", "invented_number": "Unknown number", "constant": "constants only", "same": "are equal", "repeated": "Repeats", "mixed": "needs parentheses", "unguarded": "WHERE guard"}


def _flawed(spark, sf) -> DataFrame:
    """c_custkey, flaw, text, source: a formula for each customer."""
    names, texts = list(FLAWS), list(FLAWS.values())
    c = table(spark, sf, "customer")
    i = (F.col("c_custkey") % len(names)).cast("int")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), i)
    source = F.when(pick(names) == "unguarded", "UPDATE c SET flag = bal WHERE kind = 'X'").otherwise(F.concat(F.lit("UPDATE c SET flag = CASE WHEN bal > "), "c_custkey", F.lit(" THEN 'A' ELSE 'B' END -- 5 2")))
    return c.select("c_custkey", pick(names).alias("flaw"), F.replace(pick(texts), F.lit("{k}"), F.col("c_custkey").cast("string")).alias("text"), source.alias("source"))


_FLAW_SQL = "SELECT c_custkey, [" + ", ".join(f"'{n}'" for n in FLAWS) + f"][(c_custkey % {len(FLAWS)})::INT + 1] AS flaw FROM customer"


@query(f"SELECT c_custkey, flaw, flaw IN ('empty', 'ended', 'unknown_function', 'text_sum') AS bad, flaw = 'ended' AS ended FROM ({_FLAW_SQL})")
def g_grammar(spark, sf):
    """Grammar alone: empty, cut off, unknown functions, text in sums."""

    def ended(text: str) -> bool:
        try:
            syntax.parse(text)
        except syntax.FormulaError as e:
            return e.ended and bool(text.strip())
        return False

    return _flawed(spark, sf).select("c_custkey", "flaw", (F.size(guards.grammar_errors("text")) > 0).alias("bad"), each(ended, "boolean")("text").alias("ended"))


@query(f"SELECT c_custkey, flaw, flaw <> 'fine' AS found FROM ({_FLAW_SQL})")
def g_semantic(spark, sf):
    """Each formula against its target and its source: the flaw that it was built with is found, and nothing in the others."""
    names = {n: w for n, w in FINDINGS.items()}

    def found(flaw: str, text: str, source: str) -> bool:
        errors = lint.check(text, "c", "flag", source)
        return any(names[flaw] == "%" or names[flaw] in e for e in errors) if flaw in names else bool(errors)

    return _flawed(spark, sf).select("c_custkey", "flaw", each(found, "boolean")("flaw", "text", "source").alias("found"))


@query("SELECT n_nationkey, n_regionkey > 2 AS aggregated FROM nation")
def g_dropped_aggregate(spark, sf):
    """A formula of one entity against a grouped source, and against a plain one."""
    source = F.when(F.col("n_regionkey") > 2, "SELECT k, MAX(bal) FROM c GROUP BY k").otherwise("UPDATE c SET x = bal")
    test = lambda s: any("aggregation" in e for e in lint.dropped(syntax.parse('"c"."bal"'), s))
    return table(spark, sf, "nation").select("n_nationkey", each(test, "boolean")(source).alias("aggregated"))


@query("SELECT p_partkey, 'SELECT ''--' || p_brand || ''' ' || p_size || ' ' || chr(10) || ' FROM t' AS text FROM part")
def g_comments(spark, sf):
    """SQL without its comments, quoted marks kept."""
    sql = F.concat(F.lit("SELECT '--"), "p_brand", F.lit("'/* "), "p_name", F.lit(" */"), F.col("p_size").cast("string"), F.lit("-- "), "p_type", F.lit("\n FROM t"))
    return table(spark, sf, "part").select("p_partkey", each(lint.without_comments)(sql).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Company is required' WHEN c_custkey % 5 = 0 THEN 'Platform is required' ELSE '' END AS errors FROM customer")
def g_job(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("company"), F.when((F.col("c_custkey") % 5 != 0) | (F.col("c_custkey") % 3 == 0), F.col("c_mktsegment")).otherwise(" ").alias("platform"))
    return c.select("c_custkey", F.array_join(guards.job_errors("company", "platform"), "|").alias("errors"))


@query("SELECT n_nationkey, (n_nationkey % 5 = 0)::INT + (n_nationkey % 3 = 0)::INT + (n_nationkey % 7 = 0)::INT + (n_nationkey % 4 = 0)::INT * 2 AS errors FROM nation")
def g_structure(spark, sf):
    """Confidence, dynamic SQL, unparsed statements, chunks and tables of analysed objects."""
    k, none = F.col("n_nationkey"), F.array().cast("array<string>")
    n = table(spark, sf, "nation").select("n_nationkey", F.when(k % 5 == 0, 0.4).otherwise(0.9).alias("confidence"), (k % 3 == 0).alias("has_dynamic_sql"), F.when(k % 7 == 0, 2).otherwise(0).alias("unparsed"), F.when(k % 4 == 0, 0).otherwise(3).alias("chunks"), F.when(k % 4 == 0, none).otherwise(F.array("n_name")).alias("tables_read"), none.alias("tables_written"))
    return n.select("n_nationkey", F.size(guards.structure_errors()).alias("errors"))


@query(f"SELECT c_custkey, CASE WHEN flaw IN ('empty', 'ended', 'unknown_function', 'text_sum') THEN 1 ELSE 0 END + (c_custkey % 4 = 0)::INT AS errors FROM ({_FLAW_SQL})")
def g_output(spark, sf):
    """Dictionary rows: the formula's grammar and the names."""
    rows = _flawed(spark, sf).select("c_custkey", F.lit("Formula Expression").alias("derivation_option"), F.lit(None).cast("string").alias("decision_table_json"), F.lit("E").alias("entity_name"), F.when(F.col("c_custkey") % 4 != 0, "C").otherwise("").alias("column_name"), F.slice(guards.grammar_errors("text"), 1, 1).alias("grammar_errors"))
    return rows.select("c_custkey", F.size(guards.output_errors()).alias("errors"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'c.bal,o.price' ELSE 'c.bal' END AS deps FROM customer")
def e_dependencies(spark, sf):
    """What a formula reads, in order."""
    text = F.concat(F.lit('IF("c"."bal">'), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, ')THEN("o"."price")ELSE("c"."bal")').otherwise(')THEN("text")ELSE("c"."bal")'))
    return table(spark, sf, "customer").select("c_custkey", each(lambda t: ",".join(syntax.references(syntax.parse(t))))(text).alias("deps"))


# --- formulas in words ----------------------------------------------------------------------


@query("SELECT c_custkey, '- If acct bal is greater than ' || c_custkey || ' and mkt segment is one of \"' || c_mktsegment || '\" or \"X\":' || chr(10) || '  - \"' || c_name || '\"' || chr(10) || '- Otherwise, if flag dt is blank or missing:' || chr(10) || '  - the start of the month for last cr date' || chr(10) || '- Otherwise:' || chr(10) || '  - acct bal plus ' || c_custkey AS text FROM customer".replace("flag dt", "flag date"))
def x_bullets(spark, sf):
    """IF chains as bullets, with conditions, membership, calls and identifiers in words."""
    text = F.format_string('IF("c"."acct_bal">%d AND "c"."mkt_segment" IN ["%s","X"])THEN("%s")ELSEIF(ISEMPTY("c"."FlgDt"))THEN(SOM("c"."LastCrDate"))ELSE("c"."acct_bal"+%d)', "c_custkey", "c_mktsegment", "c_name", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", each(lambda t: explain.explain(t))(text).alias("text"))


@query("SELECT p_partkey, 'use size; otherwise, ' || p_size || '|size is between 1 and ' || p_size || '|the length of name|it is not the case that size equals ' || p_size || '|the highest size, evaluated per group of brand' AS text FROM part")
def x_phrases(spark, sf):
    """COALESCE, BETWEEN, functions, NOT and grouped extremes, in words."""
    shapes = ('COALESCE("p"."size",%d)', '"p"."size" BETWEEN [1,%d]', 'LEN("p"."name")', 'NOT("p"."size"==%d)', 'MAX("p"."size","p"."brand")')
    say = each(lambda t: explain.Explainer().value(syntax.parse(t)))
    texts = [F.format_string(s, "p_size") if "%d" in s else F.lit(s) for s in shapes]
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("|", *(say(t) for t in texts)).alias("text"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g'), '^ | $', '', 'g')) AS text FROM part")
def x_words(spark, sf):
    """Names in capitals and underscores as words."""
    return table(spark, sf, "part").select("p_partkey", each(explain.words_of)(F.regexp_replace("p_type", r"[^A-Za-z0-9]+", "_")).alias("text"))


@query("SELECT p_partkey, 'IF (\"p\".\"size\">' || p_size || ')' || chr(10) || '    → \"' || p_brand || '\"' || chr(10) || 'ELSE IF (\"p\".\"size\"==1)' || chr(10) || '    → ' || p_partkey || chr(10) || 'ELSE' || chr(10) || '    → LEN(\"p\".\"name\")' AS text FROM part")
def x_layout(spark, sf):
    """Branches on lines of their own, values as written."""
    text = F.format_string('IF("p"."size">%d)THEN("%s")ELSEIF("p"."size"==1)THEN(%d)ELSE(LEN("p"."name"))', "p_size", "p_brand", "p_partkey")
    return table(spark, sf, "part").select("p_partkey", each(lambda t: explain.laid_out(t))(text).alias("text"))


# --- statements -----------------------------------------------------------------------------


def _scripts(spark, sf) -> DataFrame:
    """object_id, dialect, raw_sql, name: a script for each nation, in Oracle's or SQL Server's form."""
    n = table(spark, sf, "nation")
    t = F.regexp_replace("n_name", r"\W", "_")
    oracle = F.concat(F.lit("UPDATE "), t, F.lit(" SET a = 'x;y', b = NULL WHERE k = "), "n_nationkey", F.lit(";\nIF p_KEY > 5 THEN MERGE INTO "), t, F.lit(" T USING (SELECT k, MAX(v) AS v FROM src_"), "n_regionkey", F.lit(" GROUP BY k) S ON (T.k = S.k) WHEN MATCHED THEN UPDATE SET T.m = S.v; /* ; */ ELSE DELETE FROM old WHERE k IN (SELECT k FROM "), t, F.lit("); END IF;\nSELECT 1 FROM dual"))
    server = F.concat(F.lit("SELECT k, v INTO #t FROM "), t, F.lit("\nGO\nUPDATE a SET a.x = s.v FROM "), t, F.lit(" a JOIN #t s ON a.k = s.k WHERE s.v > "), "n_nationkey", F.lit("\nINSERT INTO log (k)\nVALUES ("), "n_nationkey", F.lit(")"))
    even = F.col("n_nationkey") % 2 == 0
    return n.select(F.col("n_nationkey").cast("string").alias("object_id"), F.when(even, "oracle").otherwise("sqlserver").alias("dialect"), F.when(even, oracle).otherwise(server).alias("raw_sql"), t.alias("name"))


_SCRIPT_SQL = "WITH n AS (SELECT n_nationkey::VARCHAR AS object_id, n_nationkey % 2 = 0 AS even, n_nationkey AS k, n_regionkey AS r, regexp_replace(n_name, '\\W', '_', 'g') AS t FROM nation), s AS (SELECT *, unnest(CASE WHEN even THEN range(7) ELSE range(3) END) AS i FROM n)"


def _objects(spark, sf) -> DataFrame:
    """The objects of a file for each region, with a procedure for each of its nations."""
    n = table(spark, sf, "nation")
    t = F.regexp_replace("n_name", r"\W", "_")
    one = F.concat(
        F.lit("CREATE OR REPLACE PROCEDURE PRO.\"P_"), t, F.lit("\"(p_TIMEKEY INT) AS v_B INT; BEGIN SELECT MAX(b) INTO v_B FROM bands; UPDATE "), t, F.lit(" SET a = v_B; IF p_TIMEKEY > "), F.col("n_nationkey") * 100,
        F.lit(" THEN MERGE INTO "), t, F.lit(" T USING (SELECT k, MAX(v) AS v FROM src_"), "n_regionkey", F.lit(" GROUP BY k) S ON (T.k = S.k) WHEN MATCHED THEN UPDATE SET T.m = S.v; END IF; CALL PRO.Log_"), "n_regionkey", F.lit("(1); END;\n"),
    )
    files = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("x")))), lambda s: s["x"]), "").alias("text"))
    return statements.split_objects(files.select(F.concat(F.lit("r"), "n_regionkey", F.lit(".sql")).alias("file"), "text"))


_OBJECT_SQL = "WITH n AS (SELECT 'r' || n_regionkey || '.sql#' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS object_id, n_nationkey AS k, n_regionkey AS r, regexp_replace(n_name, '\\W', '_', 'g') AS t FROM nation)"


@query(_OBJECT_SQL + " SELECT object_id, 'P_' || t AS name, 'bands,src_' || r AS reads, t AS writes, 'Log_' || r AS calls, 1.0::DOUBLE AS confidence FROM n")
def s_object_rollup(spark, sf):
    """Objects of files with what they read, write and call."""
    objects = _objects(spark, sf)
    out = statements.object_rollup(objects, statements.statements(objects))
    join = lambda c: F.array_join(c, ",")
    return out.select("object_id", "name", join("tables_read").alias("reads"), join("tables_written").alias("writes"), join("called").alias("calls"), "confidence")


@query(_OBJECT_SQL + ", u AS (SELECT 'bands' AS tab, 'P_' || t AS reader, NULL AS col FROM n UNION ALL SELECT 'src_' || r, 'P_' || t, NULL FROM n UNION ALL SELECT t, NULL, unnest(['a', 'm']) FROM n) SELECT tab, coalesce(string_agg(reader, ', ' ORDER BY reader), '') AS readers, coalesce(string_agg(col, ', ' ORDER BY col), '') AS columns FROM u GROUP BY tab")
def e_tables_pivot(spark, sf):
    """Each table with the objects that read it and the columns that are written."""
    objects = _objects(spark, sf)
    return dictionary.table_use(statements.statements(objects).join(objects.select("object_id", "name"), "object_id")).withColumnRenamed("table", "tab")


@query(_OBJECT_SQL + " SELECT object_id, 'p_TIMEKEY' AS variable, k * 100 AS value, k * 100 + 1 AS representative, coalesce(o_orderdate::DATE, DATE '2000-01-01' + (k * 100)::INT) AS effective_date FROM n LEFT JOIN orders ON o_orderkey = k * 100")
def t_threshold_extract(spark, sf):
    """The versions that procedures test, with their dates, from a calendar or counted."""
    days = table(spark, sf, "orders").select(F.col("o_orderkey").alias("time_key"), F.col("o_orderdate").cast("date").alias("date"))
    return periods.periods(periods.thresholds(_objects(spark, sf)), days).select("object_id", "variable", "value", "representative", "effective_date")


@query(_SCRIPT_SQL + " SELECT object_id, i::INT AS statement_index, CASE WHEN even THEN ['UPDATE', 'CONTROL_FLOW', 'MERGE', 'CONTROL_FLOW', 'DELETE', 'CONTROL_FLOW', 'SELECT'][i + 1] ELSE ['SELECT', 'UPDATE', 'INSERT'][i + 1] END AS statement_type FROM s")
def s_split(spark, sf):
    """Statements at semicolons or lines, headers apart, and their kinds."""
    return statements.statements(_scripts(spark, sf)).select("object_id", "statement_index", "statement_type")


@query(
    _SCRIPT_SQL
    + """ SELECT object_id, i::INT AS statement_index, CASE WHEN even THEN [t, '', t, '', 'old', '', ''][i + 1] ELSE ['#t', t, 'log'][i + 1] END AS wrote, CASE WHEN even THEN ['', '', 'src_' || r, '', t, '', ''][i + 1] ELSE [t, '#t', ''][i + 1] END AS read,
    CASE WHEN even THEN ['a,b', '', 'm', '', '', '', ''][i + 1] ELSE ['k,v', 'x', 'k'][i + 1] END AS sets, CASE WHEN NOT even AND i = 1 THEN 'a.k = s.k' ELSE '' END AS joins, CASE WHEN even AND i = 1 THEN 'p_KEY > 5' WHEN even AND i = 2 THEN 'MATCHED' ELSE '' END AS tests FROM s"""
)
def s_parse(spark, sf):
    """Tables read and written, columns set, joins and conditions of each statement."""
    found = statements.statements(_scripts(spark, sf))
    text = lambda c: F.array_join(c, ",")
    sets = F.array_join(F.flatten(F.map_values("set_columns_by_table")), ",")
    return found.select("object_id", "statement_index", text("tables_written").alias("wrote"), text("tables_read").alias("read"), F.coalesce(sets, F.lit("")).alias("sets"), text("join_conditions").alias("joins"), text("conditions").alias("tests"))


@query(_SCRIPT_SQL + ", c AS (SELECT *, CASE WHEN even THEN [0, 1, 1, 1, 1, 1, 2][i + 1] ELSE i END AS c FROM s) SELECT object_id, c::INT AS chunk_index, count(*) AS n, CASE WHEN even AND c = 1 THEN 'CONTROL_FLOW' ELSE 'STATEMENT' END AS kind, CASE WHEN even AND c = 0 THEN 'a,b' WHEN even AND c = 1 THEN 'm' WHEN even THEN '' WHEN c = 0 THEN 'k,v' WHEN c = 1 THEN 'x' ELSE 'k' END AS sets FROM c GROUP BY ALL")
def s_chunks(spark, sf):
    """Chunks of statements, with what they write."""
    rolled = statements.chunk_rollup(statements.statements(_scripts(spark, sf)))
    return rolled.select("object_id", "chunk_index", F.size("statement_indices").cast("bigint").alias("n"), "kind", F.array_join("columns_written", ",").alias("sets"))


@query(_SCRIPT_SQL + " SELECT object_id, c::INT AS chunk_index FROM (SELECT object_id, even, unnest(CASE WHEN even THEN [1] ELSE [] END) AS c FROM n)")
def d_relevant_chunks(spark, sf):
    """The chunks that write a column, whatever the case of its name."""
    rolled = statements.chunk_rollup(statements.statements(_scripts(spark, sf)))
    return statements.relevant(rolled, "M").select("object_id", "chunk_index")


@query("SELECT n_nationkey::VARCHAR AS object_id, CASE WHEN n_nationkey % 2 = 0 THEN '0|1,2' ELSE '' END AS sites, n_nationkey % 2 = 0 AS guarded, n_nationkey % 2 = 0 AS later, CASE WHEN n_nationkey % 2 = 0 THEN 'INITIAL_RESET,SEQUENTIAL_FIXUP' ELSE '' END AS roles FROM nation")
def d_sites(spark, sf):
    """Where a column is written with the headers before it, guarded updates, later reads of it, and the roles of the writes."""
    even = F.col("n_nationkey") % 2 == 0
    sql = F.when(even, F.concat(F.lit("UPDATE t SET x = 0; IF k > 1 THEN UPDATE t SET x = x + y WHERE z = "), "n_nationkey", F.lit("; END IF; UPDATE t SET y = 1"))).otherwise(F.concat(F.lit("UPDATE t SET y = "), "n_nationkey"))

    def described(text: str):
        return [statements.describe(s, i) for i, s in enumerate(statements.split_statements(text))]

    found = lambda text: sites.sites(described(text), "X")
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("object_id"),
        each(lambda t: "|".join(",".join(map(str, s.statement_indices)) for s in found(t)))(sql).alias("sites"),
        each(lambda t: any(sites.guarded_update(s, "x") for s in described(t)), "boolean")(sql).alias("guarded"),
        each(lambda t: sites.reads_itself_later(described(t), "x"), "boolean")(sql).alias("later"),
        each(lambda t: ",".join(sites.role(s.raw_sql) for s in found(t)))(sql).alias("roles"),
    )


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '2:V_A,1:V_B,0:V_C' WHEN 1 THEN '1:V_A' ELSE '' END AS chain FROM nation")
def d_variables(spark, sf):
    """The definitions that a write depends on, through other variables."""
    sql = F.when(F.col("n_nationkey") % 3 == 0, "v_C := 1; SELECT m INTO v_B FROM t WHERE k = v_C; v_A := v_B * 2; UPDATE t SET x = v_A; v_A := 9").when(F.col("n_nationkey") % 3 == 1, "v_Z := 1; v_A := 5; UPDATE t SET x = v_A").otherwise("UPDATE t SET x = 1")

    def chain(text: str) -> str:
        found = statements.split_statements(text)
        use = next(i for i, s in enumerate(found) if s.startswith("UPDATE"))
        return ",".join(f"{i}:{v}" for i, v in statements.variable_chain(found, use))

    return table(spark, sf, "nation").select("n_nationkey", each(chain)(sql).alias("chain"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 200000 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN NOT (o_orderpriority LIKE '2%') THEN 'later' END ELSE 'none' END AS label,
    CASE WHEN o_orderstatus = 'O' OR o_totalprice > 150000 THEN (o_totalprice - 3) * 2 ELSE 0 END AS amount, CASE WHEN o_orderdate IS NOT NULL THEN o_orderdate::DATE + 3 END AS due FROM orders"""
)
def d_compose(spark, sf):
    """The formulas of a script's writes, folded in order and compiled: CASE, conditions, values, ADDDAY."""
    sql = """UPDATE orders SET label = 'none', amount = 0; UPDATE orders A SET A.label = CASE WHEN A.o_orderpriority = '1-URGENT' THEN 'urgent' WHEN NOT A.o_orderpriority LIKE '2%' THEN 'later' END WHERE A.o_orderstatus IN ('F','P') AND A.o_totalprice BETWEEN 1000 AND 200000;
    MERGE INTO orders T USING (SELECT o_orderkey, (o_totalprice - 3) * 2 AS v FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 150000) S ON (T.o_orderkey = S.o_orderkey) WHEN MATCHED THEN UPDATE SET T.amount = S.v; UPDATE orders SET due = DATEADD(DAY, 3, o_orderdate) WHERE o_orderdate IS NOT NULL;"""
    found = [statements.describe(s, i) for i, s in enumerate(statements.split_statements(sql))]
    df = table(spark, sf, "orders").withColumns({"o_orderdate": F.col("o_orderdate").cast("date"), "label": F.lit(None).cast("string"), "due": F.lit(None).cast("date")})
    out = []
    for c in ("label", "amount", "due"):
        text, _, problems = compose.compose(found, "orders", c)
        if problems:
            raise ValueError(problems)
        out.append(formula(df, text).alias(c))
    return df.select("o_orderkey", *out)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'ACCT' WHEN n_nationkey % 3 = 1 THEN 'B' ELSE 'A' END || '.x|' || CASE WHEN n_nationkey % 3 = 0 THEN 'NULL' ELSE 'keeps' END AS text FROM nation")
def d_formula_edits(spark, sf):
    """Aliases replaced by the tables that they name once, and a last ELSE that reads its own column by NULL."""
    alias = F.when(F.col("n_nationkey") % 3 == 0, "T").when(F.col("n_nationkey") % 3 == 1, "B").otherwise("A")
    text = F.concat(F.lit('IF("z"."k">1)THEN(1)ELSE("'), alias, F.lit('"."x")'))

    def edit(t: str) -> str:
        new = sites.with_tables(t, {"T": "ACCT"})
        last = sites.without_trailing_self(new, "acct", "X")
        name = syntax.references(syntax.parse(new))[-1]
        return f"{name}|{'NULL' if last.endswith('ELSE(NULL)') else 'keeps'}"

    return table(spark, sf, "nation").select("n_nationkey", each(edit)(text).alias("text"))


@query("WITH u AS (SELECT c_mktsegment AS alias, 'T' || (c_nationkey % 2) AS t FROM customer UNION ALL SELECT n_name, 'N' || n_regionkey FROM nation) SELECT upper(alias) AS alias, min(t) AS tab FROM u GROUP BY 1 HAVING count(DISTINCT t) = 1")
def d_aliases(spark, sf):
    """Aliases that name one table only."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    uses = c.select(F.col("c_mktsegment").alias("alias"), F.concat(F.lit("T"), F.col("c_nationkey") % 2).alias("table")).unionByName(n.select(F.col("n_name").alias("alias"), F.concat(F.lit("N"), "n_regionkey").alias("table")))
    return dictionary.alias_map(uses).withColumnRenamed("table", "tab")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 3 = 0)")
def d_exceptions(spark, sf):
    """Writes whose guard is that of an exception handler."""
    guard = F.concat(F.lit(" WHERE region = "), "n_regionkey")
    rows = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("EXCEPTION WHEN OTHERS THEN UPDATE t SET x = 1"), guard)).otherwise(F.concat(F.lit("UPDATE t SET x = 2 "), guard, F.lit(";"))).alias("raw_sql"))
    return dictionary.pending_exceptions(rows).select("n_nationkey")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Decision Table' ELSE 'Formula Expression' END AS kind, CASE WHEN p_size % 3 = 0 THEN '{\"rules\": [' || p_size || ']}' ELSE 'LEN(\"' || p_brand || '\")' END AS body FROM part")
def d_answers(spark, sf):
    """A model's answer as a decision table or a formula, fenced or not."""
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(F.lit('```json\n{"rules": ['), "p_size", F.lit("]}\n```"))).when(size % 3 == 1, F.concat(F.lit('```\nLEN("'), "p_brand", F.lit('")\n```'))).otherwise(F.concat(F.lit('LEN("'), "p_brand", F.lit('")')))
    return table(spark, sf, "part").select("p_partkey", each(lambda t: sites.answer_kind(t)[0])(text).alias("kind"), each(lambda t: sites.answer_kind(t)[1])(text).alias("body"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Days past due' WHEN 1 THEN 'A flag' ELSE 'x' || n_nationkey || ',' END || ' derived ' || CASE WHEN n_regionkey = 0 THEN 'by conditions' ELSE 'directly' END || ' from its source.' AS text FROM nation")
def d_meaning(spark, sf):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, "DPD_Max").when(k % 3 == 1, "FlgDeg").otherwise(F.concat(F.lit("x"), k))
    return table(spark, sf, "nation").select("n_nationkey", each(service.meaning)(name, F.when(F.col("n_regionkey") == 0, "IF(1==2)THEN(1)ELSE(2)").otherwise("1")).alias("text"))


# --- periods, jobs, stored rows -------------------------------------------------------------


@query("SELECT o_custkey::VARCHAR AS object_id, 'V' || (o_orderkey % 2) AS variable, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS vals FROM orders GROUP BY ALL")
def t_by_variable(spark, sf):
    """The thresholds of each object and variable in order."""
    found = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("object_id"), F.col("o_orderkey").alias("value"), F.concat(F.lit("v"), F.col("o_orderkey") % 2).alias("variable"), F.col("o_orderkey").alias("pos"), F.lit(">").alias("operator"))
    return periods.by_variable(found).select("object_id", "variable", F.array_join(F.transform("thresholds", lambda t: t["value"].cast("string")), ",").alias("vals"))


@query("SELECT c_custkey, coalesce(o_orderdate::DATE, DATE '2026-01-01') AS effective_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def t_fan_out(spark, sf):
    """A row for each period of its object, from today without one."""
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("object_id"))
    cut = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("object_id"), F.lit("K").alias("variable"), F.lit(1).alias("representative"), F.col("o_orderdate").cast("date").alias("effective_date"))
    return periods.fan_out(rows, cut, dt.date(2026, 1, 1)).select("c_custkey", "effective_date")


def _stored(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 7).alias("row_index"), F.when(F.col("event_type") == "error", "PENDING_REVIEW").otherwise("ACTIVE").alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit('["e'), F.col("event_id") % 3, F.lit('", "f"]'))).alias("validation_errors"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'error'")
def q_pending(spark, sf):
    return jobs.pending(_stored(spark, sf)).select("id")


@query("SELECT event_id AS id, event_id % 7 AS row_index FROM events WHERE user_id = 7")
def q_of_job(spark, sf):
    """The rows of one job."""
    return jobs.of_job(_stored(spark, sf), "7").select("id", "row_index")


@query("SELECT event_id AS id, user_id::VARCHAR AS job_id FROM events WHERE event_id = 11")
def q_point(spark, sf):
    """One row by its id."""
    return jobs.one(_stored(spark, sf), "id", 11).select("id", "job_id")


@query("SELECT event_id AS id, 'e' || (event_id % 3) || '|f' AS errors FROM events WHERE event_type = 'error'")
def q_review_items(spark, sf):
    """Pending rows with their errors as arrays."""
    return jobs.review_items(_stored(spark, sf)).select("id", F.array_join("validation_errors", "|").alias("errors"))


@query("SELECT n_name AS entity_name, n_regionkey AS region, regexp_matches(lower(n_name), 'status|log|audit|error|process|temp|tmp|stg|#') AS is_technical, min(n_nationkey) OVER (PARTITION BY upper(trim(n_name))) AS entity_first FROM nation")
def e_by_entity(spark, sf):
    """Rules by their entity's first rule, technical entities apart."""
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("entity_name"), F.col("n_nationkey").alias("first"), F.col("n_regionkey").alias("region"))
    return dictionary.by_entity(rows).select("entity_name", "region", "is_technical", "entity_first")


@query("SELECT c_custkey, strftime(DATE '2020-02-01' + (c_custkey % 28)::INT, '%d-%m-%Y') AS d FROM customer WHERE c_custkey % 3 <> 0")
def e_reviewed_export(spark, sf):
    """The rows of a job that are active after review, in the external form."""
    from .sources import dictionary_csv

    rows = _dictionary(table(spark, sf, "customer"), "c_mktsegment", "CAST(c_custkey AS STRING)", "'x'", "date_add(DATE'2020-02-01', CAST(c_custkey % 28 AS INT))", "c_custkey").withColumns({"id": F.col("pos"), "job_id": F.lit("j"), "row_index": F.col("pos"), "status": F.lit("PENDING_REVIEW"), "expression": F.lit("x")})
    acts = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("decision_id"), F.when(F.col("c_custkey") % 3 == 0, "REJECT").otherwise("APPROVE").alias("action"), F.lit(None).cast("string").alias("edited_expression"))
    done = jobs.reviewed(rows, acts, "j")
    out = dictionary_csv.from_external(dictionary_csv.to_external(done))
    return out.select(F.col("column_name").cast("bigint").alias("c_custkey"), F.date_format("effective_start_date", "dd-MM-yyyy").alias("d"))


# --- retrieval ------------------------------------------------------------------------------


@query("SELECT 'kb-doc' || item_id || '-0' AS id, trim(text) AS document FROM benchmark WHERE length(text) <= 800")
def r_ingest(spark, sf):
    """Files as chunks with ids; here texts of one paragraph that fit in a chunk."""
    b = table(spark, sf, "benchmark").where(F.length("text") <= 800)
    return retrieval.ingest(b.select(F.concat(F.lit("doc"), "item_id", F.lit(".md")).alias("file"), F.regexp_replace("text", r"\n\s*\n", "\n").alias("text")), "kb")


@query("SELECT (SELECT count(*) FROM benchmark) AS n, least(3, (SELECT count(*) FROM benchmark)) AS k")
def r_collection(spark, sf):
    """A vector collection: rows added, counted, and min(n, count) of a question."""
    c = retrieval.Collection(spark, "items")
    c.add(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("document")))
    question = table(spark, sf, "benchmark").orderBy("item_id").limit(1).select(F.lit("q").alias("id"), F.col("text").alias("document"))
    return spark.range(1).select(F.lit(c.count()).cast("bigint").alias("n"), F.lit(c.query(question, 3).count()).cast("bigint").alias("k"))


# --- sources, stores, names -----------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 3 = 0 THEN 'utf-16' ELSE 'utf-8-sig' END AS encoding FROM documents")
def s_decode(spark, sf):
    """Texts read back from their bytes, whose encoding isn't told."""
    from .sources import texts

    content = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    found = table(spark, sf, "documents").select("doc_id", texts.decoded(content).alias("d"))
    return found.select("doc_id", F.sha2("d.text", 256).alias("sha"), F.col("d.encoding").alias("encoding"))


@query("SELECT doc_id, sha256(text) AS sha, strftime(DATE '2020-02-01' + (doc_id % 28)::INT, '%d-%m-%Y') AS d FROM documents")
def s_dictionary_csv(spark, sf):
    """The dictionary's CSV written and read, with any text as an expression."""
    from .sources import dictionary_csv, store

    rows = _dictionary(table(spark, sf, "documents"), "lang", "CAST(doc_id AS STRING)", "text", "date_add(DATE'2020-02-01', CAST(doc_id % 28 AS INT))", "doc_id")
    path = f"{store.shared_dir(spark)}/ledgerwise/csv-{uuid.uuid4().hex}"
    dictionary_csv.write(rows, path)
    return dictionary_csv.read(spark, path).select(F.col("column_name").cast("bigint").alias("doc_id"), F.sha2("display_derivation_expression", 256).alias("sha"), F.date_format("effective_start_date", "dd-MM-yyyy").alias("d"))


@query("SELECT user_id::VARCHAR AS job_id, arg_max(event_type, event_id) AS status FROM events GROUP BY ALL")
def s_store(spark, sf):
    """Rows of a store, appended twice, and the last of each job."""
    from .sources import store

    s = store.Store(spark, f"{store.shared_dir(spark)}/ledgerwise/store-{uuid.uuid4().hex}")
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    for part in (rows.where("version % 2 = 1"), rows.where("version % 2 = 0")):
        s.append("jobs", part)
    return jobs.latest(s.read("jobs"), "job_id", "version").select("job_id", "status")


@query("SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g') AS process, trim(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug, p_brand || '.' AS first FROM part")
def e_names(spark, sf):
    """Process names, parts of file names, first sentences."""
    file = F.concat(F.lit("in/dir/"), F.regexp_replace("p_type", r"[^A-Za-z0-9]+", "_"), F.lit(".sql"))
    return table(spark, sf, "part").select("p_partkey", each(dictionary.process_name)(file).alias("process"), each(dictionary.slug)("p_name").alias("slug"), each(dictionary.first_sentence)(F.concat("p_brand", F.lit(". "), "p_type", F.lit(". More"))).alias("first"))


@query("SELECT n_nationkey, 'Writes of x:' || chr(10) || '1. [INITIAL_RESET] UPDATE t SET x = 0' || chr(10) || '2. [SEQUENTIAL_FIXUP] UPDATE t SET x = ' || (n_nationkey + 1) || ' WHERE k = ' || n_regionkey || chr(10) || 'Source:' || chr(10) || n_name AS text FROM nation")
def d_context(spark, sf):
    """A column's writes as a numbered sequence with their roles."""
    sql = F.concat(F.lit("UPDATE t SET x = 0; UPDATE t SET x =  "), F.col("n_nationkey") + 1, F.lit("\n WHERE k = "), "n_regionkey")

    def text(script: str, source: str) -> str:
        found = [statements.describe(s, i) for i, s in enumerate(statements.split_statements(script))]
        return sites.context("x", sites.sites(found, "x"), source)

    return table(spark, sf, "nation").select("n_nationkey", each(text)(sql, "n_name").alias("text"))


@query("SELECT n_nationkey, 'A,B,K' || n_nationkey || ',P_KEY,SRC,T,X' AS names FROM nation")
def d_known_names(spark, sf):
    """Columns, parameters, tables and aliases of a statement."""
    sql = F.concat(F.lit("UPDATE t SET x = (SELECT a.k"), "n_nationkey", F.lit(" FROM src a WHERE a.b = 1)"))
    known = lambda s: ",".join(sorted(sites.known_names([statements.describe(s)], frozenset({"p_KEY"}))))
    return table(spark, sf, "nation").select("n_nationkey", each(known)(sql).alias("names"))


@query("SELECT 'q' || item_id AS query_id, trim(text) AS context FROM benchmark WHERE length(text) <= 800")
def r_context(spark, sf):
    """The document nearest to each question as its context; here every question is a document itself."""
    b = table(spark, sf, "benchmark").where(F.length("text") <= 800).select(F.concat(F.lit("q"), "item_id").alias("id"), F.trim("text").alias("document"))
    return retrieval.context(b, b, b.limit(0), (1, 1))


_CHAIN_SQL = "WITH g AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 IN (0, 1) THEN 0 WHEN n_nationkey % 5 IN (2, 3) THEN 2 ELSE 4 END AS g FROM nation)"


@query(_CHAIN_SQL + " SELECT min('o' || k) AS chain, count(*) AS n, CASE WHEN g = 4 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN g = 4 THEN 'low' ELSE 'high' END AS order_confidence FROM g GROUP BY g")
def l_chain_models(spark, sf):
    """One row a chain: its objects, evidence and confidence, at most 0.6 for a cycle."""
    from .operators import lineage
    from .queries import _nodes

    nodes = _nodes(spark, sf)
    models = lineage.chain_models(lineage.orders(nodes, lineage.edges(nodes)), nodes)
    return models.select("chain", F.size("order").cast("bigint").alias("n"), "confidence", "order_confidence")


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') THEN 'outside' ELSE 'inside' END AS place FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')")
def f_hierarchy_not_in(spark, sf):
    from .operators import steps

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return steps.derive(n, "place", 'IF("n"."n_name" HRCHYNOTIN ["ASIA"])THEN("outside")ELSE("inside")', hierarchies={"n_name": edges}).select("n_nationkey", "place")


@query("SELECT l_orderkey, l_quantity = (SELECT max(l_quantity) FROM lineitem) AS top, l_quantity FROM lineitem")
def f_max_of_all(spark, sf):
    """MAX of one argument is over all rows: one aggregate, not a window in one task."""
    df = table(spark, sf, "lineitem")
    return df.select("l_orderkey", (F.col("l_quantity") == formula(df, 'MAX("l"."l_quantity")')).alias("top"), "l_quantity")
