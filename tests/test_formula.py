import datetime as dt
from decimal import Decimal

import pytest
from ledgerwise.functions import lint
from ledgerwise.functions.compile import formula
from ledgerwise.functions.explain import explain, laid_out, words_of
from ledgerwise.functions.prune import prune
from ledgerwise.functions.repair import repair
from ledgerwise.functions.syntax import FormulaError, Number, Reference, parse, references


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, "Y", dt.date(2020, 2, 10), dt.datetime(2020, 2, 10, 5), Decimal("10.50"), "12"), (2, "", None, None, None, "x"), (3, None, dt.date(2019, 12, 31), dt.datetime(2019, 12, 31), Decimal("-3.25"), None)]
    return spark.createDataFrame(rows, "id int, flg string, d date, t timestamp_ntz, amt decimal(10,2), txt string")


def values(df, text, **bound):
    return [r.v for r in df.select("id", formula(df, text, **bound).alias("v")).orderBy("id").collect()]


CASES = [
    ('IF(ISEMPTY("A"."flg"))THEN("e")ELSE("A"."flg")', ["Y", "e", "e"]),
    ('IF("A"."amt">0)THEN(1)ELSEIF("A"."amt"<0)THEN(2)', [1, None, 2]),
    ('IF(NOT("A"."flg"=="Y"))THEN(1)ELSE(0)', [0, 1, 0]),
    ('IF(AND("A"."id">=2,OR("A"."id"<3,"A"."id"==3)))THEN("in")ELSE("out")', ["out", "in", "in"]),
    ('"A"."id" IN [1,3]', [True, False, True]),
    ('"A"."flg" NOTIN ["Y","N"]', [False, True, None]),
    ('"A"."id" BETWEEN [2,3]', [False, True, True]),
    ('"A"."id" == "2"', [False, True, False]),
    ('"A"."d" == "2020-02-10"', [True, None, False]),
    ('"A"."t" > "2020-01-01"', [True, None, False]),
    ('COALESCE("A"."amt",0)+1', [Decimal("11.50"), Decimal("1.00"), Decimal("-2.25")]),
    ('1/("A"."id"-1)', [None, 1.0, 0.5]),
    ('-"A"."id"*2+"A"."id"', [-1, -2, -3]),
    ('CONVERT("A"."txt","INT")', [12, None, None]),
    ('CONCAT("A"."flg","-","A"."id")', ["Y-1", "-2", "-3"]),
    ('SUBSTR("abcdef",2,3)', ["bcd"] * 3),
    ('LEN(TRIM("  ab "))', [2] * 3),
    ('REGEX("A"."txt","^[0-9]+$")', [True, False, None]),
    ('SOM("A"."d")', [dt.date(2020, 2, 1), None, dt.date(2019, 12, 1)]),
    ('EOM("A"."t")', [dt.date(2020, 2, 29), None, dt.date(2019, 12, 31)]),
    ('SOFY("A"."d")', [dt.date(2019, 4, 1), None, dt.date(2019, 4, 1)]),
    ('EOFY("A"."d")', [dt.date(2020, 3, 31), None, dt.date(2020, 3, 31)]),
    ('EOQ("A"."d")', [dt.date(2020, 3, 31), None, dt.date(2019, 12, 31)]),
    ('DATEDIFF("A"."var"."BUSINESS_DATE","A"."d","d")+1', [5, None, 46]),
    ('DATEDIFF("A"."var"."BUSINESS_DATE","A"."d","M")', [0, None, 1]),
    ('ADDDAY("A"."d","2")', [dt.date(2020, 2, 12), None, dt.date(2020, 1, 2)]),
    ('"A"."d"-1', [dt.date(2020, 2, 9), None, dt.date(2019, 12, 30)]),
    ('TODATE("31/12/2020","DD/MM/YYYY")', [dt.date(2020, 12, 31)] * 3),
    ('ROUND("A"."amt",1)', [Decimal("10.5"), None, Decimal("-3.3")]),
    ('ABS("A"."amt")', [Decimal("10.50"), None, Decimal("3.25")]),
    ('FLOOR(17,5)+CEIL(17,5)', [35] * 3),
    ('MAX("A"."amt","A"."flg")', [Decimal("10.50"), None, Decimal("-3.25")]),
    ('MIN("A"."id")', [1] * 3),
    ('IF(p_TIMEKEY > 100)THEN("new")ELSE(NULL)', ["new"] * 3),
    ('"A"."flg" CONTAINS ["Y"]', [True, False, None]),
    ('"A"."flg" DOESNOTCONTAINS ["Y"]', [False, True, None]),
    ('PERIOD("QUARTER",1,"A"."d")', [dt.date(2020, 5, 10), None, dt.date(2020, 3, 31)]),
    ('DATEPART("A"."d","YEAR")', [2020, None, 2019]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_values(df, text, want):
    assert values(df, text, business_date=dt.date(2020, 2, 14), parameters={"p_TIMEKEY": 101}) == want


@pytest.mark.parametrize("text", ['"A"."nosuch"', "nosuch", 'BOGUS("A"."id")', 'SOM()', '"B"."id"', '"A"."var"."BUSINESS_DATE"', 'DATEDIFF("A"."d","A"."d","fortnight")'])
def test_names_and_functions_that_do_not_exist(df, text):
    with pytest.raises(FormulaError):
        formula(df, text, entities=frozenset({"A"}))


def test_syntax():
    assert parse("1 + 2 * 3") == parse("1+(2*3)").__class__((0, 0), "+", Number((0, 0), 1), parse("2*3"))
    assert parse('"a"."b"') == Reference((0, 0), ("a", "b"), (True, True))
    assert references(parse('IF("A"."X"=="lit" AND y > 1)THEN(NULL)ELSE("Z")'), {"Z"}) == ["A.X", "y", "Z"]
    for bad in ("", "  ", "1 +", "IF(1)THEN(2", '"open', "a IN []", "f(,)", "a b", "AND(1)", "1 ? 2", "a IN [b]"):
        with pytest.raises(FormulaError):
            parse(bad)
    for cut in ('IF(ISNOTEMPTY("A"."X"))THEN(("A"."Y") +', "IF(", "f(1,"):
        with pytest.raises(FormulaError, match="Unexpected end-of-input"):
            parse(cut)


@pytest.mark.parametrize(
    "text,want",
    [
        ('IF("A"."X"==DATE"1900-01-01")THEN(1)ELSE(0)', 'IF("A"."X"==TODATE("1900-01-01"))THEN(1)ELSE(0)'),
        ("IF(A.X IS NOT NULL AND NVL(A.Y,'N') = 'Y',1,0)", 'IF(ISNOTEMPTY(A.X) AND COALESCE(A.Y,"N") == "Y")THEN(1)ELSE(0)'),
        ('(A.X > 3) ? "a" : "b"', 'IF(A.X > 3)THEN("a")ELSE("b")'),
        ('IF(NOT ISEMPTY("X"))THEN(1) ELSE IF(A.Z<>3)THEN(2)ELSE(3)', 'IF(NOT(ISEMPTY("X")))THEN(1) ELSEIF(A.Z!=3)THEN(2)ELSE(3)'),
        ('IF(ISEMPTY("A"."X")THEN(1)ELSE(0)', 'IF(ISEMPTY("A"."X"))THEN(1)ELSE(0)'),
        ('IF(a IN ["D"."P" WHERE "D"."N"=="T"])THEN("N")ELSE(NULL)', 'IF(a == "D"."P" AND ("D"."N"=="T"))THEN("N")ELSE(NULL)'),
        ("ISNULL(X)", "ISEMPTY(X)"),
        ("ISEMPTY(a,b)", "ISEMPTY(COALESCE(a,b))"),
        ("TO_DATE(A.D,'DD/MM/YYYY')", 'TODATE(A.D,"DD/MM/YYYY")'),
        ("DATEADD(DAY, 3, A.D)", "ADDDAY(A.D,3)"),
        ("IF(v_ProcessDate > A.D)THEN(1)ELSE(0)", 'IF("var"."BUSINESS_DATE" > A.D)THEN(1)ELSE(0)'),
        ('IF("a  b"=="x")THEN(1)ELSE(0)', 'IF("a  b"=="x")THEN(1)ELSE(0)'),
    ],
)
def test_repairs(text, want):
    assert repair(text) == want
    parse(want)


def test_prune():
    text = 'IF("p_TIMEKEY" > 300)THEN("late")ELSEIF(200 < p_TIMEKEY)THEN("mid")ELSE("early")'
    assert [prune(text, "p_timekey", v) for v in (50, 250, 350)] == ['"early"', '"mid"', '"late"']
    kept = 'IF(ISNOTEMPTY("A"."X"))THEN(%s)ELSE(0)'
    assert prune(kept % 'IF("p_TIMEKEY" > 100)THEN(("A"."Y") + 1)', "p_TIMEKEY", 50) == kept % "NULL"
    for same in ('IF("p_OTHER" > 1)THEN(1)ELSE(0)', 'IF(AND("p_TIMEKEY" > 1, "A"."F" == "Y"))THEN(1)ELSE(0)', "not a formula(((", "1"):
        assert prune(same, "p_TIMEKEY", 5) == same


def test_lint():
    assert lint.grammar("  ") == ["Empty expression"]
    assert "BOGUS" in lint.grammar('IF(BOGUS("A"."X"))THEN(1)ELSE(0)')[0]
    assert lint.grammar('"A"."X" + "text"')
    assert not lint.grammar('IF(("A"."X"+1)>0)THEN(1)ELSE(0)')
    assert len(lint.check('IF("A"=="B")THEN(1)ELSE(1)')) == 2
    assert lint.check('IF("A"."X">1)THEN(IF("A"."X">1)THEN(2)ELSE(3))ELSE(0)') == ["Repeats a condition that is decided"]
    assert lint.check('IF("A"."X">1 OR "A"."Y">1 AND "A"."Z">1)THEN(2)ELSE(0)') == ["AND inside OR needs parentheses"]
    assert lint.check('IF("A"."X">1)THEN("A"."Y")ELSE(0)', "A", "Y") == ["Reads its own target A.Y"]
    source = "UPDATE A SET Y = 5 WHERE X > 1 -- and Z"
    assert lint.check('IF("A"."X">1)THEN(5)ELSE(NULL)', source=source) == []
    assert set(lint.check('IF("A"."Z">7)THEN(5)ELSE(NULL)', source=lint.without_comments(source))) == {"Unknown name Z", "Unknown number 7", "Drops a WHERE guard"}


def test_explanations():
    text = 'IF(AND("A"."FLG_DEG"=="Y","A"."DPDMax" BETWEEN [1,30]))THEN("SMA0")ELSE(MAX("A"."Bal","A"."Cust"))'
    assert explain(text).split("\n") == ['- If flag deg equals "Y" and DPD max is between 1 and 30:', '  - "SMA0"', "- Otherwise:", "  - the highest bal, evaluated per group of cust"]
    assert laid_out('IF(a>1)THEN(IF(b>2)THEN(3)ELSE(4))ELSE(5)') == "IF (a>1)\n    → IF (b>2)\n        → 3\n    ELSE\n        → 4\nELSE\n    → 5"
    assert laid_out("(((") is None and explain("(((") == "((("
    assert words_of("RefPeriodOverDrawn") == "reference period over drawn"
