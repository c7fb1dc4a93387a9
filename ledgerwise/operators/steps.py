"""The steps of a derivation, as functions from DataFrame to DataFrame.

One step is simultaneous: its right-hand sides read the values before it. A NULL guard keeps
the old value. Merges take sources whose key is unique and fail on others while they run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.compile import Compiler, Scope
from ..functions.syntax import Member, parse

#: Rows up to which a table that was counted is sent to every executor.
SMALL = 100_000
#: Cells that a range join cuts the span of its probe side into, at most.
CELLS = 1024


def small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """df, marked for broadcast only if it has at most `bound` rows; reads bound + 1 of them at most."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def update(df: DataFrame, values: Mapping[str, Column], guard: Column | None = None) -> DataFrame:
    """UPDATE ... SET values WHERE guard; columns that don't exist begin as NULL."""
    old = {c.lower(): c for c in df.columns}
    make = lambda c, v: v if guard is None else F.when(guard, v).otherwise(F.col(f"`{old[c.lower()]}`") if c.lower() in old else F.lit(None))
    return df.withColumns({old.get(c.lower(), c): make(c, v) for c, v in values.items()})


def fold(df: DataFrame, stages: Sequence[tuple[Column | None, Mapping[str, Column]]]) -> DataFrame:
    """Guarded writes in source order; the last that applies wins."""
    return reduce(lambda d, s: update(d, s[1], s[0]), stages, df)


def _unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.first(F.struct(*(rest or [F.lit(1).alias("_")]))).alias("_row"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(f"a merge source repeats a key of {', '.join(keys)}")))
    return one.select(*keys, checked.alias("_row")).where(F.col("_row").isNotNull())


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], matched: Mapping[str, str | Column], insert: Mapping[str, str | Column] | None = None) -> DataFrame:
    """MERGE on equal keys. `matched` and `insert` give target columns from source columns, by name or as expressions over `s`."""
    s = _unique(source, keys).withColumns({f"_k_{k}": F.col(k) for k in keys}).drop(*keys).withColumnRenamed("_row", "s")
    value = lambda v, k: (F.col(f"_k_{v}") if v in keys else F.col(f"s.`{v}`")) if isinstance(v, str) else v
    on = reduce(lambda a, b: a & b, (target[k] == s[f"_k_{k}"] for k in keys))
    both = target.join(s, on, "left")
    hit = F.col("s").isNotNull()
    types = dict(target.dtypes)
    out = both.withColumns({c: F.when(hit, value(v, c)).otherwise(F.col(f"`{c}`")).cast(types[c]) if c in types else F.when(hit, value(v, c)) for c, v in matched.items()})
    out = out.select(*dict.fromkeys([*target.columns, *matched]))
    if insert is None:
        return out
    new = s.join(target, on, "left_anti")
    made = {c: value(v, c) for c, v in insert.items()}
    return out.unionByName(new.select(*(made[c].cast(types[c]).alias(c) if c in types else made[c].alias(c) for c in made)), allowMissingColumns=True)


def delete(df: DataFrame, guard: Column | None = None) -> DataFrame:
    """Rows for which the guard is false or NULL stay."""
    return df.limit(0) if guard is None else df.where(~F.coalesce(guard, F.lit(False)))


def exists(df: DataFrame, other: DataFrame, keys: Mapping[str, str], name: str) -> DataFrame:
    """df with a flag whether a row of other has equal keys: {column of df: column of other}."""
    hits = other.select(*(F.col(v).alias(f"_e_{k}") for k, v in keys.items())).distinct().withColumn(name, F.lit(True))
    on = reduce(lambda a, b: a & b, (df[k] == hits[f"_e_{k}"] for k in keys))
    return df.join(hits, on, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(*(f"_e_{k}" for k in keys))


def effective(df: DataFrame, key: int, low: str = "EffectiveFromTimeKey", high: str = "EffectiveToTimeKey") -> DataFrame:
    """Rows in force at a version key."""
    return df.where((F.col(low) <= key) & (F.col(high) >= key))


def range_join(df: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int | None = None) -> DataFrame:
    """df, each row with the rows of ranges that hold its integer or date `at` between low and high, or with NULLs.

    Both sides are cut into cells, so it is an equi-join whatever the size of ranges; a range is in
    as many rows as it has cells between the least and the greatest `at`, CELLS at most.
    """
    num = lambda c: F.datediff(c, F.lit(dt.date(1970, 1, 1))) if dict([*df.dtypes, *ranges.dtypes]).get(at, "").startswith(("date", "timestamp")) else c
    least, most = (x if x is not None else 0 for x in df.agg(F.min(num(F.col(at))).cast("bigint"), F.max(num(F.col(at))).cast("bigint")).first())
    width = max(width or 1, (most - least) // CELLS + 1)
    first, last = F.floor(F.greatest(num(F.col(low)), F.lit(least)) / width), F.floor(F.least(num(F.col(high)), F.lit(most)) / width)
    cells = ranges.where((num(F.col(low)) <= most) & (num(F.col(high)) >= least) & (F.col(low) <= F.col(high))).withColumn("_cell", F.explode(F.sequence(first, last)))
    on = (F.col("_at") == F.col("_cell")) & (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    return df.withColumn("_at", F.floor(num(F.col(at)) / width)).join(cells, on, "left").drop("_at", "_cell")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with the number of each row, from 1, in an order: ranges are sorted apart and begin after the rows of those before."""
    from ..sources.store import stash

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = stash(rows, "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes, start = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()), {}  # one row a partition
    total = 0
    for p, n in sizes:
        start[p], total = total, total + n
    starts = F.broadcast(df.sparkSession.createDataFrame(list(start.items()), "__part bigint, __start bigint"))
    return rows.join(starts, part == F.col("__part")).withColumn(name, F.col("__start") + place + 1).drop("__part", "__start", "__at")


def hierarchy(edges: DataFrame, roots: Sequence[object], child: str = "child", parent: str = "parent") -> DataFrame:
    """The distinct members (id) of the trees under roots, roots included; one join for each level until none is new, which cycles end too."""
    from ..sources.store import stash

    spark = edges.sparkSession
    kind = dict(edges.dtypes)[parent]
    found = spark.createDataFrame([(r,) for r in roots], "id string").select(F.col("id").cast(kind)) if kind != "string" else spark.createDataFrame([(str(r),) for r in roots], "id string")
    edges, found = edges.select(F.col(child).cast(kind).alias("c"), F.col(parent).alias("p")), found.distinct()
    level = found
    while True:
        level = stash(edges.join(level, F.col("p") == F.col("id")).select(F.col("c").alias("id")).distinct().join(found, "id", "left_anti"), "level")
        if level.isEmpty():
            break
        found = stash(found.unionByName(level), "members")
    return found


def derive(df: DataFrame, target: str, text: str, parameters: Mapping[str, object] | None = None, business_date: dt.date | None = None, hierarchies: Mapping[str, DataFrame] | None = None, **scope) -> DataFrame:
    """df with a column from a formula. hierarchies: (child, parent) edges by the column tested."""
    tree, s = parse(text), Scope(df.schema, parameters or {}, business_date, frame=df, **scope)
    extra = []
    for n in dict.fromkeys(x for x in tree.walk() if isinstance(x, Member) and x.op.startswith("HRCHY")):
        name = n.left.parts[-1]
        flag = f"_member_{len(extra)}"
        members = hierarchy({k.lower(): v for k, v in (hierarchies or {}).items()}[name.lower()], n.values).withColumn(flag, F.lit(True))
        df = df.join(members.withColumnRenamed("id", f"_id{flag}"), F.col(name) == F.col(f"_id{flag}"), "left").drop(f"_id{flag}")
        s.flags[n] = flag
        extra.append(flag)
    return df.withColumn(target, Compiler(s).value(tree).column).drop(*extra)


def decision_table(df: DataFrame, column: str, buckets: Sequence[Mapping[str, object]], target: str, low: str = "min", high: str = "max", value: str = "value", otherwise: object = None) -> DataFrame:
    """df with the value of the first bucket whose inclusive bounds hold the column; open bounds are None."""
    out = None
    for b in buckets:
        test = F.lit(True)
        if b.get(low) is not None:
            test = test & (F.col(column) >= F.lit(b[low]))
        if b.get(high) is not None:
            test = test & (F.col(column) <= F.lit(b[high]))
        out = (F if out is None else out).when(F.col(column).isNotNull() & test, F.lit(b[value]))
    return df.withColumn(target, out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise))


def least_known(*columns: str) -> Column:
    """LEAST that is NULL if any argument is."""
    return F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)), F.least(*columns))


def arg_max(labels: Mapping[str, Column]) -> Column:
    """The label of the largest value; the first of equals."""
    top = F.greatest(*labels.values()) if len(labels) > 1 else next(iter(labels.values()))
    out = None
    for label, c in labels.items():
        out = (F if out is None else out).when(c == top, F.lit(label))
    return out
