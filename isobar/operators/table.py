"""Relational operators on tables."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.functions import calendars, expressions
from isobar.functions.coordinates import equal
from isobar.functions.geometry import Polygon, basin, point_in


def evaluate_expression(df: DataFrame, expression: str, result: str, remove_dependent_variables: bool = False) -> DataFrame:
    """A new column from an infix expression."""
    value, _ = expressions.to_column(expression, df.schema)
    out = df.withColumn(result, value)
    gone = [v for v in expressions.variables(expression) if v != result]
    return out.drop(*gone) if remove_dependent_variables else out


def remove_rows(df: DataFrame, mask_expression: str, remove_dependent_variables: bool = False) -> DataFrame:
    """Drops the rows where the expression is true; rows where it is null stay."""
    mask = expressions.truth(df, mask_expression)
    out = df.where(~F.coalesce(mask, F.lit(False)))
    return out.drop(*expressions.variables(mask_expression)) if remove_dependent_variables else out


def sort(df: DataFrame, column: str | int, ascending: bool = True, stable_by: list[str] | None = None) -> DataFrame:
    """The whole table sorted by a column (by name or position), ties by the columns stable_by. A range shuffle, not one task."""
    name = df.columns[column] if isinstance(column, int) else column
    key = F.col(name).asc() if ascending else F.col(name).desc()
    return df.orderBy(key, *(stable_by or []))


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Row numbers from 0 in a total order, without a single-task window.

    Rows are dealt by ranges of the order; each range is numbered on its own and shifted by the sizes of the ranges before. The
    ranges are kept (in memory, beyond it on disk), since Spark samples their bounds anew for each plan.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row for each partition
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (own - 1 + F.col("__before")).cast("long")).drop("__part", "__before")


def join_by_position(tables: list[DataFrame], orders: list[list[str]], check: bool = True) -> DataFrame:
    """Columns of several tables side by side, row n with row n; a name in several comes from the first that has it.

    Row counts that differ are an error if `check`, raised when the plan runs.
    """
    parts = [numbered(t, o, "__row") for t, o in zip(tables, orders, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        own = [c for c in p.columns if c == "__row" or c not in out.columns]
        out = out.withColumn("__left", F.lit(True)).join(p.select(*own, F.lit(True).alias("__right")), "__row", "full" if check else "left")
        if check:
            paired = F.col("__left").isNotNull() & F.col("__right").isNotNull()
            out = out.withColumn("__row", F.when(paired, F.col("__row")).otherwise(F.raise_error(F.lit("tables of unlike length")).cast("long")))
        out = out.drop("__left", "__right")
    return out.withColumnRenamed("__row", "row_id")


def concatenate(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, matched by name; other columns are an error."""
    names = set(tables[0].columns)
    for t in tables[1:]:
        if set(t.columns) != names:
            raise ValueError(f"columns differ: {sorted(names ^ set(t.columns))}")
    return reduce(DataFrame.unionByName, tables)


def concatenate_by_position(tables: list[DataFrame]) -> DataFrame:
    if len({len(t.columns) for t in tables}) > 1:
        raise ValueError("numbers of columns differ")
    return reduce(DataFrame.union, tables)


def region_mask(df: DataFrame, x: str, y: str, polygons: list[Polygon] | str, result: str = "mask", invert: bool = False) -> DataFrame:
    """A short column: 1 in any of the polygons (or of a cyclone basin, by name), else 0."""
    inside = point_in(F.col(x), F.col(y), basin(polygons) if isinstance(polygons, str) else polygons)
    return df.withColumn(result, (~inside if invert else inside).cast("smallint"))


def table_calendar(df: DataFrame, units: str, calendar: str, time: str = "time", prefix: str = "", second: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """Year, month, day, hour and minute (and second) of a CF time column, before the other columns."""
    parts = calendars.decode(F.col(time), units, calendar)
    wanted = ["year", "month", "day", "hour", "minute"] + ["second"] * second
    new = [parts[p].alias(prefix + (names or {}).get(p, p)) for p in wanted]
    return df.select(*new, *df.columns)


#: Accuracy of the sketches that bracket an order statistic: its rank is known to within a share of 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: The order statistics of `descriptive_statistics`: the elements at n * q // 4 of the sorted values.
QUARTERS = {"low_q": 1, "med": 2, "up_q": 3}


def descriptive_statistics(df: DataFrame, variables: list[str], by: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """Minimum, maximum, mean, population variance, and the elements at n/4, n/2 and 3n/4 of the sorted values.

    Two scans for all variables, and no sort of a group's rows. The first gives the moments and, by mergeable sketches, two values
    between which each order statistic must lie. The second counts the values below them and how often each value between them occurs
    (both combined before the shuffle); the ranks of these few values give the exact elements. Nulls do not count; a group without values has
    nulls; null groups are groups. Values of other types than doubles hold exactly (decimals, longs, dates) are ranked by a sort of the group.
    """
    by = by or ["step", "time"]
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    quick = [v for v in variables if kinds[v] in ("byte", "short", "integer", "float", "double")]
    margin = 4.0 / accuracy
    shares = [min(1.0, max(0.0, q / 4 + side)) for q in QUARTERS.values() for side in (-margin, margin)]
    moments = [f for v in variables for f in (F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), F.avg(v).alias(f"avg_{v}"), F.var_pop(v).alias(f"var_{v}"))]
    sketches = [f for n, v in enumerate(quick) for f in (F.count(v).alias(f"__n{n}"), F.percentile_approx(F.col(v).cast("double"), shares, accuracy).alias(f"__b{n}"))]
    first = df.groupBy(*by).agg(*moments, *sketches)
    same = lambda a, b: reduce(Column.__and__, (a[c].eqNullSafe(b[f"__by{k}"]) for k, c in enumerate(by)))
    keyed = lambda d: d.withColumnsRenamed({c: f"__by{k}" for k, c in enumerate(by)})
    out = first.select(*by, *(f"{f}_{v}" for v in variables for f in ("min", "max", "avg", "var")), *(f"__n{n}" for n in range(len(quick))))
    if quick:
        bounds = keyed(first.select(*by, *(f"__{c}{n}" for n in range(len(quick)) for c in "nb")))
        values = df.select(*by, *(F.col(v).cast("double").alias(f"__v{n}") for n, v in enumerate(quick)))
        told = []
        for n in range(len(quick)):
            for k in range(len(QUARTERS)):
                x, low, high = F.col(f"__v{n}"), F.col(f"__b{n}")[2 * k], F.col(f"__b{n}")[2 * k + 1]
                told.append(F.when(x <= high, F.struct(F.lit(n * len(QUARTERS) + k).alias("q"), F.when(x >= low, x).alias("x"), F.col(f"__n{n}").alias("n"))))
        each = values.join(bounds, same(values, bounds)).select(*by, F.explode(F.filter(F.array(*told), lambda t: t.isNotNull())).alias("__t"))
        counted = each.groupBy(*by, F.col("__t.q").alias("__q"), F.col("__t.x").alias("__x")).agg(F.count("*").alias("__c"), F.first("__t.n").alias("__n"))
        upto = F.sum("__c").over(W.partitionBy(*by, "__q").orderBy(F.col("__x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
        rank = F.expr(f"__n * (__q % {len(QUARTERS)} + 1) div 4")
        hit = counted.withColumn("__upto", upto).where((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank))
        picks = keyed(hit.groupBy(*by).agg(*(F.max(F.when(F.col("__q") == n * len(QUARTERS) + k, F.col("__x"))).alias(f"__x{n}_{k}") for n in range(len(quick)) for k in range(len(QUARTERS)))))
        out = out.join(picks, same(out, picks), "left")
        for n, v in enumerate(quick):
            for k, name in enumerate(QUARTERS):
                x = F.col(f"__x{n}_{k}")
                missed = x.isNull() & (F.col(f"__n{n}") > 0)
                out = out.withColumn(f"{name}_{v}", F.when(missed, F.raise_error(F.lit(f"{name} of {v} lies outside its bracket; raise accuracy")).cast("double")).otherwise(x).cast(kinds[v]))
    for v in (v for v in variables if v not in quick):
        w = W.partitionBy(*by)
        ranked = df.where(F.col(v).isNotNull()).select(*by, v).withColumn("__r", F.row_number().over(w.orderBy(v)) - 1).withColumn("__n", F.count("*").over(w))
        picks = keyed(ranked.groupBy(*by).agg(*(F.max(F.when(F.col("__r") == F.expr(f"__n * {q} div 4"), F.col(v))).alias(f"{name}_{v}") for name, q in QUARTERS.items())))
        out = out.join(picks, same(out, picks), "left").drop(*(f"__by{k}" for k in range(len(by))))
    return out.select(*by, *(f"{f}_{v}" for v in variables for f in ("min", "max", "avg", "var")), *(f"{name}_{v}" for v in variables for name in QUARTERS))


def component_statistics(areas: DataFrame, label: str = "label", area: str = "area") -> DataFrame:
    """step, time, global id (step * 1000000 + id), id and area of each component."""
    return areas.select("step", "time", (F.col("step") * 1_000_000 + F.col(label)).cast("long").alias("global_component_ids"), F.col(label).alias("component_ids"), F.col(area).alias("component_area"))


def dataset_diff(left: DataFrame, right: DataFrame, keys: list[str], absolute: float = 1e-6, relative: float = 1e-6, skip: list[str] | None = None) -> DataFrame:
    """The differences of two keyed tables: a row for each key and column that differ beyond both tolerances.

    status is `value`, `left only` or `right only`. Columns in one table only are an error. Two nulls, and
    two NaNs, are equal.
    """
    names = [c for c in left.columns if c not in keys and c not in (skip or [])]
    if set(names) != {c for c in right.columns if c not in keys and c not in (skip or [])}:
        raise ValueError("the tables have unlike columns")
    a = left.select(*keys, F.struct(*names).alias("__a"))
    b = right.select(*keys, F.struct(*names).alias("__b"))
    joined = a.join(b, keys, "full")
    numeric = {f.name for f in left.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}

    def differs(n: str) -> Column:
        x, y = F.col(f"__a.{n}"), F.col(f"__b.{n}")
        if n not in numeric:
            return ~x.eqNullSafe(y)
        x, y = x.cast("double"), y.cast("double")
        return ~(x.eqNullSafe(y) | F.coalesce(equal(x, y, relative=relative, absolute=absolute), F.lit(False)))

    missing = F.when(F.col("__b").isNull(), "left only").when(F.col("__a").isNull(), "right only")
    text = lambda side, n: F.col(f"{side}.{n}").cast("string")
    found = F.array(*(F.when(missing.isNull() & differs(n), F.struct(F.lit(n).alias("column"), text("__a", n).alias("left"), text("__b", n).alias("right"), F.lit("value").alias("status"))) for n in names))
    gone = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), missing.alias("status")))
    rows = F.when(missing.isNotNull(), gone).otherwise(F.array_compact(found))
    return joined.select(*keys, F.explode(rows).alias("__d")).select(*keys, "__d.*")


def assert_same(left: DataFrame, right: DataFrame, keys: list[str], **kw: object) -> None:
    """Fails on the first differences."""
    found = dataset_diff(left, right, keys, **kw).limit(5).collect()
    if found:
        raise AssertionError(f"tables differ: {found}")


def row_range(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """The rows first to last (inclusive) of an order."""
    return numbered(df, order, "__row").where(F.col("__row").between(first, last)).drop("__row")


def to_text(df: DataFrame, header: str = "", footer: str = "", rows: int = 1000) -> str:
    """A table as text for display: at most `rows` rows."""
    body = df.limit(rows).toPandas().to_string(index=False)
    return "\n".join(x for x in (header, body, footer) if x)
