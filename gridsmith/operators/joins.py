"""Joins that need more than an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell for each task that it is dealt to.
HOT = 5_000
#: Side of a cell in widths: a point reaches into 1.25 cells an axis on average.
SIDE = 4


def with_defaults(base: DataFrame, others: list[DataFrame], key: str, zero: list[str]) -> DataFrame:
    """base with each aggregate left-joined by key, nulls of the named columns as 0."""
    for other in others:
        base = base.join(other, key, "left")
    return base.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def first_match(df: DataFrame, array: str, lookup: DataFrame, item: str, value: str, key: str) -> DataFrame:
    """(key, value): for each key the value of the first array element found in the lookup."""
    spread = df.select(key, F.posexplode(array).alias("_pos", item))
    return spread.join(lookup.select(item, value), item).groupBy(key).agg(F.min_by(value, "_pos").alias(value))


def band(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, width: float, order: list[Column] | None = None, key: str | None = None, hot: int = HOT) -> DataFrame:
    """Pairs within `width` on both axes; with order and key, the first hit of each key.

    Cells of SIDE widths are joined by equality; a row of the right side stands in the cells that its
    band reaches, mostly one, four at most. A cell with more than `hot` rows of the left is cut: those
    rows are dealt to so many parts, and the right's rows of that cell alone are repeated for each."""
    cell = lambda c: F.floor(c / F.lit(SIDE * width)).cast("long")
    # a hair wider, so that rounding rules out no cell
    reach = lambda c: F.sequence(cell(F.col(c) - width * (1 + 1e-9)), cell(F.col(c) + width * (1 + 1e-9)))
    a = left.filter(F.col(lx).isNotNull() & F.col(ly).isNotNull()).withColumns({"_cx": cell(F.col(lx)), "_cy": cell(F.col(ly))})
    # over all cores: a row meets many, and a table of few splits may stay where the other side is sent to it
    spread = right.filter(F.col(rx).isNotNull() & F.col(ry).isNotNull()).repartition(4 * right.sparkSession.sparkContext.defaultParallelism, *right.columns)
    b = spread.withColumn("_cx", F.explode(reach(rx))).withColumn("_cy", F.explode(reach(ry)))
    near = (F.abs(F.col(lx) - F.col(rx)) < width) & (F.abs(F.col(ly) - F.col(ry)) < width)
    if left.limit(hot + 1).count() <= hot:  # so no cell is crowded
        hits = a.join(b, ["_cx", "_cy"]).filter(near).drop("_cx", "_cy")
    else:
        hits = _cut(a, b, left.columns, hot).filter(near).drop("_cx", "_cy", "_p")
    if order is None or key is None:
        return hits
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def _cut(a: DataFrame, b: DataFrame, columns: list[str], hot: int) -> DataFrame:
    """Rows of equal cells, those of crowded ones in parts."""
    crowded = a.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / hot).cast("int").alias("_k")).filter("_k > 1")
    cut = lambda df, some: df.join(crowded, ["_cx", "_cy"], "left").withColumn("_p", some(F.coalesce("_k", F.lit(1)))).drop("_k")
    a = cut(a, lambda k: F.pmod(F.xxhash64(*[F.col(c) for c in columns]), k).cast("int"))
    b = cut(b, lambda k: F.explode(F.sequence(F.lit(0), k - 1)))
    return a.join(b, ["_cx", "_cy", "_p"])
