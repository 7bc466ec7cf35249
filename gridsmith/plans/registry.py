"""Registry statistics: units to locations to connection points to operators (X2), and
their parts. In the driver's tables a nation is an operator, a customer a connection
point, an order a location and a line item a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.operators.joins import with_defaults
from gridsmith.registry import query
from gridsmith.session import Tables

SEGMENTS = {"ns": "HOUSEHOLD", "ms": "BUILDING", "hs": "MACHINERY", "hoe": "AUTOMOBILE"}


def chain(t: Tables) -> DataFrame:
    """Unit to location to connection point to operator, inner hops."""
    units = t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    return units.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")


def level_counts(cp: DataFrame) -> DataFrame:
    """A1: connection points of each operator by level, with the rest and all."""
    known = F.col("c_mktsegment").isin(*SEGMENTS.values())
    return cp.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        *(F.count_if(F.col("c_mktsegment") == v).alias(f"cp_{k}") for k, v in SEGMENTS.items()), F.count_if(~known).alias("cp_other"), F.count("*").alias("cp_total")
    )


def chained_units(t: Tables, only: str = "true") -> DataFrame:
    """n_nationkey, flag, amount and n of the units that `only` keeps. Units are added up by
    order and source before the hops, so fewer rows are shuffled to orders and customers."""
    units = t.lineitem.filter(only).groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).alias("amount"), F.count("*").alias("n"))
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    return units.join(orders, "l_orderkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")


def capacity(units: DataFrame, count: bool = False) -> DataFrame:
    """A3: capacity by source in thousands, exact decimals; missing sources are 0. With
    count, the number of units too."""
    mega = lambda flag: (F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("amount"))), F.lit(0)) / 1000).cast("decimal(18,6)").cast("double")
    more = [F.sum("n").alias("n_units")] if count else []
    return units.groupBy("n_nationkey").agg(*(mega(f).alias(n) for n, f in (("cap_solar", "A"), ("cap_wind", "N"), ("cap_storage", "R"))), (F.sum("amount") / 1000).cast("decimal(18,6)").cast("double").alias("cap_total"), *more)


def registry_stats(t: Tables, quick: bool = False) -> DataFrame:
    """X2 and A5. quick leaves out the units, whose branch is then never planned."""
    cps = level_counts(t.customer)
    names = [*(f"cp_{k}" for k in SEGMENTS), "cp_other", "cp_total"]
    parts, zero = [cps], names
    if not quick:
        parts.append(capacity(chained_units(t, "l_linestatus = 'O'"), count=True))
        zero = [*names, "cap_solar", "cap_wind", "cap_storage", "cap_total", "n_units"]
    base = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    out = with_defaults(base, parts, "n_nationkey", zero)
    return out if quick else out.withColumn("has_full_data", (F.col("cp_total") > 0) & (F.col("n_units") > 0))


_CP = ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{v}') AS cp_{k}" for k, v in SEGMENTS.items())
_CP += ", count(*) FILTER (WHERE c_mktsegment NOT IN ('HOUSEHOLD','BUILDING','MACHINERY','AUTOMOBILE')) AS cp_other, count(*) AS cp_total"
_CAP = ", ".join(f"CAST(CAST(coalesce(sum(CASE WHEN l_returnflag = '{f}' THEN CAST(l_quantity AS DECIMAL(18,4)) END), 0) / 1000 AS DECIMAL(18,6)) AS DOUBLE) AS {n}" for n, f in (("cap_solar", "A"), ("cap_wind", "N"), ("cap_storage", "R")))
_CAP += ", CAST(CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) / 1000 AS DECIMAL(18,6)) AS DOUBLE) AS cap_total"
_CHAIN = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["cp_ns", "cp_ms", "cp_hs", "cp_hoe", "cp_other", "cp_total"])


@query(
    "x2_registry_stats",
    f"""WITH cp AS (SELECT c_nationkey AS k, {_CP} FROM customer GROUP BY 1),
    u AS (SELECT c_nationkey AS k, {_CAP}, count(*) AS n_units FROM {_CHAIN} WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT n_nationkey, n_name, r_name, {_ZERO}, coalesce(cap_solar, 0) AS cap_solar, coalesce(cap_wind, 0) AS cap_wind, coalesce(cap_storage, 0) AS cap_storage,
    coalesce(cap_total, 0) AS cap_total, coalesce(n_units, 0) AS n_units, coalesce(cp_total, 0) > 0 AND coalesce(n_units, 0) > 0 AS has_full_data
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN cp ON cp.k = n_nationkey LEFT JOIN u ON u.k = n_nationkey""",
)
def x2(t: Tables) -> DataFrame:
    return registry_stats(t)


@query("x2_registry_stats_quick", f"WITH cp AS (SELECT c_nationkey AS k, {_CP} FROM customer GROUP BY 1) SELECT n_nationkey, n_name, r_name, {_ZERO} FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN cp ON cp.k = n_nationkey")
def x2_quick(t: Tables) -> DataFrame:
    return registry_stats(t, quick=True)


@query("j1_unit_operator_chain", f"SELECT c_nationkey AS n_nationkey, count(*) AS n_units FROM {_CHAIN} GROUP BY 1")
def j1(t: Tables) -> DataFrame:
    return chain(t).groupBy("n_nationkey").agg(F.count("*").alias("n_units"))


@query("a1_level_counts", f"SELECT c_nationkey AS n_nationkey, {_CP} FROM customer GROUP BY 1")
def a1(t: Tables) -> DataFrame:
    return level_counts(t.customer)


@query("a3_capacity_by_source", f"SELECT c_nationkey AS n_nationkey, {_CAP} FROM {_CHAIN} GROUP BY 1")
def a3(t: Tables) -> DataFrame:
    return capacity(chained_units(t))


@query(
    "j4_left_join_defaults",
    f"WITH cp AS (SELECT c_nationkey AS k, {_CP} FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT n_nationkey, {_ZERO} FROM nation LEFT JOIN cp ON cp.k = n_nationkey",
)
def j4(t: Tables) -> DataFrame:
    return with_defaults(t.nation.select("n_nationkey"), [level_counts(t.customer.filter("c_acctbal > 9000"))], "n_nationkey", [*(f"cp_{k}" for k in SEGMENTS), "cp_other", "cp_total"])


@query("a6_export_metadata", "WITH cp AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT count(*) AS operators, count(*) FILTER (WHERE n > 0) AS with_cp, count(*) FILTER (WHERE n > 60) AS large FROM nation LEFT JOIN cp ON k = n_nationkey")
def a6(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return t.nation.join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").agg(F.count("*").alias("operators"), F.count_if(F.col("n") > 0).alias("with_cp"), F.count_if(F.col("n") > 60).alias("large"))


@query("a5_final_stats", f"WITH u AS (SELECT c_nationkey AS k, count(*) AS n FROM {_CHAIN} GROUP BY 1) SELECT n_nationkey, coalesce(n, 0) AS n_units, coalesce(n, 0) > 0 AS has_full_data FROM nation LEFT JOIN u ON k = n_nationkey")
def a5(t: Tables) -> DataFrame:
    n = chain(t).groupBy("n_nationkey").agg(F.count("*").alias("n_units"))
    return with_defaults(t.nation.select("n_nationkey"), [n], "n_nationkey", ["n_units"]).withColumn("has_full_data", F.col("n_units") > 0)
