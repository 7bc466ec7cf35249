"""SQL that users write, over tables narrowed to one key.

A text is looked at twice, as objects and never as printed text. Its parsed plan may hold nodes of
queries only and name only functions of an allow-list, the tables given and its own common table
expressions, so nothing is executed or looked up while it is analysed. The analysed plan may hold only
nodes and expressions of an allow-list: what isn't known to be harmless is refused, wherever it stands."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from functools import cache

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.session import Tables


class RefusedError(ValueError):
    """The text isn't one plain SELECT over the tables allowed."""

    code = "INVALID_QUERY"


#: Nodes that only shape rows, and those that stand for them before analysis.
NODES = set("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin Union Distinct Intersect Except SubqueryAlias Window WithCTE CTERelationDef CTERelationRef OneRowRelation LocalRelation Generate Expand Pivot Unpivot".split())
PARSED = NODES | set("UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable WithWindowDefinition".split())

#: Functions by their SQL names.
FUNCTIONS = (
    "count count_if sum avg mean min max min_by max_by median percentile percentile_approx approx_count_distinct stddev stddev_pop variance var_pop corr any_value bool_and bool_or every first first_value last last_value nth_value "
    "collect_list collect_set array_agg listagg string_agg row_number rank dense_rank percent_rank cume_dist ntile lag lead "
    "abs round bround floor ceil ceiling sqrt exp ln log10 power pow mod pmod sign greatest least coalesce nvl nvl2 ifnull nullif nanvl if isnull isnotnull isnan "
    "between lower upper trim ltrim rtrim btrim length char_length substring substr left right replace translate concat concat_ws split split_part instr locate lpad rpad initcap reverse contains startswith endswith like ilike rlike regexp_like regexp_extract regexp_replace regexp_count "
    "year month day dayofmonth dayofweek dayofyear quarter weekofyear hour minute second date_trunc trunc date_add date_sub datediff add_months months_between last_day to_date to_timestamp date_format make_date extract date_part "
    "array size cardinality array_contains array_distinct array_max array_min array_sort array_join element_at try_element_at explode explode_outer posexplode inline map_keys map_values struct named_struct try_divide try_cast"
).split()

#: What operators, literals and clauses become.
SYNTAX = set(
    "Alias AttributeReference OuterReference LateralColumnAliasReference TempResolvedColumn Literal Cast And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between In InSet InSubquery ListQuery Exists ScalarSubquery "
    "IsNull IsNotNull IsNaN Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny CaseWhen If Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Concat GetArrayItem GetStructField GetMapValue SortOrder "
    "PivotFirst Explode PosExplode Inline AggregateExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame UnboundedPreceding UnboundedFollowing CurrentRow DateAdd DateSub DateDiff DateAddInterval SubtractDates SubtractTimestamps TimestampAddInterval DateAddYMInterval TimestampAddYMInterval".split()  # fmt: skip
)


def _all(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.size()):
        yield seq.apply(i)


def _name(o: JavaObject) -> str:
    return o.getClass().getSimpleName().rstrip("$")


@cache
def _kind(jvm: object, name: str) -> JavaObject:
    return jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")


def _functions(spark: SparkSession) -> set[str]:
    """The classes that Spark's own registry gives the names allowed."""
    out, jvm = set(), spark._jvm
    known = spark._jsparkSession.sessionState().functionRegistry()
    for name in FUNCTIONS:
        found = known.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if found.isDefined():
            out.add(found.get().getClassName().rsplit(".", 1)[-1])
    return out


class _Walk:
    """All nodes and expressions of a plan, those of subqueries too."""

    def __init__(self, spark: SparkSession, nodes: set[str], expressions: set[str] | None, tables: set[str]) -> None:
        self.jvm, self.nodes, self.expressions, self.tables = spark._jvm, nodes, expressions, tables

    def plan(self, p: JavaObject, names: frozenset[str] = frozenset()) -> None:
        kind = _name(p)
        if kind == "UnresolvedRelation":
            parts = list(_all(p.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in self.tables | names:
                raise RefusedError(f"not allowed: {'.'.join(parts)}")
            return
        if kind == "View":
            if not p.isTempView() or p.desc().identifier().table().lower() not in self.tables:
                raise RefusedError("not allowed: another view")
            return
        if kind not in self.nodes:
            raise RefusedError(f"{kind} not allowed")
        if kind == "UnresolvedWith":
            for pair in _all(p.cteRelations()):
                self.plan(pair.productElement(1), names)
                names = names | {pair.productElement(0).lower()}
        for e in _all(p.expressions()):
            self.expression(e, names)
        for child in _all(p.children()):
            self.plan(child, names)

    def expression(self, e: JavaObject, names: frozenset[str]) -> None:
        kind = _name(e)
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            # analysis itself evaluates some, so a name that isn't known goes no further
            called = list(_all(e.nameParts())) if kind == "UnresolvedFunction" else [e.name().funcName()]
            if len(called) != 1 or called[0].lower() not in FUNCTIONS:
                raise RefusedError(f"{'.'.join(called)} not allowed")
        if self.expressions is not None and kind not in self.expressions:
            raise RefusedError(f"{e.prettyName()} not allowed")
        if _kind(self.jvm, "expressions.PlanExpression").isInstance(e):
            self.plan(e.plan(), names)
        # what Spark itself puts in a function's place isn't the user's; the arguments are
        own = e.parameters() if _kind(self.jvm, "expressions.InheritAnalysisRules").isInstance(e) else e.children()
        for child in _all(own):
            self.expression(child, names)


def views(t: Tables, tables: list[str], key: str | None, value: object, via: dict[str, tuple[str, str, str]]) -> Tables:
    """Views g_<table> of the rows of one key, in a session of their own. A table without the
    key is narrowed through another: via names its column, that table and that table's column."""
    out = Tables(t.spark.newSession(), t.path)
    seen: dict[str, DataFrame] = {}

    def narrowed(name: str) -> DataFrame:
        if name not in seen:
            df = getattr(out, name)
            if key and key in df.columns:
                df = df.filter(F.col(key) == F.lit(value))
            elif key and name in via:
                own, parent, theirs = via[name]
                df = df.join(narrowed(parent).select(F.col(theirs).alias(own)).distinct(), own, "left_semi")
            elif key:
                raise ValueError(f"{name} has no {key}: name the table that it is narrowed through")
            seen[name] = df
        return seen[name]

    for name in tables:
        narrowed(name).createOrReplaceTempView(f"g_{name}")
    return out


def guarded(t: Tables, sql: str, tables: list[str], key: str | None = None, value: object = None, rows: int = 1000, via: dict[str, tuple[str, str, str]] | None = None, args: dict[str, object] | None = None) -> DataFrame:
    """One SELECT over views g_<table> of the tables allowed, narrowed to a key, of `rows` rows at
    most; args are the values of markers as :name. All else is refused."""
    names = {f"g_{n}".lower() for n in tables}
    spark = views(t, tables, key, value, via or {}).spark
    try:
        _Walk(spark, PARSED, None, names).plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
    except ParseException as e:
        raise RefusedError(f"not a query: {str(e)[:200]}") from e
    try:
        df = spark.sql(sql, args=args or {})  # no command, so nothing runs yet
    except AnalysisException as e:
        raise RefusedError(f"not a query: {str(e)[:200]}") from e
    _Walk(spark, NODES, SYNTAX | _functions(spark), names).plan(df._jdf.queryExecution().analyzed())
    return df.limit(rows)


def answer(df: DataFrame, limit: int = 100, seconds: float = 5.0) -> dict[str, object]:
    """The explorer's reply: columns, rows, row_count, truncated, execution_time_ms; a query
    that takes longer than `seconds` is cancelled."""
    limit = max(0, min(limit, 1000))
    sc, group = df.sparkSession.sparkContext, f"explorer-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer, began = threading.Timer(seconds, stop), time.perf_counter()
    sc.setJobGroup(group, "explorer", interruptOnCancel=True)
    timer.start()
    try:
        got = df.limit(limit + 1).collect()
    except Exception as e:
        if late.is_set():
            raise RefusedError(f"stopped after {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.setJobGroup("", "")
    return {"columns": df.columns, "rows": [list(r) for r in got[:limit]], "row_count": min(len(got), limit), "truncated": len(got) > limit, "execution_time_ms": round(1000 * (time.perf_counter() - began))}


#: The explorer's ready queries, over orders as facts and line items as what hangs below them.
PRESETS = {
    "by_year": "SELECT year(o_orderdate) AS year, o_orderpriority AS level, o_totalprice AS price FROM g_orders WHERE o_custkey = :key ORDER BY year DESC, level",
    "windows": "SELECT year(o_orderdate) AS year, o_orderpriority AS level, o_orderstatus AS status FROM g_orders WHERE o_custkey = :key ORDER BY year DESC",
    "recent": "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS at FROM g_orders WHERE o_custkey = :key ORDER BY at DESC, id DESC LIMIT 20",
    "sources": "SELECT year(l_shipdate) AS year, l_returnflag AS kind, count(*) AS n FROM g_lineitem GROUP BY 1, 2 ORDER BY year DESC, kind",
    "trend": "SELECT o_orderpriority AS level, year(o_orderdate) AS year, round(avg(o_totalprice), 2) AS price FROM g_orders WHERE o_custkey = :key AND year(o_orderdate) >= 1994 GROUP BY 1, 2 ORDER BY level, year",
}
VIA = {"lineitem": ("l_orderkey", "orders", "o_orderkey")}


def preset(t: Tables, name: str, key: object) -> DataFrame:
    return guarded(t, PRESETS[name], ["orders", "lineitem"], "o_custkey", key, via=VIA, args={"key": key})
