"""Read-only SQL with bounds, documented recipes, and search, sort and paging of a result."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SQL_BYTES, MOST_ROWS, MOST_COLUMNS, MOST_RESULT_BYTES, MOST_SECONDS = 64 * 1024, 1000, 128, 8 * 1024 * 1024, 15
#: Nodes of a parsed statement that only read; every other one (commands, writes, scripts) is refused.
_READS = {
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "LateralJoin",
    "UnresolvedRelation", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Union", "Except", "Intersect", "Generate",
    "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "WithWindowDefinition", "Window", "Pivot", "Unpivot", "Sample",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedHint",
}
#: Functions that call any static method, by name and as they stand in an analysed plan.
_REFLECTS, _REFLECTION = {"java_method", "reflect", "try_reflect"}, {"CallMethodViaReflection", "TryReflect"}
#: Leaves of an analysed plan that hold literal rows.
_LITERALS = {"OneRowRelation", "LocalRelation", "ResolvedInlineTable", "Range", "CTERelationRef"}


_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _each(found) -> list:
    return [found.apply(k) for k in range(found.size())]


def _nodes(node, of_plan: bool = True) -> Iterator[tuple]:
    """(node, whether it is a plan's) of a plan, its expressions, its named parts and all subqueries in them."""
    yield node, of_plan
    for child in _each(node.children()):
        yield from _nodes(child, of_plan)
    if of_plan:
        for expression in _each(node.expressions()):
            yield from _nodes(expression, False)
        if _kind(node) == "UnresolvedWith":
            for named in _each(node.innerChildren()):
                yield from _nodes(named)
        if _kind(node) == "WithWindowDefinition":  # its windows are no expressions of the node
            for named in _each(node.windowDefinitions().values().toSeq()):
                yield from _nodes(named, False)
        elif _kind(node) == "WithCTE":
            for named in _each(node.cteDefs()):
                yield from _nodes(named)
    elif _kind(node) in _SUBQUERIES:
        yield from _nodes(node.plan())


def _leaves(node) -> Iterator:
    """The leaves that a plan reads, those of registered views left out: what is below a view's name is the session's own."""
    if _kind(node) == "View":
        return
    children = _each(node.children())
    if not children:
        yield node
    for child in children:
        yield from _leaves(child)
    for expression in _each(node.expressions()):
        for found, _ in _nodes(expression, False):
            if _kind(found) in _SUBQUERIES:
                yield from _leaves(found.plan())
    if _kind(node) == "WithCTE":
        for named in _each(node.cteDefs()):
            yield from _leaves(named)


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Raise unless the text is one statement, within the size limit, whose plan only reads the session's temporary views.

    The parsed plan is looked at before anything is analysed: commands run as soon as they are, and tables of literals are
    evaluated then. Names must be those of temporary views or of the statement's own WITH, so no file or table is read by name.
    """
    if len(sql.encode()) > MOST_SQL_BYTES or "\0" in sql:
        raise ValueError("the statement is too long or holds a NUL")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as wrong:
        raise ValueError("not one readable statement") from wrong
    nodes = list(_nodes(plan))
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    named = {c.alias().lower() for n, _ in nodes if _kind(n) == "UnresolvedWith" for c in _each(n.innerChildren())} - views
    if any(spark.catalog.tableExists(name) for name in named):
        raise ValueError("a name in WITH is that of a stored table")
    for node, of_plan in nodes:
        kind = _kind(node)
        if of_plan and kind not in _READS:
            raise ValueError(f"statements may only read, not {kind}")
        if kind == "UnresolvedRelation":
            name = _each(node.multipartIdentifier())
            if len(name) != 1 or name[0].lower() not in views | named:
                raise ValueError(f"{'.'.join(name)} is not a view of this session")
        if not of_plan and kind == "UnresolvedFunction" and _each(node.nameParts())[-1].lower() in _REFLECTS:
            raise ValueError("a statement may not call methods")


def query_sql(spark: SparkSession, sql: str, max_rows: int = 100, seconds: float = MOST_SECONDS) -> tuple[DataFrame, bool]:
    """(rows, truncated) of a read-only statement over the session's views: at most ``max_rows`` rows, 128 columns and 8 MiB.

    The bounded rows are fetched under a job tag that is cancelled when the time is up. Numbers that are not finite are an error.
    """
    if not 1 <= max_rows <= MOST_ROWS:
        raise ValueError(f"max_rows must lie between 1 and {MOST_ROWS}")
    check_read_only(spark, sql)
    df = spark.sql(sql)
    analysed = df._jdf.queryExecution().analyzed()
    if any(_kind(n) in _REFLECTION for n, _ in _nodes(analysed)):
        raise ValueError("a statement may not call methods")
    # What the walk over the parsed plan did not see would show here: every leaf is a view's or holds literal rows.
    if any(_kind(leaf) not in _LITERALS for leaf in _leaves(analysed)):
        raise ValueError("a statement may read the session's views alone")
    if len(df.columns) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    df = df.limit(max_rows + 1)
    cells = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    shown = F.concat_ws("", *[F.col(c).cast("string") for c in cells.columns])
    size = cells.agg(F.sum(F.octet_length(shown)))  # by an aggregate first, so that nothing larger goes to the driver
    tag = f"adhoc-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        if (size.first()[0] or 0) > MOST_RESULT_BYTES:
            raise ValueError("the result exceeds 8 MiB")
        rows = df.collect()  # bounded in rows and bytes
    finally:
        timer.cancel()
        spark.removeTag(tag)
    kept = rows[:max_rows]
    if any(isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) for row in kept for v in row):
        raise ValueError("a number in the result is not finite")
    return spark.createDataFrame(kept, df.schema), len(rows) > max_rows


def search_sorted(df: DataFrame, search: str = "", sort: str | None = None, descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows with ``search`` in any shown cell (letters of any case), sorted with missing values last both ways, one page of them."""
    if search:
        cells = [F.contains(F.lower(F.col(c).cast("string")), F.lit(search.lower())) for c in df.columns]
        df = df.where(F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in [*cells, cells[0]]]), F.lit(False)))
    if sort:
        rest = [c for c in df.columns if c != sort]
        df = df.orderBy((F.desc_nulls_last if descending else F.asc_nulls_last)(sort), *rest)
    return df.offset(offset).limit(limit)


RECIPES = {
    "rain_coverage_by_month": """
        SELECT device_id, date_format(timestamp_seconds(epoch), 'yyyy-MM') AS month, count(*) AS stored_rows,
               count(rain_mm) AS rain_readings, sum(rain_mm) AS rain_mm, round(sum(rain_mm) / 25.4, 3) AS rain_in
        FROM obs GROUP BY 1, 2""",
    "top_gust_days": """
        SELECT device_id, utc_day, peak_gust_mph, mean_wind_mph, gust_readings, wind_readings FROM (
            SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY peak_gust_mph DESC, utc_day) AS place FROM (
                SELECT device_id, to_date(timestamp_seconds(epoch)) AS utc_day,
                       round(max(wind_gust) * 2.2369362921, 1) AS peak_gust_mph, round(avg(wind_avg) * 2.2369362921, 1) AS mean_wind_mph,
                       count(wind_gust) AS gust_readings, count(wind_avg) AS wind_readings
                FROM obs GROUP BY 1, 2 HAVING count(wind_gust) > 0))
        WHERE place <= 5""",
    "latest_temperatures": """
        SELECT device_id, epoch, air_temp_c FROM (
            SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY epoch DESC) AS place FROM obs WHERE air_temp_c IS NOT NULL)
        WHERE place <= 10""",
}


def recipe(spark: SparkSession, obs: DataFrame, name: str) -> DataFrame:
    """A documented statement over ``obs`` as the view obs."""
    obs.createOrReplaceTempView("obs")
    return spark.sql(RECIPES[name])
