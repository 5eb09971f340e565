"""Sources: text trees, pipe tables, versioned JSON contracts, and guarded read-only SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXCLUDED = (".git", ".obsidian", "node_modules", "__pycache__", ".venv")


def read_notes(spark: SparkSession, root: str, pattern: str = "*.md", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(rel, content, size, mtime) of the text files under a folder, without those below excluded directories.

    Files with a NUL byte are kept with null content, so that checks can report them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"/+$", "", root)
    rel = F.regexp_replace(F.col("path"), F.lit(f"^(?:[a-z]+:)?/*{re.escape(base.split('://')[-1].lstrip('/'))}/"), F.lit(""))
    rows = files.select(rel.alias("rel"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows.where(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, excluded))))
    nul = F.position(F.lit(b"\x00"), "content") > 0
    return rows.select("rel", F.when(~nul, F.decode("content", "UTF-8")).alias("content"), "size", "mtime")


def pipe_table(notes: DataFrame, columns: list[str]) -> DataFrame:
    """(rel, columns...): rows of Markdown tables with that many cells, without header and rule lines."""
    lines = notes.select("rel", F.explode(F.split("content", "\r?\n")).alias("line")).where(F.ltrim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", "^\\s*\\|\\s*|\\s*\\|\\s*$", ""), "(?<!\\\\)\\|"), lambda x: F.trim(x))
    rows = lines.select("rel", cells.alias("c")).where(F.size("c") == len(columns)).where(~F.forall("c", lambda x: x.rlike("^:?-+:?$")))
    named = rows.select("rel", *[F.col("c")[i].alias(c) for i, c in enumerate(columns)])
    return named.where(F.lower(columns[0]) != columns[0].lower())


def json_contract(documents: DataFrame, schema: T.StructType, version: int = 1) -> DataFrame:
    """(rel, ok, problem, data) of JSON texts (rel, content): unreadable ones and other schema versions are problems."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = documents.select("rel", F.from_json("content", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("data"))
    problem = F.when(F.col("data").isNull() | F.col("data._corrupt").isNotNull(), "not JSON").when(~F.col("data.schema_version").eqNullSafe(F.lit(version)), "schema_version")
    return rows.select("rel", problem.isNull().alias("ok"), problem.alias("problem"), "data")


# Nodes that parsed queries are made of, commands that only read, and functions that run code of the caller's choice.
QUERY_NODES = {
    "Aggregate", "AsOfJoin", "CurrentNamespace", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation",
    "PipeOperator", "Pivot", "Project", "RebalancePartitions", "RelationTimeTravel", "Repartition", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Union", "Unpivot", "UnresolvedFunctionName",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedNamespace", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTable", "UnresolvedTableOrView",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedView", "UnresolvedWith", "View", "Window", "WithWindowDefinition",
}
READING_COMMANDS = {"DescribeRelation", "DescribeColumn", "DescribeFunction", "DescribeNamespace", "DescribeQueryCommand", "ShowTables", "ShowColumns", "ShowColumnsCommand", "ShowNamespaces", "ShowViews", "ShowFunctions", "ShowPartitions", "ShowTableProperties"}
RUNNING_FUNCTIONS = {"reflect", "try_reflect", "java_method"}


def _sequence(items) -> list:
    return [items.apply(i) for i in range(items.size())]


class _Reading:
    """Decides on the tree of a parsed statement whether it only reads."""

    def __init__(self, spark: SparkSession):
        names = ("plans.logical.LogicalPlan", "expressions.PlanExpression")
        self.kinds = {n.split(".")[-1]: spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst." + n) for n in names}

    def _is(self, node, kind: str) -> bool:
        return self.kinds[kind].isInstance(node)

    def problem(self, plan) -> str | None:
        """The first node that does more than read, in the plan, its common table expressions, its subqueries and what it explains; None if there is none."""
        name = plan.getClass().getSimpleName()
        if name == "ExplainCommand":
            return self.problem(plan.logicalPlan())
        if name.rstrip("$") not in QUERY_NODES | READING_COMMANDS:
            return name
        return next(filter(None, (*map(self.problem, self._below(plan)), *map(self._in_expression, _sequence(plan.expressions())))), None)

    def _below(self, plan) -> list:
        return _sequence(plan.children()) + [x for x in _sequence(plan.innerChildren()) if self._is(x, "LogicalPlan")]

    def _in_expression(self, e) -> str | None:
        name = e.getClass().getSimpleName()
        if name == "UnresolvedFunction" and (called := e.nameParts().last().lower()) in RUNNING_FUNCTIONS:
            return called
        if self._is(e, "PlanExpression") and (found := self.problem(e.plan())):
            return found
        return next(filter(None, map(self._in_expression, _sequence(e.children()))), None)


def guarded_sql(spark: SparkSession, query: str, limit: int = 20) -> DataFrame:
    """At most ``limit`` rows of one statement that only reads; ValueError for anything else. PRAGMA table_info(t) describes a table.

    The statement is parsed by Spark's own parser and admitted by its tree: all nodes have to be known to read, wherever they stand (behind WITH, in a
    subquery, under EXPLAIN), so writes, changes of the catalog or the settings, scripts and several statements are refused. Semicolons in literals and comments are text.
    """
    body = re.sub(r"(?i)^\s*pragma\s+table_info\s*\(\s*['\"`]?(\w+)['\"`]?\s*\)\s*;?\s*$", r"DESCRIBE TABLE \1", query)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:
        raise ValueError(f"not one readable statement: {str(e)[:200]}") from e
    problem = _Reading(spark).problem(plan)
    if problem:
        raise ValueError(f"only a single statement that reads is allowed, not {problem}")
    return spark.sql(body).limit(limit)


def table_counts(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(table, n) of catalog tables and views, all by default: one union of counts, each of which reads no column."""
    names = sorted({t.name for t in spark.catalog.listTables()}) if names is None else names
    counts = [spark.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n in names]
    return reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "table string, n bigint")


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, position, column, type) of catalog tables or views."""
    rows = [(n, i, c.name, c.dataType) for n in names for i, c in enumerate(spark.catalog.listColumns(n))]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")
