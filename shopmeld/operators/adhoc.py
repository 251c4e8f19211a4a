"""Guarded read-only SQL and table preview; every value comes back as text, NULL stays NULL.

A statement is run only if its parsed plan consists of listed clauses over listed relations and calls listed
functions only; whatever is not listed is refused, also inside subqueries and common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmeld.config import FORBIDDEN_SQL_WORDS
from shopmeld.functions.columns import text_of

MAX_PREVIEW = 100

# Quoted text, quoted names and comments, which the word checks leave out.
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)

#: Clauses of a query, by the name of the parsed plan's node.
CLAUSES = frozenset(
    """Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin
    UnresolvedWith WithWindowDefinition SubqueryAlias UnresolvedSubqueryColumnAliases OneRowRelation
    UnresolvedInlineTable UnresolvedRelation UnresolvedTableValuedFunction Union Except Intersect Pivot Unpivot
    Generate UnresolvedStarWithColumns LocalRelation Sample""".split()
)

#: Expressions that call no function by name, by the name of the parsed node.
EXPRESSIONS = frozenset(
    """UnresolvedAttribute AttributeReference UnresolvedStar UnresolvedAlias Alias MultiAlias Literal NamedParameter PosParameter
    UnresolvedFunction UnresolvedExtractValue UnresolvedOrdinal UnresolvedNamedLambdaVariable LambdaFunction
    And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual Between In InSubquery
    Like ILike LikeAll LikeAny NotLikeAll NotLikeAny RLike IsNull IsNotNull IsTrue IsUnknown
    Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot
    CaseWhen Cast TryCast Extract Concat SortOrder WindowExpression WindowSpecDefinition SpecifiedWindowFrame
    UnresolvedWindowExpression WindowSpecReference UnspecifiedFrame$ UnboundedPreceding$ UnboundedFollowing$
    CurrentRow$ RowFrame$ RangeFrame$ ScalarSubquery Exists ListQuery LateralSubquery
    Grouping GroupingID GroupingSets Cube Rollup CreateNamedStruct UnresolvedGenerator UnresolvedInlineTable
    CurrentDate CurrentTimestamp Now LocalTimestamp DateAddInterval TimestampAdd TimestampDiff StringTrim
    StringTrimLeft StringTrimRight Substring StringLocate Overlay StringReplace Count""".split()
)

#: Functions without effects that read nothing but their arguments.
FUNCTIONS = frozenset(
    """abs approx_count_distinct array array_contains array_distinct array_join array_max array_min array_size avg
    between bool_and bool_or boolean cast ceil ceiling char_length coalesce collect_list collect_set concat
    concat_ws contains count count_if cume_dist current_date current_timestamp date date_add date_diff
    date_format date_part date_sub date_trunc datediff day dayname dayofmonth dayofweek dayofyear decimal
    dense_rank double element_at endswith exists exp explode extract filter first_value float floor forall
    format_number from_unixtime get_json_object greatest grouping grouping_id hour if ifnull initcap instr int
    isnan isnotnull isnull json_array_length lag last_day last_value lead least left length ln locate log log10
    log2 lower lpad ltrim map_keys max max_by mean median min min_by minute mode month monthname named_struct
    next_day now nth_value ntile nullif nvl percent_rank percentile percentile_approx position power quarter
    rank regexp_extract regexp_like regexp_replace repeat replace reverse right round row_number rpad rtrim
    second sequence sign size sort_array split sqrt startswith stddev stddev_samp string struct substr substring
    sum timestamp to_char to_date to_timestamp transform translate trim trunc try_add try_cast try_divide
    try_to_timestamp unix_timestamp upper var_samp variance weekofyear year""".split()
)

#: Functions that stand for a relation.
TABLE_FUNCTIONS = frozenset({"range", "explode", "posexplode"})


class ForbiddenSqlError(ValueError):
    """The statement is not a plain SELECT over what it may read."""


def check_sql(sql: str) -> None:
    """Raise unless the text starts as a SELECT and holds no forbidden word outside quotes and comments."""
    words = re.findall(r"\w+", _QUOTED.sub(" ", sql).upper())
    if not words or words[0] != "SELECT":
        raise ForbiddenSqlError("only SELECT statements are allowed")
    for word in FORBIDDEN_SQL_WORDS:
        if word in words:
            raise ForbiddenSqlError(f"statement contains forbidden keyword: {word}")


def _each(items: JavaObject) -> Iterator[JavaObject]:
    """The elements of a Scala collection."""
    i = items.iterator()
    while i.hasNext():
        yield i.next()


def _kind(node: JavaObject) -> str:
    """The class name of a parsed node, without its package."""
    return node.getClass().getName().rsplit(".", 1)[-1]


class _PlanCheck:
    """Walks a parsed plan; names of common table expressions hold for the whole statement below them."""

    def __init__(self, relations: frozenset[str]) -> None:
        self.relations = relations

    def plan(self, node: JavaObject, known: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in CLAUSES:
            raise ForbiddenSqlError(f"clause not allowed: {kind}")
        if kind == "UnresolvedWith":
            # A name holds in the statement and in the definitions that follow its own.
            for relation in _each(node.cteRelations()):
                self.plan(relation._2(), known)
                known |= {relation._1().lower()}
        elif kind == "UnresolvedRelation":
            name = [x for x in _each(node.multipartIdentifier())]
            self.relation(name, known)
        elif kind == "UnresolvedTableValuedFunction":
            self.function(node.name(), TABLE_FUNCTIONS)
        for expression in _each(node.expressions()):
            self.expression(expression, known)
        if kind == "Generate":
            self.expression(node.generator(), known)
        for child in _each(node.children()):
            self.plan(child, known)

    def relation(self, name: list[str], known: frozenset[str]) -> None:
        text = ".".join(name).lower()
        if not (text in self.relations or len(name) == 1 and text in known):
            raise ForbiddenSqlError(f"relation not allowed: {text}")

    def function(self, name: JavaObject, allowed: frozenset[str]) -> None:
        parts = [str(x) for x in _each(name)]
        if len(parts) != 1 or parts[0].lower() not in allowed:
            raise ForbiddenSqlError(f"function not allowed: {'.'.join(parts)}")

    def expression(self, node: JavaObject, known: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in EXPRESSIONS:
            raise ForbiddenSqlError(f"expression not allowed: {kind}")
        if kind == "UnresolvedFunction":
            self.function(node.nameParts(), FUNCTIONS)
            if node.filter().isDefined():
                self.expression(node.filter().get(), known)
        elif kind == "UnresolvedGenerator":
            self.function(node.name().nameParts(), FUNCTIONS)
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(node.plan(), known)
        for child in _each(node.children()):
            self.expression(child, known)


def session_relations(spark: SparkSession) -> frozenset[str]:
    """The temporary views of the session, which `register_views` makes."""
    return frozenset(t.name.lower() for t in spark.catalog.listTables() if t.isTemporary)


def check_plan(spark: SparkSession, sql: str, relations: Iterable[str] | None = None) -> bool:
    """Raise unless the statement's parsed plan is read-only; return whether its outermost clause limits the rows.

    `relations` are the names that may be read, with dots between their parts; by default the session's
    temporary views. Nothing is resolved or run, so a refused statement has no effect.
    """
    check_sql(sql)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise ForbiddenSqlError(f"not one statement that can be read: {error.getCondition()}") from error
    allowed = session_relations(spark) if relations is None else frozenset(r.lower() for r in relations)
    _PlanCheck(allowed).plan(plan, frozenset())
    while _kind(plan) == "Offset":
        plan = next(_each(plan.children()))
    return _kind(plan) in ("GlobalLimit", "LocalLimit")


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text; names may occur twice."""
    by_place = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return by_place.select(*(text_of(F.col(f"_{i}"), kind).alias(name) for i, (name, kind) in enumerate(df.dtypes)))


def run_sql(
    spark: SparkSession,
    sql: str,
    limit: int | None = 100,
    args: Mapping[str, Any] | None = None,
    relations: Iterable[str] | None = None,
) -> DataFrame:
    """Run a SELECT with `:name` parameters over the listed relations (the session's temporary views by default).

    Unless its outermost clause is a LIMIT, at most `limit` rows come back, 100 by default; None gives all.
    """
    own_limit = check_plan(spark, sql, relations)
    result = spark.sql(sql, args=dict(args or {}))
    return as_text(result if own_limit or limit is None else result.limit(limit))


def preview_table(spark: SparkSession, schema: str, table: str, limit: int = 10) -> DataFrame:
    """Some rows of a table; asking for more than 100 is an error."""
    if limit > MAX_PREVIEW:
        raise ValueError(f"limit is above {MAX_PREVIEW}")
    if not (schema.isidentifier() and table.isidentifier()):
        raise ValueError("invalid schema or table name")
    return as_text(spark.table(f"`{schema}`.`{table}`").limit(limit))
