"""Read-only guard: only what reads may run. The parsed plan decides; a lexical check is there as an expression too."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Keywords that write, of SQL and of graph query languages.
WRITE_WORDS = ["create", "merge", "delete", "detach", "set", "remove", "drop", "insert", "update", "alter", "truncate", "load", "call", "foreach", "grant", "revoke", "replace"]
#: Nodes of a parsed plan that only read. A statement made of any other node is refused, commands included.
_READS = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset LimitAll Distinct Union Except Intersect Sample Window WithWindowDefinition "
    "SubqueryAlias UnresolvedRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation UnresolvedTableValuedFunction UnresolvedTVFAliases Range "
    "UnresolvedWith UnresolvedHaving UnresolvedHint UnresolvedSubqueryColumnAliases Generate Pivot Unpivot UnpivotTransformer RelationTimeTravel "
    "Repartition RepartitionByExpression RebalancePartitions UnionLoop UnionLoopRef PipeOperator".split()
)
#: Functions that run code of the caller's choice.
_CALLS_OUT = frozenset({"reflect", "java_method", "try_reflect"})


class ReadOnlyViolation(ValueError):
    """The query is empty, does not parse, or is not made of reading nodes only."""


def assert_read_only(spark: SparkSession, query: str) -> None:
    """Refuse all that is not a query by its parsed plan: root, children, subqueries and CTEs."""
    if not query or not query.strip():
        raise ReadOnlyViolation("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise ReadOnlyViolation(f"not a query: {str(e).splitlines()[0]}") from e
    todo = [plan]
    while todo:
        node = todo.pop()
        if (name := _kind(node)) not in _READS:
            raise ReadOnlyViolation(f"not read-only: {name}")
        expressions = _items(node.expressions())
        while expressions:
            e = expressions.pop()
            if _kind(e) == "UnresolvedFunction" and _items(e.nameParts())[-1].lower() in _CALLS_OUT:
                raise ReadOnlyViolation(f"not read-only: {_items(e.nameParts())[-1]}")
            expressions += _items(e.children())
        todo += _items(node.children()) + _items(node.subqueries())
        if name == "UnresolvedWith":
            todo += [cte._2() for cte in _items(node.cteRelations())]


def is_read_only(spark: SparkSession, query: str) -> bool:
    try:
        assert_read_only(spark, query)
    except ReadOnlyViolation:
        return False
    return True


def _items(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _kind(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def lexical_violation(text: Column, words: list[str] | None = None) -> Column:
    """The first write keyword outside comments and string literals, in lower case; null if there is none."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*|--[^\n]*|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", " ")
    found = F.lower(F.regexp_extract(bare, rf"(?i)\b({'|'.join(words or WRITE_WORDS)})\b", 1))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("empty")).when(found != "", found)
