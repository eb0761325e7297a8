"""A read-only guard for SQL text, on the plan that Spark's own parser makes of it."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

# Plan nodes that run no data change. Any other command is refused.
READ_COMMANDS = {
    "ShowTables", "ShowColumns", "ShowCreateTable", "ShowNamespaces", "ShowNamespacesCommand", "ShowViews", "ShowFunctions",
    "ShowTablesCommand", "ShowPartitions", "ShowTableProperties", "ShowTableExtended",
    "DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeNamespace", "DescribeFunction",
    "DescribeFunctionCommand", "DescribeRelationJsonCommand", "ExplainCommand", "SubqueryAlias",
}
# Plan nodes of queries, as Spark's parser makes them. Any other node is refused, known or not.
READ_NODES = {
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Sample", "Distinct", "Deduplicate",
    "Join", "LateralJoin", "AsOfJoin", "Union", "Intersect", "Except", "Generate", "Pivot", "Unpivot", "Window", "WithWindowDefinition", "Expand",
    "UnresolvedWith", "UnresolvedHint", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "PipeOperator", "RepartitionByExpression", "Repartition",
    "OneRowRelation", "LocalRelation", "Range", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedTableValuedFunction", "RelationTimeTravel",
    "PlanWithUnresolvedIdentifier", "UnresolvedTableOrView", "UnresolvedNamespace", "CurrentNamespace", "UnresolvedFunctionName", "UnresolvedIdentifier",
    "ParameterizedQuery", "NameParameterizedQuery", "PosParameterizedQuery", "UnionLoop", "UnionLoopRef", "TransposeRelation", "UnresolvedTVFAliases", "UnresolvedTableValuedFunctionWithAlias",
}
# Functions that call arbitrary JVM code.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
REFUSED_CLASSES = {"CallMethodViaReflection", "TryReflect"}

READS = "This box answers questions and changes nothing: it takes SELECT, WITH, FROM, VALUES, SHOW, DESCRIBE, SUMMARIZE, PIVOT and EXPLAIN."
ANALYZE = "ANALYZE would execute what is explained; a plain EXPLAIN shows the plan alone."

_EXPLAIN_ANALYZE = re.compile(r"^\W*explain\b.*\banaly[sz]e\b", re.IGNORECASE | re.DOTALL)


class RefusedQuery(ValueError):
    """A statement the guard does not let through."""


def refusal(node: str) -> str:
    """Why a plan node is not let through, by the node's name in words."""
    return f"{READS} Not taken: {' '.join(re.findall('[A-Z][a-z]+|[A-Z]+(?![a-z])', node)).upper()}."


#: Commands whose plan is neither a child nor an inner child, and where it is held.
HELD_PLANS = {"ExplainCommand": "logicalPlan", "DescribeQueryCommand": "plan"}


def _nodes(plan):
    yield plan
    held = HELD_PLANS.get(plan.getClass().getSimpleName())
    if held:
        yield from _nodes(getattr(plan, held)())
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _each(group):
            if hasattr(child, "innerChildren"):
                yield from _nodes(child)


def _is_command(spark: SparkSession, node) -> bool:
    jvm = spark._jvm
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    parsed = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    return command.isInstance(node) or parsed.isInstance(node)


def check_statement(spark: SparkSession, text: str) -> None:
    """Raise RefusedQuery unless ``text`` only reads. Every node of the plan is looked at."""
    if _EXPLAIN_ANALYZE.search(text):
        raise RefusedQuery(ANALYZE)
    parser = spark._jsparkSession.sessionState().sqlParser()
    plan = parser.parsePlan(text)
    for node in _nodes(plan):
        name = node.getClass().getSimpleName().rstrip("$")
        if name not in (READ_COMMANDS if _is_command(spark, node) else READ_COMMANDS | READ_NODES):
            raise RefusedQuery(refusal(name))
    _check_functions(_called_functions(plan))
    if not _is_command(spark, plan):
        # names can also come from IDENTIFIER(...), views and SQL functions: what they stand for is seen once they are resolved
        _check_functions(_resolved_functions(spark._jsparkSession.sessionState().analyzer().execute(plan)))


def _check_functions(names) -> None:
    for name in names:
        if name in REFUSED_FUNCTIONS:
            raise RefusedQuery(f"{READS} Not taken: the function {name}.")


def _each(sequence):
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _expressions(plan):
    """Every expression anywhere in a plan."""
    for node in _nodes(plan):
        waiting = list(_each(node.expressions()))
        while waiting:
            expression = waiting.pop()
            waiting += _each(expression.children())
            yield expression


def _called_functions(plan):
    """The last part of the name of every function called anywhere in a parsed plan, in lower case."""
    for expression in _expressions(plan):
        if expression.getClass().getSimpleName() == "UnresolvedFunction":
            yield expression.nameParts().last().lower()


def _resolved_functions(plan):
    """The names under which the functions of an analysed plan are known, in lower case."""
    for expression in _expressions(plan):
        yield expression.prettyName().lower()
        if expression.getClass().getSimpleName() in REFUSED_CLASSES:
            yield "reflect"


_PIECE = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;|[^;'"`/-]+|.""", re.DOTALL)


def split_statements(text: str) -> list[str]:
    """Statements of a text; semicolons inside quotes and comments do not count."""
    statements, current, has_code = [], "", False
    for piece in _PIECE.findall(text) + [";"]:
        if piece == ";":
            if has_code:
                statements.append(current.strip())
            current, has_code = "", False
            continue
        current += piece
        has_code = has_code or not (piece.startswith(("--", "/*")) or piece.isspace())
    return statements


__all__ = ["ParseException", "RefusedQuery", "check_statement", "refusal", "split_statements"]
