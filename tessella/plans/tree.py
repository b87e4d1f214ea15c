"""Expression trees by head symbol, for callers that build queries as data: operators, tables, Python blocks, variables.

``Node("select", Node("table", "lineitem"), ["l_quantity"], ["<"], [24])`` is evaluated to a DataFrame. Heads: table,
project, select, equi_join, aggregate, encoded (a dictionary-encoded column list, unwrapped), python_globals, python,
get_python_var, reset_python_dict; ``Node("Table", Node("a", Node("List", 1, 2)), ...)`` is a table given in the tree, each column in one or more lists.
``Node("List", ...)`` of codes in ``encoded`` with a dictionary gives the list of values. Unknown heads are rebuilt with evaluated children.

The heads of the richer dialect are Project(child, As(name, expr, ...)), Select(child, Where(predicate)), Join(left, right, Where(Equal(key, key))) with
List(keys) for several, Group(child, By(key, ...), As(name, Sum(expr), ...)) with or without By, Order(child, By(...)) and Top(child, By(...), n); in By,
Node("Desc", name) sorts downwards. Expressions are Plus, Minus, Times, Divide, Greater, Equal, And, StringContainsQ, DateObject and Year; bare strings name columns.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.operators import relational
from tessella.operators.blocks import Variables
from tessella.plans import algebra


class Node:
    def __init__(self, head: str, *args: Any):
        self.head, self.args = head, args

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and (self.head, self.args) == (other.head, other.args)

    def __hash__(self) -> int:
        return hash(self.head)

    def __repr__(self) -> str:
        return f"{self.head}({', '.join(map(repr, self.args))})"


EXPRESSIONS = {"Plus": "plus", "Minus": "minus", "Times": "times", "Divide": "divide", "Greater": "greater", "Equal": "equal", "And": "and", "StringContainsQ": "contains", "Year": "year"}
REDUCTIONS = {"Sum": "sum", "Count": "count", "Min": "min", "Max": "max", "Avg": "avg"}
DIALECT = ("Project", "Select", "Join", "Group", "Order", "Top")


def expression(x: Any) -> algebra.Expr:
    """An expression of the richer dialect: bare strings name columns, all else that is no node is a literal."""
    if not isinstance(x, Node):
        return algebra.wrap(x)
    if x.head == "DateObject":
        return algebra.date(x.args[0])
    if x.head == "String":
        return algebra.Value(x.args[0])
    if x.head not in EXPRESSIONS:
        raise ValueError(f"not an expression: {x!r}")
    if x.head == "StringContainsQ":
        return expression(x.args[0]).contains(x.args[1].args[0] if isinstance(x.args[1], Node) else x.args[1])
    return algebra.Call(EXPRESSIONS[x.head], tuple(map(expression, x.args)))


def pairs_of(names: Node) -> list[tuple[str, Any]]:
    if names.head != "As" or len(names.args) % 2:
        raise ValueError(f"names and expressions in turn are needed: {names!r}")
    return list(zip(names.args[::2], names.args[1::2], strict=True))


def keys_of(by: Node) -> tuple:
    return tuple((k.args[0], "desc") if isinstance(k, Node) else k for k in by.args)


def is_literal_table(node: Node) -> bool:
    return node.head == "Table" and all(isinstance(c, Node) and all(isinstance(s, Node) and s.head == "List" for s in c.args) for c in node.args)


class Evaluator:
    """Evaluates trees against a catalogue of tables, with variables that last as long as it does."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame] | None = None):
        self.spark, self.tables, self.variables = spark, tables or spark.table, Variables()

    def literal(self, node: Node) -> DataFrame:
        """A table given in the tree; of a column in several lists, one follows the other."""
        columns = {c.head: [v for part in c.args for v in part.args] for c in node.args}
        if len({len(v) for v in columns.values()}) != 1:
            raise ValueError("columns of a table differ in length, or there are none")
        return self.spark.createDataFrame(pa.table({name: pa.array(values) for name, values in columns.items()}))

    def plan(self, node: Any) -> algebra.Plan:
        """The plan of a node of the richer dialect; other nodes are evaluated and stand as they are."""
        if not isinstance(node, Node) or node.head not in DIALECT:
            return algebra.Frame(self(node))
        child, *rest = node.args
        match node.head:
            case "Project":
                return self.plan(child).project(*(expression(e).named(n) for n, e in pairs_of(rest[0])))
            case "Select":
                return self.plan(child).where(expression(rest[0].args[0]))
            case "Join":
                left, right = rest[1].args[0].args
                keys = lambda k: tuple(k.args) if isinstance(k, Node) else (k,)
                return self.plan(child).join(self.plan(rest[0]), keys(left), keys(right))
            case "Group":
                by = keys_of(rest[0]) if rest[0].head == "By" else ()
                return algebra.Group(self.plan(child), by, tuple((n, REDUCTIONS[e.head], expression(e.args[0])) for n, e in pairs_of(rest[-1])))
            case "Order":
                return self.plan(child).order(*keys_of(rest[0]))
        return self.plan(child).top(rest[1], *keys_of(rest[0]))

    def __call__(self, node: Any) -> Any:
        if not isinstance(node, Node):
            return node
        match node.head:
            case "table":
                return self.tables(node.args[0])
            case "project" | "select" | "aggregate":
                return getattr(relational, node.head)(self(node.args[0]), *node.args[1:])
            case "equi_join":
                left, right, *keys = node.args
                return relational.equi_join(self(left), self(right), *keys)
            case "encoded":
                codes, *dictionary = node.args
                return Node("List", *(dictionary[0].args[k] for k in codes.args)) if dictionary else self(codes)
            case "Table" if is_literal_table(node):
                return self.literal(node)
            case "Project" | "Select" | "Join" | "Group" | "Order" | "Top":
                return algebra.lower(self.plan(node), self.tables)
            case "python_globals":
                self.variables.globals.update(node.args[0])
                return node
            case "python":
                block, *bound = node.args
                self.variables.run(block, {name: self(child) for name, child in bound})
                return Node("python")
            case "get_python_var":
                return self.variables.get(node.args[0])
            case "reset_python_dict":
                self.variables.reset()
                return node
        return Node(node.head, *map(self, node.args))
