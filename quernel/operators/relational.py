"""The operators as functions from DataFrames to DataFrames.

Predicates are conjunctions in the dialect's text, expressions its arithmetic. Names are the
columns', case-sensitive; in a join an unqualified name is looked for on the left, then on the
right, and ``left.`` or ``right.`` says which; ``k = k`` is the left and the right column k.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import arithmetic, comparison, kind, predicate
from ..plans.syntax import AllOf, Compare, DialectError, Name, parse_cnf, parse_expression


def column_of(df: DataFrame):
    """Resolver over one DataFrame; a qualifier is ignored."""
    types = {f.name: f.dataType for f in df.schema}

    def resolve(name: Name):
        if name.column not in types:
            raise DialectError(f"unknown column {name}")
        return F.col(f"`{name.column}`"), types[name.column]

    return resolve


def select_file(df: DataFrame, cnf: str | AllOf) -> DataFrame:
    """Rows of a stored table that satisfy the conjunction; Spark pushes it into the scan."""
    return df.filter(predicate(parse_cnf(cnf) if isinstance(cnf, str) else cnf, column_of(df)))


#: The same on rows that come from another operator.
select_pipe = select_file


def project(df: DataFrame, keep: list[str | int]) -> DataFrame:
    """Columns by name or place, in the given order, repeats allowed."""
    return df.select(*(F.col(f"`{df.columns[k] if isinstance(k, int) else k}`") for k in keep))


def total(df: DataFrame, expression: str, distinct: bool = False) -> DataFrame:
    """The sum of an expression as ``sum``; 0 for no rows."""
    x, k = arithmetic(parse_expression(expression) if isinstance(expression, str) else expression, column_of(df))
    return df.agg(sum_of(x, k, distinct))


def sum_of(x: Column, k: str, distinct: bool) -> Column:
    zero = F.lit(0).cast("bigint" if k == "int" else "double")
    return F.coalesce((F.sum_distinct if distinct else F.sum)(x), zero).alias("sum")


def group_by(df: DataFrame, keys: list[str], expression: str, distinct: bool = False) -> DataFrame:
    """The sum for each group: ``sum``, then the keys; no rows for no rows."""
    x, k = arithmetic(parse_expression(expression), column_of(df))
    return df.groupBy(*(F.col(f"`{c}`") for c in keys)).agg(sum_of(x, k, distinct)).select("sum", *(F.col(f"`{c}`") for c in keys))


def duplicate_removal(df: DataFrame) -> DataFrame:
    return df.distinct()


def join(left: DataFrame, right: DataFrame, cnf: str | AllOf = ()) -> DataFrame:
    """Inner join: the left columns, then the right ones without those that are keys.

    A key is a comparison ``=`` of a left and a right column that stands alone; all other parts of
    the conjunction hold as well. Without keys the rows are those of the product that satisfy it.
    """
    cnf = parse_cnf(cnf) if isinstance(cnf, str) else cnf
    mark = "__right_"
    renamed = right.toDF(*(mark + c for c in right.columns))
    sides = {"left": {f.name: f for f in left.schema}, "right": {f.name: f for f in right.schema}}

    def side(name: Name) -> str:
        for s in (name.qualifier,) if name.qualifier in sides else ("left", "right"):
            if name.column in sides[s]:
                return s
        raise DialectError(f"unknown column {name}")

    def resolve(name: Name):
        s = side(name)
        return F.col(f"`{mark if s == 'right' else ''}{name.column}`"), sides[s][name.column].dataType

    def key(part) -> tuple[str, str] | None:
        """The left and the right column that the part makes equal."""
        c = part[0]
        if len(part) > 1 or c.op != "=" or not (isinstance(c.left, Name) and isinstance(c.right, Name)):
            return None
        if c.left == c.right and not c.left.qualifier and all(c.left.column in s for s in sides.values()):
            return c.left.column, c.left.column
        by_side = {side(n): n.column for n in (c.left, c.right)}
        return (by_side["left"], by_side["right"]) if len(by_side) == 2 else None

    parts, dropped = [], set()
    for part in cnf:
        found = key(part)
        if found:
            part = (Compare(Name(found[0], "left"), "=", Name(found[1], "right")),)
            dropped.add(found[1])
        parts.append(reduce(or_, (comparison(c, resolve) for c in part)))
    both = left.join(renamed, reduce(and_, parts)) if parts else left.crossJoin(renamed)
    keep = [F.col(f"`{c}`") for c in left.columns] + [F.col(f"`{mark}{c}`").alias(c) for c in right.columns if c not in dropped]
    return both.select(*keep)


def order_all(df: DataFrame) -> list[str]:
    """The order by all columns: whole numbers first, then doubles, then the others."""
    rank = {"int": 0, "double": 1}
    return [f.name for f in sorted(df.schema, key=lambda f: rank.get(kind(f.dataType), 2))]


def order_from_cnf(cnf: str) -> list[str]:
    """The order that ``(a = a) AND (b = b)`` stands for."""
    return [part[0].left.column for part in parse_cnf(cnf)]


def sort(df: DataFrame, order: list[str] | None = None, ascending: bool = True) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in order or order_all(df)]
    return df.orderBy(*(c.asc() if ascending else c.desc() for c in columns))


def seek(df: DataFrame, **prefix) -> DataFrame:
    """Rows with these values in a sorted table's leading columns; the scan skips by their ranges."""
    return df.filter(reduce(and_, (F.col(f"`{c}`") == F.lit(v) for c, v in prefix.items())))
