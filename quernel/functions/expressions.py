"""Predicates and arithmetic of the dialect as Columns.

Three kinds of values are told apart: whole numbers, doubles and strings. Whole numbers and
doubles may meet in comparisons and arithmetic, strings only meet strings. A column of dates or
timestamps is compared with a string literal as a timestamp. Division of whole numbers truncates,
and division by zero is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import AllOf, Arithmetic, Compare, DialectError, Literal, Name, Negative

#: From a name to its Column and type.
Resolver = Callable[[Name], tuple[Column, T.DataType]]


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "double"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "string"


def operand(x: Name | Literal, resolve: Resolver) -> tuple[Column, str, T.DataType | None]:
    if isinstance(x, Name):
        column, dtype = resolve(x)
        return column, kind(dtype), dtype
    if isinstance(x.value, str):
        return F.lit(x.value), "string", None
    if isinstance(x.value, int):
        return F.lit(x.value).cast("bigint"), "int", None
    return F.lit(x.value).cast("double"), "double", None


def comparison(c: Compare, resolve: Resolver) -> Column:
    (left, lk, lt), (right, rk, rt) = operand(c.left, resolve), operand(c.right, resolve)
    if {lk, rk} == {"time", "string"} and isinstance((c.left, c.right)[lk == "time"], Literal):
        left, right = (left.cast(rt), right) if rk == "time" else (left, right.cast(lt))
    elif lk != rk and not {lk, rk} <= {"int", "double"}:
        raise DialectError(f"{c}: {lk} and {rk} cannot be compared")
    return {"<": left < right, ">": left > right, "=": left == right}[c.op]


def predicate(cnf: AllOf, resolve: Resolver) -> Column:
    return reduce(and_, (reduce(or_, (comparison(c, resolve) for c in part)) for part in cnf), F.lit(True)) if cnf else F.lit(True)


def arithmetic(e, resolve: Resolver) -> tuple[Column, str]:
    """The expression and its kind, int or double."""
    if isinstance(e, Negative):
        x, k = arithmetic(e.operand, resolve)
        return -x, k
    if isinstance(e, Arithmetic):
        (a, ka), (b, kb) = arithmetic(e.left, resolve), arithmetic(e.right, resolve)
        whole = ka == kb == "int"
        if not whole:
            a, b = a.cast("double"), b.cast("double")
        if e.op == "/":
            return (F.call_function("div", a, b) if whole else a / b), "int" if whole else "double"
        return {"+": a + b, "-": a - b, "*": a * b}[e.op], "int" if whole else "double"
    x, k, _ = operand(e, resolve)
    if k not in ("int", "double"):
        raise DialectError(f"{e}: no arithmetic with a {k}")
    return x.cast("bigint" if k == "int" else "double"), k


def names(x) -> list[Name]:
    """All names in a predicate or expression."""
    if isinstance(x, Name):
        return [x]
    if isinstance(x, tuple):
        return [n for y in x for n in names(y)]
    if isinstance(x, (Compare, Arithmetic)):
        return names(x.left) + names(x.right)
    return names(x.operand) if isinstance(x, Negative) else []
