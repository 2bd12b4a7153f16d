"""From a SELECT to a DataFrame.

Parts of the WHERE clause that name one table filter it before it is joined; comparisons ``=`` of
two tables' columns that stand alone are join keys; all other parts hold as soon as their tables
are joined. Tables without a part between them make a product. Spark chooses the strategy of each
join, prunes columns and pushes filters into the scans; the order of the joins is this module's,
by statistics where all tables have them and by the FROM clause otherwise, and never changes the
answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import arithmetic, comparison, names
from ..operators.relational import sum_of
from ..sources.catalog import Catalog
from .statistics import Statistics, join_order
from .syntax import AnyOf, DialectError, Name, Select


@dataclass
class Scope:
    """The tables of a FROM clause; columns are kept apart as ``alias.column``."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)
    types: dict[tuple[str, str], T.DataType] = field(default_factory=dict)

    def locate(self, name: Name) -> tuple[str, str]:
        if name.qualifier:
            aliases = [name.qualifier] if name.qualifier in self.tables else [a for a, t in self.tables.items() if t == name.qualifier]
        else:
            aliases = list(self.tables)
        found = [(a, name.column) for a in aliases if (a, name.column) in self.types]
        if len(found) != 1:
            raise DialectError(f"{'ambiguous' if found else 'unknown'} column {name}")
        return found[0]

    def resolve(self, name: Name) -> tuple[Column, T.DataType]:
        at = self.locate(name)
        return F.col(f"`{at[0]}.{at[1]}`"), self.types[at]

    def aliases(self, x) -> set[str]:
        return {self.locate(n)[0] for n in names(x)}

    def holds(self, part: AnyOf) -> Column:
        return reduce(lambda a, b: a | b, (comparison(c, self.resolve) for c in part))


@dataclass
class Plan:
    df: DataFrame
    steps: list[tuple[int, str]]

    def to_df(self) -> DataFrame:
        return self.df

    def describe(self) -> str:
        """The tree, the last step first."""
        return "\n".join("  " * depth + text for depth, text in self.steps)


def _show(part: AnyOf) -> str:
    return "(" + " OR ".join(map(repr, part)) + ")"


def plan(select: Select, catalog: Catalog, statistics: Statistics | None = None) -> Plan:
    scope = Scope()
    for table, alias in select.tables:
        if alias in scope.tables:
            raise DialectError(f"alias {alias} occurs twice")
        df = catalog.get(table)
        scope.tables[alias] = table
        scope.types.update({(alias, f.name): f.dataType for f in df.schema})
        scope.frames[alias] = df.select(*(F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns))

    parts = [(part, scope.aliases(part)) for part in select.where]
    df, steps = _joined(scope, parts, statistics)
    df, top = _shaped(select, scope, df)
    return Plan(df, [(i, t) for i, t in enumerate(top)] + [(d + len(top), t) for d, t in steps])


def _joined(scope: Scope, parts: list[tuple[AnyOf, set[str]]], statistics: Statistics | None) -> tuple[DataFrame, list[tuple[int, str]]]:
    frames, notes = dict(scope.frames), {}
    for alias, table in scope.tables.items():
        own = [p for p, used in parts if used <= {alias} and (used or alias == next(iter(scope.tables)))]
        for p in own:
            frames[alias] = frames[alias].filter(scope.holds(p))
        notes[alias] = f"SCAN {table} AS {alias}" + "".join(f" {_show(p)}" for p in own)
    between = [(p, used) for p, used in parts if len(used) > 1]
    order = _order(scope, between, statistics)
    done, df, waiting = {order[0]}, frames[order[0]], list(between)
    steps = [(0, notes[order[0]])]
    for alias in order[1:]:
        done.add(alias)
        ready = [p for p, used in waiting if used <= done]
        waiting = [(p, used) for p, used in waiting if not used <= done]
        condition = reduce(lambda a, b: a & b, map(scope.holds, ready)) if ready else None
        df = df.crossJoin(frames[alias]) if condition is None else df.join(frames[alias], condition)
        head = "JOIN " + " AND ".join(map(_show, ready)) if ready else "PRODUCT"
        steps = [(0, head), *((d + 1, t) for d, t in steps), (1, notes[alias])]
    return df, steps


def _order(scope: Scope, between, statistics: Statistics | None) -> list[str]:
    """By statistics, or as written, but tables that a part links to what is joined come first."""
    aliases = list(scope.tables)
    links: dict[frozenset, tuple] = {}
    for part, used in between:
        if len(used) == 2 and len(part) == 1 and part[0].op == "=":
            at = tuple(Name(scope.locate(n)[1], scope.locate(n)[0]) for n in (part[0].left, part[0].right))
            links[frozenset(used)] = (*links.get(frozenset(used), ()), (type(part[0])(at[0], "=", at[1]),))
    if statistics and len(aliases) > 2 and all(t in statistics.distinct for t in scope.tables.values()):
        own = statistics.copy()
        for alias, table in scope.tables.items():
            if alias != table:
                own.copy_relation(table, alias)
        try:
            return join_order(aliases, links, own)[0]
        except (KeyError, ZeroDivisionError):
            pass
    order = [aliases.pop(0)]
    while aliases:
        linked = [a for a in aliases if any(a in pair and pair - {a} <= set(order) for pair in links)]
        order.append((linked or aliases)[0])
        aliases.remove(order[-1])
    return order


def _outputs(scope: Scope, columns: tuple[Name, ...]) -> list[Column]:
    """Columns under their plain names; names that occur twice keep their alias before them."""
    at = [scope.locate(n) for n in columns]
    plain = [c for _, c in at]
    return [F.col(f"`{a}.{c}`").alias(c if plain.count(c) == 1 else f"{a}_{c}") for a, c in at]


def _shaped(select: Select, scope: Scope, df: DataFrame) -> tuple[DataFrame, list[str]]:
    columns, keys = [scope.locate(n) for n in select.columns], [scope.locate(n) for n in select.group_by]
    shown = ", ".join(map(repr, select.columns))
    if select.total is None:
        if keys and not set(columns) <= set(keys):
            raise DialectError("without SUM, only grouped columns can be selected")
        df = df.select(*_outputs(scope, select.columns))
        return (df.distinct(), [f"DISTINCT {shown}"]) if select.distinct or keys else (df, [f"PROJECT {shown}"])
    if not set(columns) <= set(keys):
        raise DialectError("columns beside SUM must be grouped")
    x, kind = arithmetic(select.total, scope.resolve)
    total = sum_of(x, kind, select.total_distinct)
    text = f"SUM {'DISTINCT ' if select.total_distinct else ''}{select.total}"
    if not keys:
        return df.agg(total), [text]
    grouped = df.groupBy(*(F.col(f"`{a}.{c}`") for a, c in keys)).agg(total)
    return grouped.select("sum", *_outputs(scope, select.columns or select.group_by)), [f"{text} GROUP BY {', '.join(map(repr, select.group_by))}"]
