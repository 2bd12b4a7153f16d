"""Statements of the dialect against a Spark session."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .plans.planner import plan
from .plans.statistics import Statistics, collect
from .plans.syntax import CreateTable, DialectError, DropTable, Help, Insert, Select, SetOutput, UpdateStatistics, parse_sql
from .sources import text
from .sources.catalog import Catalog, relations

#: The tables that ``Session.of`` looks for.
TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events")

HELP = """\
SELECT columns | SELECT DISTINCT columns | SELECT SUM([DISTINCT] expression)[, grouped columns]
  FROM table AS alias, … WHERE (a < b OR …) AND (…) … [GROUP BY columns];
CREATE TABLE name (column INTEGER|DOUBLE|STRING, …) AS HEAP | SORTED [ON (columns)];
INSERT 'file' INTO table;   DROP TABLE table;
SET OUTPUT STDOUT | NONE | 'folder';   UPDATE STATISTICS FOR table;   help;
Keywords are upper-case. Arithmetic associates to the right and has no precedence, and a minus
sign negates all that follows it. Subtraction needs spaces: a - b."""


@dataclass
class Result:
    message: str = ""
    df: DataFrame | None = None
    plan: str = ""
    seconds: float = 0.0

    def lines(self) -> Iterator[str]:
        """The rows as text, fetched one after the other; their time is added to ``seconds``."""
        began = time.perf_counter()
        try:
            for row in text.as_lines(self.df).toLocalIterator():
                yield row[0]
        finally:
            self.seconds += time.perf_counter() - began


class Session:
    def __init__(self, spark: SparkSession, home: str | None = None):
        """Made tables are kept in the folder ``home``, where later sessions find them; without one,
        in a folder of this session that goes when the driver ends."""
        self.spark = spark
        self.catalog = Catalog(spark, home)
        self.statistics = Statistics()
        self.output = "STDOUT"

    @classmethod
    def of(cls, spark: SparkSession, folder: str, home: str | None = None) -> Session:
        """A session over a folder of Parquet tables."""
        out = cls(spark, home)
        for name in TABLES:
            out.catalog.register(name, lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet"))
        return out

    def use_catalog(self, path: str, folder: str) -> list[str]:
        """Registers the relations of a text catalog, each read from its delimited file in ``folder``."""
        known = relations("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))
        for name, (file, schema) in known.items():
            self.catalog.register(name, lambda file=file, schema=schema: text.load(self.spark, f"{folder}/{file}", schema))
        return list(known)

    def select(self, statement: str) -> DataFrame:
        """The DataFrame of a SELECT, not run."""
        found = parse_sql(statement)
        if not isinstance(found, Select):
            raise DialectError("not a SELECT")
        return plan(found, self.catalog, self.statistics).df

    def execute(self, statement: str) -> Result:
        """Runs a statement. A SELECT's rows go where SET OUTPUT says: to the result's ``df``
        (STDOUT), to a folder of text, or, with NONE, nowhere: it is planned only."""
        began = time.perf_counter()
        result = self._run(parse_sql(statement))
        result.seconds = time.perf_counter() - began
        return result

    def _run(self, s) -> Result:
        if isinstance(s, Select):
            made = plan(s, self.catalog, self.statistics)
            if self.output == "STDOUT":
                return Result(df=made.df, plan=made.describe())
            if self.output != "NONE":
                text.write_out(made.df, self.output)
            return Result(self.output, plan=made.describe())
        if isinstance(s, CreateTable):
            self.catalog.create(s)
            return Result(f"created {s.name}")
        if isinstance(s, Insert):
            self.catalog.insert(s.table, s.path)
            return Result(f"loaded {s.path} into {s.table}")
        if isinstance(s, DropTable):
            self.catalog.drop(s.table)
            return Result(f"dropped {s.table}")
        if isinstance(s, SetOutput):
            self.output = s.target
            return Result(f"output: {s.target}")
        if isinstance(s, UpdateStatistics):
            self.update_statistics(s.table)
            return Result(f"statistics of {s.table}")
        assert isinstance(s, Help)
        return Result(HELP)

    def update_statistics(self, table: str, exact: bool = False) -> None:
        """Counts again what the table has now."""
        rows, distinct = collect(self.catalog.get(table), exact)
        self.statistics.rows.pop(table, None)
        self.statistics.distinct.pop(table, None)
        self.statistics.add_relation(table, rows)
        for column, n in distinct.items():
            self.statistics.add_attribute(table, column, n)
