"""Tables by name: views of existing DataFrames, and tables made and filled by statements.

A made table is a folder of Parquet parts in the catalog's home, and a description (columns, sort
order, parts) that a later session reads again. A heap's insert adds a part. A sorted table's insert adds
a part that is written in ranges of the order and sorted within files, so that scans skip by
the files' ranges; after ``RUNS`` parts they are merged into one. A description is replaced as a
whole when its parts are written; one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.relational import order_all
from ..plans.syntax import CreateTable, DialectError
from . import text

#: Type names of statements and of text catalogs.
TYPES = {"INTEGER": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "Int": T.LongType(), "Double": T.DoubleType(), "String": T.StringType()}


def schema_of(columns) -> T.StructType:
    columns = list(columns)
    for name, kind in columns:
        if kind not in TYPES:
            raise DialectError(f"{name}: unknown type {kind}")
    return T.StructType([T.StructField(n, TYPES[k]) for n, k in columns])


def relations(lines: str) -> dict[str, tuple[str, T.StructType]]:
    """File and schema of the relations in a text catalog: BEGIN, name, file, then a column and its type a line, END."""
    out = {}
    for block in lines.split("BEGIN")[1:]:
        words = block.partition("END")[0].split()
        if len(words) > 1:
            out[words[0]] = (words[1], schema_of(zip(words[2::2], words[3::2])))
    return out


def read_catalog(lines: str, relation: str) -> T.StructType:
    """The schema of a relation in a text catalog."""
    known = relations(lines)
    if relation not in known:
        raise DialectError(f"the catalog has no {relation}")
    return known[relation][1]


#: Parts of a sorted table that an insert merges into one.
RUNS = 8


@dataclass
class Table:
    schema: T.StructType
    sort_on: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()


class _Home:
    """A folder of descriptions and parts, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str, keep: bool):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not keep:
            self.files.deleteOnExit(self._path(folder))

    def names(self) -> list[str]:
        place = self._path(self.folder)
        return [s.getPath().getName() for s in self.files.listStatus(place) if s.isDirectory()] if self.files.exists(place) else []

    def read(self, name: str) -> Table | None:
        place = self._path(f"{self.folder}/{name}/table.json")
        if not self.files.exists(place):
            return None
        found = json.loads(self.spark.read.text(place.toString(), wholetext=True).first()[0])
        return Table(T.StructType.fromJson(found["schema"]), tuple(found["sort_on"]), tuple(found["parts"]))

    def write(self, name: str, table: Table) -> None:
        new, place = self._path(f"{self.folder}/{name}/table-{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}/table.json")
        out = self.files.create(new)
        out.write(bytearray(json.dumps({"schema": table.schema.jsonValue(), "sort_on": table.sort_on, "parts": table.parts}), "utf-8"))
        out.close()
        if self.files.exists(place):
            self.files.delete(place, False)
        self.files.rename(new, place)

    def part(self, name: str, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}/{part}")
        return part

    def scan(self, name: str, table: Table) -> DataFrame:
        if not table.parts:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*(f"{self.folder}/{name}/{p}" for p in table.parts))

    def erase(self, name: str, part: str = "") -> None:
        self.files.delete(self._path(f"{self.folder}/{name}/{part}".rstrip("/")), True)


class Catalog:
    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark = spark
        self.views: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        self.home = _Home(spark, home.rstrip("/") if home else f"{warehouse}/quernel-{uuid.uuid4().hex}", keep=home is not None)
        self.tables: dict[str, Table] = {n: t for n in self.home.names() if (t := self.home.read(n))}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A DataFrame, or what gives one when it is first used."""
        self.views[name] = df

    def get(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.home.scan(name, self.tables[name])
        if name in self.views:
            if not isinstance(self.views[name], DataFrame):
                self.views[name] = self.views[name]()
            return self.views[name]
        raise DialectError(f"no table {name}")

    def __contains__(self, name: str) -> bool:
        return name in self.tables or name in self.views

    def create(self, statement: CreateTable) -> None:
        if statement.name in self:
            raise DialectError(f"table {statement.name} exists")
        schema = schema_of(statement.columns)
        if statement.kind == "TREE":
            raise NotImplementedError("tree tables")
        if statement.kind not in ("HEAP", "SORTED"):
            raise DialectError(f"a table is HEAP or SORTED, not {statement.kind}")
        missing = [c for c in statement.sort_on if c not in schema.names]
        if missing:
            raise DialectError(f"unknown column {missing[0]}")
        order = (statement.sort_on or tuple(order_all(self.spark.createDataFrame([], schema)))) if statement.kind == "SORTED" else ()
        self._keep(statement.name, Table(schema, order))

    def _keep(self, name: str, table: Table) -> None:
        self.home.write(name, table)
        self.tables[name] = table

    def insert(self, name: str, path: str) -> None:
        """Loads a delimited text file."""
        self.append(name, text.load(self.spark, path, self._made(name).schema))

    def append(self, name: str, rows: DataFrame) -> None:
        table = self._made(name)
        rows = rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in table.schema))
        spent: tuple[str, ...] = ()
        if table.sort_on and len(table.parts) >= RUNS:
            rows, spent = self.home.scan(name, table).unionByName(rows), table.parts
        if table.sort_on:
            rows = rows.repartitionByRange(*table.sort_on).sortWithinPartitions(*table.sort_on)
        part = self.home.part(name, rows)
        self._keep(name, Table(table.schema, table.sort_on, (part,) if spent else (*table.parts, part)))
        for old in spent:
            self.home.erase(name, old)

    def _made(self, name: str) -> Table:
        if name not in self.tables:
            raise DialectError(f"no table {name} that can be inserted into" if name in self.views else f"no table {name}")
        return self.tables[name]

    def drop(self, name: str) -> None:
        self._made(name)
        self.home.erase(name)
        del self.tables[name]
