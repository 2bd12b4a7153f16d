"""What the operators of this subpackage share: reading, the shared folder and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset on one machine (a
    ``local`` master, as in tests) a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and
    survives lost executors. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    for made in _SCOPES:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """The places of the tables that are written inside it, in order."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]


def erase(spark: SparkSession, places: list[str]) -> None:
    """Deletes tables that ``written`` made and that nothing needs any more."""
    for path in places:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' hashes."""
    n = max(0, len(words) - size + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = (mixed ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


class Sieve:
    """A bit for each remainder of a 64-bit hash: tells for certain that a hash is not among those
    it was made from, and lets some others through. Its size is fixed (4 MB)."""

    BITS = 1 << 25

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Sieve:
        cell = F.pmod(F.col(column), F.lit(cls.BITS))
        bits = df.select(F.floor(cell / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int")).alias("x"))
        got = bits.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()  # at most BITS / 64 rows
        table = np.zeros(cls.BITS // 64, np.int64)
        table[got["w"].to_numpy()] = got["x"].to_numpy()
        return cls(table)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes & np.uint64(64 * len(self.table) - 1)
        words = self.table[(cell >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return (words >> (cell & np.uint64(63))) & np.uint64(1) != 0


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; null keys have none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def held_out(key: str, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(key, modulus) == value, F.lit(False))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``limit`` bytes of text, so that a slice's working
    memory is bounded by that or by its longest text."""
    for batch in batches:
        column = batch.column(text)
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for at, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python
    workers need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quernel_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    stage = Path(tempfile.mkdtemp(prefix="quernel-"))
    atexit.register(shutil.rmtree, stage, ignore_errors=True)
    shutil.copytree(package, stage / "code" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(stage / package.name), "zip", stage / "code"))
    context._quernel_shipped = True


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow of ``function(batches) -> iterator of dict of column lists``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip((columns[f.name] for f in arrow), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
