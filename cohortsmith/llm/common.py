"""Helpers the operators share: global row numbers, batches bounded in bytes, word arrays."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import durable

#: Bytes of text that one vectorised step works on.
CHUNK = 1 << 19

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_shipped: set[str] = set()


#: Rows and bytes of a batch that goes to a Python worker, where the session leaves Spark's defaults.
BATCH = {"maxRecordsPerBatch": ("10000", "1000"), "maxBytesPerBatch": ("2147483647", str(16 << 20))}


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a Spark application, and bounds their batches."""
    sc = spark.sparkContext
    for name, (default, bound) in BATCH.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default).rstrip("b") == default:
            spark.conf.set(key, bound)
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():  # else it already runs from a shipped archive
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def _settle() -> None:
    """Gives what a finished task has freed back to the system: workers live on for other steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker may forget when it goes on to another operator's step.
FORGET: list[Callable[[], None]] = []
_owner: str | None = None


def _take_over(owner: str) -> None:
    """Workers live on from step to step: what they remember for one operator goes when another needs the memory."""
    global _owner
    if _owner is not None and _owner != owner:
        for forget in FORGET:
            forget()
        _settle()
    _owner = owner


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose function may use this package's modules on the workers."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _take_over(fn.__module__)
        yield from fn(b for b in batches if b.num_rows)
        _settle()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas whose function may use this package's modules on the workers, and that keeps
    whole numbers whole where a column has nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def pandas_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.num_rows:
                nullable = any(c.null_count for c in b.columns)
                yield b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get if nullable else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _take_over(fn.__module__)
        for out in fn(pandas_of(batches)):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=kind, preserve_index=False)
        _settle()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, decide: Callable[[list], np.ndarray], column: str) -> DataFrame:
    """The rows, all columns as they are, for which `decide` of one column's values says so."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _take_over(decide.__module__)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(decide(b.column(column).to_pylist())))
        _settle()

    return df.mapInArrow(run, df.schema)


def row_numbers(df: DataFrame, order: Sequence[str], out: str = "row") -> tuple[DataFrame, int]:
    """0-based position of every row in the order of the named columns, and the number of rows.

    A range sort deals the rows out; each task counts its own, and a table with one row a
    task gives the offsets. The sorted rows are written before they are used, so a lost
    executor cannot change a number that was already read.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    placed = durable(df.orderBy(*order).select(*kept, F.monotonically_increasing_id().alias("__at")))
    task = F.shiftright("__at", 33).alias("__task")
    sizes = placed.groupBy(task).agg(F.count(F.lit(1)).alias("__n"))
    upto = W.orderBy("__task").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = durable(sizes.select("__task", (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), "__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("__task", F.shiftright("__at", 33)).join(sizes.drop("__n"), "__task")
    return numbered.select(*kept, (F.col("__before") + within).alias(out)), total


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def byte_chunks(texts: Sequence[bytes | str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold about `limit` bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encoded(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 of every text; a null counts as empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def ascii_lower(text: bytes) -> bytes:
    """A-Z in lower case, every other byte as it is."""
    return text.translate(_LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
