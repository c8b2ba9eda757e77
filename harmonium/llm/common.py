"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonium.session import discard, materialise, shuffles_removed, tune

__all__ = ["SLICE_BYTES", "batches", "bounded_batches", "broadcast_if_small", "discard", "materialise", "mix", "prepared", "read", "shuffles_removed", "slices", "word_hashes", "words"]

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of a Python step that are worked on together.
SLICE_ROWS = 512
#: Bytes of such a part where what is made of a text is many times its size.
SLICE_BYTES = 1 << 20
#: Largest list of ids or groups that is sent to every task; anything longer is joined by a shuffle.
BROADCAST_ROWS = 500_000


#: Rows of an Arrow batch: texts can be long, and every task holds a batch on either side of Python.
ARROW_ROWS = "1024"
#: Bytes of one, whatever the length of its texts.
ARROW_BYTES = "2m"


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, size: str = ARROW_BYTES):
    """Arrow batches of at most about ``size`` bytes while a table is written, whatever the length of its texts."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows at most ``rows`` narrow rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows, and of about ``size`` bytes at most unless a single row is longer."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            todo = [batch.slice(start, rows)]
            while todo:
                part = todo.pop()
                if size is None or part.num_rows < 2 or part.nbytes <= size:
                    yield part
                else:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]


def batches(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` with A-Z in lower case, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is exactly that rule.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around by design)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
