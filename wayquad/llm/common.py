"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayquad.session import pin, remove, shared_dir

__all__ = ["crc_of_id", "first", "fresh", "pin", "python_crc_of_id", "ready", "remove", "shared_dir", "slices", "small", "table", "texts", "word_hashes"]

#: Rows in an Arrow batch of texts, where the session does not say.
BATCH_ROWS = 1000
_shipped: set[str] = set()


def ready(spark: SparkSession) -> None:
    """What every operator needs of a session: this package on the workers, and batches that hold texts.

    The package goes to the executors as a zip file, once an application.  A limit of rows in a batch is set
    only where the session has none of its own.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="wayquad-zip-")  # the driver serves the file from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "wayquad"), "zip", root, "wayquad"))
        _shipped.add(sc.applicationId)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(rows: DataFrame, n_rows: int, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """``rows`` with a broadcast hint if ``n_rows`` counted rows of ``row_bytes`` are at most ``max_bytes``, else as they are."""
    return F.broadcast(rows) if n_rows * row_bytes <= max_bytes else rows


def first(rows: DataFrame, key: str, limit: int, total: int) -> DataFrame:
    """The ``limit`` of ``total`` rows with the smallest hashes of ``key``; tasks offer little more than that in all."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = min(1.0, (2 * limit + 100) / max(total, 1))
    return rows.where(place < int(share * (1 << 30))).orderBy(place, key).limit(limit) if share < 1 else rows.orderBy(place, key).limit(limit)


class WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: One memory of words a worker, for all operators.
word_hashes = WordHashes()


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of an id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def python_crc_of_id(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def trim() -> None:
    """Return freed memory to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of ``column``, one row at least.

    At the end a worker gives the memory back that it has freed, since it lives on for other stages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    trim()
