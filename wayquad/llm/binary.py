"""Token ids as flat unsigned integer files with 64-bit document offsets.

A dataset is a folder with three files a part and a manifest:

- ``*.bin``: the ids of the part's documents one after another, unsigned little-endian integers of the
  width that the largest id needs (2 or 4 bytes);
- ``*.off``: unsigned 64-bit little-endian offsets in ids from the start of the part, one more than documents;
- ``*.key``: the documents' ids, signed 64-bit little-endian, ascending over the whole dataset; the first
  ``nameless`` documents of a part have no id, and 0 stands for it;
- ``manifest.json``: width, and for each part its names, documents, nameless documents, ids and base (ids before it).

Whole texts are cut into pre-tokens by the file's own pattern (as ``bpe`` does, which refuses files with other
settings), and every distinct pre-token that a worker does not know yet goes through the tokenizers library; no token
spans two pre-tokens, so the ids of a text are those that the library gives to all of it.  Documents are dealt to parts of about ``PART_BYTES`` by
ranges of (doc_id, a checksum of the text), so one id with many texts spreads, and sorted inside.  A part is
written once, under a name that no other attempt has, and reported with its counts; the driver turns the counts
of the parts (not of documents) into bases by a prefix sum and lists in the manifest just the parts that were
reported.  Parts of attempts that were lost are never read.  Files lie in a folder that all executors see; where it
is a local path they are memory-mapped, else read through the file system of its scheme.

Defined results: null and empty texts hold the end id alone; documents without an id come first; documents with
one and the same id, or none, keep the order of the checksums of their texts and then of the texts; repeated rows
are written each; an empty table gives a manifest without parts; other columns are not written.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayquad.llm.bpe import Cutter, vocabulary
from wayquad.llm.common import pin, ready, remove, shared_dir, slices, table, texts

#: Bytes of text in a part, about.
PART_BYTES = 16 << 20
END = 2
#: Pre-tokens that go to the library as one text.
JOINED = 512


class LibraryEncoder(Cutter):
    """A file of the tokenizers library, without its truncation and padding."""

    limit = 700_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker uses one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            super().__init__(json.load(file))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        # A character of a byte-level token stands for one byte.
        self.sizes = np.zeros(1 + max(vocab.values()), np.int64)
        self.sizes[list(vocab.values())] = list(map(len, vocab))

    def words(self, distinct: list[str]) -> list[bytes]:
        """Ids of pre-tokens.

        Those that begin with a space and a character that is none go to the library many at a time: beginnings like
        these are pre-token borders, and the ids are cut where the bytes of a word end.
        """
        out: list[bytes] = [b""] * len(distinct)
        together = [k for k, w in enumerate(distinct) if w[0] == " " and w[1:2] and not w[1].isspace()]
        apart = sorted(set(range(len(distinct))).difference(together))
        for low in range(0, len(together), JOINED):
            own = together[low : low + JOINED]
            ids = np.array(self.tokenizer.encode("".join([distinct[k] for k in own]), add_special_tokens=False).ids, "<i4")
            ends = np.cumsum([len(distinct[k].encode()) for k in own])
            stops = ((np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4).tolist()
            raw = ids.tobytes()
            for k, i, j in zip(own, [0, *stops], stops, strict=False):
                out[k] = raw[i:j]
        for k, e in zip(apart, self.tokenizer.encode_batch_fast([distinct[k] for k in apart], add_special_tokens=False), strict=True):
            out[k] = array("i", e.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class PartWriter:
    """Streams one part to its files and reports it."""

    def __init__(self, folder: str, kind: np.dtype, part: int):
        self.files, root = store(folder)
        self.name, self.kind, self.part = f"part-{uuid.uuid4().hex}", kind, part
        self.ids = self.files.open_output_stream(f"{root}/{self.name}.bin")
        self.root, self.sizes, self.keys = root, [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.ids.write(ids.astype(self.kind).tobytes())
        self.sizes.append(len(ids))
        self.keys.append(key)

    def close(self) -> dict:
        self.ids.close()
        for suffix, values in ((".off", np.append(0, np.cumsum(self.sizes)).astype("<u8")), (".key", np.array([k or 0 for k in self.keys], "<i8"))):
            with self.files.open_output_stream(f"{self.root}/{self.name}{suffix}") as out:
                out.write(values.tobytes())
        return {"name": self.name, "part": self.part, "documents": len(self.keys), "nameless": self.keys.count(None), "ids": sum(self.sizes)}


REPORT = "name string, part long, documents long, nameless long, ids long"


def write(docs: DataFrame, folder: str, path: str, end: int | None = END, parts: int | None = None) -> dict:
    """Encode ``docs`` (doc_id, text), append ``end`` to each and write the dataset; returns the manifest."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = parts or max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    kind = id_type(_vocabulary_size(path))
    files, root = store(folder)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library(path), None
        tail = np.array([] if end is None else [end], "<i4").tobytes()
        for batch in slices(batches, "text", 4 << 20):
            part = part or PartWriter(folder, kind, batch.column(2)[0].as_py())
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch.column(1))), strict=True):
                part.add(key, np.frombuffer(ids + tail, "<i4"))
        if part:
            yield pa.RecordBatch.from_pylist([part.close()], pa.schema([("name", pa.string()), *((c, pa.int64()) for c in ("part", "documents", "nameless", "ids"))]))

    check = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), check).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), check, "text")
    numbered = ordered.withColumn("part", F.spark_partition_id().cast("long"))
    reported = sorted((r.asDict() for r in numbered.mapInArrow(run, REPORT).collect()), key=lambda r: r["part"])
    for part, base in zip(reported, accumulate([0, *(r["ids"] for r in reported)]), strict=False):
        part["base"] = base
    manifest = {"folder": folder, "id_bytes": kind.itemsize, "parts": reported}
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


@lru_cache(maxsize=2)
def _vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return 1 + max([END, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def open_part(folder: str, name: str, id_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and keys of a part; memory-mapped where the folder is local."""
    files, root = store(folder)
    kinds = ((".bin", f"<u{id_bytes}"), (".off", "<u8"), (".key", "<i8"))
    if isinstance(files, fs.LocalFileSystem):
        ids, offsets, keys = (np.memmap(f"{root}/{name}{suffix}", kind, "r") for suffix, kind in kinds)
    else:
        ids, offsets, keys = (np.frombuffer(files.open_input_stream(f"{root}/{name}{suffix}").read(), kind) for suffix, kind in kinds)
    return ids, offsets, keys


def read(spark: SparkSession, folder: str, each: Callable[[np.ndarray], dict], schema: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and what ``each`` makes of a document's ids."""
    files, root = store(folder)
    with files.open_input_stream(f"{root}/manifest.json") as file:
        manifest = json.loads(file.read())
    width = manifest["id_bytes"]
    listed = [(p["name"], p["base"], p["nameless"]) for p in manifest["parts"]]
    ready(spark)
    parts = spark.createDataFrame(listed, "name string, base long, nameless long").repartition(max(1, len(listed)))
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, keys = open_part(folder, row["name"], width)
                for low in range(0, len(keys), 1000):
                    stops = offsets[low : low + 1001].astype(np.int64).tolist()
                    own = [None if low + k < row["nameless"] else key for k, key in enumerate(keys[low : low + 1000].tolist())]
                    out = [{"doc_id": k, "start": row["base"] + a, "n_tokens": b - a, **each(ids[a:b])} for k, a, b in zip(own, stops, stops[1:], strict=False)]
                    yield pa.RecordBatch.from_pylist(out, arrow)

    return parts.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def ids_of(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a dataset with their ids."""
    return read(spark, folder, lambda ids: {"ids": ids.tolist()}, "ids array<long>", [("ids", pa.list_(pa.int64()))])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, vocabulary())
    digest = lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
    found = pin(read(spark, folder, digest, "ids_crc32 long", [("ids_crc32", pa.int64())]))
    remove(spark, folder)
    return found
