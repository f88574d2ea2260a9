"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised to words: A-Z becomes a-z, every other ASCII character that is not a digit or a-z
separates words, all other characters belong to words.  A window is ``window`` consecutive words of an
item; an item with fewer words is one window.  The automaton runs over word numbers, so a document is
scanned once and a match gives word positions, which map to character offsets in the original text.

Size bound: an automaton holds the windows of about ``BLOCK_WORDS`` benchmark words, and only one block of the
benchmark is collected and broadcast at a time.  Items longer than ``PIECE_WORDS`` are cut into pieces that overlap
by a window less one word, so every window lies in one piece; pieces are dealt to blocks by hash.  A larger
benchmark takes one pass over the documents a block, each written to the shared folder with what it has found so
far.  Memory is the same at every size and no window is left out.

Defined results: null and empty texts have no words and no hits; an item without words has no window; a
null item_id counts as the empty string; items with one item_id count once; repeated documents are judged each;
an empty benchmark hits nothing.  Only the text column is read, other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import groupby, repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayquad.llm.common import fresh, pin, ready, shared_dir, slices, table, texts

BLOCK_WORDS, PIECE_WORDS = 100_000, 5_000
WINDOW = 10
#: Byte by byte: a word's byte in its normal form, or a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


def words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def spans(text: str, hit: bytearray) -> list[dict[str, int]]:
    """Character ranges of the runs of hit words in the original text."""
    raw = text.encode()
    found: list[list[int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(raw.translate(NORMAL))):
        if hit[k]:
            if last == k - 1:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
            last = k
    out, chars, at = [], 0, 0
    for a, b in found:
        chars += len(raw[at:a].decode())
        length = len(raw[a:b].decode())
        out.append({"start": chars, "end": chars + length})
        chars, at = chars + length, b
    return out


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        patterns: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            for start in range(max(1, len(ids) - window + 1)):
                part = ids[start : start + window]
                if part:
                    patterns.setdefault(part, (len(part), []))[1].append(k)
        for part, value in patterns.items():
            self.automaton.add_word(part, value)
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, document: list[bytes], hit: bytearray, items: set[int]) -> None:
        if self.empty or not document:
            return
        for end, (size, owners) in self.automaton.iter(tuple(map(self.numbers.get, document, repeat(0)))):
            hit[end - size + 1 : end + 1] = b"\x01" * size
            items.update(owners)


_ready: dict[str, Matcher] = {}


def matcher(run: str, items: list[tuple[str, str]], window: int) -> Matcher:
    """The automaton of a pass; a worker keeps one at a time."""
    if run not in _ready:
        _ready.clear()
        _ready[run] = Matcher(items, window)
    return _ready[run]


def pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """name, body (normalised words) and their number, items of over ``PIECE_WORDS`` words in several rows."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            names, bodies, sizes = [], [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = words(body)
                for low in range(0, max(1, len(cut) - window + 1), PIECE_WORDS):
                    part = cut[low : low + PIECE_WORDS + window - 1]
                    names.append(name)
                    bodies.append(b" ".join(part).decode())
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string()), pa.array(sizes, pa.int64())], names=["name", "body", "n"])

    return items.mapInArrow(run, "name string, body string, n long")


def ranges(hit: bytearray) -> list[dict[str, int]]:
    """Runs of hit words as (start, end)."""
    out, at = [], 0
    for value, run in groupby(hit):
        n = sum(1 for _ in run)
        if value:
            out.append({"start": at, "end": at + n})
        at += n
    return out


STATE = "struct<items:array<string>,ranges:array<struct<start:int,end:int>>>"
ARROW_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ARROW_STATE = pa.struct([("items", pa.list_(pa.string())), ("ranges", ARROW_RANGES)])
ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", ARROW_RANGES)])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text", into: str = "found") -> DataFrame:
    """Add ``into``: number of words, number of hit words, items (names as text, distinct) and hit spans; a column of that name is replaced."""
    docs = docs.drop(into)
    spark = docs.sparkSession
    ready(spark)
    shared_dir(spark)
    cut = pieces(benchmark, window)
    n_blocks = max(1, -(-int(cut.agg(F.sum("n")).first()[0] or 0) // block_words))
    cut = cut if n_blocks == 1 else pin(cut)
    state, first = fresh(docs, "_state"), True
    for k in range(n_blocks):
        block = cut if n_blocks == 1 else cut.where(F.pmod(F.xxhash64("name", "body"), F.lit(n_blocks)) == k)
        sent = spark.sparkContext.broadcast([(r["name"], r["body"]) for r in block.select("name", "body").collect()])
        last = k == n_blocks - 1
        docs = _scanned(docs, sent, window, text, state, into, first, last)
        if not last:
            docs, first = pin(docs), False
            sent.destroy()
    return docs


def _scanned(docs: DataFrame, sent, window: int, text: str, state: str, into: str, first: bool, last: bool) -> DataFrame:
    """One pass: add what the items of ``sent`` hit to the column ``state``, and make ``into`` of it in the last one."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            with_items = matcher(name, sent.value, window)
            bodies = texts(batch.column(batch.schema.get_field_index(text)))
            before = [None] * len(bodies) if first else batch.column(batch.schema.get_field_index(state)).to_pylist()
            out = []
            for body, old in zip(bodies, before, strict=True):
                document = words(body)
                hit, owner = bytearray(len(document)), set(old["items"]) if old else set()
                for r in old["ranges"] if old else ():
                    hit[r["start"] : r["end"]] = b"\x01" * (r["end"] - r["start"])
                own: set[int] = set()
                with_items.scan(document, hit, own)
                owner.update(with_items.names[i] for i in own)
                if last:
                    out.append({"n_words": len(document), "n_hit": sum(hit) if owner else 0, "items": sorted(owner), "spans": spans(body, hit) if owner else []})
                else:
                    out.append({"items": sorted(owner), "ranges": ranges(hit) if owner else []})
            kept = [c for c in batch.schema.names if c != state]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, ARROW_FOUND if last else ARROW_STATE)], names=[*kept, into if last else state])

    added = T.StructField(into, ADDED) if last else T.StructField(state, T._parse_datatype_string(STATE))
    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name != state), added]))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    name = fresh(docs, "_found")
    return find(docs, benchmark, window, into=name).where(F.col(f"{name}.n_hit") == 0).drop(name)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, coalesce(item_id::VARCHAR, '') AS name, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (
  SELECT i, name, least(len(w), {WINDOW}) AS size, list_slice(w, s, s + least(len(w), {WINDOW}) - 1) AS win
  FROM (SELECT i, name, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, s, size, list_slice(w, s, s + size - 1) AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.r, dw.s, dw.size, bw.i, bw.name FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY encode(name)) AS names FROM (SELECT DISTINCT r, name FROM m) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
