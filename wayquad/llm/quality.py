"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words (lower-cased A-Z, hashed to ``WORDS`` terms), the runs of three character classes
of its bytes (letters in lower and upper case, digits, blanks, line ends, sentence marks, symbols of several
kinds, anything beyond ASCII), and four terms for n-grams that repeat: words like the word before, and words,
word pairs and word triples that have occurred before.  Counts become logarithms of rates, weighted by inverse
document frequency; the strongest ``RANK`` directions of the labelled sample (a truncated singular value
decomposition) make latent-semantic vectors of unit length.

The labelled vectors (at most sum(PER_CLASS) x RANK numbers, the bound of the sample) are broadcast.  Every
document is compared with all of them by exact cosine products, ``BLOCK`` documents at a time; its
``NEIGHBOURS`` nearest vote with their labels, weighted by a power of the similarity and by how many labelled
rows of its class a sampled row stands for.  Products are made in blocks of one shape in double precision and
rounded to nine places, so a score does not depend on the rows beside it.

Defined results: null and empty texts have no neighbours and get the share of label 1 among the labelled
rows; without any label every score is 0; equal similarities are counted in the order of the labelled ids; a
labelled id with several texts is learnt with the smallest of them; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayquad.llm.common import crc_of_id, fresh, ready, shared_dir, slices, table, texts, word_hashes
from wayquad.llm.labelled import learn_rows, sample, usable

PER_CLASS = (1000, 2000)
RANK, NEIGHBOURS, POWER, BLOCK = 64, 15, 8, 64
MODULUS, HELD = 5, 0
THRESHOLD = 0.3
#: Character classes 0 to 13; other control characters are 14, bytes beyond ASCII 15.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\v\f\r", ".", ",", "!?", "|", "#$%&*@^~+=", "-_/\\", ":;", "'\"`", "()[]{}<>")
KIND_OF = np.array([next((k for k, own in enumerate(KINDS) if chr(b) in own), 14 if b < 128 else 15) for b in range(256)], np.int64)
RUNS, WORDS, REPEATS = 16**3, 4096, 4
TERMS = RUNS + WORDS + REPEATS
#: Weight of the terms for repeated n-grams.
REPEATED = 4.0
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str) -> np.ndarray:
    """Counts of the terms of a text."""
    raw = text.encode()
    kinds = KIND_OF[np.frombuffer(raw, np.uint8)]
    out = np.zeros(TERMS)
    if len(kinds) > 2:
        out[:RUNS] = np.bincount((kinds[:-2] * 16 + kinds[1:-1]) * 16 + kinds[2:], minlength=RUNS)
    cut = raw.lower().split()
    if cut:
        w = np.fromiter(map(word_hashes.__getitem__, cut), np.uint64, len(cut))
        out[RUNS : RUNS + WORDS] = np.bincount((w % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
        two = w[:-1] * FACTOR ^ w[1:]
        three = two[:-1] * FACTOR ^ w[2:]
        out[RUNS + WORDS :] = (w[1:] == w[:-1]).sum(), *(len(x) - len(np.unique(x)) for x in (w, two, three))
    return out


def sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts).astype(np.int32)
    return at, counts[at]


def dense(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(TERMS)
    out[at] = counts
    return out


def rates(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the rates of a text's terms: runs a thousand runs, the other terms a hundred words."""
    runs, words = max(counts[:RUNS].sum(), 1), max(counts[RUNS : RUNS + WORDS].sum(), 1)
    out = np.zeros(TERMS)
    there = np.flatnonzero(counts)
    out[there] = np.log1p(counts[there] * np.where(there < RUNS, 1000 / runs, 100 / words))
    out[RUNS + WORDS :] *= REPEATED
    return out


def directions(m: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(seed).standard_normal((m.shape[1], rank + 16)).astype(m.dtype)
    for _ in range(6):
        q = np.linalg.qr(m.T @ (m @ q))[0]
    _, _, v = np.linalg.svd(m @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


class Model:
    """Labelled vectors; ``rows`` are the terms that occur in the sampled texts and their counts, in the order of ids."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, totals: np.ndarray):
        self.share = float(totals[1] / totals.sum()) if totals.sum() else 0.0
        self.y = y.astype(float)
        if not len(y):
            return
        self.idf = np.log((1 + len(y)) / (1 + np.bincount(np.concatenate([at for at, _ in rows]), minlength=TERMS))) + 0.2
        taken = np.array([(y == 0).sum(), (y == 1).sum()])
        self.stands = (totals / np.maximum(taken, 1))[y]
        weighted = np.zeros((len(rows), TERMS), np.float32)
        for k, row in enumerate(rows):
            weighted[k] = rates(dense(*row)) * self.idf
        self.base = directions(weighted, min(RANK, *weighted.shape)).astype(float)
        del weighted
        self.base *= self.idf[:, None]
        self.vectors = np.array([self._vector(dense(*row)) for row in rows])

    def _vector(self, counts: np.ndarray) -> np.ndarray:
        """A unit vector from the terms that occur."""
        r = rates(counts)
        there = np.flatnonzero(r)
        z = (r[there, None] * self.base[there]).sum(axis=0)
        return z / max(np.sqrt((z * z).sum()), 1e-9)

    def _voted(self, block: list[str]) -> np.ndarray:
        z = np.zeros((BLOCK, self.base.shape[1]))
        z[: len(block)] = [self._vector(terms(t)) for t in block]
        near = (z @ self.vectors.T)[: len(block)].round(9)
        k = min(NEIGHBOURS, len(self.y))
        # All above the k-th similarity, and the first of those that equal it.
        edge = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        above, equal = near > edge, near == edge
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        best = np.nonzero(chosen)[1].reshape(-1, k)
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** POWER * self.stands[best]
        total = weight.sum(axis=1)
        voted = (weight * self.y[best]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-12, voted, self.share).clip(0, 1).round(12)

    def scores(self, block: list[str]) -> list[float]:
        if not len(self.y):
            return [self.share] * len(block)
        return [s for low in range(0, len(block), BLOCK) for s in self._voted(block[low : low + BLOCK]).tolist()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS) -> Model:
    """Learn from the labelled rows outside the held-out remainder, at most ``per_class`` of each class."""
    ready(docs.sparkSession)
    shared_dir(docs.sparkSession)
    found, totals = usable(docs, labels, label, learn_rows(MODULUS, HELD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [sparse(terms(t)) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.list_(pa.int32())), pa.array([n for _, n in out], pa.list_(pa.float64()))], names=["doc_id", "y", "term", "n"])

    # One text an id, so at most sum(per_class) rows of at most TERMS numbers reach the driver.
    chosen = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample(found, totals, per_class)), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, term array<int>, n array<double>").orderBy("doc_id").toArrow()
    found = [(at.values.to_numpy(), n.values.to_numpy()) for at, n in zip(rows.column("term"), rows.column("n"), strict=True)]
    return Model(found, rows.column("y").to_numpy().astype(int), totals)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``, a number from 0 to 1, from the text alone; a column of that name is replaced."""
    ready(docs.sparkSession)
    docs = docs.drop(into)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = sent.value.scores(texts(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are predicted good, with their own columns."""
    name = fresh(docs, "_score")
    return score(docs, model, into=name).where(F.col(name) >= THRESHOLD).drop(name)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(MODULUS)) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
