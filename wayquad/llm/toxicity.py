"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, spell normalised text byte by byte: words of letters and digits in lower
case with one space between them.  Contexts are the ``ORDER - 1`` bytes before, across the ends of words, so
expressions of several short words count, and so do stems that take many endings.  The longest runs have the
number of distinct labelled texts of the class that hold them (a text of over ``PIECE`` bytes counts once a
piece); every lower order has continuation counts, the number of different bytes that come before a run.
Runs of up to ``SHARED`` bytes have continuation counts that both classes share, from all documents, labelled
or not, so what neither class knows is equally likely in both.

A text is compared by one figure, the difference of its two log-likelihoods divided by its number of bytes.  A
logistic function turns that figure into a score; its second input is the logarithm of the length, because a
short text's mean is less certain.  It is fitted on ``PER_CLASS`` labelled texts of each class at most (those
with the smallest hashes of their ids); each half of the texts is compared by the models of the other half,
so that it sees runs that these models have not learnt.  Frequencies of all labelled texts set the bias.

All counts are summed in Spark over all labelled texts outside the held-out remainder.  Only distinct runs of
``ORDER`` bytes with four counts, and distinct shared runs, reach the driver: their number follows the
vocabulary, not the number of texts.  Of the calibration texts only the figures do.

Defined results: null, empty and wordless texts get the toxic share of the labelled texts; with labels of one
class only, or none, every score is that share, or 0; equal texts count once, toxic if any of them is;
repeated rows count once and are scored each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayquad.llm.common import crc_of_id, fresh, ready, shared_dir, slices, small, table, texts
from wayquad.llm.labelled import learn_rows, logistic, sample, usable

ORDER, SHARED, DISCOUNT = 5, 2, 0.9
PER_CLASS = (3000, 3000)
#: Ridge of the logistic function: classes lie far apart, so little of it.
RIDGE = 1e-4
MODULUS, HELD = 4, 2
THRESHOLD = 0.3
#: Runs of a text that are looked at together.
PIECE = 1 << 18
#: A task that counts gives its counts away when it holds so many entries.
COUNT_ROWS = 500_000
#: Entries of a worker's memory of runs.
MEMO = 1 << 18
SEPARATORS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
HALVES = ("n00", "n01", "n10", "n11")  # half, class


def normal(text: str) -> bytes:
    """Words in lower case with one space between them; a space ends the text and ``ORDER - 1`` begin it; empty without words."""
    words = text.encode().translate(SEPARATORS).decode("utf-8", "replace").lower().encode().split()
    return b" " * (ORDER - 1) + b" ".join(words) + b" " if words else b""


def pieces(bodies: Iterable[bytes], length: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Blocks of texts: the text's place for each piece, the first key of each piece, and the keys of its runs of ``length`` bytes."""
    block: list[bytes] = []
    owners: list[int] = []
    held = 0

    def keys() -> tuple[list[int], np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(block), np.uint8).astype(np.uint64)
        n = len(x) - length + 1
        key = np.zeros(n, np.uint64)
        for k in range(length):
            key = (key << np.uint64(8)) | x[k : n + k]
        sizes = np.fromiter(map(len, block), np.int64, len(block))
        starts = np.cumsum(sizes) - sizes
        inside = np.ones(n, bool)
        for k in range(1, length):
            cut = starts[1:] - k
            inside[cut[cut < n]] = False
        return owners, np.cumsum(sizes - length + 1) - (sizes - length + 1), key[inside]

    for k, body in enumerate(bodies):
        for low in range(0, max(0, len(body) - length + 1), PIECE):
            block.append(body[low : low + PIECE + length - 1])
            owners.append(k)
            held += len(block[-1])
            if held >= 4 * PIECE:
                yield keys()
                block, owners, held = [], [], 0
    if block:
        yield keys()


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of the rows of ``weights``."""
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(back, weights[:, c], len(distinct)) for c in range(weights.shape[1])], axis=1)


def counted(bodies: list[bytes], column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs, and in how many texts each occurs, in the column that each text belongs to."""
    found = []
    for owners, starts, key in pieces(bodies, ORDER):
        own = np.repeat(np.arange(len(owners), dtype=np.uint64), np.diff(np.append(starts, len(key))))
        once = np.unique((own << np.uint64(8 * ORDER)) | key)
        at = column[np.array(owners)[(once >> np.uint64(8 * ORDER)).astype(np.int64)]]
        distinct, back = np.unique(once & np.uint64((1 << (8 * ORDER)) - 1), return_inverse=True)
        found.append((distinct, np.bincount(back * width + at, minlength=len(distinct) * width).reshape(-1, width)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros((0, width))
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def shared_runs(bodies: Iterable[bytes]) -> np.ndarray:
    """The distinct runs of ``SHARED + 1`` bytes."""
    seen = np.zeros(1 << (8 * (SHARED + 1)), bool)
    for _, _, key in pieces(bodies, SHARED + 1):
        seen[key.astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.uint64)


class Level:
    """The runs of one length with the part of the probability that they keep, and the weights of their contexts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys = keys
        self.contexts, back = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.stack([np.bincount(back, n[:, c], len(self.contexts)) for c in (0, 1)], axis=1)
        kinds = np.stack([np.bincount(back, n[:, c] > 0, len(self.contexts)) for c in (0, 1)], axis=1)
        safe = np.where(total > 0, total, 1)
        self.kept = np.maximum(n - DISCOUNT, 0) / safe[back]
        self.weight = np.where(total > 0, DISCOUNT * kinds / safe, 1)

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(wanted), 2), default)
        i = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
        return np.where((keys[i] == wanted)[:, None], values[i], default)

    def apply(self, runs: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return self._get(self.keys, self.kept, runs, 0) + self._get(self.contexts, self.weight, runs >> np.uint64(8), 1) * lower


class KneserNey:
    """Interpolated models of two classes: p = kept(run) + weight(context) * p of the shorter run."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, runs: np.ndarray):
        """``keys``: distinct runs of ORDER bytes, ``n``: their counts by class, ``runs``: the distinct runs that are shared."""
        self.levels: list[Level] = []
        there = n.sum(axis=1) > 0
        keys, n = keys[there], n[there]
        shared: list[Level] = []
        for length in range(SHARED, 0, -1):
            runs, before = np.unique(runs & np.uint64((1 << (8 * length)) - 1), return_counts=True)
            shared.append(Level(runs, np.repeat(before[:, None].astype(float), 2, axis=1)))
        own: list[Level] = []
        for length in range(ORDER, SHARED, -1):
            own.append(Level(keys, n))
            # How many different bytes come before each shorter run, in texts of each class.
            keys, n = summed(keys & np.uint64((1 << (8 * (length - 1))) - 1), (n > 0).astype(float))
        self.levels = [*reversed(shared), *reversed(own)]

    def gain(self, runs: np.ndarray) -> np.ndarray:
        """log P(last byte | the bytes before, toxic) - log P(... | ordinary) of runs of ORDER bytes."""
        p = np.full((len(runs), 2), 1 / 256)
        for length, level in enumerate(self.levels, 1):
            p = level.apply(runs & np.uint64((1 << (8 * length)) - 1), p)
        return np.log(p[:, 1]) - np.log(p[:, 0])


class Comparer:
    """Figures of texts under a pair of models, behind a memory of runs."""

    def __init__(self, models: KneserNey):
        self.models = models
        self.keys = np.full(MEMO, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(MEMO)

    def gains(self, runs: np.ndarray) -> np.ndarray:
        slot = ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO.bit_length() + 1)).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != runs)
        if len(miss):
            distinct, back = np.unique(runs[miss], return_inverse=True)
            found = self.models.gain(distinct)
            out[miss] = found[back]
            self.keys[slot[miss]], self.values[slot[miss]] = runs[miss], out[miss]
        return out

    def figures(self, bodies: list[bytes]) -> np.ndarray:
        """For each text the mean gain of a byte and the logarithm of its length; 0 and 0 without words."""
        total, size = np.zeros(len(bodies)), np.zeros(len(bodies))
        for owners, starts, key in pieces(bodies, ORDER):
            # Each piece is summed by itself, so a text's sum does not depend on its neighbours.
            np.add.at(total, owners, np.add.reduceat(self.gains(key), starts))
            np.add.at(size, owners, np.diff(np.append(starts, len(key))))
        return np.stack([total / np.maximum(size, 1), np.log1p(size)], axis=1)


class Model:
    """Models of both classes with their calibration; ``constant`` where the labels do not tell classes apart."""

    def __init__(self, share: float, models: KneserNey | None = None, weights: np.ndarray | None = None):
        self.share, self.models, self.weights = share, models, weights
        self.comparer: Comparer | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "comparer": None}

    def scores(self, block: list[str]) -> list[float]:
        if self.models is None or self.weights is None:
            return [self.share] * len(block)
        self.comparer = self.comparer or Comparer(self.models)
        x = self.comparer.figures([normal(t) for t in block])
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))
        return np.where(x[:, 1] > 0, p, self.share).round(12).tolist()


def learnt(docs: DataFrame, found: DataFrame, n_found: int) -> DataFrame:
    """text, y and half of the distinct labelled texts."""
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("digest", F.md5(F.col("text").cast("binary")))
    # Which row stands for each text is settled without the texts.
    named = rows.select("doc_id", "digest").join(small(found, n_found, 32), "doc_id")
    stands = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))
    chosen = rows.join(small(stands, n_found, 96), ["digest", "doc_id"])
    if stands.where("n > ids").limit(1).count():
        chosen = chosen.dropDuplicates(["digest", "doc_id"])
    return chosen.select("text", "y", (F.conv(F.substring("digest", -1, 1), 16, 10).cast("int") % 2).alias("half"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model:
    """Learn from the labelled rows outside the held-out remainder."""
    spark = docs.sparkSession
    ready(spark)
    shared_dir(spark)
    found, totals = usable(docs, labels, label, learn_rows(MODULUS, HELD))
    share = float(totals[1] / totals.sum()) if totals.sum() else 0.0
    if not totals.all():
        return Model(share)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def given() -> pa.RecordBatch:
            keys, n = summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held[:] = [(keys, n)]
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(n[:, k].astype(np.int64)) for k in range(4))], names=["run", *HALVES])

        for batch in slices(batches, "text"):
            column = np.array(batch.column(2).to_pylist()) * 2 + np.array(batch.column(1).to_pylist())
            held.append(counted([normal(t) for t in texts(batch.column(0))], column, 4))
            if sum(len(k) for k, _ in held) > COUNT_ROWS:
                if len((out := given()).column(0)) > COUNT_ROWS // 2:
                    held.clear()
                    yield out
        if held:
            yield given()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = (normal(t) for batch in slices(batches, "text") for t in texts(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(shared_runs(bodies).astype(np.int64))], names=["run"])

    counts = learnt(docs, found, int(totals.sum())).mapInArrow(own, "run long, " + ", ".join(f"{x} long" for x in HALVES))
    counts = counts.groupBy("run").agg(*(F.sum(x).alias(x) for x in HALVES)).orderBy("run").toArrow()
    everywhere = docs.select("text").where("text IS NOT NULL").mapInArrow(runs, "run long").distinct().orderBy("run").toArrow()
    keys, n = counts.column("run").to_numpy().astype(np.uint64), np.stack([counts.column(x).to_numpy() for x in HALVES], axis=1).astype(float)
    shared = everywhere.column("run").to_numpy().astype(np.uint64)
    # A half is judged by the models of the other half, if that has texts of both classes.
    halves = [KneserNey(keys, n[:, 2 - 2 * h : 4 - 2 * h] if n[:, 2 - 2 * h : 4 - 2 * h].any(axis=0).all() else n[:, :2] + n[:, 2:], shared) for h in (0, 1)]
    sent = spark.sparkContext.broadcast(halves)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [Comparer(m) for m in sent.value]
        for batch in slices(batches, "text"):
            bodies, half = [normal(t) for t in texts(batch.column(0))], np.array(batch.column(2).to_pylist())
            x = np.zeros((len(bodies), 2))
            for h in (0, 1):
                mine = np.flatnonzero(half == h)
                x[mine] = judges[h].figures([bodies[k] for k in mine])
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["mean", "size", "y"])

    # One text an id at most, so the figures are as many as the sample allows.
    chosen = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample(found, totals, per_class)), "doc_id").groupBy("doc_id", "y")
    half = (F.conv(F.substring(F.md5(F.col("text").cast("binary")), -1, 1), 16, 10).cast("int") % 2).alias("half")
    judged = chosen.agg(F.min("text").alias("text")).select("text", "y", half).mapInArrow(figures, "mean double, size double, y int").toArrow()
    x, y = np.stack([judged.column("mean").to_numpy(), judged.column("size").to_numpy()], axis=1), judged.column("y").to_numpy()
    order = np.lexsort((y, x[:, 1], x[:, 0]))  # one order of summation
    x, y = x[order][x[order][:, 1] > 0], y[order][x[order][:, 1] > 0]
    sent.destroy()
    taken = np.array([(y == 0).sum(), (y == 1).sum()])
    if not taken.all():
        return Model(share)
    weights = logistic(x, y, RIDGE)
    weights[-1] += np.log(totals[1] / totals[0]) - np.log(taken[1] / taken[0])
    return Model(share, KneserNey(keys, n[:, :2] + n[:, 2:], shared), weights)


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


def ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    name = fresh(docs, "_score")
    return score(docs, model, into=name).where(F.col(name) < THRESHOLD).drop(name)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(MODULUS)) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
