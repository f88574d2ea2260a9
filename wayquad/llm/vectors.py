"""Approximate nearest neighbours by inner product in a hierarchical k-means tree.

The tree is fitted on the driver with at most ``SAMPLE`` vectors (those with the smallest hashes of their ids): every
node splits by k-means into ``BRANCH`` children until a leaf stands for about ``LEAF`` rows of the whole table or
for ``LEAST`` sampled vectors, so the number of leaves grows with the table up to SAMPLE / LEAST.  Every row goes to
the leaf reached by the nearest centre at each level.

A query walks the tree best-bin-first: a priority queue holds subtrees by the inner product with their
centres, plus a weight times their reach (the distance of a subtree's farthest sampled vector from its centre)
times the query's length.  How many leaves a query visits is calibrated: ``PROBES`` sampled vectors are answered by
brute force over all rows, in one pass, and visits widen until ``RECALL`` of their true neighbours lie in
visited leaves; of the weights in ``REACHES`` the one that needs the fewest visits is taken.

Equal vectors are one point with its smallest ``k + 1`` ids, which are all that any answer can hold, so a
vector that a third of the rows share costs one point; equal queries are answered once.  Neighbouring
leaves form bundles of about ``BUNDLE`` points, larger ones are dealt in blocks; queries meet the blocks of
their bundles and look at the leaves they visit, scores are double-precision inner products of the original
vectors, and each block returns its best ``k + 1`` ids, which the final top-k merges.  Tables with a row a bundle
are broadcast: they have no more rows than the tree has leaves.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither
do rows with a null id; an inner product of vectors of unequal lengths does not exist, so of these only the most
common length takes part; ties go to the smaller id; with fewer candidates than ``k`` all of them are returned;
repeated ids count once each row; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayquad.llm.common import first, pin, ready, shared_dir, table

SAMPLE, PROBES, LEAST = 32768, 128, 4
BRANCH, LEAF, BUNDLE = 16, 192, 2048
RECALL = 0.95
REACHES = (0.0, 0.5)
#: Queries that meet one block of a bundle in one task.
QUERY_BLOCK = 4096


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the number of each row's centre; centres without rows fall out."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        kept, own = np.unique(own, return_inverse=True)
        size = np.bincount(own)
        centres = np.add.reduceat(x[np.argsort(own, kind="stable")], np.cumsum(size) - size, axis=0) / size[:, None]
    own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
    kept, own = np.unique(own, return_inverse=True)
    return centres[kept], own


class Tree:
    """Nodes hold child numbers (leaves: their leaf number), and the centres and reaches of their children."""

    def __init__(self, x: np.ndarray, per_leaf: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.children: list[list[int] | None] = []
        self.centres: list[np.ndarray | None] = []
        self.reaches: list[np.ndarray | None] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        self._grow(x, per_leaf, rng)

    def _grow(self, x: np.ndarray, per_leaf: float, rng: np.random.Generator) -> int:
        me = len(self.children)
        self.children.append(None)
        self.centres.append(None)
        self.reaches.append(None)
        self.leaf.append(-1)
        if len(x) > per_leaf:
            centres, own = kmeans(x, int(min(BRANCH, max(2, round(len(x) / per_leaf)))), rng)
            if len(centres) > 1:
                self.centres[me] = centres
                self.reaches[me] = np.array([np.linalg.norm(x[own == k] - c, axis=1).max() for k, c in enumerate(centres)])
                self.children[me] = [self._grow(x[own == k], per_leaf, rng) for k in range(len(centres))]
                return me
        self.leaf[me] = self.n_leaves
        self.n_leaves += 1
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[node]
            own = np.argmax(x[rows] @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
            todo += [(child, rows[own == k]) for k, child in enumerate(self.children[node]) if (own == k).any()]
        return out

    def visit(self, q: np.ndarray, reach: float = 0.0) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue, far = [(0.0, 0)], reach * float(np.linalg.norm(q))
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                yield self.leaf[node]
                continue
            near = self.centres[node] @ q + far * self.reaches[node]
            for child, s in zip(self.children[node], near.tolist(), strict=True):
                heapq.heappush(queue, (-s, child))


def calibrate(tree: Tree, probes: np.ndarray, leaves: list[list[int]], recall: float = RECALL) -> tuple[int, float]:
    """The smallest number of visits that reaches ``recall`` of the true neighbours, which lie in ``leaves``, and its weight of the reach."""
    best = (tree.n_leaves, REACHES[0])
    for reach in REACHES:
        places: list[int] = []
        for q, wanted in zip(probes, leaves, strict=True):
            left = Counter(wanted)
            for place, leaf in enumerate(tree.visit(q, reach), 1):
                places += [place] * left.pop(leaf, 0)
                if not left:
                    break
        if places:
            places.sort()
            best = min(best, (max(1, places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]), reach))
    return best


def truth(placed: DataFrame, probes: np.ndarray, names: list[int], k: int) -> list[list[int]]:
    """For each probe the leaves of its ``k`` nearest other points, by brute force over all points; tasks send ``k`` a probe."""
    sent = placed.sparkSession.sparkContext.broadcast((probes, np.array(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, names = sent.value
        scores, points, leaves = (np.zeros((len(probes), 0), t) for t in (float, np.int64, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch.column(0).to_numpy()
            near = probes @ _matrix(batch.column(1)).T
            near[names[:, None] == here[None, :]] = -np.inf
            scores = np.concatenate((scores, near), axis=1)
            points, leaves = (np.concatenate((old, np.broadcast_to(new, near.shape)), axis=1) for old, new in ((points, here), (leaves, batch.column(2).to_numpy())))
            best = np.lexsort((points, -scores), axis=1)[:, :k]
            scores, points, leaves = (np.take_along_axis(a, best, axis=1) for a in (scores, points, leaves))
        row = np.repeat(np.arange(len(probes)), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(scores.ravel()), pa.array(points.ravel()), pa.array(leaves.ravel())], names=["probe", "score", "point", "leaf"])

    found = placed.select("point", "v", "leaf").mapInArrow(run, "probe long, score double, point long, leaf long").where("score > double('-inf')")
    out: list[list[int]] = [[] for _ in names]
    for r in _first(found, ["probe"], [F.desc("score"), "point"], k).select("probe", "leaf").collect():
        out[r["probe"]].append(r["leaf"])
    return out


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part, in double precision."""
    v = F.col(embedding).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    return rows.where(F.size("v") == (width[0]["w"] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(rows: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row that ``is_query`` (a Column of ``id``) picks."""
    spark = rows.sparkSession
    ready(spark)
    shared_dir(spark)
    own = usable(rows, vec_id, embedding)
    # At most k + 1 ids of a point are kept, the rest before the shuffle: no answer holds more of them.
    numbered = _first(own, ["v"], ["id"], k + 1).groupBy("v").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids"))
    points = pin(numbered.select("point", "v", "ids"))
    total = points.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    taken = first(points.select("point", "v"), "point", SAMPLE + PROBES, total).toArrow().combine_chunks()
    x, names = _matrix(taken.column("v").combine_chunks()), taken.column("point").to_pylist()
    cut = max(1, len(x) - min(PROBES, len(x) // 4))
    tree = Tree(x[:cut], max(float(LEAST), LEAF * cut / total))
    grown = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = grown.value.assign(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    points = pin(points.mapInArrow(place, "point long, v array<double>, ids array<long>, leaf long"))
    visits, reach = calibrate(tree, x[cut:], truth(points, x[cut:], names[cut:], k), recall) if tree.n_leaves > 1 and cut < len(x) else (tree.n_leaves, 0.0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [list(islice(grown.value.visit(q, reach), visits)) for q in _matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

    # Neighbouring leaves form bundles of about BUNDLE points, so a query gets one list a bundle, not one a leaf.
    together = max(1, int(BUNDLE * tree.n_leaves / total))
    placed = points.withColumn("bundle", F.expr(f"leaf div {together}"))
    size = pin(placed.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / (2 * BUNDLE)).cast("int").alias("blocks")))
    placed = placed.join(F.broadcast(size), "bundle").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    asked = own.where(is_query(F.col("id"))).groupBy("v").agg(F.min("id").alias("q")).select("q", "v")
    visited = asked.mapInArrow(route, "q long, v array<double>, leaves array<long>")
    routed = visited.withColumn("bundle", F.explode(F.expr(f"array_distinct(transform(leaves, l -> l div {together}))")))
    routed = routed.withColumn("leaves", F.expr(f"filter(leaves, l -> l div {together} = bundle)"))
    crowd = pin(routed.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts")).join(F.broadcast(size), "bundle"))
    # Every block of queries of a bundle meets every block of its points; both are spread by hash.
    asking = routed.join(F.broadcast(crowd), "bundle").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    offered = placed.join(F.broadcast(crowd.select("bundle", "parts")), "bundle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = asking.select("bundle", "block", "part", F.col("q").alias("key"), "v", "leaves", F.lit(None).cast("array<long>").alias("ids")).union(
        offered.select("bundle", "block", "part", F.lit(None).cast("long").alias("key"), "v", F.array("leaf").alias("leaves"), "ids")
    )

    def meet(group: pa.Table) -> pa.Table:
        keys = group.column("key").combine_chunks()
        wanted = keys.is_valid()
        queries, there = group.filter(wanted), group.filter(pc.invert(wanted))
        out: list[dict] = []
        if queries.num_rows and there.num_rows:
            q, v = _matrix(queries.column("v").combine_chunks()), _matrix(there.column("v").combine_chunks())
            ids = there.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            names = queries.column("key").to_pylist()
            leaves, leaf = np.unique(there.column("leaves").combine_chunks().flatten().to_numpy(), return_inverse=True)
            wanted_leaves = queries.column("leaves").to_pylist()
            for low in range(0, len(q), 256):
                near = q[low : low + 256] @ v.T
                for row, scores in enumerate(near):
                    seen = np.flatnonzero(np.isin(leaves, wanted_leaves[low + row])[leaf])
                    best = seen[_best(scores[seen], first[seen], k + 1)]
                    listed = sorted((-s, i) for b, s in zip(best.tolist(), scores[best].tolist(), strict=True) for i in ids[b])[: k + 1]
                    out.append({"q": names[low + row], "near": [{"m": m, "id": i} for m, i in listed]})
        return pa.Table.from_pylist(out, pa.schema([("q", pa.int64()), ("near", pa.list_(pa.struct([("m", pa.float64()), ("id", pa.int64())])))]))

    # One row a query and block, with the best k + 1 ids of the block.
    found = sides.groupBy("bundle", "block", "part").applyInArrow(meet, "q long, near array<struct<m:double,id:long>>")
    listed = found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    answers = own.where(is_query(F.col("id"))).join(asked.withColumnRenamed("v", "qv"), F.col("v") == F.col("qv")).select(F.col("id").alias("query_id"), "q").join(listed, "q")
    others = answers.select("query_id", F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k).alias("near"))
    ranked = others.select("query_id", F.posexplode("near").alias("pos", "n"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.m")).alias("score"))


def _first(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; map tasks send no more than ``k`` of a group."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def _best(scores: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((first[some], -scores[some]))][:k]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
