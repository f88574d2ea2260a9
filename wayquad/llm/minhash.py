"""Near-duplicates by bottom-k sketches from one hash function.

1. One pass turns every text into the sorted distinct hashes of its word shingles.  Their smallest
   ``k`` values are the sketch.  Texts with one and the same set meet in one row (the class); only
   classes go on, so thousands of exact copies cost one row.
2. Inverted lists: two linked classes share at least ``need`` of their retained values, but for a chance
   below ``MISS``.  If each class ranks its values from rare to common, the two share one among the first
   ``size - need + 1``; only those enter the lists, which keeps common passages out of them.  The lists
   tie classes to candidate groups (stars towards the list's smallest class, so linear in its length).
3. Candidate groups of up to ``BLOCK`` classes are compared inside one task.  Larger ones are cut into zones of
   that size: classes whose lists lead to one smallest class lie in one zone, or in several if they are too many.
   Each zone is compared inside, and the first zone of such classes with their other zones (linear work).  Of
   what that leaves apart, two zones meet only if an inverted list holds classes of both that are not yet
   connected, and only classes of such lists take part; no task holds more than two zones.
4. Inside a task, inverted lists count the overlaps of sketches.  The union sketch of a pair (the ``k`` smallest
   values of both) estimates its similarity; pairs with fewer common values in it than a link shows (see
   ``needed``) fall out, and exact set sizes confirm the rest: ``scale_den * shared >= scale_num * union``.
   Only a spanning forest of the confirmed links leaves the task.
5. Components of the links: tasks of ``EDGES`` edges connect what they hold; label propagation with pointer
   jumping, written to the shared folder each round, connects the rest.

Hashes of shingles and of sets are 64 bits wide; two different ones of a corpus collide with a chance of
n^2 / 2^65 for n compared values, which is the only approximation besides ``MISS``.

Defined results: a null, empty or wordless text has size 0 and is its own component; texts with fewer
words than a shingle are one shingle; a component is named by the smallest doc_id of its rows, whatever the
type of doc_id; repeated ids are judged row by row, by their texts; rows with a null doc_id keep a null
component and are kept; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayquad.llm.common import fresh, pin, ready, shared_dir, slices, small, table, texts, word_hashes

K = 64
#: Chance that a link shows fewer common retained values than asked for.
MISS = 1e-9
BLOCK = 256
#: Edges that one task connects.
EDGES = 400_000
#: Shingles in a block, about.
VOLUME = 1 << 20
#: Pairs whose union sketches are made together.
PAIRS = 1 << 14
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Stands for no value in sketches that are not full.
NONE = np.iinfo(np.uint64).max


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; words end at ASCII white space, A-Z is lower-cased."""
    cut = text.encode().lower().split()
    if not cut:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(word_hashes.__getitem__, cut), np.uint64, len(cut))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * FACTOR
        h ^= h >> np.uint64(31)
    return np.unique(h)


def needed(size: int, k: int, share: float, miss: float = MISS) -> int:
    """Common retained values that a linked pair has, for a sketch of ``size`` values.

    Each of the k smallest values of the union is common with chance ``share``; the binomial tail bounds
    the sampling without replacement, and all of these values lie in both sketches.  Sets so small that
    every partner fits its sketch, too, are compared whole.
    """
    whole = max(1, math.ceil(share * size - 1e-9))
    if size < share * k:
        return whole
    tail, t = 0.0, 0
    while t < k:
        tail += math.comb(k, t) * share**t * (1 - share) ** (k - t)
        if tail > miss:
            break
        t += 1
    return max(1, min(t, whole))


def key_of(found: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "little", signed=True)


def sets(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, a digest of the text, n_shingles, the key of the set (cls) and its sketch (signed 64-bit values in unsigned order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t, n) for t in texts(batch.column(2))]
            sketches = [x[:k] for x in found]
            offsets = np.append(0, np.cumsum([len(x) for x in sketches])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([key_of(x) for x in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sketches, np.zeros(0, np.uint64)]).view(np.int64))),
                ],
                names=["doc_id", "body_md5", "n_shingles", "cls", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", body_md5().alias("body_md5"), "text").mapInArrow(run, f"doc_id {kind}, body_md5 binary, n_shingles long, cls long, sketch array<long>")


def body_md5() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def inverted_lists(classes: DataFrame, k: int, share: float) -> DataFrame:
    """(cls, near, lists): the inverted lists of rare retained values that hold a class and others, as an array of
    value and hub, the list's smallest class; near is the smallest hub.
    """
    need = F.expr("CASE " + " ".join(f"WHEN m = {s} THEN {needed(s, k, share)}" for s in range(1, k)) + f" ELSE {needed(k, k, share)} END")
    kept = classes.select("cls", F.explode("sketch").alias("value"))
    # Tables with a row a value are written before rows are joined to them, so that hot values can be split.
    common = pin(kept.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # Values of one class only come first in the order from rare to common and tie nothing.
    shared = kept.join(common, "value")
    by_class = shared.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    by_class = by_class.join(classes.select("cls", F.least("n_shingles", F.lit(k)).cast("int").alias("m")), "cls")
    room = F.col("m") - need + 1 - (F.col("m") - F.size("v"))
    lists = by_class.withColumn("room", room).where("room > 0").select("cls", F.explode(F.slice("v", F.lit(1), F.col("room"))).alias("x"))
    lists = pin(lists.select("cls", F.col("x.value").alias("value")))
    hubs = pin(lists.groupBy("value").agg(F.min("cls").alias("hub"), F.max("cls").alias("other")).where("hub < other").select("value", "hub"))
    return lists.join(hubs, "value").groupBy("cls").agg(F.min("hub").alias("near"), F.collect_list(F.struct("value", "hub")).alias("lists"))


def contract(edges: DataFrame, parts: int) -> DataFrame:
    """Edges dealt to ``parts`` tasks, each of which returns (a, b): its vertices with the smallest vertex it connects them to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches if b.num_rows]
        found = np.array(forest(np.concatenate(got)) if got else [], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return edges.select("a", "b").repartition(parts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the undirected edges (a, b); root is the smallest vertex reached.

    Tasks of about ``EDGES`` edges first connect what they hold; what is left between tasks is settled by
    propagating the smallest label, with pointer jumping.
    """
    edges = pin(edges)
    parts = -(-edges.count() // EDGES)
    stars = pin(contract(edges, max(1, parts)))
    roots = stars.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    if parts <= 1:
        return stars.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)
    both = pin(stars.union(stars.select(F.col("b"), F.col("a"))).distinct())
    labels = pin(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:  # labels only fall, so this ends; jumping makes the rounds few
        near = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("v")).agg(F.min("r").alias("r"))
        hooked = labels.join(near, "v", "left").select("v", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        # A root learns the smallest label that any of its vertices has found.
        lowest = hooked.groupBy(F.col("old").alias("at")).agg(F.min("root").alias("low"))
        for _ in range(2):  # pointer jumping: four steps towards the smallest
            further = lowest.select(F.col("at").alias("low"), F.col("low").alias("next"))
            lowest = lowest.join(further, "low", "left").select("at", F.coalesce("next", "low").alias("low"))
        step = pin(hooked.join(lowest.withColumnRenamed("at", "old"), "old").select("v", "old", F.least("root", "low").alias("root")))
        labels = step.select("v", "root")
        if not step.where("root <> old").limit(1).count():
            return labels


def forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Edges (child, root) of the components of an array of index pairs."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in found.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(i, r) for i in list(parent) if (r := root(i)) != i]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, counted value by value in blocks of values."""
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    rows, cols = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    both = np.intersect1d(x, y)
    if not len(both):
        return out
    at = np.searchsorted(both, x).clip(max=len(both) - 1)
    inside = both[at] == x
    a, rows = at[inside], rows[inside]
    at = np.searchsorted(both, y).clip(max=len(both) - 1)
    inside = both[at] == y
    b, cols = at[inside], cols[inside]
    step = 4096
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, rows, b, cols = a[order_a], rows[order_a], b[order_b], cols[order_b]
    for low in range(0, len(both), step):
        ia, ja = np.searchsorted(a, [low, low + step])
        ib, jb = np.searchsorted(b, [low, low + step])
        width = min(step, len(both) - low)
        p, q = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        p[rows[ia:ja], a[ia:ja] - low] = 1
        q[cols[ib:jb], b[ib:jb] - low] = 1
        out += p @ q.T
    return out


def union_sketches(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches (rows, filled up with the largest value): the size of the union sketch and its common values."""
    x = np.sort(np.concatenate((left, right), axis=1), axis=1)
    real = x != NONE
    new = real.copy()
    new[:, 1:] &= x[:, 1:] != x[:, :-1]
    place = np.cumsum(new, axis=1)
    return np.minimum(place[:, -1], k), (real & ~new & (place <= k)).sum(axis=1)


def linked(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int, k: int) -> np.ndarray:
    """Index pairs whose exact share of common shingles is num / den or more."""
    heads, tails = [s[:k] for s in left], [s[:k] for s in right]
    common = overlaps(heads, tails)
    na, nb = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    # All common values of a union sketch lie in both sketches; smaller sets are whole in their sketches.
    floor = np.array([needed(int(min(s, k)), k, num / den) for s in range(k + 1)])
    least = np.minimum(floor[np.minimum(na, k)][:, None], floor[np.minimum(nb, k)][None, :])
    maybe = (common >= least) & (np.minimum(na[:, None], nb[None, :]) * den >= np.maximum(na[:, None], nb[None, :]) * num)
    filled = [np.array([np.append(s, np.full(k - len(s), NONE)) for s in side], np.uint64).reshape(-1, k) for side in (heads, tails)]
    pairs = np.argwhere(maybe)
    for low in range(0, len(pairs), PAIRS):
        i, j = pairs[low : low + PAIRS].T
        size, both = union_sketches(filled[0][i], filled[1][j], k)
        # A union sketch that is not full holds both sets, so its share is exact.
        maybe[i, j] = both >= np.where(size < k, np.ceil(num / den * size - 1e-9), floor[k])
    if not maybe.any():
        return np.zeros((0, 2), np.int64)
    i, j = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    shared = np.zeros(maybe.shape, np.int64)
    shared[np.ix_(i, j)] = overlaps([left[x] for x in i], [right[x] for x in j]).astype(np.int64)
    union = na[:, None] + nb[None, :] - shared
    return np.argwhere(maybe & (den * shared >= num * union))


def confirm(dealt: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Links (a, b) inside each dealt pair of blocks: rows task, side (0, 1, or -1 for a block against itself), cls, body.
    Pairs of a class with itself fall out.
    """

    def run(batch: pa.Table) -> pa.Table:
        rows = batch.to_pydict()
        side = {s: [i for i, x in enumerate(rows["side"]) if x == s] for s in (-1, 0, 1)}
        own = [np.frombuffer(x, np.uint64) for x in rows["body"]]
        left, right = (side[-1], side[-1]) if side[-1] else (side[0], side[1])
        if not left or not right:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        pairs = linked([own[i] for i in left], [own[i] for i in right], num, den, k)
        cls = np.array(rows["cls"], np.int64)
        pairs = np.stack([cls[np.array(left)][pairs[:, 0]], cls[np.array(right)][pairs[:, 1]]], axis=1)
        edges = forest(pairs[pairs[:, 0] != pairs[:, 1]])
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


def bodies(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """Full sets of the chosen classes, from the texts of the rows called ``name``; of rows with one id, one whose set has the class's key."""
    rest = [c for c in chosen.columns if c != "name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t, n) for t in texts(batch.column(batch.schema.get_field_index("text")))]
            same = pa.array([key_of(x) == c for x, c in zip(found, batch.column(batch.schema.get_field_index("cls")).to_pylist(), strict=True)], pa.bool_())
            own = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in found], pa.binary())], names=[*rest, "body"]).filter(same)

    found = chosen.join(docs.select(F.col("doc_id").alias("name"), "text"), "name")
    fields = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in rest)
    return found.mapInArrow(run, f"{fields}, body binary").dropDuplicates(["cls"])


def zones(near: DataFrame) -> DataFrame:
    """cls, grp, zone, cell, sub and subs of classes (cls, grp, n_shingles, near), where near is the smallest class that a list leads to.

    The classes of one near are a cell.  A cell that is too large is cut into ``subs`` zones by hash; small cells
    of a group are put together, by a hash of near.
    """
    cells = near.groupBy("grp", "near").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("volume"))
    blocks = lambda c, v: F.ceil(F.greatest(F.col(c) * 2 / BLOCK, F.col(v) * 2 / VOLUME)).cast("int")
    cells = cells.withColumn("subs", blocks("c", "volume"))
    packs = cells.where("subs <= 1").groupBy("grp").agg(F.sum("c").alias("all"), F.sum("volume").alias("every")).select("grp", blocks("all", "every").alias("packs"))
    dealt = near.join(cells, ["grp", "near"]).join(packs, "grp", "left").withColumn("sub", F.pmod(F.xxhash64("cls"), F.col("subs")).cast("int"))
    zone = F.when(F.col("subs") > 1, F.concat_ws(":", F.lit("c"), "grp", "near", "sub")).otherwise(F.concat_ws(":", F.lit("p"), "grp", F.pmod(F.xxhash64("near"), F.col("packs"))))
    return dealt.select("cls", "grp", zone.alias("zone"), F.concat_ws(":", "grp", "near").alias("cell"), "sub", "subs")


def links(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int, k: int) -> DataFrame:
    """Confirmed links between classes that connect what the whole link graph connects."""
    entries = pin(inverted_lists(classes, k, num / den))
    pairs = entries.select(F.col("cls").alias("a"), F.explode("lists.hub").alias("b")).where("a <> b").distinct()
    groups = components(pairs)
    groups = groups.join(classes.select(F.col("cls").alias("v"), "n_shingles", "name"), "v")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("volume"))
    single = (F.col("size") <= BLOCK) & (F.col("volume") <= 2 * VOLUME)
    chosen = groups.join(sizes, "root").select(F.col("v").alias("cls"), "name", "n_shingles", F.col("root").alias("grp"), single.alias("single"))
    full = pin(bodies(docs, chosen, n))
    first = confirm(full.where("single").select(F.col("grp").cast("string").alias("task"), F.lit(-1).alias("side"), "cls", "body"), num, den, k)
    large = full.where("NOT single")
    if large.limit(1).count() == 0:
        return first
    zone = pin(zones(entries.select("cls", "near").join(large.select("cls", "grp", "n_shingles"), "cls")))
    zoned = pin(large.select("cls", "body").join(zone.drop("grp"), "cls"))
    inside = zoned.select(F.col("zone").alias("task"), F.lit(-1).alias("side"), "cls", "body")
    cut = zoned.where("subs > 1")
    key = F.concat_ws(":", "cell", "sub").alias("task")
    hubs = cut.where("sub = 0").withColumn("sub", F.explode(F.sequence(F.lit(1), F.col("subs") - 1))).select(key, F.lit(0).alias("side"), "cls", "body")
    star = hubs.union(cut.where("sub > 0").select(key, F.lit(1).alias("side"), "cls", "body"))
    near = pin(confirm(inside, num, den, k).union(confirm(star, num, den, k)))
    # The main component of each group needs no more comparisons inside.  Of the lists that hold other classes, those
    # whose classes are all connected are done; in the others zones with different components meet.
    member = pin(zone.select("cls", "grp", "zone").join(components(near).withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    main = member.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    rest = pin(member.join(main, "grp").where("root <> main").select("cls"))
    if rest.limit(1).count() == 0:
        return first.union(near)
    held = pin(entries.select("cls", "lists.value").join(member.select("cls", "zone", "root"), "cls"))
    values = pin(held.join(rest, "cls", "left_semi").select(F.explode("value").alias("value")).distinct())
    state = held.select(F.explode("value").alias("value"), "cls", "zone", "root").join(small(values, values.count(), 32), "value", "left_semi")
    apart = pin(state.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("value"))
    state = pin(state.join(small(apart, apart.count(), 32), "value"))
    sides = state.groupBy("value", "zone").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    x, y = sides.select("value", *(F.col(c).alias(f"x_{c}") for c in ("zone", "low", "high"))), sides.select("value", *(F.col(c).alias(f"y_{c}") for c in ("zone", "low", "high")))
    met = x.join(y, "value").where("x_zone < y_zone AND NOT (x_low = x_high AND y_low = y_high AND x_low = y_low)").select("x_zone", "y_zone").distinct()
    met = pin(met.withColumn("task", F.concat_ws("/", "x_zone", "y_zone")))
    part = zoned.select("cls", "zone", "body").join(state.select("cls").distinct(), "cls", "left_semi")
    sides = [met.select("task", F.lit(k).alias("side"), F.col(c).alias("zone")).join(part, "zone").select("task", "side", "cls", "body") for k, c in enumerate(("x_zone", "y_zone"))]
    return first.union(near).union(confirm(sides[0].union(sides[1]), num, den, k))


def grouped(docs: DataFrame, n: int, num: int, den: int, k: int) -> DataFrame:
    """doc_id, body_md5, n_shingles, component and first (its smallest doc_id) of every row; the last two are null where a row is alone."""
    ready(docs.sparkSession)
    shared_dir(docs.sparkSession)
    found = pin(sets(docs, n, k))
    named = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = pin(named.groupBy("cls").agg(F.min("doc_id").alias("name"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")))
    joined = components(links(docs, classes, n, num, den, k)).withColumnRenamed("v", "cls")
    several = classes.select("cls", "name", "copies").join(joined, "cls", "left").where("copies > 1 OR root IS NOT NULL").select("cls", "name", F.coalesce("root", "cls").alias("component"))
    several = pin(several)
    firsts = pin(several.groupBy("component").agg(F.min("name").alias("first")))
    several = pin(several.join(small(firsts, firsts.count(), 64), "component").select("cls", "component", "first"))
    rows = found.select("doc_id", "body_md5", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls"))
    return rows.join(small(several, several.count(), 64), "cls", "left").drop("cls")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    out = grouped(docs, n, num, den, k).select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicates, the one with the smallest id (then the smallest digest of the text).

    Of rows that repeat an id and its text one stays; rows without an id or without words all stay.
    """
    rows = pin(grouped(docs, n, num, den, k).where("component IS NOT NULL").groupBy("component", "doc_id", "body_md5").agg(F.count(F.lit(1)).alias("n")))
    first = pin(rows.groupBy("component").agg(F.min(F.struct("doc_id", "body_md5")).alias("stays")))
    md5, stays, repeated = (fresh(docs, c) for c in ("_md5", "_stays", "_repeated"))
    fate = rows.join(small(first, first.count(), 96), "component").select(
        "doc_id", F.col("body_md5").alias(md5), ((F.col("stays.doc_id") == F.col("doc_id")) & (F.col("stays.body_md5") == F.col("body_md5"))).alias(stays), (F.col("n") > 1).alias(repeated)
    )
    fate = pin(fate.where(f"NOT {stays} OR {repeated}"))
    marked = docs.withColumn(md5, body_md5()).join(small(fate, fate.count(), 64), ["doc_id", md5], "left")
    out = marked.where(F.col(stays).isNull()).select(docs.columns)
    if fate.where(f"{stays} AND {repeated}").limit(1).count():
        out = out.union(marked.where(F.col(stays)).dropDuplicates(["doc_id", md5]).select(docs.columns))
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, num=85, den=100)


def _sql(n: int, num: int, den: int) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) END AS sh
  FROM d),
x AS (SELECT r, doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p WHERE {den} * c >= {num} * (na + nb - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, u) AS (SELECT r, r FROM d UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON reach.u = both_ways.a),
c AS (SELECT v, min(doc_id) AS component_id FROM reach JOIN d ON reach.u = d.r GROUP BY v)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.r = c.v
"""


ORACLE = _sql(3, 85, 100)

__all__ = ["ORACLE", "components", "keep_one", "near_duplicates", "op3", "shingles"]
