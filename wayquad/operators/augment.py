"""New trajectories and queries from given ones.

Random numbers are functions of a key and a salt (xxhash64), so results do not depend on the order or the
partitions of the rows; they are no other generator's numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METERS_PER_DEGREE = 111_000.0
#: Share of each method in an augmented data set (fixed values).
SHARES = (("perturb", 0.20), ("gaussian", 0.20), ("interpolate", 0.20), ("rotate", 0.18), ("scale", 0.12), ("mix", 0.10))


def uniform(salt: str, *keys: str | Column) -> Column:
    """A number in [0, 1) from keys and a salt: 48 bits of the md5 of them joined by ':'."""
    text = F.concat_ws(":", F.lit(salt), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(salt: str, *keys: str | Column) -> Column:
    """A standard normal number from keys and a salt (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(salt + "a", *keys))) * F.cos(2 * math.pi * uniform(salt + "b", *keys))


def meters_to_degrees(meters: Column, latitude: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude."""
    return meters / (METERS_PER_DEGREE * F.cos(F.radians(latitude))), meters / METERS_PER_DEGREE


def interpolate(points: str | Column, factor: int) -> Column:
    """``factor - 1`` points on each segment."""
    p = F.col(points) if isinstance(points, str) else points
    if factor < 2:
        return p
    pairs = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    between = F.transform(
        pairs,
        lambda s: F.array(
            *(F.struct((s["a"]["x"] + j / factor * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + j / factor * (s["b"]["y"] - s["a"]["y"])).alias("y")) for j in range(1, factor)),
            F.struct(s["b"]["x"].alias("x"), s["b"]["y"].alias("y")),
        ),
    )
    return F.when(F.size(p) < 2, p).otherwise(F.concat(F.slice(p, 1, 1), F.flatten(between)))


def _centre(points: str, c: str) -> Column:
    v = F.transform(points, lambda p: p[c])
    return (F.array_min(v) + F.array_max(v)) / 2


def rotate(points: str, degrees: Column) -> Column:
    """Turn about the centre of the bounding box."""
    cx, cy = _centre(points, "x"), _centre(points, "y")
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(points, lambda p: F.struct(((p["x"] - cx) * cos - (p["y"] - cy) * sin + cx).alias("x"), ((p["x"] - cx) * sin + (p["y"] - cy) * cos + cy).alias("y")))


def scale(points: str, by: Column, least: int = 10) -> Column:
    """Scale about the centre of the bounding box; with fewer than ``least`` points, interpolate up to that."""
    cx, cy = _centre(points, "x"), _centre(points, "y")
    scaled = F.transform(points, lambda p: F.struct((cx + (p["x"] - cx) * by).alias("x"), (cy + (p["y"] - cy) * by).alias("y")))
    out = scaled
    for size in range(2, least):
        out = F.when(F.size(points) == size, interpolate(scaled, -(-least // size))).otherwise(out)
    return out


def mix(main: str, other: str, ratio: Column | float) -> Column:
    """Move the points of ``main`` towards those of ``other``, as far as both go."""
    r = F.lit(ratio) if isinstance(ratio, float) else ratio
    both = F.zip_with(main, other, lambda a, b: F.when(b.isNull(), a).otherwise(F.struct((a["x"] + r * (b["x"] - a["x"])).alias("x"), (a["y"] + r * (b["y"] - a["y"])).alias("y"))))
    return F.slice(both, F.lit(1), F.size(main))


def perturb(points: str, key: str, sigma: float = 1e-4) -> Column:
    """Independent normal noise."""
    return F.transform(points, lambda p, i: F.struct((p["x"] + sigma * normal("px", key, i)).alias("x"), (p["y"] + sigma * normal("py", key, i)).alias("y")))


def gaussian(points: str, key: str, size: float = 0.02, correlation: float = 0.9) -> Column:
    """Noise that follows the noise of the point before."""
    fresh = math.sqrt(1 - correlation * correlation) * size
    indexed = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (fresh * normal("gx", key, i)).alias("nx"), (fresh * normal("gy", key, i)).alias("ny")))
    start = F.struct(F.lit(0.0).alias("ex"), F.lit(0.0).alias("ey"), F.expr("cast(array() as array<struct<x:double,y:double>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        ex, ey = correlation * acc["ex"] + p["nx"], correlation * acc["ey"] + p["ny"]
        return F.struct(ex.alias("ex"), ey.alias("ey"), F.concat(acc["out"], F.array(F.struct((p["x"] + ex).alias("x"), (p["y"] + ey).alias("y")))).alias("out"))

    return F.aggregate(indexed, start, step, lambda acc: acc["out"])


def augment(trajectories: DataFrame, share: float) -> DataFrame:
    """(tid, oid, points): the given rows, then ``share`` times as many new ones, each made by one method.

    A row gets the whole part of ``share`` as copies, and one more if its hash is below the rest; every copy draws its
    own numbers.  Partners for mixing are the next rows by hash.  Ids are not negative.
    """
    if share < 0:
        raise ValueError("share must not be negative")
    whole = int(share)
    copies = F.lit(whole) + (uniform("pick", "tid") < share - whole).cast("int")
    ring = F.pmod(F.xxhash64("tid"), F.lit(1024))
    order = Window.partitionBy(ring).orderBy(F.xxhash64("tid"))
    rows = trajectories.withColumns({"partner": F.coalesce(F.lead("points").over(order), F.col("points")), "_n": copies}).where("_n > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_key", F.concat_ws(":", "tid", "_copy")).withColumn("u", uniform("method", "_key"))
    made = {
        "perturb": perturb("points", "_key"),
        "gaussian": gaussian("points", "_key"),
        "interpolate": F.when(uniform("factor", "_key") < 0.5, interpolate("points", 2)).otherwise(interpolate("points", 3)),
        "rotate": rotate("points", -20 + 40 * uniform("angle", "_key")),
        "scale": scale("points", 0.85 + 0.3 * uniform("size", "_key")),
        "mix": mix("points", "partner", 0.05 + 0.1 * uniform("ratio", "_key")),
    }
    chosen, upto = made["mix"], 0.0
    steps = []
    for name, part in SHARES[:-1]:
        upto += part
        steps.append((upto, made[name]))
    for bound, column in reversed(steps):
        chosen = F.when(F.col("u") < bound, column).otherwise(chosen)
    top = trajectories.agg(F.coalesce(F.max("tid"), F.lit(0)).alias("top"))
    new = rows.join(F.broadcast(top), F.lit(True)).select((F.col("tid") + F.col("_copy") * (F.col("top") + 1)).alias("tid"), F.concat(F.col("tid").cast("string"), F.lit("_aug")).alias("oid"), chosen.alias("points"))
    return trajectories.select("tid", F.col("tid").cast("string").alias("oid"), "points").union(new)


def synthetic(spark, n: int, box: tuple[float, float, float, float], seed: int = 42) -> DataFrame:
    """(tid, points): ``n`` random walks of 10 to 49 points with steps up to a tenth of the box, kept inside it."""
    w, h = box[2] - box[0], box[3] - box[1]
    salt = f"walk{seed}"
    rows = spark.range(n).withColumnRenamed("id", "tid").withColumn("k", (10 + F.floor(40 * uniform(salt + "n", "tid"))).cast("int"))
    first = F.struct((box[0] + w * uniform(salt + "x", "tid")).alias("x"), (box[1] + h * uniform(salt + "y", "tid")).alias("y"))
    moves = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct((w * (0.2 * uniform(salt + "dx", "tid", i) - 0.1)).alias("x"), (h * (0.2 * uniform(salt + "dy", "tid", i) - 0.1)).alias("y")))
    keep = lambda v, low, high: F.least(F.lit(high), F.greatest(F.lit(low), v))

    def step(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(keep(last["x"] + m["x"], box[0], box[2]).alias("x"), keep(last["y"] + m["y"], box[1], box[3]).alias("y"))))

    return rows.select("tid", F.aggregate(moves, F.array(first), step).alias("points"))


def _around(centres: DataFrame, box: tuple[float, float, float, float], ranges: tuple[float, ...], metres: bool) -> DataFrame:
    """(query_id, range, min_x, ...): a box around each (tid, seq, x, y) for each range, cut at ``box``, with six digits."""
    each = centres.select("tid", "seq", "x", "y", F.explode(F.array(*(F.lit(float(r)) for r in ranges))).alias("range"))
    cut = lambda v, low, high: F.round(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v)), 6)
    half = F.col("range") / 2
    dx, dy = meters_to_degrees(half, F.col("y")) if metres else (half, half)
    name = F.row_number().over(Window.orderBy("range", "tid", "seq"))
    return each.select(
        name.alias("query_id"), "range", cut(F.col("x") - dx, box[0], box[2]).alias("min_x"), cut(F.col("y") - dy, box[1], box[3]).alias("min_y"), cut(F.col("x") + dx, box[0], box[2]).alias("max_x"), cut(F.col("y") + dy, box[1], box[3]).alias("max_y")
    )


def generate_queries(points: DataFrame, box: tuple[float, float, float, float], count: int, ranges: tuple[float, ...], hot: DataFrame | None = None, metres: bool = False) -> DataFrame:
    """(query_id, range, min_x, ...): boxes around the ``count`` points with the smallest draws, for each range, cut at ``box``.

    With ``hot`` (gx, gy of a 10 x 10 grid), four fifths of the centres come from these squares.  ``metres``: x and y are
    degrees and ranges metres.
    """
    key = ["tid", "seq"]
    first = lambda rows, salt, n: rows.orderBy(uniform(salt, *key), *key).limit(n)
    if hot is None:
        return _around(first(points, "centre", count), box, ranges, metres)
    at = lambda c, low, high: F.least(F.lit(9), F.floor((F.col(c) - low) / (high - low) * 10)).cast("int")
    placed = points.withColumns({"gx": at("x", box[0], box[2]), "gy": at("y", box[1], box[3])})
    crowded = first(placed.join(F.broadcast(hot.select("gx", "gy")), ["gx", "gy"]).select(points.columns), "hot", count * 4 // 5)
    return _around(crowded.union(first(points, "all", count - count * 4 // 5)), box, ranges, metres)


def generate_gaussian_queries(spark, about: tuple[float, float, float, float], box: tuple[float, float, float, float], count: int, ranges: tuple[float, ...], metres: bool = True) -> DataFrame:
    """Boxes around normally distributed centres; ``about``: mean and deviation of x and of y; centres are cut at ``box``."""
    keep = lambda v, low, high: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))
    rows = spark.range(count).select(F.col("id").alias("tid"), F.lit(0).alias("seq"))
    x, y = keep(about[0] + about[1] * normal("qx", "tid"), box[0], box[2]), keep(about[2] + about[3] * normal("qy", "tid"), box[1], box[3])
    return _around(rows.select("tid", "seq", x.alias("x"), y.alias("y")), box, ranges, metres)


def split_sets(items: DataFrame, key: str, train: float, validation: float) -> DataFrame:
    """Add ``part`` (train, validation, test) by position in hash order (a query set is small)."""
    order, everything = Window.orderBy(F.md5(F.col(key).cast("string")), key), Window.partitionBy()
    place = (F.row_number().over(order) - 1) / F.count(F.lit(1)).over(everything)
    return items.withColumn("part", F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test"))
