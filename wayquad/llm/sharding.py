"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a pseudo-random number in (0, 1) from the record key and its own name; the record
goes to the shard with the largest ``-weight / ln(u)``.  A shard that is added only ever wins records
for itself, so growing from n to n + 1 equal shards moves about 1 / (n + 1) of the rows and nothing else.

Everything is a Column expression.  Slots inside a shard come from counts of hash blocks, whose prefix
sums (shards x 16**BLOCK_DIGITS rows, a fixed bound) are broadcast; no shard is ever sorted by one task.

Defined results: a null key hashes as the empty string; a null payload has size 1 and crc32 0; repeated
rows get slots of their own; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayquad.llm.common import fresh, table

#: Hash blocks in a shard: 16 ** BLOCK_DIGITS.
BLOCK_DIGITS = 3


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard only (52 bits of an md5)."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; equal scores go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    scores = [F.struct((F.lit(-float(w)) / F.log(draw(key, s))).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["minus"]).cast("int")


def place(rows: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float], order: Sequence[str] = ()) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (the shard under ``grown`` weights) and the gapless ``slot`` in the shard.

    Slots follow a hash of ``key`` and ``order``, so rows that repeat a key spread over the blocks, then these
    columns themselves.  Columns of the three names are replaced.
    """
    rows = rows.drop(*({"shard", "grown_shard", "slot"} - {key, *order}))
    h, block, at, base = (fresh(rows, n) for n in ("_h", "_block", "_at", "_base"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *order)]
    hashed = F.md5(F.concat_ws(":", parts[0], F.lit("slot"), *parts[1:]).cast("binary"))
    here = rows.withColumns({"shard": rendezvous(F.col(key), weights), "grown_shard": rendezvous(F.col(key), grown), h: hashed})
    here = here.withColumn(block, F.substring(h, 1, BLOCK_DIGITS))
    counts = here.groupBy("shard", block).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy("shard", block).orderBy(h, key, *order)
    placed = here.withColumn(at, F.row_number().over(inside) - 1).join(F.broadcast(bases), ["shard", block])
    return placed.withColumn("slot", (F.col(base) + F.col(at)).cast("long")).drop(h, block, at, base)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = place(docs, "doc_id", [1.0] * 8, [1.0] * 9, ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(n: int) -> str:
    draws = ", ".join(f"row(-1.0::DOUBLE / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{s}'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE), {-s})" for s in range(n))
    return f"(-(list_max([{draws}])[2]))::INTEGER"


#: Bytes come from the hex form of the text; the remainder table of the reversed polynomial is built by recursion.
ORACLE = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS s, CASE WHEN text IS NULL THEN 1 ELSE strlen(text) + 1 END AS size,
    {_sql_shard(8)} AS shard, {_sql_shard(9)} AS grown_shard
  FROM documents),
e AS (
  SELECT d.*, CASE WHEN s = '' THEN 0 ELSE xor(4294967295, list_reduce(
      [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) END AS text_crc32
  FROM d, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':slot:' || text_crc32 || ':' || size), doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM e
"""
