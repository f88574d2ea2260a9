import zlib
from collections import Counter

from wayquad.llm import sharding


def test_law_slots_and_odd_rows(spark):
    rows = [(k, f"text {k % 7}") for k in range(4000)] + [(5, "again"), (5, "again"), (None, None), (9001, None), (9002, ""), (9003, "é" * 50_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, slot_of string, _h string").repartition(5)
    got = sharding.place(df, "doc_id", [1.0] * 8, [1.0] * 9, ["text"]).collect()
    assert len(got) == len(rows)
    by_shard: dict = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
        assert (r["slot_of"], r["_h"]) == ("x", "y")
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert set(by_shard) == set(range(8))
    moved = sum(r["grown_shard"] == 8 for r in got) / len(got)
    assert 0.08 < moved < 0.15
    again = sharding.place(df.repartition(2), "doc_id", [1.0] * 8, [1.0] * 9, ["text"])
    key = lambda r: (r["doc_id"], r["text"], r["shard"], r["slot"], r["grown_shard"])
    assert Counter(map(key, got)) == Counter(map(key, again.collect()))


def test_weights(spark):
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    n = Counter(r["shard"] for r in df.select(sharding.rendezvous(df["doc_id"], [1.0, 3.0]).alias("shard")).collect())
    assert 0.72 < n[1] / 6000 < 0.78


def test_query_columns_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "a/documents.parquet"))
    got = {r["doc_id"]: r for r in sharding.op4(spark, str(tmp_path / "a")).collect()}
    assert (got[1]["size"], got[1]["text_crc32"], got[1]["law"]) == (3, zlib.crc32("é".encode()), "key")
    assert (got[2]["size"], got[2]["text_crc32"]) == (1, 0)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "b/documents.parquet"))
    assert sharding.op4(spark, str(tmp_path / "b")).collect() == []
