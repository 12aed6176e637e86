from __future__ import annotations

from pyspark.sql import functions as F
import pytest

from strandline.llm.splits import assign_splits, consolidate, rendezvous, session_reading, split_targets

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def test_tied_records_share_a_part(spark):
    rows = [(k, f"s{k % 40}", f"s{(k * 7) % 40}" if k % 10 == 0 else None) for k in range(400)] + [(900, None, None), (900, None, None), (901, None, "s1")]
    df = spark.createDataFrame(rows, "id long, own string, also string")
    out = assign_splits(df, "own", "also", TARGETS, ["id"]).collect()
    assert len(out) == len(rows)
    parts = {}
    for r in out:
        for entity in (r["own"], r["also"]):
            if entity is not None:
                assert parts.setdefault(entity, (r["component"], r["split"])) == (r["component"], r["split"])
    assert len({r["split"] for r in out if r["id"] == 900}) == 1
    assert parts["s1"][1] == next(r["split"] for r in out if r["id"] == 901)


def test_shares_and_stability(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    split = lambda t: {r["k"]: r["p"] for r in df.select("k", rendezvous(F.col("k"), t).alias("p")).collect()}
    first = split(TARGETS)
    assert sum(p == "train" for p in first.values()) / 20000 == pytest.approx(0.8, abs=0.02)
    second = split([("train", 0.8), ("validation", 0.2), ("test", 0.1)])
    moved = {(first[k], second[k]) for k in first if first[k] != second[k]}
    assert all(to == "validation" for _, to in moved)  # only towards what grew


def test_clashing_names_and_bad_targets(spark):
    df = spark.createDataFrame([("a", 1, "x")], "own string, split int, component string")
    out = assign_splits(df, "own", None, TARGETS, ["split"]).first()
    assert out["split"] == 1 and out["component"] == "x" and out["split_1"] in dict(TARGETS)
    assert assign_splits(df.limit(0), "own", None, TARGETS, ["split"]).count() == 0
    with pytest.raises(ValueError):
        rendezvous(F.lit("k"), [("none", 0.0)])
    table = spark.createDataFrame([("a", 0.5), ("a", 0.5), (None, 0.1), ("b", None)], "partition_name string, proportion double")
    assert split_targets(table) == [("a", 0.5)]


def test_session_keys(spark):
    key = "20260101_s0_ab_cd"
    rows = [
        (None, key + "_act1_9f", None, key),
        ("x", None, f"root/{key}_act12_0a/{key}_act12_0a/data.mp4", key),
        (" 20260101-S0 Ab__cd\t", None, "data.mp4", key),
        ("2026-01-01_s0_ab_cd", "", "", None),
        ("unknown", key + "_act1_", f"{key}_act1_9f.mp4", None),
        (None, None, None, None),
        ("20260102_s0_ab_cd", key + "_act1_9f", None, key),
    ]
    df = spark.createDataFrame(rows, "p string, s string, v string, want string")
    read = df.withColumn("read", session_reading(F.col("p"), F.col("s"), F.col("v")))
    for r in read.select("want", "read.*").collect():
        assert r["name"] == r["want"] and (r["spelling"] is None) == (r["want"] is None)
    out = consolidate(read.withColumn("key", F.lit(0)), F.col("read.spelling"), F.col("read.name"), "key").collect()
    assert len(out) == len(rows) and all(r["key_1"] == r["want"] and r["key"] == 0 for r in out)
    assert consolidate(read.limit(0), F.col("read.spelling"), F.col("read.name"), "key").count() == 0


def test_keys_come_from_the_components(spark, data, monkeypatch):
    from strandline.llm import queries, splits

    assert queries.p4_found(spark, data).count() > 0
    empty = spark.createDataFrame([], "entity string, component string")
    monkeypatch.setattr(splits, "hash_to_min", lambda *a, **k: empty)
    assert queries.p4_found(spark, data).count() == 0
