from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.operators import asof as J
from strandline.sources import readers as R
from strandline.sources import sinks as W


def test_pairs_need_no_heading(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Query,b,label\n a , b ,1\nonly,two\nx,y,0,extra\n")
    assert sorted(map(tuple, R.read_pairs(spark, str(tmp_path / "p.csv")).collect())) == [("a", "b", 1), ("x", "y", 0)]
    (tmp_path / "q.csv").write_text("first,b,1\n")
    assert R.read_pairs(spark, str(tmp_path / "q.csv")).count() == 1


def test_wrong_sequence_file_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="emb"):
        R.read_sequences(spark, str(tmp_path / "x"))


def test_staged_write_replaces_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    W.write_staged(spark.range(3), path)
    W.write_staged(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        W.write_staged(spark.range(5).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5


def test_fingerprint_ignores_order(spark):
    a = W.fingerprint(spark.range(100), ["id"]).first()
    b = W.fingerprint(spark.range(100).repartition(7).orderBy(F.desc("id")), ["id"]).first()
    c = W.fingerprint(spark.range(101), ["id"]).first()
    assert a == b and a != c


def test_interpolation_clamps_and_keeps_nulls(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 9.0), (1, 2.0), (2, 1.0), (1, None), (None, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 30.0), (1, None, 5.0)], "k int, ts double, v double")
    out = sorted((r["k"] or 0, r["t"] or -1.0, r["value_at"]) for r in J.asof_interpolate(left, right, ["k"], "t", "ts", "v", 2.0).collect())
    assert [o for o in out if o[0] == 1 and o[1] > 0] == [(1, 0.5, 10.0), (1, 2.0, 20.0), (1, 9.0, 30.0)]
    assert len(out) == 6


def test_command_line(spark, tmp_path, capsys):
    rows = [(f"s{i}", [[float(i + 1), float(t)] for t in range(6)]) for i in range(4)]
    spark.createDataFrame(rows, "seq_id string, emb array<array<double>>").write.parquet(str(tmp_path / "s"))
    (tmp_path / "p.csv").write_text("s0,s0,1\ns1,s1,1\ns0,s3,0\ns1,s2,0\n")
    base = ["--first", str(tmp_path / "s")]
    assert cli.run(spark, cli._parser().parse_args(["s-rev", *base]))["n_videos"] == 4
    pairs = ["--pairs", str(tmp_path / "p.csv")]
    out = cli.run(spark, cli._parser().parse_args(["scramble-gradient", *base, *pairs, "--k-values", "1", "4"]))
    assert set(out["ap"]) == {"1", "4"}
    out = cli.run(spark, cli._parser().parse_args(["decompose", *base, *pairs]))
    assert out["n_pairs"] == 4 and set(out["ap"]) == {"baseline", "alternative"} and set(out["ap"]["baseline"]) == {"cosine", "dtw"}
    spark.createDataFrame([(i, x[::-1]) for i, x in rows], "seq_id string, emb array<array<double>>").write.parquet(str(tmp_path / "t"))
    two = ["--baseline-embeddings", str(tmp_path / "s"), "--alternative-embeddings", str(tmp_path / "t"), *pairs, "--baseline-comparator", "chamfer", "--alternative-comparator", "ordered_frame"]
    out = cli.run(spark, cli._parser().parse_args(["decompose", *two]))
    assert {m for cell in out["ap"].values() for m in cell} == {"chamfer", "ordered_frame"}
    out = cli.run(spark, cli._parser().parse_args(["report", "--embeddings-a", str(tmp_path / "s"), "--embeddings-b", str(tmp_path / "t"), *pairs]))
    assert {r["measure"] for r in out["report"]} == {"ap", "drop", "s_rev_mean", "s_rev_std"}
    assert json.dumps(cli.run(spark, cli._parser().parse_args(["report", *base, *pairs, "--similarity", "ordered_frame"])))
    with pytest.raises(ValueError, match="known"):
        cli.run(spark, cli._parser().parse_args(["s-rev", *base, "--similarity", "nothing"]))


def test_names_at_the_top_and_poolings(spark):
    import strandline
    from strandline.operators import sequences as S

    assert strandline.near_pairs.__module__ == "strandline.operators.near" and "score_pairs" in dir(strandline)
    with pytest.raises(AttributeError):
        strandline.nothing
    assert S.pooling("attention_weighted") is S.pool_attention and set(S.pooling_names()) >= {"mean", "max", "attention_weighted"}
    with pytest.raises(ValueError, match="known"):
        S.pooling("median")
