from __future__ import annotations

from strandline.sources import readers as R


def test_no_number_of_topics_takes_all(spark):
    topics = spark.createDataFrame([(t,) for t in range(300)], "topic_id long")
    videos = spark.createDataFrame([(2 * t + k, t, "v") for t in range(300) for k in (0, 1)], "video_id long, topic_id long, video_name string")
    related = spark.createDataFrame([(2 * t, 2 * t + 1, t) for t in range(300)], "video1_id long, video2_id long, topic_id long")
    assert R.related_videos(topics, videos, related).count() == 300
    assert R.related_videos(topics.limit(0), videos, related).count() == 300  # the topics only matter for a number of them
    assert R.related_videos(topics, videos, related, 120).count() == 120


def test_all_pairs_are_written_and_read(spark, data):
    from strandline.catalog.files import QUERIES

    ids = {int(r["id_a"]) % 5 for r in QUERIES["src_pairs_csv_all"](spark, data).select("id_a").distinct().collect()}
    assert ids == {0, 1, 2, 3, 4}


def test_long_chain_is_walked_to_its_end(spark):
    n = 140_000  # more than 131,072 links
    samples = spark.range(n).selectExpr("cast(id as string) as token", "cast(id + 1 as string) as next", "id as timestamp")
    scenes = spark.createDataFrame([(1, "0")], "scene int, first_token string")
    out = R.walk_chain(scenes, samples)
    assert out.count() == n and out.where("step <> timestamp").count() == 0


def test_cycle_is_refused(spark):
    import pytest

    samples = spark.createDataFrame([("a", "b", 0), ("b", "a", 1)], "token string, next string, timestamp int")
    with pytest.raises(ValueError, match="cycle"):
        R.walk_chain(spark.createDataFrame([(1, "a")], "scene int, first_token string"), samples)
