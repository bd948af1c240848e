import datetime

import pytest
from pyspark.sql import functions as F

from siftlake.functions import text as X
from siftlake.operators import dedup, issues, scoring, similarity
from siftlake.sources import readers
from siftlake.streaming import events as E


def test_headers_and_defaults(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Review_Text,STARS,id\n"crashes, ""often""\nreally",9,r1\n  ok  ,x,\n')
    rows = readers.canonical(readers.read_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r["content"], r["score"], r["thumbsUpCount"]) for r in rows] == [('crashes, "often"\nreally', 9.0, 0), ("ok", 3.0, 0)]
    assert rows[0]["reviewId"] == "r1" and rows[1]["reviewId"] is not None


def test_longest_column_is_the_text_or_an_error(spark):
    df = spark.createDataFrame([("x", "a text that is longer than twenty characters")], "a string, b string")
    assert readers.detect(df)["content"] == "b"
    with pytest.raises(readers.NoText):
        readers.detect(df.select("a"))


def test_stage_round_trip_and_cleanup(spark, tmp_path):
    df = spark.range(5)
    path = readers.write_stage(df, str(tmp_path), 7, "run-1", "reviews")
    assert path.endswith("/staging/upload=7/run=run-1/reviews.parquet") and spark.read.parquet(path).count() == 5
    assert readers.delete_run(spark, str(tmp_path), 7, "run-1") and not readers.delete_run(spark, str(tmp_path), 7, "run-1")
    with pytest.raises(ValueError):
        readers.stage_path("x", 1, "../y", "z")


def test_load_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], "upload_id int, v string, embedding array<double>")
    readers.load_table(df, path)
    readers.load_table(df.where("upload_id = 2").withColumn("v", F.lit("c")), path)
    got = {(r["upload_id"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "a"), (2, "c")} and "embedding" not in spark.read.parquet(path).columns


def test_codec_round_trip(spark):
    rows = spark.createDataFrame(
        [(42, "App crashes", (1, "3.2.1"), (0.87, 0.92, {"length": "38"}, True)), (1, "only text", (None, None), (None, None, None, None))],
        "id long, text string, metadata struct<rating:int,version:string>, actionability struct<score:double,confidence:double,features:map<string,string>,is_actionable:boolean>",
    )
    assert readers.nested(readers.flat(rows)).collect() == rows.collect()


def test_account_export_and_report(spark):
    uploads = spark.createDataFrame([(1,), (2,)], "upload_id int")
    clusters = spark.createDataFrame([(1, "c2"), (1, "c1")], "upload_id int, cluster_id string")
    out = {r["upload_id"]: [c["cluster_id"] for c in r["clusters"]] for r in readers.account_export(uploads, clusters).collect()}
    assert out == {1: ["c1", "c2"], 2: []}
    samples = spark.createDataFrame([("c1", i, f"t{i}") for i in range(5)], "cluster_id string, ordinal int, content string")
    got = {r["cluster_id"]: r["samples"] for r in readers.report_rows(clusters, samples).collect()}
    assert got == {"c1": "t0 | t1 | t2", "c2": ""}


def test_regression_golden(spark):
    rows = [("t", "i", "v1", "medium", 100, 0), ("t", "i", "v2", "high", 140, 1), ("t", "i", "v3", "high", 260, 2), ("t", "j", "v1", "critical", 400, 0), ("t", "j", "v2", "low", 20, 1)]
    df = spark.createDataFrame(rows, "tenant string, issue string, version string, severity string, review_count int, seq int").withColumn("severity_rank", issues.severity_rank(F.col("severity")))
    got = [r["regression_status"] for r in issues.regression_status(df, ["tenant", "issue"], ["seq", "version"]).orderBy("issue", "seq").collect()]
    assert got == ["NEW", "REGRESSED_SEVERITY", "REGRESSED_VOLUME", "NEW", "IMPROVED"]
    alone = df.withColumn("cluster", F.monotonically_increasing_id())
    assert {r["regression_status"] for r in issues.regression_status(alone, ["cluster"], ["seq"]).collect()} == {"NEW"}


def test_fingerprint_golden(spark):
    one = spark.range(1).select(
        X.fingerprint(F.lit("The app Crashes on startup"), F.array(F.lit(" Startup "))).alias("a"),
        X.fingerprint(F.lit("startup: crashes on"), F.array().cast("array<string>")).alias("b"),
        X.fingerprint(F.lit("startup: crashes on"), F.array(F.lit("login"))).alias("c"),
    ).first()
    assert one["a"] == one["b"] == "45b839a0ec9afb779ef688d1fcd793f9" != one["c"]


def test_priority_golden_and_k_rule(spark):
    null = F.lit(None).cast("double")
    assert spark.range(1).select(issues.priority_triage(F.lit("critical"), null, F.lit(False), null, F.lit(0))).first()[0] == 110.0
    assert [similarity.adaptive_k(n) for n in (10, 300, 960, 60_000, 90_000)] == [1, 2, 6, 400, 400]


def test_nulls_in_filters_and_features(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", 5), (3, "good", 5), (4, "good but crash", 5)], "id int, content string, rating int")
    kept = {r["id"] for r in df.where(scoring.keep_v1(F.col("content"), F.col("rating"))).collect()}
    assert kept == {1, 4}
    assert scoring.features(df).count() == 4 and scoring.validated(df).where("is_valid").count() == 2


def test_vector_search_and_bursts(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [r["id"] for r in similarity.vector_search(v.where("vec_id = 0"), v, 2).orderBy("rank").collect()]
    assert got == [1, 2]
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t + datetime.timedelta(hours=4 * i)) for i in range(7)], "id int, at timestamp")
    assert {r["id"]: r["n_window"] for r in similarity.bursts(df).collect()} == {0: 6, 1: 6, 2: 5}


def test_latest_wins(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 2)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in dedup.latest(old, new, ["k"], "at").collect()} == {(1, "c"), (2, "b")}


def envelopes(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("e1", "upload", {"ok": "1"}, t, 0, 3, False)] * 3 + [("e2", "upload", {"ok": "0"}, t, 0, 3, False), ("e3", "upload", {"ok": "0"}, t, 2, 3, False)]
    return spark.createDataFrame(rows, E.ENVELOPE)


def test_redelivery_has_one_effect_per_consumer(spark, tmp_path):
    envelopes(spark).write.parquet(str(tmp_path / "in"))
    seen = {"a": [], "b": []}
    for consumer in seen:
        stream = E.once_per_consumer(E.file_source(spark, str(tmp_path / "in"), E.ENVELOPE), consumer)
        run = E.consume(stream, lambda df, _, c=consumer: seen[c].extend(r["id"] for r in df.collect()), str(tmp_path / consumer), consumer)
        assert run.awaitTermination(120)
    assert sorted(seen["a"]) == sorted(seen["b"]) == ["e1", "e2", "e3"]


def test_claims_and_routing(spark):
    inbox = spark.createDataFrame([("e1", "warehouse")], "event_id string, consumer_name string")
    assert {r["id"] for r in E.claims(inbox, envelopes(spark), "warehouse").collect()} == {"e2", "e3"}
    assert {r["id"] for r in E.claims(inbox, envelopes(spark), "notify").collect()} == {"e1", "e2", "e3"}
    good, again, dead = E.routed(envelopes(spark).dropDuplicates(["id"]), F.col("payload")["ok"] == "1")
    assert [r["id"] for r in good.collect()] == ["e1"]
    assert [(r["id"], r["retry_count"]) for r in again.collect()] == [("e2", 1)]
    assert [(r["id"], r["dead_letter"]) for r in dead.collect()] == [("e3", True)]


def test_windows_in_a_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=3 * i), float(i)) for i in range(10)]
    spark.createDataFrame(rows, "id int, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = E.file_source(spark, str(tmp_path / "in"), "id int, ts timestamp, value double")
    got = []
    run = E.tumbling(stream, "ts", "15 minutes", "1 minute").writeStream.outputMode("complete").foreachBatch(lambda df, _: got.append([r["n"] for r in df.orderBy("window").collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and got[-1] == [5, 5]
