import json
import os

import pytest
from pyspark.sql import functions as F

from siftlake.operators import summaries
from siftlake.plans import reports
from siftlake.sources import readers


def test_distinct_bursts_against_plain_python(spark):
    import random

    rng = random.Random(5)
    rows = [(g, -rng.randint(1, 9), i, sorted(rng.sample(range(30), rng.randint(1, 12)))) for g in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, rank int, i int, review_ids array<long>")
    got = {(r["g"], r["i"]) for r in summaries.distinct_bursts(df, "g", ["rank", "i"]).collect()}
    want = set()
    for g in range(6):
        used = set()
        for _, rank, i, ids in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if len(set(ids) & used) < 0.5 * len(ids):
                used |= set(ids)
                want.add((g, i))
    assert got == want and summaries.distinct_bursts(df.limit(0), "g", ["rank", "i"]).collect() == []


def test_balancing(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id long, label string")
    for method, n in (("under", 3), ("over", 7)):
        rows = summaries.balanced(df, "label", "id", method).collect()
        assert sorted(r["label"] for r in rows) == ["a"] * n + ["b"] * n
        if method == "over":
            assert {r["id"] for r in rows} == set(range(10))


def test_shuffle_depends_on_the_seed_alone(spark):
    a, b = spark.range(50).withColumn("x", F.lit(1)), spark.range(50, 90)
    one = [r["id"] for r in summaries.shuffled([a, b], 1, "id").collect()]
    assert one == [r["id"] for r in summaries.shuffled([a.repartition(3), b], 1, "id").collect()]
    assert sorted(one) == list(range(90)) and one != [r["id"] for r in summaries.shuffled([a, b], 2, "id").collect()]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "x double, severity string, actionability double, priority int")
    r = summaries.distribution(none, "x", {"p95": 0.95}, 0.3).first()
    assert r["n"] == 0 and r["mean"] is None
    r = summaries.version_match(none, none).first()
    assert r["match_score"] == 1 and not r["significant"] and r["overlap_pct"] == 100


def test_metrics_are_replaced_by_upload_and_version(spark, tmp_path):
    path = str(tmp_path / "metrics")
    row = lambda u, v, n: spark.createDataFrame([(u, v, n)], "upload_id int, pipeline_version string, n int")
    for u, v, n in ((1, "v1", 5), (1, "v2", 6), (2, "v1", 7), (1, "v2", 9)):
        readers.load_metrics(row(u, v, n), path)
    assert sorted((r["upload_id"], r["pipeline_version"], r["n"]) for r in spark.read.parquet(path).collect()) == [(1, "v1", 5), (1, "v2", 9), (2, "v1", 7)]


def test_chunked_appends(spark, tmp_path):
    path = str(tmp_path / "rows")
    readers.append_chunks(spark.range(1200).coalesce(1), path, "id")
    out = readers.append_chunks(spark.range(1200, 1300).coalesce(1), path, "id")
    assert out.count() == 1300
    per = [r["n"] for r in out.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(per) <= 500 and len(per) >= 4


def test_report_files(spark, tmp_path):
    report = spark.createDataFrame([(3, None, [1, 2])], "n int, note string, ids array<int>")
    text = "\n".join(r["value"] for r in spark.read.text(readers.write_report(report, str(tmp_path), "Drift")).collect())
    assert text.startswith("## Drift\n- **n:** 3\n- **note:** -\n- **ids:** [1,2]")
    files = [f for f in os.listdir(tmp_path / "json") if f.startswith("part-")]
    rows = [json.loads(x) for f in files for x in open(tmp_path / "json" / f)]
    assert rows == [{"n": 3, "ids": [1, 2]}]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables")
def test_bursts_of_the_test_tables_overlap_by_under_half(spark):
    seen: dict[int, set] = {}
    for r in reports.u7(spark, "/root/testdata/sf0.01").collect():
        ids = set(r["review_ids"])
        assert len(ids) >= 2 and len(ids & seen.get(r["upload_id"], set())) < 0.5 * len(ids)
        seen.setdefault(r["upload_id"], set()).update(ids)
    assert seen
