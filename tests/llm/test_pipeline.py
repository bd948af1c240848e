"""The pipeline on the smallest test tables, each stage against what it should do to its own input."""

import os
import re
from collections import Counter

import brute
import duckdb
import pytest

import corpus_pipeline
from siftlake.llm import mixing, registry, toxicity
from siftlake.llm.common import documents, settle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages(spark):
    docs = documents(spark, SF)
    columns, held, at = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, at, SF), "test")
        if name != "packing":
            assert out.columns == columns
        held[name] = (at, out)
        at = out

    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in held["toxicity"])
    model = toxicity.train(docs, toxicity.train_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert after == {d: t for d, t in before.items() if scores[d] < 0.3}

    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in held["exact dedup"])
    first = {}
    for d in sorted(before):
        first.setdefault(norm(before[d]), d)
    assert set(after) == set(first.values())

    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in held["near dedup"])
    assert set(after) == {c for _, c in brute.near_groups(list(before.items())).values()}

    before, after = ({r["doc_id"]: r for r in df.collect()} for df in held["mixing"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(held["mixing"][0]).collect()}
    assert {d: len(r["text"].encode().split()) for d, r in after.items()} == {d: n for d, n in taken.items() if n}
    assert sum(taken.values()) == pytest.approx(1.5 * sum(len((r["text"] or "").encode().split()) for r in before.values()), abs=20)

    whole, packed = held["packing"][0].count(), held["packing"][1].collect()
    assert len({r["doc_id"] for r in packed}) == whole
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and sum(fill.values()) >= 0.97 * 1024 * len(fill)


HARD = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, "word " * 30_000), (6, "x" * 100_000), (7, "a  b c d e\tf"), (8, "ü 日本 é ß a b")]
CLASHES = ["sha", "_sha", "SHA", "nth", "_n", "whole", "_whole", "rest", "_rest", "slot", "size", "row", "kept", "score", "rep", "key", "h", "taken"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_hard_rows(spark, name, stage):
    """Null and repeated ids, null, empty and long texts, clashing columns, an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES if c != "SHA")
    rows = [(d, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, *range(len(CLASHES) - 1)) for i, (d, t) in enumerate(HARD)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    got = [r.asDict() for r in out.collect()]
    if name == "packing":
        assert {r["doc_id"] for r in got} == {d for d, _ in HARD}
    else:
        assert out.columns == docs.columns
        assert all(list(r.values())[5:] == list(range(len(CLASHES) - 1)) for r in got)
        known = {(d, norm(t)) for d, t in HARD}
        assert name == "mixing" or {(r["doc_id"], norm(r["text"])) for r in got} <= known
    if name == "toxicity":
        assert len(got) == len(HARD)
    if name == "exact dedup":
        assert sorted(norm(r["text"]) for r in got) == sorted({norm(t) for _, t in HARD})
    if name == "near dedup":
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, None, 5, 6, 8}
    if name == "mixing":
        assert sum(len(r["text"].encode().split()) for r in got) == pytest.approx(1.5 * sum(len((t or "").encode().split()) for _, t in HARD), abs=3)
    assert stage(spark, docs.limit(0), SF).collect() == []


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_stay_are_not_shuffled_by_near_dedup(spark):
    """Only rows that may go meet the ids that go; at any size, so also where no table is broadcast."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 997}" for k in range(30))) for i in range(300)] + [(1000 + i, "one two three four five") for i in range(20)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_copies(spark, docs, SF)
        stay = [line for line in plan_of(out).split("\n") if line.startswith("   :")]
        assert any("MapInArrow" in line for line in stay) and not any("Exchange" in line for line in stay)
        got = sorted(r["doc_id"] for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted({c for _, c in brute.near_groups([tuple(r) for r in docs.collect()]).values()})


def test_mixed_rows_are_dealt_by_a_hash_at_any_size(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(50)], "doc_id long, text string, source string")
    assert "SortMergeJoin" in plan_of(mixing.mixed_rows(docs))
