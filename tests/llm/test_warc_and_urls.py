import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from siftlake.llm import host_reputation as hr
from siftlake.llm import warc
from siftlake.llm.common import fresh_path


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, digest string, size int")


ROWS = [(1, "http://a/b c\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (7, "http://b", ""), (5, "http://c", "x" * 300_000), (None, "http://n", "<p>é</p>"), (9, "http://z", "\r\n\r\n")]


def test_round_trip(spark, monkeypatch):
    path = fresh_path(spark, "t")
    manifest = warc.archive(pages(spark, ROWS), path)
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(ROWS)
    for page, _, html in ROWS:
        raw = (html or "").encode()
        r = got[page]
        assert r["payload_digest"] == warc.digest_of(raw) and r["payload_bytes"] == len(raw)
        assert r["payload"] == (raw if r["record_type"] == "response" else None)
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 3: ("revisit", 7), 7: ("response", None), 5: ("response", None), 9: ("response", None)}


def test_small_payloads_are_responses(spark):
    path = fresh_path(spark, "t")
    warc.archive(pages(spark, ROWS[:4]), path, min_bytes=1)
    assert {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, path).collect()} == {1: "revisit", 2: "response", 3: "response", 7: "response"}


def test_empty_table_and_many_archives(spark, monkeypatch):
    assert warc.archive(pages(spark, []), fresh_path(spark, "t")).collect() == []


def build(records, known=b"some words that occur again and again " * 20):
    import struct

    import zstandard

    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known), write_checksum=True)
    return struct.pack("<II", warc.DICT_MAGIC, len(known)) + known + b"".join(writer.compress(r) for r in records)


@given(st.lists(st.binary(max_size=400), max_size=6))
@settings(max_examples=50, deadline=None)
def test_frames_are_walked(payloads):
    records = [warc.record(i, "http://x", p, warc.digest_of(p), None) for i, p in enumerate(payloads)]
    got = list(warc.read_archive(build(records)))
    assert [g["payload"] for g in got] == payloads


def test_damage_is_noticed():
    good = warc.record(1, "http://x", b"abc", warc.digest_of(b"abc"), None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"Date"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    whole = build([good])
    for cut in (whole[:-5], whole[:40], whole + b"zz"):
        with pytest.raises(Exception):
            list(warc.read_archive(cut))


def test_rules_and_parts(spark):
    cases = {
        "https://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://blog.example.com/en/": ("blog.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/de?/en/": ("example.com", "/de", "com/", "allow"),
        "http://a.net/es/1#z": ("a.net", "/es/1", "net/es/", "block"),
        "http://notnet/es/": ("notnet", "/es/", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "x://y://z/p": ("y:", "//z/p", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://É.com:80/a\nb": ("É.com:80", "/a\nb", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hr.judge(df, none).collect()}
    assert got == dict(enumerate(cases.values()))
    assert hr.judge(df.limit(0), none).collect() == []


def test_reputation_shrinks_and_blocks(spark):
    rows, page = [], 0
    for host, good, n in (("bad.spam.org", 0, 60), ("a.fine.org", 60, 60), ("b.fine.org", 40, 40), ("new.fine.org", 0, 1), ("new.spam.org", 0, 1), ("mixed.org", 30, 60)):
        for k in range(n):
            rows.append((page, f"http://{host}/{page}", k < good))
            page += 1
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    rep = {r["host"]: (r["mean"], r["upper"]) for r in hr.reputation(df.select(hr.host_of(df.url).alias("host"), "good")).collect()}
    assert rep["new.spam.org"][0] < rep["new.fine.org"][0] and rep["bad.spam.org"][1] < 0.5 < rep["a.fine.org"][0]
    verdicts = {r["host"]: r["verdict"] for r in hr.judge(df, df).collect()}
    assert verdicts["bad.spam.org"] == "block" and verdicts["a.fine.org"] == verdicts["mixed.org"] == "allow"


def test_domains(spark):
    df = spark.createDataFrame([("a.b.example.co.uk:8080",), ("example.com",), ("localhost",), ("u@x.y.org",)], "h string")
    d = hr.domain_of(df.h)
    assert [tuple(r) for r in df.select(d, hr.suffix_of(d)).collect()] == [("example.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("y.org", "org")]


def test_base32_has_no_padding():
    assert re.fullmatch("[A-Z2-7]{32}", warc.digest_of(b""))


def test_repeated_rows_many_archives_and_paths_without_scheme(spark, tmp_path):
    rows = [(i // 2, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(200)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    joined = warc.payloads(pages).withColumn("refers_to", F.lit(None).cast("long"))
    made = warc.write_archives(joined, str(tmp_path / "a"), b"", roll=2000).collect()
    assert len(made) > 4 and sum(r["records"] for r in made) == len(rows) and len({r["name"] for r in made}) == len(made)
    back = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"]) for r in back) == sorted((d is None, d or 0, len(h or "")) for d, _, h in rows)
    warc.archive(pages, str(tmp_path / "b"))
    got = warc.read_archives(spark, str(tmp_path / "b")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["record_type"] == "revisit":
            assert r["refers_to"] > r["page_id"] and r["payload"] is None


def test_repeated_rows_are_judged_alike(spark):
    pages = spark.createDataFrame([(1, "http://a.co.uk/x"), (1, "http://a.co.uk/x"), (2, "http://a.co.uk/y"), (None, "http://a.co.uk/x")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, False), (2, False)], "page_id long, good boolean")
    got = [(r["page_id"], r["host"], r["verdict"]) for r in hr.judge(pages, outcomes).collect()]
    assert len(got) == 4 and len({(h, v) for _, h, v in got}) == 1
    assert hr.judge(pages.limit(0), outcomes).collect() == []
    domains = spark.createDataFrame([("x.a.co.uk",), ("a.net.es",), ("b.a.com",), ("com",)], "h string").select(hr.domain_of(F.col("h"))).collect()
    assert [r[0] for r in domains] == ["a.co.uk", "a.net.es", "a.com", "com"]
