"""WARC archives and their capture index: exact round trips."""

import base64
import hashlib
import random

import pytest
from tests.llm.helpers import clashing

from tessera.llm import warc


def brute(rows, min_bytes):
    newest = {}
    for page_id, _, html in rows:
        newest[html or ""] = max(newest.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        other = newest[html or ""]
        revisit = len(raw) >= min_bytes and other != page_id
        out.append((page_id, len(raw), digest, "revisit" if revisit else "response", other if revisit else None))
    return sorted(out)


def pages(spark, n=300, seed=0):
    rng = random.Random(seed)
    bodies = ["", None, "a", "<p>é</p>\r\n\r\n", "x" * 70000] + [f"<html>{i}</html>" * 5 for i in range(60)]
    urls = [f"http://{'www.' * (i % 2)}h{i % 7}.example.com:{80 + i % 2}/p{i % 40}/?q={i % 3}" for i in range(n)]
    rows = [(i * 3, urls[i], rng.choice(bodies)) for i in range(n)]
    rows += [(5001, None, "none"), (5004, "", "a"), (5007, "http://[bad", "b\tad"), (5010, "x\ty\nz", "odd")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_round_trip(spark, min_bytes):
    rows, table = pages(spark)
    got = sorted(tuple(r) for r in warc.round_trip(clashing(table), min_bytes).collect())
    assert got == brute(rows, min_bytes)


def test_look_up_finds_all_captures(spark, monkeypatch):
    rows, table = pages(spark)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    folder, directory, captures = warc.archive(table)
    index = warc.CaptureIndex.load(directory, folder)
    wanted = {}
    for page_id, url, _ in rows:
        wanted.setdefault(warc.url_key(url), set()).add(page_id)
    html = {p: h for p, _, h in rows}
    for page_id, url, _ in rows[::11] + rows[-4:]:
        found = index.records(url)
        assert {r.page_id for r in found} == wanted[warc.url_key(url)]
        for r in found:
            if r.kind == "response":
                assert r.payload == (html[r.page_id] or "").encode()
    assert index.records("http://nowhere.example.org/") == []
    keys = captures.select("key").distinct()
    assert sorted(map(tuple, warc.look_up(keys, directory, folder).collect()), key=str) == sorted(map(tuple, captures.collect()), key=str)
    some = [warc.url_key(url) for _, url, _ in rows[::17]] + ["com,nowhere)/", "", "zz"]
    found = warc.look_up(spark.createDataFrame([(k,) for k in set(some)], "key string"), directory, folder).collect()
    assert sorted(r.page_id for r in found) == sorted(p for p, url, _ in rows if warc.url_key(url) in some)


def test_keys_with_controls_are_found(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    urls = ["h", "h\x01", "h\t", "h\n", "h ", "h\x01x", "h!", "hh", "h\x1f", "é", "\U0001f600", "\uffff"] * 2
    table = spark.createDataFrame([(i, u, str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder, directory, _ = warc.archive(table)
    index = warc.CaptureIndex.load(directory, folder)
    for u in set(urls):
        wanted = {i for i, v in enumerate(urls) if warc.url_key(v) == warc.url_key(u)}
        assert {r[1] for r in index.captures(u)} == wanted
    assert warc.round_trip(table).count() == len(urls)


def test_empty_table_null_ids_and_repeated_rows(spark):
    table = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "v", "a"), (None, None, None)], "page_id long, url string, html string")
    got = warc.round_trip(table).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0) == [(0, 0, "response", None)]
    assert [(r.record_type, r.refers_to) for r in got if r.page_id is None and r.payload_bytes] == [("revisit", 1)]
    assert {r.record_type for r in got if r.page_id == 1} == {"response"}
    assert warc.round_trip(table.limit(0)).count() == 0


def test_damaged_record_is_noticed():
    good = warc.build_record(1, "u", warc.payload_digest(b"abc"), b"abc", None, 3)
    assert warc.parse_record(warc.pack(good)).payload == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(warc.pack(good.replace(b"abc", b"abd")))


def test_url_keys():
    assert warc.url_key("https://www.Example.com/A/?b=1") == "com,example)/a?b=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == ""
