"""WARC archives, URL reputation, registration and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
from collections import Counter, defaultdict

import pytest

from millwright.llm import queries, url_reputation, warc

PAGES = "page_id long, url string, html string"


# --- WARC --------------------------------------------------------------------------------------------------------


def brute_archive(rows):
    largest = defaultdict(list)
    for key, _, html in rows:
        if key is not None:
            largest[html or ""].append(key)
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        latest = max(largest[html or ""], default=None)
        revisit = latest is not None and key != latest
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((key, len(data), digest, "revisit" if revisit else "response", latest if revisit else None))
    return Counter(out)


@pytest.fixture(scope="module")
def pages():
    return [
        (1, "https://a.example/x", "<p>one</p>"), (2, "http://b.example/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://c", ""), (5, "u", "é" * 90_000),
        (6, "u", "\r\n\r\nHTTP/1.1"), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "<p>one</p>"), (None, "u", "alone"), (9, "u", "same"), (9, "u", "same"), (8, "u", "same"),
    ]


def test_archive_round_trip(spark, pages, tmp_path):
    got = warc.report(spark.createDataFrame([(*p, 1, "x") for p in pages], PAGES + ", payload int, digest string"), f"file://{tmp_path}/a")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == brute_archive(pages)
    assert not list((tmp_path / "a").glob("_temporary*"))
    assert warc.report(spark.createDataFrame([], PAGES), str(tmp_path / "none")).count() == 0


def test_source_reads_headers_payloads_and_foreign_files(spark, pages, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "a")
    warc.archive(spark.createDataFrame(pages[:5], PAGES), path)
    read = spark.read.format("warc").load(path)
    payloads = {r.record_id: bytes(r.payload) for r in read.where("warc_type = 'response'").collect()}
    assert payloads["urn:page:5"] == ("é" * 90_000).encode() and payloads["urn:page:2"] == b"<p>one</p>"
    heads = spark.read.format("warc").option("payload", "false").load(path)
    assert heads.where("payload is not null").count() == 0 and heads.count() == 5
    assert [r.target_uri for r in heads.where("record_id in ('urn:page:2', 'x')").collect()] == ["http://b.example/%0D%0AX: y"]
    assert heads.where("refers_to = 'urn:page:2'").count() == 1 and heads.where("target_uri is null").count() == 1
    # Members of unknown size, and plain records.
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(info.replace(b"hello", b"howdy")))
    (tmp_path / "b" / "g.warc").write_bytes(info + info)
    (tmp_path / "b" / "note.txt").write_text("no archive")
    found = spark.read.format("warc").load(str(tmp_path / "b")).collect()
    assert Counter(bytes(r.payload) for r in found) == {b"hello": 3, b"howdy": 1}


def test_pushed_predicates_skip_payloads(tmp_path):
    """A record that headers rule out is jumped over, not inflated."""
    body = warc.member(warc.record("response", "urn:page:1", "u", "d", b"x" * 3_000_000, "D", None))
    last = warc.member(warc.record("revisit", "urn:page:2", "u", "d", b"", "D", "urn:page:1"))
    (tmp_path / "a.warc.gz").write_bytes(body + last)
    reader = warc.WarcReader(str(tmp_path), True, False)
    list(reader.pushFilters([warc.EqualTo(("warc_type",), "revisit")]))
    seen = []
    take = warc._Plain.take
    try:
        warc._Plain.take = lambda self, n: seen.append(n) or take(self, n)
        got = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    finally:
        warc._Plain.take = take
    assert [r["record_id"] for r in got] == ["urn:page:2"] and not seen
    assert gzip.decompress(body).endswith(b"xxxx\r\n\r\n")  # any gzip reader can read it


def test_a_changed_payload_is_noticed(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record("response", "urn:page:1", "u", "d", b"body", "A" * 32, None)))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.inventory(spark, str(tmp_path)).collect()


# --- URLs --------------------------------------------------------------------------------------------------------


def test_rules_and_parts(spark):
    urls = [
        "https://EXAMPLE.com/en/1", "https://www.example.com/en/1", "https://a.www.example.com/en/", "https://notexample.com/en/1", "http://x.net/es/?q", "http://x.net/fr/#a",
        "http://x.net/frx", "http://com/", "http://a.com", "no scheme", None, "", "http://", "https://h?x=/en/", "ftp://É.NET/es/ü?://", "http://a.net:80/es/", "http://u@b.net/es/x",
    ]
    pages = spark.createDataFrame([(i, u, "kept", 7) for i, u in enumerate(urls)], "page_id long, url string, verdict string, n long")
    empty = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: r for r in url_reputation.judge(pages, empty).collect()}
    assert len(got) == len(urls)

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = []
        for rule, verdict in url_reputation.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(u), u


def test_reputation_shrinks_to_the_level_above(spark):
    rows = [("http://bad.spam.org/", True)] * 200 + [("http://fine.spam.org/", False)] * 200 + [("http://good.site.org/", False)] * 200
    rows += [("http://few.site.org/", True)] * 2 + [("http://other.co.uk/", None)] * 5 + [(None, True)]
    seen = spark.createDataFrame(rows, "url string, bad boolean")
    names = ["bad.spam.org", "fine.spam.org", "new.spam.org", "good.site.org", "few.site.org", "unknown.xyz", "other.co.uk"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(names)], "page_id long, url string")
    got = {r.host: r for r in url_reputation.judge(pages, seen, rules=[]).collect()}
    assert got["bad.spam.org"].verdict == "block" and got["fine.spam.org"].verdict == got["good.site.org"].verdict == "allow"
    assert got["bad.spam.org"].bad_share > got["new.spam.org"].bad_share > got["good.site.org"].bad_share
    assert 0 < got["few.site.org"].bad_share < 1 and not math.isnan(got["unknown.xyz"].bad_share)
    assert got["few.site.org"].bad_bound < got["few.site.org"].bad_share
    domain, suffix = url_reputation.levels("host")
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("com",), ("",)], "host string")
    assert [tuple(r) for r in hosts.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", "")]
    assert url_reputation.judge(spark.createDataFrame([], "page_id long, url string"), seen).count() == 0


def test_warc_writers_to_one_path_do_not_meet(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "archive")
    row = {"warc_type": "response", "record_id": "r", "target_uri": None, "date": "2000-01-01T00:00:00Z", "payload": b"x", "payload_digest": None, "refers_to": None}
    one, two = (warc.WarcWriter(path, False) for _ in range(2))
    written = [w.write(iter([pa.RecordBatch.from_pylist([row])])) for w in (one, two)]
    one.commit([written[0]])
    assert len(list((tmp_path / "archive").glob("part-*"))) == 1
    two.commit([written[1]])
    assert len(list((tmp_path / "archive").iterdir())) == 2  # both parts, and nothing else


# --- registration and the pipeline -------------------------------------------------------------------------------


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(queries.oracle_sql()) <= names


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    before = {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, folder, "labels").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        columns, n = docs.columns, docs.count()
        docs = pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        if name == "quality":
            good = [i for i in before if labels.get(i) == 1]
            assert len([i for i in good if i in after]) >= 0.97 * len(good)
        before = after
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == before


def test_pipeline_stages_on_odd_documents(spark):
    """NULLs, empty and long texts, repeated rows, no rows, and columns named as the stages' own."""
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    leak = queries.table(spark, folder, "benchmark").first().text
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))
    rows = [(1, None), (2, ""), (None, "a text without a key, of some words"), (4, long), (5, "same row\nsame row"), (5, "same row\nsame row"), (6, f"x {leak} y")]
    odd = ["label", "order", "score", "predicted", "size_log", "_gone", "gone", "_kept", "g", "of", "key", "line", "id", "sig", "odd name"]
    docs = spark.createDataFrame([(*r, *range(len(odd)), 7) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in odd) + ", n_chars long")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in found.collect()}
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert kept["line_dedup"][5] == "same row" and kept["line_dedup"][4] == long and kept["line_dedup"][1] is None
    assert set(kept["ngram_join"]) == {1, 2, None, 4, 5, 6} and set(kept["decontamination"]) == {1, 2, None, 4, 5}
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.count() >= len(rows) and pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
