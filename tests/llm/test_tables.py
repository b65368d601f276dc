"""Embeddings, URL rules and WARC archives against plain Python."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import components, embedding_join, entry, url_rules, warc
from marketlens.llm.common import scratch

VECTOR = "vec_id bigint, embedding array<float>, label int, size int, cell int"


def expected_links(rows, threshold=0.9):
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(fine))}
    for a, (_, x) in enumerate(fine):
        for b, (_, y) in enumerate(fine):
            if a != b and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
    root = brute.roots(links, links)
    out = [(i, len(links[k]), min(j for q, (j, _) in enumerate(fine) if root[q] == root[k])) for k, (i, _) in enumerate(fine)]
    return sorted(out + [(i, 0, i) for i, v in rows if (i, v) not in fine])


def embedded(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    out = []
    for i in range(n):
        v = centres[i % 12] + rng.normal(size=8) * rng.choice([0.02, 0.3, 1.0])
        out.append((i, [float(np.float32(x)) for x in v]))
    return out + [(n + k, out[0][1]) for k in range(9)] + [(n + 20, [x * 2 for x in out[0][1]])]


@pytest.mark.parametrize(("cell", "block"), [(4000, 2048), (20, 8)])
def test_op3_links_and_components(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_join, "CELL", cell)
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    rows = embedded(1, 150)
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [float("inf")] * 8), (906, rows[0][1][:4])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECTOR)
    got = embedding_join.join(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == expected_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_op3_ties_nulls_and_empty(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(1, v, 0, 0, 0), (1, v, 0, 0, 0), (None, v, 0, 0, 0), (None, None, 0, 0, 0)], VECTOR)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embedding_join.join(df).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    assert embedding_join.join(df.limit(0)).collect() == []


def test_op3_pivots_of_one_direction_share_their_vectors():
    rng = np.random.default_rng(3)
    v = rng.normal(size=8)
    rows = v + rng.normal(size=(500, 8)) * 0.05
    vectors = pa.array(rows.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(np.ones(500, np.int64)), vectors], names=["cid", "size", "vector"])
    out = list(embedding_join._cells([(v * f).tolist() for f in (1.0, 1.1, 1.3, 1.7)], 0.9)(iter([batch])))
    first = {c for b in out for c, cell in zip(b.column("cid").to_pylist(), b.column("cell").to_pylist(), strict=True) if cell == 0}
    assert first == set(range(500))


def test_op3_on_the_tables(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = entry.op3_embedding_near_dedup(spark, small).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == expected_links(rows)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100 + i, 500) for i in range(30)] + [(500, 500)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain + star, "u bigint, v bigint")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys([*range(100, 130), 500], 100)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_components_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_NODES", 0)
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(7, 1000 + i) for i in range(300)]
    links = {i: set() for e in edges for i in e}
    for u, v in edges:
        links[u].add(v)
        links[v].add(u)
    want = brute.roots(links, links)
    least = {}
    for i in links:
        least[want[i]] = min(i, least.get(want[i], i))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: least[want[i]] for i in links if links[i] - {i}}


PAGE = "page_id bigint, url string, html string, host string, part int"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def verdict(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_op4_edge_cases(spark):
    rng = random.Random(4)
    hosts = ["a.example.org", "example.org", "notexample.org", "x.org", "ORG", "b.a.Example.ORG", "é.com", "example.org:80", "", "com.org", "org.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a#b", "#/es/", "?q", "/en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "://", "a://b://c", "http://x.org/" + "p" * 100_000, "http://x.org/a\nb"]
    rules = [*entry.RULES, ("a.example.org", "/en/", "allow"), ("org", "/en/1", "allow"), ("a.example.org", "/es/", "block"), ("a.example.org", "/es/", "allow"), (None, "/", "block"), ("com", None, "block")]
    df = spark.createDataFrame([(i, u, None, "clash", 1) for i, u in enumerate(urls)] + [(0, urls[0], None, "clash", 1), (None, urls[0], None, "clash", 1)], PAGE)
    got = url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) + 2
    plain = [(h or "", p or "", v) for h, p, v in rules]
    for r in got:
        want = verdict(urls[r["page_id"] or 0], plain)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_rules.judge(df, none).collect()} == {"allow"}
    assert url_rules.judge(df.limit(0), none).collect() == []


def test_op4_ranges_are_tasks_of_even_size(spark):
    """A host with a third of the pages is split, and no two ranges share a task."""
    page = "CASE WHEN id % 3 = 0 THEN 'http://hot.org/' ELSE concat('http://h', id, '.com/') END"
    df = spark.range(12_000).selectExpr("id AS page_id", f"{page} AS url")
    rules = spark.createDataFrame([("org", "/", "block"), ("com", "/x", "allow")], "host string, path string, verdict string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = url_rules.judge(df, rules).selectExpr("spark_partition_id() AS task", "verdict").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = Counter(r["task"] for r in got)
    assert len(got) == 12_000 and len(sizes) == 24 and max(sizes.values()) < 3 * 12_000 / 24
    assert sum(r["verdict"] == "block" for r in got) == 4_000


def test_op4_on_the_tables(spark, small):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["page_id"]: tuple(r)[1:] for r in entry.op4_url_filters(spark, small).collect()}
    assert got == {i: verdict(u, entry.RULES) for i, u in urls.items()}


def test_op6_round_trip(spark):
    pages = [
        (1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "http://b/é", "same"), (4, "u", ""), (5, "u", None), (6, "u", "é漢🙂\r\n\r\n" * 1000), (None, "u", "same"),
        (7, "u", "z" * 3_000_000), (8, "u", "unique"), (3, "again", "same"),
    ]
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in pages], PAGE)
    got = sorted((tuple(r) for r in warc.round_trip(df, archive_bytes=1000).collect()), key=str)
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        first = last[h or ""] == i
        digest = __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        want.append((i, len(body), digest, "response" if first else "revisit", None if first else last[h or ""]))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_op6_payloads_and_damage(spark):
    df = spark.createDataFrame([(1, "http://a", "payload one", "", 0), (2, "http://b", "payload two", "", 0)], PAGE)
    folder = scratch(spark, "test-warc")
    archives = warc.write(df.coalesce(1), folder)
    found = {r["id"]: bytes(r["payload"]).decode() for r in warc.read(spark, archives, folder, payloads=True).collect()}
    assert found == {"1": "payload one", "2": "payload two"}
    whole = warc.record(1, "u", b"body", "response") + warc.record(2, None, b"body", "revisit", 1)
    split = [whole[i : i + 7] for i in range(0, len(whole), 7)]
    assert [(h["warc-type"], p) for h, p in warc.records(iter(split))] == [("response", b"body"), ("revisit", None)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([whole[:-3]])))
    import zlib

    text = zlib.decompress(warc.record(1, "u", b"body", "response"), 31)
    for bad in (text.replace(b"body", b"bodY"), text.replace(b"body", b"bod"), text[:-2]):
        with pytest.raises(ValueError):
            list(warc.records(iter([zlib.compress(bad, wbits=31)])))


def foreign(kind, block, *lines, version="WARC/1.0"):
    head = "".join(f"{x}\r\n" for x in (f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *lines))
    return gzip.compress(f"{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n")


def test_op6_reads_archives_of_other_writers(spark, tmp_path):
    body = b"<html>\r\n\r\n" + b"z" * (3 << 20)  # inflates to many times a chunk
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + body
    parts = [
        foreign("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.0\r\n\r\n", "WARC-Record-ID: <urn:uuid:2>"),
        foreign("response", page, "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://a/", "Content-Type: application/http;", " msgtype=response"),
        foreign("response", b"20240101\r\n\r\nA 1.2.3.4", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: text/dns", "WARC-Block-Digest: md5:abc"),
        foreign("resource", b"plain", "WARC-Record-ID: <urn:uuid:5>", "WARC-Payload-Digest: sha1:" + warc._digest(b"plain").lower(), version="WARC/1.1"),
        foreign("revisit", b"", "WARC-Record-ID: <urn:uuid:6>", "WARC-Refers-To: <urn:uuid:3>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no archive")
    folder = tmp_path.as_uri()
    got = warc.read(spark, warc.archives_in(spark, folder), folder, payloads=True).collect()
    assert sorted((r["id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in got) == [
        ("urn:uuid:1", "warcinfo", None, None, None, None), ("urn:uuid:2", "request", None, None, None, None),
        ("urn:uuid:3", "response", len(body), warc._digest(body), None, body),
        ("urn:uuid:4", "response", 21, warc._digest(b"20240101\r\n\r\nA 1.2.3.4"), None, b"20240101\r\n\r\nA 1.2.3.4"),
        ("urn:uuid:5", "resource", 5, warc._digest(b"plain").lower(), None, b"plain"),
        ("urn:uuid:6", "revisit", None, None, "urn:uuid:3", None),
    ]
    wrong = foreign("resource", b"plain", "WARC-Payload-Digest: sha1:" + warc._digest(b"other"))
    with pytest.raises(ValueError, match="payload differs"):
        list(warc.records(iter([wrong])))
    whole = b"".join(parts)
    assert [len(p or b"") for _, p in warc.records(iter([whole[i : i + 5] for i in range(0, len(whole), 5)]))] == [0, 0, len(body), 21, 5, 0]
    with pytest.raises(ValueError, match="cannot be kept in nosuch"):
        warc.read(spark, warc.archives_in(spark, folder), "nosuch://a/b")


def test_op6_on_the_tables(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r["page_id"]: r["payload_bytes"] for r in entry.op6_warc(spark, small).collect()}
    assert got == {r["page_id"]: len((r["html"] or "").encode()) for r in pages}
