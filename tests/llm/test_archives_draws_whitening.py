"""Archives, importance draws and whitening against brute force, and on missing, repeated and clashing input."""

import base64
import gzip
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricspark.llm import importance, warc, whitening
from metricspark.session import scratch_path

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")

# --- archives ---------------------------------------------------------------------------------------------------

TRICKY = "é日本\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
PAGES = [(1, "http://a.example/\r\nX-Page-Id: 99", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", TRICKY),
         (5, "u", "same"), (5, "u", "same"), (7, "u", "WARC/1.1\r\n" * 5), (8, "u", TRICKY), (9, "u", "x" * 3_000_000),
         (None, None, "alone"), (None, None, "twice"), (None, None, "twice")]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "k", 1, 2) for r in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, offset long, times long")


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for h, ids in groups.items():
        top, size = max(-1 if i is None else i for i in ids), len(h.encode())
        spare = [i for i in ids if (-1 if i is None else i) == top][:1]
        for i in sorted(ids, key=lambda i: -1 if i is None else i):
            if size < least or (spare and spare[0] == i):
                out.append((i, size, sha(h), "response", None))
                spare = spare if size < least else []
            else:
                out.append((i, size, sha(h), "revisit", None if top < 0 else top))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_archived_pages(pages, least):
    got = sorted((tuple(r) for r in warc.archived(pages, least).select(*COLUMNS).collect()), key=repr)
    assert got == expected(PAGES, least)


def test_no_pages(pages):
    assert warc.archived(pages.limit(0)).count() == 0


def test_archives_hold_each_payload_once_under_fresh_headers(spark, pages):
    crawl, kept = scratch_path(spark, "t-crawl"), scratch_path(spark, "t-kept")
    warc.write_responses(pages, crawl, date="2020-02-02T00:00:00Z")
    warc.deduplicate(spark, crawl, kept, date="2024-05-05T00:00:00Z")

    def read(path):
        out = []
        for name in sorted(os.listdir(path)):
            if name.endswith(".gz"):
                content = open(f"{path}/{name}", "rb").read()
                found = list(warc.parse(content, name))
                assert found == list(warc.parse(gzip.decompress(content), name))
                out += found
        return out

    old, new = read(crawl), read(kept)
    assert sorted(p.decode() for *_, p in old) == sorted(h or "" for *_, h in PAGES)
    stored = [p.decode() for _, h, _, p in new if h["warc-type"] == "response"]
    assert sorted(stored) == sorted({h or "" for *_, h in PAGES})
    assert all(p == b"" for _, h, _, p in new if h["warc-type"] == "revisit")
    ids = {h["warc-record-id"]: (h, p) for _, h, _, p in new}
    assert len(ids) == len(PAGES) and not ids.keys() & {h["warc-record-id"] for _, h, *_ in old}
    for _, h, http, _ in new:
        assert h["warc-date"] == "2024-05-05T00:00:00Z" and h.get("x-page-id") != "99"
        if h["warc-type"] == "revisit":
            to, payload = ids[h["warc-refers-to"]]
            assert to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"]
            assert int(http["content-length"]) == len(payload) and h.get("warc-refers-to-target-uri") == to.get("warc-target-uri")
    # Deduplicating archives that hold revisits changes nothing but ids.
    warc.deduplicate(spark, kept, again := scratch_path(spark, "t-again"))
    assert [sorted(map(repr, warc.resolved(spark, p).select(*COLUMNS).collect())) for p in (kept, again)][0] == sorted(
        map(repr, warc.resolved(spark, again).select(*COLUMNS).collect()))


def test_revisits_without_their_response(spark, tmp_path):
    def made(kind, page, size, extra=""):
        http = f"HTTP/1.1 200 OK\r\nContent-Length: {size}\r\n\r\n"
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{page}>\r\nX-Page-Id: {page}\r\n{extra}"
                f"Content-Type: application/http\r\nContent-Length: {len(http)}\r\n\r\n{http}\r\n\r\n")

    text = "WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    text += made("revisit", 1, 77, "WARC-Refers-To: <urn:gone>\r\n") + made("revisit", 2, 5)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(text.encode())
    warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = sorted(tuple(r)[:5] for r in warc.resolved(spark, str(tmp_path / "out")).collect())
    assert got == [(1, 77, None, "revisit", None), (2, 5, None, "revisit", None)]


def test_broken_archives():
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"hello\r\n"))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_frequent_digests_and_rare_ones_give_the_same(spark):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i % 700}") for i in range(3000)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


# --- importance draws -------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def draw(docs, target, max_words=1, buckets=10_000, least=20, drawn=10):
    def split(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_words + 1)
                for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(split(x)[0])
    for x in target:
        t.update(split(x)[0])
    cs, ct = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        found, n = split(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (cs + buckets) / ((s[b] + 1) * (ct + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0]))
    for k, r in enumerate(able[:len(able) * drawn // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("max_words, drawn, buckets", [(1, 10, 10_000), (2, 55, 97)])
def test_draw(spark, max_words, drawn, buckets):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = importance.resample(docs, target, max_words=max_words, drawn=drawn, buckets=buckets).collect()
    want = draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], max_words, buckets, drawn=drawn)
    assert sorted(map(tuple, got), key=repr) == want


ODD = [(1, None), (2, ""), (3, "-!? \t"), (4, "É日本 Ab"), (5, "a b " * 20), (5, "a b " * 20), (6, "x" * 300_000 + " " + "y" * 257),
       (7, "word " * 30_000), (None, "c " * 20), (8, "\U0001F600 0Z{|} é̂")]


def test_draw_on_odd_input(spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in ODD], "doc_id long, text string, rank long, tie int, part int")
    target = spark.createDataFrame([("a c é日本",), (None,), ("",)], "text string")
    got = importance.resample(docs, target, max_words=2, drawn=100).collect()
    want = draw(ODD, ["a c é日本", None, ""], 2, drawn=100)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted((r[:4] for r in want), key=repr)
    ranks = sorted((r["rank"], -r["score"]) for r in got if r["rank"])
    assert [r for r, _ in ranks] == [1, 2, 3, 4] and ranks == sorted(ranks, key=lambda r: r[1])
    assert importance.resample(docs.limit(0), target).count() == 0
    assert {r["weight"] for r in importance.resample(docs.filter("doc_id < 4"), target.limit(0)).collect()} == {0}


def test_ranks_over_many_ranges_with_one_repeated_row(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id",
                                          "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 11 END AS score")
    got = importance.ranked(rows, [F.desc("score"), "doc_id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 20_001))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)


def test_crc_of_rows():
    rng = np.random.default_rng(1)
    for size in (1, 7, 8, 9, 40):
        rows = rng.integers(0, 256, (50, size), dtype=np.uint8)
        assert importance.crc_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


# --- whitening --------------------------------------------------------------------------------------------------


def reference(vectors):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return x, n, s, e, (x - s / n) @ q


def test_whitening(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = {r.vec_id: r.embedding for r in rows.collect()}
    twice = rows.unionByName(rows.filter("vec_id % 3 = 0"))  # repeated vectors count once in the fit
    got = whitening.whiten(twice).collect()
    ids = sorted(data)
    x, n, s, e, p = reference([data[i] for i in ids])
    place = {i: k for k, i in enumerate(ids)}
    assert len(got) == 4 * (len(ids) + sum(i % 3 == 0 for i in ids))
    signs = {}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        want = p[k, c] / np.sqrt(e[c])
        sign = signs.setdefault(c, 1.0 if want * r.whitened > 0 else -1.0)
        assert r.whitened * sign == pytest.approx(want, abs=1e-9)
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s))
        assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**16, (1000, 5)).astype(np.uint64), rng.integers(0, 2**9, (1000, 3)).astype(np.uint64)
    got = whitening.products(whitening.planes(a, 16), whitening.planes(b, 9))
    assert got.tolist() == (a.T.astype(object) @ b.astype(object)).tolist()


def test_scatter_of_wide_values_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2**62, 2**62, (300, 3))
    x[0], x[1] = 2**63 - 1, -2**63
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>")
    one = whitening.marginals(fit)
    assert [m[2] for m in one] == [sum(c) for c in x.astype(object).T.tolist()]
    shifted = x.astype(object) - x.min(axis=0).astype(object)
    assert whitening.scatter(fit, [m[0] for m in one], [m[1] for m in one]).tolist() == (shifted.T @ shifted).tolist()


def test_whitening_on_odd_input(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [INF, 1.0]), (None, [0.5, -3.0]), (5, [1.0, 2.0]), (6, []),
            (7, [1.0]), (8, [-0.0, 7.0]), (10, [NAN, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n long, x string")
    got = whitening.whiten(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == [
        (i, c) for i in (-1, 1, 5, 8) for c in (1, 2)]
    assert {r.n for r in got} == {3} and all(r.identity_error < 1e-9 for r in got)
    assert len({(r.component, r.whitened) for r in got if r.vec_id in (1, 5)}) == 2
    flat = whitening.whiten(df.filter("vec_id IN (1, 5)")).collect()
    assert len(flat) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(1, 0, None, None, None)}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 2")).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.deviation is None, r.deviation_exact.isdigit()) for r in whitening.whiten(huge).collect() if r.vec_id < 3} == {(True, True)}
