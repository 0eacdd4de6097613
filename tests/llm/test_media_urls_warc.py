"""Media round trips, URL rules, archives."""

import gzip
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from disclosa.llm import media, queries, urls, warc
from disclosa.llm.queries import OP6_SQL, RULES

TEXTS = [(1, "hello"), (2, None), (3, ""), (4, "x" * 64), (5, "y" * 65), (6, "é" * 40), (None, "hello"), (1, "hello"), (7, "long words " * 20000)]


def test_media_table(spark):
    docs = spark.createDataFrame([(*t, "clash") for t in TEXTS], "doc_id long, text string, media string")
    kept = media.media_table(docs)
    assert kept.columns == ["doc_id", "n_bytes", "media"]
    got = sorted(media.features(kept).collect(), key=lambda r: str(r.doc_id))
    texts = sorted(TEXTS, key=lambda t: str(t[0]))
    assert [r.doc_id for r in got] == [t[0] for t in texts]
    for r, (_, text) in zip(got, texts):
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and media.from_wav(bytes(r.media)) == padded
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(r.media)
        frames, peaks, pairs = plain_fingerprint(padded)
        assert (r.n_frames, r.n_peaks, list(zip(r.times, r.codes))) == (frames, peaks, pairs)
        assert len(r.times) == len(r.codes) == r.n_pairs and r.times == sorted(r.times)
    assert got[0][1:] == got[1][1:] == got[8][1:]
    assert media.features(media.media_table(docs.limit(0))).count() == 0
    none = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert media.features(none).first().payload_bytes is None


def plain_fingerprint(payload):
    """Frames, peaks and (time, code) pairs from the definitions, a sum for each bin."""
    x = [(b - 128) / 128 for b in payload]
    x += [0.0] * max(0, 256 - len(x))
    x += [0.0] * (-(len(x) - 256) % 128)
    n = (len(x) - 256) // 128 + 1
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / 256) for k in range(256)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(1, 129), np.arange(256)) / 256)
    power = [np.abs(turn @ [a * b for a, b in zip(x[t * 128 : t * 128 + 256], window)]) ** 2 for t in range(n)]
    best = [[max(range(32 * b, 32 * b + 32), key=lambda f: (p[f], -f)) for b in range(4)] for p in power]
    found = []
    for t in range(n):
        for b in range(4):
            own = power[t][best[t][b]]
            before = power[t - 1][best[t - 1][b]] if t else 0
            after = power[t + 1][best[t + 1][b]] if t + 1 < n else 0
            if own >= before and own > after and own > 1e-6:
                found.append((t, best[t][b]))
    pairs = [(t, f << 12 | g << 5 | u - t) for k, (t, f) in enumerate(found) for u, g in found[k + 1 : k + 4] if u - t <= 31]
    return n, len(found), sorted(pairs)


def test_fingerprints_equal_a_plain_transform(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(20).collect()]
    same = total = 0
    for text in texts:
        payload = media.pad(text.encode()[:6000])
        frames, peaks, pairs = plain_fingerprint(payload)
        times, codes, n_peaks, n_frames = media.fingerprints(payload)
        assert n_frames == frames
        got = set(zip(times.tolist(), codes.tolist()))
        same, total = same + len(got & set(pairs)), total + len(got | set(pairs))
    # single precision may turn near ties of bins or frames
    assert same >= 0.99 * total > 0


def test_blocks_do_not_change_spectra(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(0, 256, 100_000, dtype=np.uint8))
    whole = media.fingerprints(data)
    monkeypatch.setattr(media, "BLOCK", 7)
    part = media.fingerprints(data)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


def test_a_tone_has_its_peak_and_shifts_move_times():
    n = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * n * 1000 / media.RATE) * (n % 1000 < 500)).astype(np.uint8).tobytes()
    t, f, _ = media.peaks(tone)
    assert 31 in f  # 1000 Hz is bin 32, and bin 0 is left out
    codes = set(media.fingerprints(tone)[1].tolist())
    later = set(media.fingerprints(bytes([128]) * (media.HOP * 5) + tone)[1].tolist())
    assert len(codes & later) > 0.5 * len(codes)


URLS = ["https://a.COM/en/x", "http://example.com/en/71", "http://sub.example.com/en/8", "x://net/de/", "https://example.net/de/8?q", "https://example.net/de/9#f", "org/es/", None, "", "://", "https://xcom/en/1", "http://b.org/es/#x", "https://ÄÖ.org/es/1", "http://com/en", "a://b.net/de/\n", "http://com/EN/1", "p://u.org?x://y.com/en/"]


def plain(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.pattern), default=None)
    return host, path, best and best.pattern, best.action if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(URLS)] + [(0, URLS[0], "c", "d")], "page_id long, url string, host string, best string")
    got = urls.judge_urls(pages, RULES)
    assert "PythonUDF" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, *plain(u)) for i, u in enumerate(URLS)] + [(0, *plain(URLS[0]))], key=str)
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0


def test_wildcards_host_only_rules_and_bounds(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/x/ads/1"), (2, "http://b.com"), (3, "http://b.com.evil/")], "page_id long, url string")
    got = urls.judge_urls(pages, [urls.Rule("block", "b.com/*/ads/"), urls.Rule("block", "b.com")], otherwise="keep").orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("b.com/*/ads/", "block"), ("b.com", "block"), (None, "keep")]
    assert {r.verdict for r in urls.judge_urls(pages, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.judge_urls(pages, [urls.Rule("block", "/x")])
    assert "rules" in OP6_SQL


def test_more_rules_than_an_index_and_ties(spark, monkeypatch):
    monkeypatch.setattr(urls, "RULES_OF_AN_INDEX", 3)
    rules = [urls.Rule("allow" if k % 2 else "block", f"h{k % 5}.com/p{'x' * (k % 4)}{'*' * (k % 3)}") for k in range(20)] + [urls.Rule(a, "t.com/") for a in ("allow", "block")]
    pages = spark.createDataFrame([(k, f"http://www.h{k % 7}.com/p{'x' * (k % 6)}?q") for k in range(60)] + [(100, "http://t.com/"), (101, "http://t.com/" + "y/" * 50_000), (101, "http://t.com/" + "y/" * 50_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    for p in pages.collect():
        host, path = urls_of(p.url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and re.match(".*".join(map(re.escape, r.path.split("*"))), path)]
        best = max(fits, key=lambda r: (len(r.pattern), r.pattern, r.action), default=None)
        assert got[p.page_id] == ((best.pattern, best.action) if best else (None, "allow"))
    assert got[100] == got[101] == ("t.com/", "block") and urls.judge_urls(pages, rules).count() == 63


def urls_of(url):
    rest = url.split("://", 1)[1]
    host, _, path = rest.partition("/")
    return host, "/" + path.split("?")[0]


PAGES = [(1, "http://a", "same"), (5, "http://b", "same"), (3, "http://c\nd", "same"), (2, None, "other"), (4, "u", None), (9, "v", ""), (None, "n", "same"), (None, "n", "alone"), (5, "http://b", "same"), (7, "w", "long é " * 50000), (10**12, "far", "other")]


def written(spark, **options):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, kind int")
    return warc.write_archives(pages, **options)


def test_archives_round_trip(spark):
    got = sorted((tuple(r) for r in warc.read_archives(spark, written(spark)).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()), key=str)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        top = max(ids, default=None)
        revisit = top is not None and (page is None or page < top)
        want.append((page, "revisit" if revisit else "response", top if revisit else None, len(raw), warc.base32(hashlib.sha1(raw).digest())))
    assert got == sorted(want, key=str)


def test_urls_read_back_as_they_were(spark):
    got = sorted(((r.page_id, r.url) for r in warc.read_archives(spark, written(spark)).collect()), key=str)
    assert got == sorted(((p, u) for p, u, _ in PAGES), key=str)
    pages = spark.createDataFrame([(1, "", "a"), (2, "urn:x-page:none", "b")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url) for r in warc.read_archives(spark, warc.write_archives(pages)).collect()) == [(1, ""), (2, "urn:x-page:none")]


def test_far_null_and_equal_ids_spread_over_shards(spark, tmp_path):
    text = "x" * 2000
    far = spark.createDataFrame([(i, "u", text + str(i)) for i in range(2000)] + [(10**15, "u", text)], "page_id long, url string, html string")
    null = spark.createDataFrame([(None, "u", text + str(i)) for i in range(2000)], "page_id long, url string, html string")
    same = spark.createDataFrame([(5, "u", text)] * 2000 + [(5, "u", text + "y")], "page_id long, url string, html string")
    for k, pages in enumerate((far, null, same)):
        at = warc.write_archives(pages, out=f"file:{tmp_path}/{k}", shard_bytes=200_000)
        rows = spark.read.parquet(f"{at}/manifest").groupBy("shard").agg(F.sum("records").alias("n")).toPandas()
        assert 15 <= len(rows) <= 60 and rows.n.sum() == pages.count() and rows.n.max() <= 400
        back = warc.read_archives(spark, at)
        assert back.count() == pages.count() and back.where("record_type = 'revisit'").count() == 0
        if k == 0:
            ends = spark.read.parquet(f"{at}/manifest").select("shard", "file").orderBy("shard").collect()
            assert len({r.shard for r in ends}) == len(rows)


def test_shards_are_ranges_of_ids(spark):
    pages = spark.createDataFrame([(i * 7, "u", "x" * (i % 90) * 10) for i in range(500)], "page_id long, url string, html string")
    at = warc.write_archives(pages, shard_bytes=20_000, roll_bytes=10**9)
    path, last = at.removeprefix("file://"), -1
    for r in spark.read.parquet(f"{at}/manifest").orderBy("file").collect():
        with open(f"{path}/{r.file}", "rb") as f:
            ids = [int(h["WARC-Record-ID"][12:].split(":")[0]) for h, _ in warc.parse(f) if h["WARC-Type"] != "warcinfo"]
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    assert last == 499 * 7


def test_files_are_the_same_each_time_and_roll(spark):
    a, b = (written(spark, roll_bytes=600, shard_bytes=2000) for _ in range(2))
    get = lambda at: sorted(tuple(r) for r in spark.read.parquet(f"{at}/manifest").collect())
    assert get(a) == get(b) and len(get(a)) > 3
    small = [f for f in get(a)]
    path = a.removeprefix("file://")
    for _, name, records, size, sha in small:
        data = open(f"{path}/{name}", "rb").read()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == records + 1
    ids = [r.page_id for r in warc.read_archives(spark, a).where(F.col("page_id").isNotNull()).collect()]
    assert sorted(ids) == sorted(p[0] for p in PAGES if p[0] is not None)


def test_small_payloads_are_no_revisits_and_empty_tables_work(spark):
    got = warc.read_archives(spark, written(spark, least=10)).where("record_type = 'revisit'")
    assert got.count() == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(none)).count() == 0


def test_damage_is_found(spark):
    at = written(spark)
    name = spark.read.parquet(f"{at}/manifest").first().file
    path = f"{at.removeprefix('file://')}/{name}"
    data = gzip.decompress(open(path, "rb").read()).replace(b"same", b"sane")
    open(path, "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, at).count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    got, want = queries.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(queries.oracle_sql()[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(str(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())
