"""Deterministic sharded WARC writer and its reader.

Records are range-sorted into shards, each shard rolls its files by compressed
size, headers and digests are made anew, and a file appears under its name only
when it is complete; the manifest lists what was committed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh_dir, stored

#: Keys drawn by hash to cut the range of keys into shards, and shards at most: they
#: bound what the driver holds and the plan carries.
SAMPLE, MOST_SHARDS = 65_536, 16_384
#: Copies of a digest's winner, over which a hot payload's rows are dealt.
SALTS = 32
#: The capture's date is an input, not the clock: the same rows give the same files.
DATE = "2024-01-01T00:00:00Z"
_LEAST = -(1 << 63)


def _fs(uri: str):
    """File system and path of a URI; Hadoop writes file:/x for file:///x."""
    if "://" not in uri:
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def _clean(url: str | None) -> str:
    """A URL that may stand in a header; one that had to change goes into X-Page-URL."""
    return (url or "urn:x-page:none").replace("\r", "%0D").replace("\n", "%0A")


def _cuts(keys: DataFrame, shard_bytes: int) -> list[tuple[int, int, int, int]]:
    """Ascending (page, digest, shard, parts): from that key on rows go to ``shard``;
    a key of more bytes than a shard has a range of ``parts`` shards to itself.

    Quantiles of the bytes of keys (page, digest, bytes), estimated from SAMPLE keys
    of least hash and all keys of a quarter of a shard or more (of which there are
    at most four a shard).  A pure function of the rows.
    """
    by_key = keys.groupBy("page", "d").agg(F.sum("bytes").alias("bytes"))
    about = by_key.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    size = max(shard_bytes, -(-(about["bytes"] or 0) // MOST_SHARDS))
    heavy = F.col("bytes") >= size // 4
    large = by_key.where(heavy).collect()  # at most 4 * MOST_SHARDS
    light = by_key.where(~heavy).orderBy(F.xxhash64("page", "d"), "page", "d").limit(SAMPLE).collect()
    rest = (about["bytes"] or 0) - sum(r["bytes"] for r in large)
    scale = rest / max(1, sum(r["bytes"] for r in light))
    out, shard, filled = [(_LEAST, _LEAST, 0, 1)], 0, 0
    for page, d, n in sorted([(r["page"], r["d"], r["bytes"]) for r in large] + [(r["page"], r["d"], r["bytes"] * scale) for r in light]):
        if filled and filled + n > size:
            shard, filled = shard + 1, 0
            out.append((page, d, shard, 1))
        filled += n
        if n > size:
            parts = int(-(-n // size))
            out[-1] = (page, d, shard, parts) if out[-1][:2] == (page, d) else out[-1]
            if out[-1][:2] != (page, d):
                out.append((page, d, shard, parts))
            shard, filled = shard + parts, 0
            out.append((page, d + 1, shard, 1))
    return out


def _shards(cuts: list[tuple[int, int, int, int]]):
    """Column (shard, parts) of the last cut up to the key (page, d): binary search in
    an array that is a constant of the plan."""
    kind = "array<struct<page: long, d: long, shard: int, parts: int>>"
    table = F.from_json(F.lit(json.dumps([dict(zip(("page", "d", "shard", "parts"), c)) for c in cuts])), kind)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    at = lambda i: F.get(table, i)

    def step(low, n):
        cut = at(low + n)
        reached = (cut["page"] < F.col("page")) | ((cut["page"] == F.col("page")) & (cut["d"] <= F.col("d")))
        return F.when(F.coalesce(reached, F.lit(False)), low + n).otherwise(low)

    return at(F.aggregate(steps, F.lit(0), step))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key by which they are sorted into shards: page (null least) and
    the first 63 bits of the digest."""
    d = F.conv(F.substring(F.hex("digest"), 1, 16), 16, 10).cast("decimal(20,0)")
    return rows.withColumns({"page": F.coalesce("page_id", F.lit(_LEAST)), "d": F.floor(d / 2).cast("long")})


def revisits(keys: DataFrame) -> DataFrame:
    """(page_id, digest, winner) of rows (page_id, digest) that revisit an equal payload."""
    rows = keys.select("page_id", "digest")
    won = rows.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    won = won.select("digest", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(won, ["digest", "salt"]).where("page_id is null or page_id < winner").select("page_id", "digest", "winner")


def write_archives(pages: DataFrame, out: str | None = None, least: int = 0, roll_bytes: int = 8 << 20, shard_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> str:
    """Write a WARC record for each row under ``out`` (a folder that all machines
    share; by default a new one in spark.checkpoint.dir) and return the folder.

    Of equal payloads of at least ``least`` bytes the one with the largest
    page_id is a response, rows with a smaller or null id revisit it; if all ids
    are null all are responses; repeated rows of the winning id are all
    responses.  A null html is an empty payload.  Records are ordered by
    page_id (null first), digest and url over the shards and in them; a shard is a
    range of (page_id, digest) of about ``shard_bytes``, and a pair that has more
    (repeated rows) is dealt over several.  No file starts a new record beyond
    ``roll_bytes`` compressed.  A URL reads back as it was: null, empty ones and
    those with line ends go into a header of their own.  An empty table gives a
    manifest without files.  html is shuffled once.
    """
    spark = pages.sparkSession
    out = out or fresh_dir(spark, "warc")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("html"))
    digest = F.unhex(F.sha1("html")).alias("digest")
    keys = stored(_keyed(pages.select("page_id", digest, F.octet_length("html").cast("long").alias("n"))).withColumn("bytes", F.col("n") + 500), "warc-keys")
    cuts = _cuts(keys, shard_bytes)
    cut = _shards(cuts).alias("cut")
    # copies of one key are alike, so the order they are read in may deal them
    base = _keyed(pages.select("page_id", digest, "url", "html")).select(cut, "page_id", "digest", "url", "html", F.monotonically_increasing_id().alias("nth"))
    base = base.select((F.col("cut.shard") + F.pmod("nth", "cut.parts")).cast("int").alias("shard"), "page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("winner"))
    refs = _keyed(revisits(keys.where(F.col("n") >= least))).select(cut, "page_id", "digest", "winner")
    refs = refs.select(F.explode(F.sequence(F.col("cut.shard"), F.col("cut.shard") + F.col("cut.parts") - 1)).alias("shard"), "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "winner")  # go before their page
    n = cuts[-1][2] + cuts[-1][3]
    rows = base.unionByName(refs).repartitionById(n, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    rows.mapInArrow(_writer(out, roll_bytes, date), "shard int, file string, records long, bytes long, sha256 string").write.parquet(f"{out}/manifest")
    dropped(keys)
    return out


def _writer(out: str, roll_bytes: int, date: str):
    class Shard:
        """The open file of a shard; ``done`` lists what is committed."""

        def __init__(self, shard: int):
            self.shard, self.n, self.done, self.sink = shard, 0, [], None
            self.fs, self.root = _fs(out)
            self.fs.create_dir(self.root, recursive=True)

        def add(self, data: bytes) -> None:
            if self.sink is None:
                self.name = f"shard-{self.shard:06d}-{self.n:05d}.warc.gz"
                self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
                self.sink, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
                info = f"software: disclosa\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
                self._put(record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
            self._put(data)
            self.records += 1
            if self.size >= roll_bytes:
                self.close()

        def _put(self, data: bytes) -> None:
            self.sink.write(data)
            self.sha.update(data)
            self.size += len(data)

        def close(self) -> None:
            if self.sink is not None:
                self.sink.close()
                self.fs.move(self.temp, f"{self.root}/{self.name}")  # another attempt wrote the same bytes
                self.done.append((self.shard, self.name, self.records, self.size, self.sha.hexdigest()))
                self.n, self.sink = self.n + 1, None

    def run(batches):
        at, ref, done = None, None, []
        for batch in batches:
            for shard, page, digest, kind, url, html, winner in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    ref = page, digest, winner
                    continue
                if at is None or at.shard != shard:
                    if at:
                        at.close()
                        done += at.done
                    at = Shard(shard)
                if hashlib.sha1(html).digest() != digest:
                    raise ValueError(f"page {page}: its payload and digest differ")
                b32 = base32(digest)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
                head = [("WARC-Record-ID", record_id(page, b32)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{b32}")]
                if _clean(url) != url:
                    head.append(("X-Page-URL", json.dumps(url)))
                if revisit := ref is not None and ref[:2] == (page, digest):
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(ref[2], b32))]
                block = http if revisit else http + html
                head.append(("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"))
                at.add(record("revisit" if revisit else "response", head, block))
        if at:
            at.close()
            done += at.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "file", "records", "bytes", "sha256"])

    return run


def parse(stream):
    """(headers, block) of each record of a gzip stream, one at a time."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not the start of a record: {line[:40]!r}")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                head[k] = v
            block = f.read(int(head["Content-Length"]))
            if len(block) != int(head["Content-Length"]) or f.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield head, block


def read_archives(spark, out: str, keep_html: bool = True) -> DataFrame:
    """The records of the committed files: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and html (null for revisits).

    Digests are recomputed; a difference is an error.  Files are dealt one by
    one to tasks, which read them as streams.
    """
    files = spark.read.parquet(f"{out}/manifest").select("file")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("html", pa.string())] * keep_html
    page = lambda urn: (lambda x: int(x) if x else None)(urn[12:].split(":")[0])

    def run(batches):
        fs, root = _fs(out)
        rows, size = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as stream:
                    for head, block in parse(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        if head["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
                            raise ValueError(f"{name}: block digest of {head['WARC-Record-ID']}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"][5:]
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and (n != len(payload) or base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{name}: payload digest of {head['WARC-Record-ID']}")
                        url = json.loads(head["X-Page-URL"]) if "X-Page-URL" in head else head["WARC-Target-URI"]
                        row = page(head["WARC-Record-ID"]), url, n, digest, head["WARC-Type"], page(head["WARC-Refers-To"]) if revisit else None
                        rows.append((*row, None if revisit else payload.decode()) if keep_html else row)
                        size += len(payload) * keep_html + 200
                        if size > 4 << 20:
                            yield give()
                            rows, size = [], 0
        if rows:
            yield give()

    names = {"int64": "long", "string": "string"}
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000))
    return files.repartition(n, "file").mapInArrow(run, ", ".join(f"{k} {names[str(t)]}" for k, t in fields))
