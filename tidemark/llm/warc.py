"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by (id, payload digest) and cut into shards where the running size of their payloads passes a multiple of the
shard's size. Both depend on the rows alone, not on how Spark holds them, so equal tables give equal files, byte for byte. A task
writes the records of a shard in order, one gzip member each, with headers and digests made anew, and begins a new file when
the compressed bytes reach a limit. Files are written under temporary names and renamed when whole; a repeated or second
attempt of a task gives the same bytes, so it may rename over them. The list of files is a manifest, which is itself renamed into place
last: an archive without a manifest isn't committed, and files that it doesn't name are not read.

Files are opened through Arrow's file systems, so the folder may be in any store that these and all executors reach.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import parted, pieces, prepare, stored

#: Payload bytes of a shard and shards at most; a shard grows with the table beyond these.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 10_000
#: Compressed bytes at which a file is closed, and gzip's level.
ROLL_BYTES, LEVEL = 4 << 20, 4
#: What a record's headers are taken to weigh when shards are cut.
HEADER_BYTES = 700
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, bytes long, records long, sha256 string"
SORTED = ["shard", "none", "id", "digest", "url"]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def target(url: str | None, key: int | None) -> str:
    """The URI of a record: the page's, with characters that a header can't hold percent-encoded."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{key}"


def record_id(key: int | None, url: str | None, digest: bytes, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key}|{url}|{digest.hex()}|{copy}'.encode()).digest()[:16], version=5)}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as one gzip member, without a time."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", len(block))])
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


class Archive:
    """The files of one task, each under a temporary name until it is whole."""

    def __init__(self, path: str, roll: int) -> None:
        self.store, self.path = opened(path)
        self.roll, self.shard, self.part, self.out = roll, -1, 0, None

    def write(self, shard: int, data: bytes) -> Iterator[tuple]:
        """Appends a record; yields the manifest's row of a file that this closes."""
        if self.out and (shard != self.shard or self.size >= self.roll):
            yield self.close()
        if not self.out:
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"pages-{shard:05d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self._put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(shard, self.name, b"", self.part)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        final = f"{self.path}/{self.name}"
        if self.store.get_file_info(final).type != fs.FileType.NotFound:
            self.store.delete_file(final)
        self.store.move(self.temporary, final)
        return self.shard, self.name, self.size, self.records, self.sha.hexdigest()


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    return rows.select(F.col("id").isNull().alias("none"), "id", "url", F.octet_length("html").cast("long").alias("bytes"), F.unhex(F.sha1("html")).alias("digest"), "html")


def cuts(rows: DataFrame, shard_bytes: int) -> list[tuple]:
    """The least (none, id, digest) of each shard, at most about MOST_SHARDS."""
    order = ["none", "id", "digest"]
    sizes = rows.select(*order, (F.col("bytes") + HEADER_BYTES).alias("cost"))
    held = stored(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "warc-order").withColumn("part", F.shiftright("at", 33))
    before, total = {}, 0
    for part, cost in sorted(held.groupBy("part").agg(F.sum("cost")).collect()):
        before[part], total = total, total + cost
    if not total:
        return []
    offsets = held.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    running = F.sum("cost").over(Window.partitionBy("part").orderBy("at")) - F.col("cost") + F.col("before")
    shard = F.floor(running / F.lit(max(shard_bytes, -(-total // MOST_SHARDS)))).alias("shard")
    firsts = held.join(F.broadcast(offsets), "part").select(shard, *order).groupBy("shard").agg(F.min(F.struct(*order)).alias("first"))
    return sorted((r["none"], -1 if r["id"] is None else r["id"], bytes(r["digest"])) for (r,) in firsts.select("first").collect())


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row into the folder, which must be new, and returns the manifest.

    Of rows with equal payloads of least_bytes or more that with the smallest id is a response and the others are revisits of
    it, without payload; ids that are null come last, equal ids are told apart by url, and of wholly equal rows
    the first written is the response. A null payload is empty, a null url becomes urn:page:<id>. Other columns are not read. An
    empty table gives a manifest without files. A long payload is held by the task that writes it.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = _rows(pages, id_col, url_col, html_col)
    store, root = opened(path)
    store.create_dir(f"{root}/_temporary")
    order = F.struct("none", "id", F.coalesce("url", F.lit("")).alias("u"))
    same = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(F.struct(order.alias("o"), F.col("url").alias("url"))).alias("f"), F.count(F.lit(1)).alias("n"))
    twins = stored(same.where("n > 1").select("digest", F.col("f.o.id").alias("f_id"), F.col("f.url").alias("f_url"), "n"), "warc-twins")
    firsts = cuts(rows, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(none: pd.Series, ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(firsts, (n, -1 if n else int(i), bytes(d))) - 1 for n, i, d in zip(none, ids, digests, strict=True)], dtype="int32")

    plain = [F.lit(False).alias("twin"), F.lit(None).cast("long").alias("f_id"), F.lit(None).cast("string").alias("f_url")]
    may, rest = parted(rows, twins, ["digest"])
    # Digests of over a thousandth of all rows are fewer than 1,000; their rows stay where they are.
    large = F.col("n") * 1000 > twins.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = ["digest", F.struct("f_id", "f_url").alias("f")]
    near = may.join(F.broadcast(twins.where(large).select(*kept)), "digest", "left")
    far = near.where("f is null").drop("f").join(twins.where(~large).select(*kept).hint("merge"), "digest", "left")
    marked = near.where("f is not null").unionByName(far).select(*rows.columns, F.col("f").isNotNull().alias("twin"), "f.f_id", "f.f_url").unionByName(rest.select(*rows.columns, *plain))
    first = F.col("id").eqNullSafe(F.col("f_id")) & F.col("url").eqNullSafe(F.col("f_url"))
    marked = marked.withColumn("html", F.when(~F.col("twin") | first, F.col("html"))).withColumn("shard", shard_of("none", F.coalesce("id", F.lit(-1)), "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, last, copy, done = Archive(path, roll_bytes), None, 0, []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "id", "url", "bytes", "digest", "html", "twin", "f_id", "f_url")]
            for k in range(batch.num_rows):
                shard, key, url, size, digest, html, twin, f_id, f_url = (c[k].as_py() for c in cols)
                now = (key, url, digest)
                last, copy = now, copy + 1 if now == last else 0
                revisit = html is None or (twin and copy > 0)
                payload = b"" if revisit else html.encode()
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key, url, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", target(url, key)), ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
                    ("Content-Type", "application/http;msgtype=response"), ("Page-Id", "" if key is None else key), ("Payload-Length", size),
                ]
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f_id, f_url, digest, 0)), ("WARC-Refers-To-Target-URI", target(f_url, f_id)), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Id", "" if f_id is None else f_id)]
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
                done += archive.write(shard, record(fields, block))
        if archive.out:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    n = max(1, len(firsts))
    sent = marked.select("shard", "none", "id", "url", "bytes", "digest", "html", "twin", "f_id", "f_url").repartitionById(n, F.col("shard")).sortWithinPartitions(*SORTED)
    sent.mapInArrow(run, MANIFEST).write.parquet(f"{path}/_temporary/manifest")
    store.move(f"{root}/_temporary/manifest", f"{root}/manifest")
    store.delete_dir(f"{root}/_temporary")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, file, bytes, records, sha256 of the files of a committed archive."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def records(source: pa.NativeFile, sha: hashlib._Hash | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member, read in chunks."""
    gunzip, held = zlib.decompressobj(31), []
    while data := source.read(CHUNK):
        if sha:
            sha.update(data)
        while data:
            held.append(gunzip.decompress(data))
            data = gunzip.unused_data
            if gunzip.eof:
                head, _, rest = b"".join(held).partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                if not rest.endswith(b"\r\n\r\n") or len(rest) != int(fields["Content-Length"]) + 4:
                    raise ValueError(f"record {fields.get('WARC-Record-ID')} has a wrong length")
                yield fields, rest[:-4]
                gunzip, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("the file ends inside a record")


def read(spark: SparkSession, path: str, html: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and html: the payload, null for revisits) of all records.

    Every record's digests are taken from its bytes and held against its headers, and each file's against the manifest; a difference
    is an error. One task reads one file or more, a chunk at a time.
    """
    prepare(spark)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * html
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: len(names)]

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def row(fields: dict[str, str], block: bytes) -> tuple:
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Payload-Length"])
        if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
            raise ValueError(f"record {fields['WARC-Record-ID']}: its block has another digest")
        if fields["WARC-Type"] == "response":
            digest, size = base32(hashlib.sha1(payload).digest()), len(payload)
            if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                raise ValueError(f"record {fields['WARC-Record-ID']}: its payload has another digest")
        out = (number(fields["Page-Id"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number(fields.get("Refers-To-Page-Id")))
        return (*out, payload.decode() if fields["WARC-Type"] == "response" else None) if html else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        for batch in batches:
            for name, want in zip(batch["file"].to_pylist(), batch["sha256"].to_pylist(), strict=True):
                out, held, sha = [], 0, hashlib.sha256()
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for fields, block in records(source, sha):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        out.append(row(fields, block))
                        held += len(block) if html else 100
                        if held > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out, held = [], 0
                if sha.hexdigest() != want:
                    raise ValueError(f"{name} isn't the file of the manifest")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = manifest(spark, path)
    return files.repartition(min(pieces(files.count(), 1), MOST_SHARDS), "file").mapInArrow(run, schema)
