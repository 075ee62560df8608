"""WARC archives as a Spark data source, and pages written to them with repeated payloads as revisits.

Written files are gzip members, one a record, whose header has the extra field ``sl``: the member's compressed and plain
size. A reader plans one task a file, inflates a record only as far as its WARC and HTTP headers, and inflates the rest
only if the payload is asked for and no pushed predicate on record type or other headers rules the record out; otherwise it jumps to
the next member. Members without that field, and plain ``.warc`` files, are read as well; plain records are skipped by their
length, members of unknown size are inflated to their end in small steps.

Files are opened with ``pyarrow.fs`` by URI, so archives may lie in any store it knows. Tasks write under names of their
own, and the driver moves finished files into place, so a repeated task leaves nothing behind that is read.

Cases of ``archive``: a NULL payload is empty; a NULL address leaves the header out, line ends in an address are percent-encoded. Of
equal payloads the record of the largest key is the response, and so is every row that repeats that key; a NULL key is never
the largest, unless there is no other. Rows that are the same are written as often as they came. Extra columns are not
written. Payloads of any length are written whole. An empty table gives an archive that is read as empty.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull,
    WriterCommitMessage,
)

#: Compressed bytes after which a task starts another file.
FILE_BYTES = 64 << 20
SCHEMA = (
    "warc_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
_HEADERS = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that tells its own size in the extra field ``sl``."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(
    kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None
) -> bytes:
    """One WARC record around an HTTP response; a revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{refers_to}>")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace")
    return head + block + b"\r\n\r\n"


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.aside = f"_temporary-{uuid.uuid4().hex}"  # this write's own, so that writers do not meet

    def write(self, iterator):
        fs, root = _open(self.path)
        names, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        fs.create_dir(f"{root}/{self.aside}", recursive=True)
                        out = fs.open_output_stream(f"{root}/{self.aside}/{names[-1]}", compression=None)
                    payload = row["payload"] or b""
                    digest = row["payload_digest"] or base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    made = (row["warc_type"], row["record_id"], row["target_uri"], row["date"], payload, digest, row["refers_to"])
                    out.write(member(record(*made)))
                    if out.tell() >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Files(names)

    def commit(self, messages):
        from pyarrow import fs as pafs

        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.is_file and old.base_name.endswith((".warc", ".warc.gz")):
                    fs.delete_file(old.path)
        for name in [n for m in messages if m for n in m.names]:
            fs.move(f"{root}/{self.aside}/{name}", f"{root}/part-{name}")
        self.abort([])

    def abort(self, messages):
        from pyarrow import fs as pafs

        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{self.aside}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.aside}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify = path.rstrip("/"), payload, verify
        self.tests: list[tuple[str, frozenset | None, bool]] = []

    def pushFilters(self, filters):
        """Predicates on headers are held against each record before its payload; Spark evaluates all once more."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, frozenset([f.value]), False))
            elif name in _HEADERS and isinstance(f, In):
                self.tests.append((name, frozenset(f.value), False))
            elif name in _HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, None, False))
            elif name in _HEADERS and isinstance(f, IsNull):
                self.tests.append((name, None, True))
            yield f

    def wanted(self, row: dict) -> bool:
        for name, values, null in self.tests:
            value = row[name]
            if null != (value is None) if values is None else value not in values:
                return False
        return True

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else []
        names = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and "/_temporary-" not in x.path)
        return [Part(self.path if info.is_file else self.path + n[len(root.rstrip("/")) :]) for n in names]

    def read(self, partition):
        if getattr(partition, "path", None) is None:  # there is no file at all
            return
        fs, path = _open(partition.path)
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        held: list[dict] = []
        size = 0
        with fs.open_input_file(path) as file:
            for row in self.records(file, path.endswith(".gz")):
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], k) for c, k in zip(columns, kinds)], columns)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], k) for c, k in zip(columns, kinds)], columns)

    def records(self, file, zipped: bool):
        at, end = 0, file.size()
        while at < end:
            source = _Member(file, at) if zipped else _Plain(file, at)
            head = source.upto(b"\r\n\r\n")
            if not head.strip():
                break
            fields = _fields(head)
            block = int(fields.get("content-length", 0))
            if not zipped:
                source.bounded(len(head) + block)
            row = {c: fields.get(h) for c, h in _HEADERS.items()} | {"payload_bytes": None, "payload": None}
            for c in ("record_id", "refers_to"):
                row[c] = row[c].strip("<>") if row[c] else row[c]
            if self.wanted(row):
                http = b""
                if "application/http" in fields.get("content-type", ""):
                    http = source.upto(b"\r\n\r\n", block)
                    length = _fields(http).get("content-length")
                    row["payload_bytes"] = int(length) if length and length.isdigit() else block - len(http)
                else:
                    row["payload_bytes"] = block
                if row["warc_type"] != "revisit" and self.payload:
                    row["payload"] = source.take(block - len(http))
                    self.verified(row, source)
                yield row
            at = source.end(block, len(head))

    def verified(self, row: dict, source) -> None:
        said = row["payload_digest"] or ""
        if self.verify and said.startswith("sha1:"):
            if base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != said[5:]:
                raise ValueError(f"payload of {row['record_id']} differs from its digest")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v or k}


class _Plain:
    """The bytes of one plain record, read as far as needed."""

    def __init__(self, file, at: int):
        self.file, self.at, self.next, self.left, self.ready = file, at, at, None, b""

    def more(self, n: int) -> bytes:
        self.file.seek(self.next)
        got = self.file.read(n if self.left is None else min(n, max(0, self.left - (self.next - self.at))))
        self.next += len(got)
        return got

    def bounded(self, size: int) -> None:
        self.left = size
        over = self.next - self.at - size
        if over > 0:
            self.ready = self.ready[: len(self.ready) - over]

    def upto(self, mark: bytes, most: int | None = None) -> bytes:
        """Through the first ``mark``; all there is without one."""
        while mark not in self.ready:
            if most is not None and len(self.ready) >= most or not (got := self.more(2048)):
                break
            self.ready += got
        cut = self.ready.find(mark) + len(mark) if mark in self.ready else len(self.ready) if most is None else min(most, len(self.ready))
        got, self.ready = self.ready[:cut], self.ready[cut:]
        return got

    def take(self, n: int) -> bytes:
        parts, size = [self.ready], len(self.ready)
        while size < n and (got := self.more(1 << 20)):
            parts.append(got)
            size += len(got)
        data = b"".join(parts)
        self.ready = data[n:]
        return data[:n]

    def end(self, block: int, head: int) -> int:
        return self.at + head + block + 4


class _Member(_Plain):
    """The bytes of one gzip member, inflated as far as needed."""

    def __init__(self, file, at: int):
        super().__init__(file, at)
        self.inflate = zlib.decompressobj(31)
        file.seek(at)
        start = file.read(24)
        self.size = None
        if len(start) == 24 and start[3] & 4 and start[12:14] == b"sl":
            self.size = struct.unpack("<I", start[16:20])[0]

    def more(self, n: int) -> bytes:
        while not self.inflate.eof:
            if not self.inflate.unconsumed_tail:
                self.file.seek(self.next)
                got = self.file.read(1 << 16 if self.size is None else max(0, min(1 << 16, self.at + self.size - self.next)))
                if not got:
                    return b""
                self.next += len(got)
            else:
                got = self.inflate.unconsumed_tail
            if out := self.inflate.decompress(got, n):
                return out
        return b""

    def bounded(self, size: int) -> None:
        pass

    def end(self, block: int, head: int) -> int:
        if self.size is not None:
            return self.at + self.size
        while self.more(1 << 16):
            pass
        return self.next - len(self.inflate.unused_data)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload`` (false: headers only) and ``verify`` digests."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        flag = {k: self.options.get(k, d).lower() == "true" for k, d in (("payload", "true"), ("verify", "false"))}
        return WarcReader(self.options["path"], flag["payload"], flag["verify"])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32(hex_text: Column | str) -> Column:
    """RFC 4648 base 32, upper case, of 40 hexadecimal digits: five of them are four characters."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        value = F.conv(F.substring(hex_text, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(digits), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record a row; a row whose payload a row of a larger key has as well becomes a revisit of that row."""
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    latest = rows.groupBy("digest").agg(F.max("key").alias("latest"), F.count("*").alias("n")).where("n > 1")
    # Narrow rows meet first; payloads are joined by key, where no key is hot.
    older = (
        rows.select("key", "digest").join(latest, "digest").where(~F.col("key").eqNullSafe(F.col("latest")) & F.col("latest").isNotNull())
        .select("key", "digest", "latest").distinct()
    )
    a, b = rows.alias("a"), older.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.digest") == F.col("b.digest")), "left")

    def named(c: str) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))

    joined.select(
        F.when(F.col("b.latest").isNull(), "response").otherwise("revisit").alias("warc_type"),
        named("a.key").alias("record_id"), "target_uri", F.lit(date).alias("date"),
        base32(F.hex("a.digest")).alias("payload_digest"),
        F.when(F.col("b.latest").isNotNull(), named("b.latest")).alias("refers_to"),
        F.lit(None).cast("long").alias("payload_bytes"), "payload",
    ).write.format("warc").mode("append").save(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: responses are decoded whole and held against their digests, revisits by their headers alone."""
    register(spark)
    source = spark.read.format("warc").option("path", path)
    responses = source.option("verify", "true").load().where("warc_type = 'response'").withColumn("payload_bytes", F.length("payload").cast("long"))
    revisits = source.option("payload", "false").load().where("warc_type = 'revisit'")

    def number(c: str) -> Column:
        return F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")

    return responses.drop("payload").union(revisits.drop("payload")).select(
        number("record_id").alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


def report(pages: DataFrame, path: str) -> DataFrame:
    """The registered query: all pages to archives below ``path``, and what is read back."""
    archive(pages, path)
    return inventory(pages.sparkSession, path)


#: The same for DuckDB.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, max(page_id) AS latest FROM p GROUP BY hex)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(p.hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1), '' ORDER BY i)
   FROM range(0, 32) r(i)) AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM p JOIN m USING (hex)
"""
