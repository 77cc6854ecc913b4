"""WARC archives as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans one partition a file (small files together, up to `split_bytes`); a gzip member cannot be found
safely inside a file, so files are not cut, and the writer starts a new one every `file_bytes`. Equality, IN and
prefix predicates on the type, id, URI, digest and other header columns are pushed down: a record's headers are parsed first, and
the payload of a record that fails them, or of any record under option payload=none, is neither inflated nor copied. Records that the
writer compresses carry their lengths in the gzip extra field `sl`, so that they are skipped by a seek;
members without it are inflated in steps and their bytes dropped.

Tasks write under names of their own and the driver moves only what committed tasks report, so that lost or repeated
tasks leave nothing behind.

`archive` lays out pages as records. Of records with equal payloads of at least `min_bytes` bytes the one with the smallest id is
a response, and others are revisits of it. Payloads are equal if their SHA-1 digest and length are.

Defined results: a null payload is an empty one; among equal payloads a null id sorts last, and rows that share the smallest id are all
responses; repeated rows make as many records; an empty table makes an empty folder that reads as no rows; other columns of the pages,
whatever their names, are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from tidemark.shared import fresh
from tidemark.shipping import ship

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, content_type string, content_length long, payload_digest string, refers_to string, payload_length long, digest_ok boolean, headers map<string,string>, payload binary, file string, offset long"
#: Columns that a predicate can be pushed to, and the header each is.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.string()), ("payload_length", pa.int64()), ("digest_ok", pa.bool_()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(uri[5:]).replace("//", "/", 1) if uri.startswith("file://") else unquote(uri[5:])
    if "://" in uri:
        return pafs.FileSystem.from_uri(quote(uri, safe=":/%@?&="))
    return pafs.LocalFileSystem(), uri


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def member(block: bytes, level: int) -> bytes:
    """A gzip member whose extra field sl holds the lengths of its compressed and plain data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(block) + packer.flush()
    if len(body) < 1 << 32 and len(block) < 1 << 32:
        extra = struct.pack("<HBBHII", 12, ord("s"), ord("l"), 8, len(body), len(block))
    else:
        extra = struct.pack("<H", 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A response, or a revisit without its payload, around the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_one_line(row.get('content_type') or 'text/html; charset=utf-8')}\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    lines = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_one_line(row['record_id'])}", f"WARC-Date: {_one_line(row['warc_date'])}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_one_line(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: {_one_line(row['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated: length"]
    block = http if revisit else http + row["payload"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.file_bytes = int(options.get("level", 1)), int(options.get("file_bytes", 64 << 20))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.path)
        fs.create_dir(f"{path}/_temporary-{self.job}", recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                names_in = batch.schema.names
                for i in range(batch.num_rows):
                    row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names_in)}
                    row["payload"] = row.get("payload") or b""
                    data = member(record(row), self.level)
                    if out is None or size + len(data) > self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{path}/_temporary-{self.job}/{names[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(path)):
                if info.base_name.endswith((".warc", ".warc.gz")):
                    fs.delete_file(info.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{path}/_temporary-{self.job}/{name}", f"{path}/{name}")
        self._clean(fs, path)
        fs.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        self._clean(*filesystem(self.path))

    def _clean(self, fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(f"{path}/_temporary-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_temporary-{self.job}")


@dataclass
class Files(InputPartition):
    paths: list


class _Source:
    """Bytes of a file from a place on, plain or from gzip members one record at a time."""

    def __init__(self, f):
        self.f = f
        self.gz = f.peek(2)[:2] == b"\x1f\x8b"

    def next(self) -> tuple[bytes, callable, int] | None:
        """(start of the record with its headers whole, the rest's reader, offset); None at the end."""
        at = self.f.tell()
        if not self.gz:
            head = bytearray()
            while not head.endswith(b"\r\n\r\n"):
                line = self.f.readline()
                if not line:
                    if head.strip():
                        raise ValueError(f"record at {at} ends in its headers")
                    return None
                if head or line.strip():
                    head += line
            return bytes(head), None, at
        fixed = self.f.read(10)
        if not fixed:
            return None
        if len(fixed) < 10 or fixed[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {at}")
        length, flags = None, fixed[3]
        if flags & 4:
            extra = self.f.read(struct.unpack("<H", self.f.read(2))[0])
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size == 8:
                    length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        for flag in (8, 16):
            if flags & flag:
                while self.f.read(1) not in (b"\0", b""):
                    pass
        if flags & 2:
            self.f.read(2)
        start, unpack = self.f.tell(), zlib.decompressobj(-15)
        head = bytearray()
        while b"\r\n\r\n" not in head and not unpack.eof:
            more = unpack.unconsumed_tail or self.f.read(min(4096, length - (self.f.tell() - start)) if length is not None else 4096)
            made = unpack.decompress(more, 4096)
            if not more and not made and not unpack.eof:
                raise ValueError(f"member at {at} is cut off")
            head += made

        def rest(wanted: bool) -> bytes:
            """What follows head, if wanted; leaves the file behind the member."""
            if not wanted and length is not None:
                self.f.seek(start + length + 8)
                return b""
            out = []
            while not unpack.eof:
                fed = unpack.unconsumed_tail or self.f.read(min(1 << 16, length - (self.f.tell() - start)) if length is not None else 1 << 16)
                made = unpack.decompress(fed, 1 << 20)
                if not fed and not made and not unpack.eof:
                    raise ValueError(f"member at {at} is cut off")
                if wanted:
                    out.append(made)
            if length is not None:
                self.f.seek(start + length + 8)
            else:
                self.f.seek(self.f.tell() - len(unpack.unused_data) + 8)
            return b"".join(out)

        return bytes(head), rest, at


def headers_of(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that starts with white space continues the one before."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("a record doesn't begin with its version")
    out, last = {}, ""
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _bare(digest_: str) -> str:
    """A digest without the name of its algorithm."""
    return digest_.split(":", 1)[-1].upper()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.want = options["path"], options.get("payload", "bytes") != "none"
        self.split_bytes, self.tests = int(options.get("split_bytes", 64 << 20)), []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER and isinstance(f, (EqualTo, In, StringStartsWith)):
                values = tuple(f.value) if isinstance(f, In) else (f.value,)
                self.tests.append((HEADER[column], "prefix" if isinstance(f, StringStartsWith) else "in", values))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else sorted((x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)
        groups, size = [], self.split_bytes
        for x in found:
            if size + x.size > self.split_bytes or not groups:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [Files(g) for g in groups] or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, values in self.tests:
            value = headers.get(name)
            if value is not None and name == "warc-payload-digest":
                value = _bare(value)
            if value is None or not (value.startswith(values[0]) if kind == "prefix" else value in values):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with io.BufferedReader(fs.open_input_file(path), 1 << 18) as f:
                source = _Source(f)
                while (item := source.next()) is not None:
                    head, rest, at = item
                    cut = head.index(b"\r\n\r\n") + 4
                    headers = headers_of(head[:cut])
                    length = int(headers.get("content-length", 0))
                    ok = self._wanted(headers)
                    http = headers.get("content-type", "").startswith("application/http")
                    whole = ok and (self.want or (http and len(head) < cut + length and b"\r\n\r\n" not in head[cut:]))
                    if rest is None:
                        block = f.read(length) if whole else b""
                        if not whole:
                            block = f.read(min(length, 4096)) if ok and http else b""
                            f.seek(length - len(block), 1)
                        f.seek(4, 1)
                    else:
                        block = (head[cut:] + rest(whole))[:length]
                    if not ok:
                        continue
                    rows.append(self._row(headers, block, length, http, path, at))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _row(self, headers: dict, block: bytes, length: int, http: bool, path: str, at: int) -> dict:
        size, payload = length, block
        if http and (cut := block.find(b"\r\n\r\n")) >= 0:
            payload, size = block[cut + 4 :], length - cut - 4
            for line in block[:cut].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    size = int(value)
        named = headers.get("warc-payload-digest")
        bare = _bare(named) if named else None
        full = self.want and headers.get("warc-type") != "revisit"
        return {c: headers.get(h) for c, h in HEADER.items()} | {
            "content_length": length, "payload_digest": bare, "payload_length": size, "digest_ok": bare == digest(payload) if full and bare and (named.lower().startswith("sha1:") or ":" not in named) else None,
            "headers": list(headers.items()), "payload": payload if full else None, "file": path, "offset": at,
        }


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let predicates reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0, file_bytes: int = 64 << 20) -> None:
    """Write one record a page; equal payloads of at least min_bytes are written once."""
    register(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "payload_length": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("payload_length") >= min_bytes).groupBy("sha", "payload_length").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    known = rows.join(groups, ["sha", "payload_length"], "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    laid = known.select(
        urn(F.col("key")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("warc_date"),
        base32("sha").alias("payload_digest"), F.when(again, urn(F.col("first"))).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )
    laid.write.format("warc").mode("append").option("path", path).option("file_bytes", str(file_bytes)).save()


def base32(sha: str):
    """Upper-case base32 of the 20 bytes of a digest: four characters for each five hex digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    five = lambda k: F.conv(F.substring(F.hex(sha), 5 * k + 1, 5), 16, 10).cast("int")
    return F.concat(*(letters.substr(F.shiftright(five(k), s).bitwiseAND(31) + 1, F.lit(1)) for k in range(8) for s in (15, 10, 5, 0)))


def query(spark, sf_dir: str) -> DataFrame:
    path = fresh(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = spark.read.format("warc").load(path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:record:(-?[0-9]+)>$', 1) as bigint)")
    return rows.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (
  select page_id, strlen(html) as payload_bytes, html, array_to_string(list_transform(range(0, 8), lambda k:
    array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(sha1(html), cast(5 * k + 1 as int), 5) as int) >> cast(s as int)) & 31 as int) + 1, 1)), '')), '') as payload_digest
  from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id = min(page_id) over (partition by html) then 'response' else 'revisit' end as record_type,
  case when page_id = min(page_id) over (partition by html) then null else min(page_id) over (partition by html) end as refers_to
from d
"""
