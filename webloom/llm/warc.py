"""WARC archives: pages to records of one gzip member each, and a sequential reader of such archives.

Writing: pages whose payloads are equal are one group; the page with the smallest id is a response record, the others
are revisit records that refer to it. A block is an HTTP header, whose Content-Length is that of the whole payload, and
the payload, which a revisit leaves out. A record longer than `longest` bytes is cut into segments. Spark's text writer
puts the members into files, each its own task's and committed as Spark's outputs are: a member's last byte, the
highest of the length that gzip notes, is zero as a member holds less than 16 MB, and so serves as the line end.

Reading: an archive is a stream of compressed bytes that an incremental decompressor takes in small pieces. At each
member the header is read up to its empty line, and Content-Length frames the block; block and payload digests are
computed as the bytes go by and compared with those stated. Nothing of a payload is held unless it is asked for.

Groups are decided on ids and digests; a payload is shuffled once, to meet its group's row, and a group as large as a
third of all pages is split by Spark like any skewed join.

Defined results: null html is an empty payload; of rows that repeat page and payload one is a response; without any
id in a group all of it are responses, and rows without an id never are where others have one; a URL's line ends and
other control characters are percent-encoded, a URL of over 1 MB is left out of its record; an empty table gives an
empty archive; other columns are ignored. A damaged archive gives its records up to the damage and a row with the
reason in `error`; a digest that does not fit is a reason too, but reading goes on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import light_slices, save

DATE = "2024-01-01T00:00:00Z"
LONGEST, MOST_URL = 8 << 20, 1 << 20
# Fixed value: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
SCHEMA = "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, error string"


def digest(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    stated = [*fields, ("WARC-Block-Digest", "sha1:" + digest(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in stated) + "\r\n"
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record(record_id: str, url: str | None, payload: bytes, sha: bytes, refers_to: str | None, longest: int = LONGEST, date: str = DATE) -> Iterator[bytes]:
    """The members of a page's record: one, or one for each segment."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if refers_to else payload
    about = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None and len(url.encode("utf-8", "replace")) <= MOST_URL:
        about.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    about += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest(sha))]
    if refers_to:
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    if len(block) <= longest:
        yield member(about, block)
        return
    parts = [block[at : at + longest] for at in range(0, len(block), longest)]
    yield member([*about, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}/{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(k))]
        yield member([*more, *[("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts))], part)


def _grouped(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Rows (page_id, url, payload, sha, copy, refers_to); copy numbers rows that repeat a page and its payload, from 1."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    key = ["sha", "bytes"]
    ids = rows.filter(F.col("bytes") >= least_bytes).groupBy(*key, "page_id").agg(F.count("*").alias("n"))
    groups = ids.groupBy(key).agg(F.min("page_id").alias("first"), (F.min_by("n", "page_id") > 1).alias("tied"), F.sum("n").alias("rows"))
    groups = save(groups.filter("rows > 1 AND first IS NOT NULL").drop("rows"), "groups")
    joined = rows.join(groups, key, "left")
    tied = F.coalesce(F.col("tied") & (F.col("page_id") == F.col("first")), F.lit(False))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    columns = ["page_id", "url", "payload", "sha", "copy", "refers_to"]
    out = joined.filter(~tied).withColumns({"copy": F.lit(1).cast("long"), "refers_to": refers}).select(columns)
    if groups.filter("tied").isEmpty():
        return out
    same = joined.filter(tied).groupBy(*key, "page_id", "url").agg(F.count("*").alias("n"), F.any_value("payload").alias("payload"))
    before = F.sum("n").over(Window.partitionBy("sha", "page_id").orderBy("url")) - F.col("n")
    same = same.withColumn("before", before).withColumn("copy", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))))
    return out.union(same.withColumn("refers_to", F.when(F.col("copy") > 1, F.col("page_id"))).select(columns))


def write(pages: DataFrame, path: str, least_bytes: int = 0, longest: int = LONGEST, most_records: int = 20_000) -> None:
    """Write a folder of archives with a record for each row of pages (page_id, url, html), at most `most_records` a file.

    Payloads of fewer than `least_bytes` bytes are responses however often they come.
    """
    if longest > LONGEST:
        raise ValueError(f"segments hold at most {LONGEST} bytes")

    def run(batches):
        for batch in light_slices(batches, "payload"):
            out = []
            for page, url, payload, sha, copy, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "copy", "refers_to"))):
                name = f"urn:uuid:{uuid.uuid4()}" if page is None else f"urn:page:{page}" + f":{copy}" * (copy > 1)
                out.append(b"".join(record(name, url, payload, bytes.fromhex(sha), None if to is None else f"urn:page:{to}", longest))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["members"])

    # A row has all segments of a record, so that they are in one file.
    rows = _grouped(pages, least_bytes).mapInArrow(run, "members binary").select(F.col("members").cast("string"))
    rows.write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", most_records).text(path)
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "part-*.txt")):
        old = found.getPath()
        files.rename(old, spark._jvm.org.apache.hadoop.fs.Path(folder, old.getName().removesuffix(".txt") + ".warc.gz"))


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Damage(Exception):
    """An archive that cannot be read on."""


class Reader:
    """The records of an archive in order, from a stream of its bytes."""

    def __init__(self, stream, keep: bool = False):
        self.stream, self.keep = stream, keep
        self.compressed, self.plain, self.at, self.z = b"", b"", 0, None

    def _more(self) -> bytes:
        """Some more bytes of the member; none at its end."""
        while not self.z.eof:
            data = self.compressed or self.stream.read(CHUNK)
            if not data:
                raise Damage("the archive ends inside a record")
            try:
                out = self.z.decompress(data, CHUNK)
            except zlib.error as e:
                raise Damage(str(e)) from e
            self.compressed = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += len(data) - len(self.compressed)
            if out:
                return out
        return b""

    def _fields(self) -> dict[str, str]:
        """The header of the member that begins here."""
        self.z, held, seen = zlib.decompressobj(31), bytearray(), 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            more = self._more()
            if not more:
                raise Damage("a record without a whole header")
            held += more
        self.plain = bytes(held[end + 4 :])
        first, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise Damage("a member that is no record")
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}

    def _block(self, n: int) -> Iterator[bytes]:
        """The n bytes that follow in the member."""
        while n:
            data = self.plain or self._more()
            if not data:
                raise Damage("a record shorter than its length")
            yield data[:n]
            self.plain, n = data[n:], n - len(data[:n])

    def _end(self) -> None:
        rest = self.plain
        while len(rest) <= 4 and (more := self._more()):
            rest += more
        if rest != b"\r\n\r\n":
            raise Damage("a record longer than its length")

    def records(self) -> Iterator[dict]:
        """offset, fields (of the header), http_length, payload_bytes, sha1 and payload, and error of each record."""
        now = None
        try:
            while self.compressed or (more := self.stream.read(CHUNK)):
                self.compressed = self.compressed or more
                offset, fields = self.at, self._fields()
                goes_on = fields.get("warc-type") == "continuation"
                if goes_on and (now is None or fields.get("warc-segment-origin-id") != now["fields"].get("warc-record-id") or fields.get("warc-segment-number") != str(now["segment"] + 1)):
                    raise Damage("a segment without the one before")
                if now and not goes_on:
                    raise Damage("a record without its last segment")
                if goes_on:
                    now["segment"] += 1
                else:
                    http = fields.get("content-type", "").startswith("application/http")
                    now = {"offset": offset, "fields": fields, "segment": 1, "head": b"" if http else None, "http_length": None, "payload_bytes": 0, "sha1": hashlib.sha1(), "payload": bytearray(), "error": None}
                if not fields.get("content-length", "").isdigit():
                    raise Damage("a record without a length")
                block = hashlib.sha1()
                for part in self._block(int(fields["content-length"])):
                    block.update(part)
                    self._payload(now, part)
                self._end()
                if fields.get("warc-block-digest") not in (None, "sha1:" + digest(block.digest())):
                    now["error"] = "block digest"
                if "warc-segment-number" not in fields or "warc-segment-total-length" in fields:
                    yield now
                    now = None
            if now:
                raise Damage("a record without its last segment")
        except Damage as e:
            yield {"offset": self.at, "fields": {}, "http_length": None, "payload_bytes": 0, "sha1": hashlib.sha1(), "payload": b"", "error": str(e)}

    def _payload(self, now: dict, part: bytes) -> None:
        if now["head"] is not None:  # still inside the HTTP header
            now["head"] += part
            head, end, part = now["head"].partition(b"\r\n\r\n")
            if not end:
                return
            found = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            now["head"], now["http_length"] = None, int(found[1]) if found else None
        now["payload_bytes"] += len(part)
        now["sha1"].update(part)
        if self.keep:
            now["payload"] += part


def row(found: dict) -> tuple:
    """What SCHEMA says of a record, but for the archive: a revisit's length and digest are those of the payload it refers to."""
    fields, error = found["fields"], found["error"]
    own, stated = digest(found["sha1"].digest()), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind, trim = fields.get("warc-type"), lambda name: fields[name].strip("<>") if name in fields else None
    revisit = kind == "revisit"
    size = found["http_length"] if revisit else found["payload_bytes"]
    if not revisit and not error and (stated not in ("", own) or found["http_length"] not in (None, size)):
        error = "payload digest"
    return found["offset"], trim("warc-record-id"), kind, fields.get("warc-target-uri"), trim("warc-refers-to"), size, stated if revisit else own, error


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of a folder of archives, with their payloads if asked for."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows, held, size = [], [], 0
                for found in Reader(pa.BufferReader(content.as_buffer()), payload).records():
                    rows.append((archive.as_py(), *row(found)))
                    held.append(bytes(found["payload"]))
                    size += 200 + len(held[-1])
                    if size > 1 << 21:
                        yield _batch(rows, held if payload else None, names)
                        rows, held, size = [], [], 0
                yield _batch(rows, held if payload else None, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA + ", payload binary" * payload)


def _batch(rows: list[tuple], held: list[bytes] | None, names: list[str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrays = [pa.array([r[k] for r in rows], kinds[x.split()[1]]) for k, x in enumerate(SCHEMA.split(", "))]
    return pa.RecordBatch.from_arrays(arrays if held is None else [*arrays, pa.array(held, pa.binary())], names if held is None else [*names, "payload"])


def resolved(records: DataFrame) -> DataFrame:
    """Records read with payloads; a revisit has the payload of the response it refers to, null if that is not among them."""
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("shared"))
    return records.join(responses, "refers_to", "left").withColumn("payload", F.when(F.col("record_type") == "revisit", F.col("shared")).otherwise(F.col("payload"))).drop("shared")


def page_of(record_id: Column) -> Column:
    """The page id inside a record id that write() made."""
    return F.nullif(F.regexp_extract(record_id, r"^urn:page:([^:/]*)", 1), F.lit("")).try_cast("long")


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) of pages written to `path` and read back."""
    write(pages, path, least_bytes)
    found = read(pages.sparkSession, path)
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"), "error")
