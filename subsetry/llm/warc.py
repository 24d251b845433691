"""WARC archives: writing with revisit records, and reading by boundary chains."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.0\r\n"
#: A writer begins a new file beyond so many bytes, so a file's records are a bounded group.
FILE_BYTES = 64 << 20
#: Bytes of a file that one reading task scans for candidates.
SPLIT_BYTES = 16 << 20
#: Bytes beyond a split that are read at first; more are read where a header ends later.
HEADER_BYTES = 64 << 10
#: Rows of the table of repeated payloads that are broadcast (at most 6 MB); more are shuffled.
BROADCAST_GROUPS = 100_000
#: Each archive record's date; the pages have none.
_DATE = "2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,15})[ \t]*\r\n", re.I)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has the HTTP header, with the payload's length, but no payload."""
    d = digest(payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, d)), ("WARC-Date", _DATE),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{d}"), ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to, d)), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to)),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return MAGIC + head + b"\r\n" + block + _END


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write one record for each row; returns the files (name, bytes).

    Of records with equal payloads of at least min_bytes bytes, the one with the largest id is
    the response, the others are revisits; of several with that id each is a response. A null
    id is below all others. Only digests and ids shuffle, to find repeated payloads; pages
    are written where they are read. Only names that finished tasks returned count.
    """
    common.tune(pages.sparkSession)
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    own = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("sha", F.unhex(F.sha1("payload")))
    long_enough = F.octet_length("payload") >= min_bytes
    groups = common.staged(
        own.where(long_enough).groupBy("sha").agg(F.max(F.struct("id")).alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n >= 2").select("sha", F.col("top.id").alias("keep"), F.lit(True).alias("repeated")), "payloads",
    )
    small = groups.count() <= BROADCAST_GROUPS
    joined = own.join(F.broadcast(groups) if small else groups, "sha", "left")
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & long_enough & ~F.col("id").eqNullSafe(F.col("keep"))
    rows = joined.select("id", "url", "payload", "keep", revisit.alias("revisit"))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        fs.create_dir(root, recursive=True)
        names, sizes, out = [], [], None
        for batch in stream:
            for doc_id, url, body, keep, again in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc")
                    sizes.append(0)
                    out = fs.open_output_stream(f"{root}/{names[-1]}")
                raw = record(doc_id, url, body, keep, again)
                out.write(raw)
                sizes[-1] += len(raw)
                if sizes[-1] >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return common.staged(rows.mapInArrow(run, "name string, bytes long"), "archives")


def candidates(raw: bytes, start: int, stop: int, more: Callable[[int], bytes] = lambda n: b"") -> Iterator[tuple[int, int]]:
    """(offset, successor's offset) of every magic in raw[start:stop] with a complete header.

    more(n) gives what follows raw and the bytes that it gave before, n bytes or, at the end, less;
    it is asked for as long as a header goes on. Header ends and lengths that lie
    beyond the next magic are not looked for again, so the work is linear.
    """
    at, end, length = raw.find(MAGIC, start), -1, None
    while 0 <= at < stop:
        if end < at:
            end, length = raw.find(_END, at), None
            while end < 0 and (further := more(max(HEADER_BYTES, len(raw)))):
                old, raw = len(raw), raw + further
                end = raw.find(_END, max(at, old - len(_END) + 1))
            if end < 0:
                return
        if length is None or length.start() < at:
            length = _LENGTH.search(raw, at, end + 2)
            if length is None:
                # none up to end for a later magic either
                at = raw.find(MAGIC, end)
                continue
        yield at, end + len(_END) + int(length[1]) + len(_END)
        at = raw.find(MAGIC, at + 1)


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates of one file a chain from offset 0 reaches, by pointer jumping.

    offset is sorted. In each round the marked set grows by what it points to, and every
    pointer is replaced by its successor's, so rounds grow as the logarithm of the records.
    """
    n = len(offset)
    at = np.searchsorted(offset, successor)
    jump = np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n)
    jump = np.append(jump, n)  # n: no candidate there
    marked = np.zeros(n + 1, bool)
    if n and offset[0] == 0:
        marked[0] = True
    while (jump[:n] < n).any():
        marked[jump[marked]] = True
        jump = jump[jump]
    marked[n] = False
    return marked[:n]


def boundaries(files: DataFrame, folder: str) -> DataFrame:
    """name, start and stop of each true record of the files.

    Tasks scan splits of files and emit candidates; the candidates of a file then meet, as
    three numbers each, and those that the chain from its start reaches are records. A magic
    inside a payload is a candidate that the chain jumps over. A header may have any length. A
    file whose chain does not end at its size is an error.
    """
    splits = files.where("bytes > 0").select("name", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(SPLIT_BYTES).cast("long"))).alias("start"))
    spread = splits.repartition(common.tasks_for(files.sparkSession), "name", "start")

    def scan(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        for batch in stream:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(min(SPLIT_BYTES + HEADER_BYTES + len(MAGIC), size - start), start)
                    f.seek(start + len(raw))
                    found = list(candidates(raw, 0, min(SPLIT_BYTES, size - start), f.read))
                if start == 0 and (not found or found[0][0] != 0):
                    raise ValueError(f"{name}: no record at the file's start")
                if found:
                    cols = [[name] * len(found), [start + a for a, _ in found], [start + b for _, b in found], [size] * len(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["name", "start", "stop", "bytes"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        found = table.filter(pa.array(reachable(table.column("start").to_numpy(), table.column("stop").to_numpy())))
        end, size = found.column("stop")[-1].as_py(), found.column("bytes")[0].as_py()
        if end != size:
            raise ValueError(f"{found.column('name')[0]}: records end at {end} of {size} bytes")
        return found.drop_columns(["bytes"])

    schema = "name string, start long, stop long"
    return spread.mapInArrow(scan, f"{schema}, bytes long").groupBy("name").applyInArrow(chain, schema)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    end = raw.index(_END)
    fields = {}
    for line in raw[len(MAGIC) : end].split(b"\r\n"):
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "surrogatepass")
    block = raw[end + len(_END) :]
    return fields, block[: int(fields["content-length"])]


def read(spark: SparkSession, files: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """One row for each record of the files: id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are of the payload as read, or of a revisit's full payload as its headers
    tell. Tasks read runs of neighbouring records.
    """
    found = boundaries(files, folder)
    spread = found.withColumn("part", F.floor(F.col("start") / SPLIT_BYTES)).repartition(common.tasks_for(spark), "name", "part").sortWithinPartitions("name", "start")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        name, f = None, None
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in stream:
            rows = []
            for n, start, stop in zip(*(c.to_pylist() for c in batch.select(["name", "start", "stop"]).columns)):
                if n != name:
                    f = fs.open_input_file(f"{root}/{n}")
                    name = n
                fields, block = parse(f.read_at(stop - start, start))
                http, _, payload = block.partition(_END)
                if fields["warc-type"] == "revisit":
                    size = int(_LENGTH.search(http + b"\r\n")[1])
                    name_of = fields["warc-payload-digest"].removeprefix("sha1:")
                else:
                    size, name_of = len(payload), digest(payload)
                page, ref = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, size, name_of, fields["warc-type"], int(ref) if ref else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ddl = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spread.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages to a new shared folder and read the archives back.

    Null and empty payloads are payloads of no bytes, null urls empty ones; control characters
    and blanks in a url are percent-encoded, and a url may have any length. Ids are longs (others are
    cast). Repeated rows are records each. An empty table gives no rows.
    """
    folder = common.shared_dir(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, folder, id_col, url_col, payload_col), folder, id_col)
