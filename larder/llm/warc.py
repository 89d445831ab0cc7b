"""WARC archives with a two-level capture index.

`write` stores one record per page, each a gzip member of its own, in files of bounded size. Pages
of equal payload have one response record, that of the largest page id; the others are revisit
records that name it. Which it is comes from partial aggregates over digests, without the pages;
only digests that occur twice or more are joined back, salted, so a payload with a third of all
rows is no hot key. Pages are shuffled once, by row, and equal rows as one.

`build_index` sorts the captures by reversed-host key (`org,example,www)/path`) over range
partitions. Each partition cuts its keys into compressed blocks and keeps a sparse directory, one
entry per block; the top level is one row per partition. `lookup` sends urls to the partitions
whose key range holds them, binary-searches the directory there, reads the blocks by range and
then the records by range. `read` walks all blocks and reads every record back.

Files are written in the shared folder under random names. Only those whose task committed are
named in the capture table, so a task that runs again leaves a stray file and no wrong record. The
folder may be any that pyarrow opens (local or mounted paths, HDFS, object stores).

A null page is an empty payload, a null url an empty one; a null page id is kept (it is the least
of its payload) and read back as null. Rows with equal ids are records of
their own; of rows with the largest id and equal payloads that with the last url is the response. Very long
pages need the memory of one page. An empty table gives no records. Extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.common import slices
from larder.session import run_folder, written

DATE = "2020-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
BLOCK_ROWS = 3000
READ_BYTES = 32 << 20
_SALTS = 16


@dataclass(frozen=True)
class Archive:
    """The capture table of written records and, once built, the top level of the index."""

    captures: DataFrame
    parts: DataFrame | None = None


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then port, path and query; scheme and fragment go."""
    text = (url or "").strip()
    try:
        at = urlsplit(text if "//" in text else "//" + text)
        host, port = (at.hostname or ""), at.port
    except ValueError:  # not a url: its own key
        return text
    labels = ",".join(reversed(host.split("."))) if not host.replace(".", "").isdigit() else host
    tail = f":{port}" if port not in (None, 80, 443) else ""
    return f"{labels}{tail}){at.path or '/'}" + (f"?{at.query}" if at.query else "")


def _digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def record(row: dict) -> bytes:
    """One WARC record as a gzip member."""
    revisit = row["refers_name"] is not None
    payload = b"" if revisit else (row["html"] or "").encode()
    url = quote(row["url"] or "", safe="".join(map(chr, range(33, 127))) + "%")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n"
    block = head.encode() + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(row["name"]),
        "WARC-Target-URI": url, "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{_digest(row['digest'])}", "X-Payload-Length": row["bytes"],
        "X-Page-Id": row["page_id"],
    }
    if revisit:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": _record_id(row["refers_name"]), "X-Refers-To-Page": row["refers_to"],
        }
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """Fields of one record; `payload` is null for a revisit. A wrong digest is an error."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and _digest(hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI", ""),
        "record_type": fields["WARC-Type"], "payload": payload, "payload_digest": digest,
        "payload_bytes": len(payload) if payload is not None else number("X-Payload-Length"),
        "refers_to": number("X-Refers-To-Page"),
    }


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else "file://" + folder)


_CAPTURE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def write(pages: DataFrame, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> Archive:
    """Write a record for every row of (page_id, url, html). Payloads below `least_bytes` are all
    responses."""
    folder = run_folder(pages.sparkSession, "warc")
    body = F.coalesce("html", F.lit(""))
    marked = pages.select(
        "page_id", "url", "html", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes")
    ).withColumn("row", F.to_json(F.struct("page_id", "url", "digest")))
    slim = marked.groupBy("row", "page_id", "digest").agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes"))
    slim = slim.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(_SALTS)).cast("int"))
    leaders = (
        slim.filter(F.col("bytes") >= least_bytes).groupBy("digest")
        .agg(F.sum("copies").alias("all"), F.max(F.struct("page_id", "row")).alias("lead")).filter("all > 1")
        .select("digest", "lead", F.explode(F.array(*(F.lit(s) for s in range(_SALTS)))).alias("salt"))
    )
    verdicts = slim.join(leaders, ["digest", "salt"], "left").select("row", "copies", "lead")
    # equal rows travel once, however many they are
    ready = marked.drop("bytes").dropDuplicates(["row"]).join(verdicts, "row").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    )
    other = F.col("lead").isNotNull() & ((F.col("lead.row") != F.col("row")) | (F.col("copy") > 0))
    ready = ready.select(
        "page_id", "url", "digest", F.concat_ws("#", "row", "copy").alias("name"),
        F.xxhash64("row", "copy").alias("n"), F.octet_length(body).alias("bytes"), F.when(~other, F.col("html")).alias("html"),
        F.when(other, F.col("lead.page_id")).alias("refers_to"), F.when(other, F.concat("lead.row", F.lit("#0"))).alias("refers_name"),
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for part in slices(batches, 64):
                rows = []
                for row in part.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(posixpath.join(root, name), compression=None)
                    member = record(row)
                    out.write(member)
                    rows.append((url_key(row["url"]), row["n"], posixpath.join(folder, name), at, len(member)))
                    at += len(member)
                yield _rows(rows, _CAPTURE)
        finally:
            if out is not None:
                out.close()

    return Archive(written(ready.mapInArrow(step, _CAPTURE), "warc-captures"))


_PART = T.StructType([
    T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
    T.StructField("blocks", T.StringType()), T.StructField("directory", T.StringType()),
    T.StructField("n_blocks", T.LongType()), T.StructField("n_rows", T.LongType()),
])


def build_index(archive: Archive, block_rows: int = BLOCK_ROWS) -> Archive:
    """Sort the captures into compressed blocks of `block_rows` keys with a sparse directory."""
    spark = archive.captures.sparkSession
    folder = run_folder(spark, "warc-index")
    # the number of a record spreads a key that many captures share
    ranged = archive.captures.repartitionByRange("key", "n").sortWithinPartitions("key", "n")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        directory: list[tuple] = []  # first key, last key, offset, length
        waiting: list[list] = []
        total = 0
        out = None

        def block(rows: list[list]) -> None:
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
            directory.append((rows[0][0], rows[-1][0], out.tell(), len(data)))
            out.write(data)

        try:
            for part in slices(batches, block_rows):
                out = out or system.open_output_stream(posixpath.join(root, f"{name}.blocks"))
                waiting += [[r["key"], r["file"], r["offset"], r["length"]] for r in part.to_pylist()]
                total += part.num_rows
                while len(waiting) >= block_rows:
                    block(waiting[:block_rows])
                    waiting = waiting[block_rows:]
            if waiting:
                block(waiting)
        finally:
            if out is not None:
                out.close()
        if directory:
            with system.open_output_stream(posixpath.join(root, f"{name}.directory")) as sparse:
                sparse.write(json.dumps(directory).encode())
            paths = (posixpath.join(folder, f"{name}.{x}") for x in ("blocks", "directory"))
            yield _rows([(directory[0][0], directory[-1][1], *paths, len(directory), total)], _PART)

    return Archive(archive.captures, written(ranged.mapInArrow(step, _PART), "warc-parts"))


_PLACE = T.StructType([_CAPTURE["file"], _CAPTURE["offset"], _CAPTURE["length"]])
_RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("refers_to", T.LongType()),
])


def _load(path: str, offset: int | None = None, length: int = 0) -> bytes:
    """A whole file, or a range of it."""
    system, at = _open(path)
    with system.open_input_file(at) as source:
        return source.read() if offset is None else source.read_at(length, offset)


def _unpacked(data: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(data).decode().split("\n")]


def _places(archive: Archive) -> DataFrame:
    """Where every record lies, from all blocks of the index."""
    if archive.parts is None:
        raise ValueError("build the index first")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                for _, _, offset, length in json.loads(_load(part["directory"])):
                    yield _rows([tuple(r[1:]) for r in _unpacked(_load(part["blocks"], offset, length))], _PLACE)

    # a small table with much behind every row: one task each
    return archive.parts.repartition(max(1, archive.parts.count())).mapInArrow(step, _PLACE)


def _fetched(places: DataFrame, payload: bool) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        try:
            for part in slices(batches, 64):
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if file != path:
                        if source is not None:
                            source.close()
                        system, at = _open(file)
                        path, source = file, system.open_input_file(at)
                    found = parse(source.read_at(length, offset))
                    if not payload:
                        found["payload"] = None
                    rows.append(tuple(found[f.name] for f in _RECORD))
                yield _rows(rows, _RECORD)
        finally:
            if source is not None:
                source.close()

    return places.mapInArrow(step, _RECORD)


def read(archive: Archive, payload: bool = True) -> DataFrame:
    """All records, from every block of the index in order, read by range."""
    found = _fetched(_spread(_places(archive), archive.captures), payload)
    return found if payload else found.drop("payload")


def _spread(places: DataFrame, captures: DataFrame) -> DataFrame:
    """Places dealt in runs of `READ_BYTES` of a file, in the order of the file; `captures` bound them."""
    total = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(captures.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    run = F.floor(F.col("offset") / READ_BYTES)
    return places.repartition(int(tasks), F.col("file"), run).sortWithinPartitions("file", "offset")


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url", payload: bool = True, every: bool = False) -> DataFrame:
    """The records whose url has the key of one of `urls`; each record once. The distinct keys are
    dealt to the range partitions they can lie in and searched by halves in the sparse directory; the
    blocks found are unpacked and their records read by range. `every` states that `urls` has the key
    of every capture: the places found are counted back, and a different number is an error."""
    if archive.parts is None:
        raise ValueError("build the index first")
    # one row per range partition: as many as the sort had, however many captures there are
    tops = sorted(archive.parts.collect(), key=lambda p: (p["first"], p["last"]))
    asked = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.StringType())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [p["last"] for p in tops]
        for batch in slices(batches):
            rows = set()
            for url in batch.column(0).to_pylist():
                key = url_key(url)
                at = bisect.bisect_left(last, key)
                while at < len(tops) and tops[at]["first"] <= key:
                    rows.add((at, key))
                    at += 1
            yield _rows(sorted(rows), asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, directory, last = None, [], []
        block, lines = None, []
        for batch in slices(batches):
            rows: list[tuple] = []
            for part, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, directory, block = part, json.loads(_load(tops[part]["directory"])), None
                    last = [d[1] for d in directory]
                at = bisect.bisect_left(last, key)
                while at < len(directory) and directory[at][0] <= key:
                    if block != at:
                        block, lines = at, _unpacked(_load(tops[part]["blocks"], *directory[at][2:]))
                    low = bisect.bisect_left(lines, key, key=itemgetter(0))
                    high = bisect.bisect_right(lines, key, low, key=itemgetter(0))
                    rows += (tuple(r[1:]) for r in lines[low:high])
                    at += 1
                if len(rows) >= BLOCK_ROWS:
                    yield _rows(rows, _PLACE)
                    rows = []
            yield _rows(rows, _PLACE)

    keys = urls.select(url_col).mapInArrow(route, asked).distinct()
    # a number of tasks that small rows do not shrink: much is read behind every row
    places = keys.repartition(max(1, len(tops)), "part").sortWithinPartitions("part", "key").mapInArrow(search, _PLACE)
    if every:
        places = written(places, "warc-places")
        found, captured = places.count(), archive.captures.count()
        if found != captured:
            raise ValueError(f"the search found {found} of {captured} captures")
    found = _fetched(_spread(places, places if every else archive.captures), payload)
    return found if payload else found.drop("payload")
