"""Document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes of a text (the last 32 bytes count) proposes boundaries. They are
normalised: up to `normal` bytes a strict mask must be met, beyond it a loose one, and no chunk is
shorter than `least` or longer than `most`. A boundary depends on the bytes just before it, so an
insertion shifts chunks without changing those further on. The fingerprint is the set of chunk
digests with the chunk lengths; the likeness of one text to another is the share of its chunk
bytes, each distinct chunk counted once, that the other text has as well.

`neighbours` compares every text with an edited one and with the next text by id. It ranges the
rows over partitions by id once; a task walks its rows with one text held back. Only the first and
last row of every partition cross a border, and those are joined by partition number.

Null texts are empty. An empty text has an empty fingerprint; two empty texts are alike (1), an
empty and another one are not (0). Null ids come first; equal ids are ordered by a hash of the
text, and equal rows follow each other. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.common import column, slices
from larder.session import written

LEAST, NORMAL, MOST = 16, 64, 255
#: High bits of the gear hash that must be zero: below and beyond the normal length.
STRICT, LOOSE = np.uint32(0b1111111 << 25), np.uint32(0b11111 << 27)
#: One pseudo-random number per byte value, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)
#: Bytes hashed at a time; long texts need no more memory than this for their hashes.
RUN = 1 << 20


def _gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of GEAR[byte] << age over the last 32 bytes."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h[step:] += older
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one being its length."""
    n, ends, start = len(data), [], 0
    array = np.frombuffer(data, dtype=np.uint8)
    for low in range(0, n, RUN):
        from_ = max(0, low - 31)
        h = _gear(array[from_ : low + RUN])[low - from_ :]
        at = np.flatnonzero((h & LOOSE) == 0)
        strict = ((h[at] & STRICT) == 0).tolist()
        for end, firm in zip((at + (low + 1)).tolist(), strict, strict=True):
            while end - start > MOST:
                start += MOST
                ends.append(start)
            size = end - start
            if size >= NORMAL or (firm and size >= LEAST):
                ends.append(end)
                start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[int, int]:
    """Digest (48 bits) and length of every distinct chunk."""
    data = text.encode()
    digest, start, out = xxhash.xxh64_intdigest, 0, {}
    for end in boundaries(data):
        out[digest(data[start:end]) >> 16] = end - start
        start = end
    return out


def packed(found: dict[int, int]) -> bytes:
    """The fingerprint: six bytes of digest and one of length for every chunk, sorted."""
    return b"".join((d << 8 | found[d]).to_bytes(7, "big") for d in sorted(found))


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of the chunk bytes of `own` that `other` has."""
    if not own:
        return float(not other)
    return sum(n for d, n in own.items() if d in other) / sum(own.values())


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of the following text."""
    many = len(text) // 4
    return text[: len(text) - many] + following[:many]


#: Digests and fingerprints are bytes inside the operator and hexadecimal digits in its result.
_BYTES = ("edited_sha256", "fingerprint", "edited_fingerprint")
_OUT = [
    T.StructField("n_chars", T.LongType()), *(T.StructField(b, T.BinaryType()) for b in _BYTES),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
]


def _compared(text: str, own: dict[int, int], following: str, next_: dict[int, int]) -> tuple:
    changed = edited(text, following)
    theirs = chunks(changed)
    return (
        len(text), hashlib.sha256(changed.encode()).digest(), packed(own), packed(theirs),
        containment(own, theirs), containment(own, next_),
    )


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = column(part, text_col).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [column(part, id_col).cast(arrow[0].type), pa.array([packed(chunks(t or "")) for t in texts], pa.binary())], schema=arrow
            )

    return docs.select(id_col, text_col).mapInArrow(step, schema).withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every
    row, against its edited text and the next row by id; the last row is followed by the first."""
    # The number of the row tells equal rows apart, so that many of them spread over partitions.
    rows = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_h"), F.monotonically_increasing_id().alias("_n"))
    ranged = rows.repartitionByRange(F.col(id_col).asc_nulls_first(), "_h", "_n")
    ranged = ranged.sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_h", "_n").select(id_col, text_col)
    # kind: 0 a finished row, 1 the first text of a partition, 2 its last row, whose next is elsewhere
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), docs.schema[id_col],
        T.StructField("_text", T.StringType()), *_OUT,
    ])
    arrow = to_arrow_schema(schema)
    blank = (None,) * len(_OUT)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for piece in slices(batches, 128):
            out = []
            for own, text in zip(column(piece, id_col).to_pylist(), column(piece, text_col).to_pylist(), strict=True):
                text = text or ""
                found = chunks(text)
                if held is None:
                    out.append((part, 1, own, text, *blank))
                else:
                    out.append((part, 0, held[0], None, *_compared(held[1], held[2], text, found)))
                held = own, text, found
            yield _batch(out, arrow)
        if held is not None:
            yield _batch([(part, 2, held[0], held[1], *blank)], arrow)

    walked = written(ranged.mapInArrow(walk, schema), "chunk-walk")
    heads = walked.filter("kind = 1").select("part", F.col("_text").alias("_next"))
    # one row per partition that has rows: which partition comes after it
    order = Window.orderBy("part")
    after = heads.select("part").withColumn("_after", F.lead("part").over(order)).withColumn("_first", F.min("part").over(order))
    after = after.select("part", F.coalesce("_after", "_first").alias("_after"))
    tails = (
        walked.filter("kind = 2").select("part", id_col, F.col("_text")).join(after, "part").drop("part")
        .join(heads.withColumnRenamed("part", "_after"), "_after").select(id_col, "_text", "_next")
    )
    final = T.StructType([docs.schema[id_col], *_OUT])
    final_arrow = to_arrow_schema(final)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 16):
            yield _batch([
                (own, *_compared(text, chunks(text), following, chunks(following)))
                for own, text, following in zip(*(c.to_pylist() for c in piece.columns), strict=True)
            ], final_arrow)

    found = walked.filter("kind = 0").select(id_col, *(f.name for f in _OUT)).unionByName(tails.mapInArrow(last, final))
    return found.withColumns({c: F.lower(F.hex(c)) for c in _BYTES})
