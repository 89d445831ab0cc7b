"""Near-duplicates by SimHash fingerprints and Golay-code keys.

A fingerprint has 64 bits; texts link where theirs differ in at most `max_bits` (4) bits, and a
component is what such links connect. The join never compares all fingerprints:

1. Equal fingerprints collapse to one row first, so exact copies cost nothing more.
2. The bits are cut into three segments of 22, 21 and 21. Four errors over three segments leave
   (pigeonhole) either a segment without an error beside one with two at most, or two segments
   with one error each beside one with two at most. A segment of two errors at most is met by the
   binary Golay code (23, 12, 7): every word lies within 3 of exactly one codeword, and all
   codewords within 4 of a word are what its one-bit flips decode to (1 or 6). Two words at
   distance 2 share the codeword next to the word between them. A segment with one error has one
   of its halves exact. So every linked pair shares one of these keys:
     - exact segment and one Golay index of another: 6 ordered choices, 33 bits or more;
     - Golay index of one segment and an exact half of each of the others: 12 choices, 32 bits or
       more.
3. Keys are shuffled once and every bucket is verified by counting bits. A bucket yields a spanning
   star per connected set of its members, never all its pairs. Buckets of more than `bucket_rows`
   members are cut into blocks, and every pair of blocks is verified as a bucket of its own, so no
   bucket is capped and none has to fit into a task.
4. Components come from large-star and small-star rounds over the verified links.

Nulls and empty texts have fingerprint zero and link like any other. A row whose id is null takes
part, but never names a component; a component without any id is null. Repeated rows are kept.
Extra columns are left alone; only the id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import column, map_slices
from larder.session import written

#: Widths of the segments, lowest bits first.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text: a bit is set where more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    of = xxhash.xxh64_intdigest
    hashes = np.array(
        [of(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)],
        dtype="<u8",
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    set_bits = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every whole text, as a signed 64-bit number."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def work(part: pa.RecordBatch) -> list:
        fps = [fingerprint(t, shingle) for t in column(part, text_col).to_pylist()]
        return [column(part, id_col), np.array(fps, dtype=np.uint64).view(np.int64)]

    return map_slices(docs.select(id_col, text_col), work, schema)


@functools.cache
def _decoder() -> np.ndarray:
    """Index of the codeword within distance 3 of every 23-bit word."""
    index = np.arange(4096, dtype=np.int64)
    words = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        words ^= np.where(index >> bit & 1, GENERATOR << bit, 0)
    one = 1 << np.arange(23)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | one).ravel())
    errors = np.concatenate([[0], one, two, three[np.bitwise_count(three) == 3]])
    table = np.empty(1 << 23, dtype=np.uint16)
    for error in errors:
        table[words ^ error] = index
    return table


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of all codewords within distance 4; -1 fills rows that have only one."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(_decoder()[words[:, None] ^ flips].astype(np.int64), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(words), 6), -1, dtype=np.int64)
    row, at = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[row, at]] = found[row, at]
    return out


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bucket keys of fingerprints (uint64): (row numbers, keys)."""
    fps = fps.astype(np.uint64)
    cuts = np.cumsum([0, *SEGMENTS])
    seg = [((fps >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in zip(cuts, SEGMENTS, strict=False)]
    near = [golay_indices(s) for s in seg]
    rows, out = [], []

    def add(kind: int, exact: np.ndarray, golay: np.ndarray) -> None:
        row, at = np.nonzero(golay >= 0)
        rows.append(row)
        out.append((np.int64(kind) << 58) | (exact[row] << 12) | golay[row, at])

    kind = 0
    for i in range(3):
        for j in (x for x in range(3) if x != i):
            add(kind, seg[i], near[j])
            kind += 1
    for i in range(3):
        j, k = (x for x in range(3) if x != i)
        for high_j in (0, 1):
            for high_k in (0, 1):
                half_j, half_k = (
                    s >> 11 if high else s & 0x7FF for s, high in ((seg[j], high_j), (seg[k], high_k))
                )
                add(kind, half_j << 11 | half_k, near[i])
                kind += 1
    return np.concatenate(rows), np.concatenate(out)


def _star(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of one bucket joined to the first of their connected set: (first, other)."""
    left = fps
    firsts, others = [], []
    while len(left) > 1:
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            close = np.bitwise_count(left ^ front.pop()) <= max_bits
            if close.any():
                got = left[close]
                left = left[~close]
                front.extend(got)
                firsts.append(np.full(len(got), first))
                others.append(got)
    if not firsts:
        return left[:0], left[:0]
    return np.concatenate(firsts), np.concatenate(others)


_LINKS = "a bigint, b bigint, key bigint, block bigint"


def _verify(bucket_rows: int, max_bits: int):
    """Walks sorted (key, fp) rows. Gives links (a, b), and for keys of more than `bucket_rows`
    members also the members (a, key, block) that other blocks still have to meet."""

    def bucket(key: int, fps: np.ndarray, block: int, more: bool) -> list[np.ndarray]:
        a, b = _star(fps, max_bits)
        out = [np.stack([a.view(np.int64), b.view(np.int64), np.full(len(a), key), np.full(len(a), -1)])]
        if block or more:
            ids = fps.view(np.int64)
            out.append(np.stack([ids, ids, np.full(len(ids), key), np.full(len(ids), block)]))
        return out

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_rest, fp_rest, block = np.empty(0, np.int64), np.empty(0, np.uint64), 0

        def emit(found: list[np.ndarray]) -> pa.RecordBatch:
            table = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["a", "b", "key", "block"])

        for batch in batches:
            k = np.concatenate([key_rest, column(batch, "key").to_numpy()])
            f = np.concatenate([fp_rest, column(batch, "fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on
            found = []
            edge = np.flatnonzero(np.concatenate([[True], k[1:cut] != k[: max(cut - 1, 0)]])) if cut else np.empty(0, int)
            size = np.diff(np.append(edge, cut))
            pair = edge[size == 2]  # most buckets with anything to verify
            close = np.bitwise_count(f[pair] ^ f[pair + 1]) <= max_bits
            carried = block > 0
            if carried and len(pair) and pair[0] == 0:
                close[0] = False
            a, b = f[pair[close]], f[pair[close] + 1]
            found.append(np.stack([a.view(np.int64), b.view(np.int64), np.zeros(len(a), np.int64), np.full(len(a), -1)]))
            for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if not (carried and at == 0):
                    found += _blocks(bucket, int(k[at]), f[at : at + n], 0, bucket_rows)
            if carried and cut:
                found += _blocks(bucket, int(k[0]), f[: size[0]], block, bucket_rows)
                block = 0
            key_rest, fp_rest = k[cut:], f[cut:]
            while len(fp_rest) > bucket_rows:
                found += bucket(int(key_rest[0]), fp_rest[:bucket_rows], block, True)
                key_rest, fp_rest, block = key_rest[bucket_rows:], fp_rest[bucket_rows:], block + 1
            yield emit(found)
        if len(fp_rest):
            yield emit(_blocks(bucket, int(key_rest[0]), fp_rest, block, bucket_rows))

    return step


def _blocks(bucket, key: int, fps: np.ndarray, block: int, rows: int) -> list[np.ndarray]:
    found = []
    while len(fps):
        found += bucket(key, fps[:rows], block, len(fps) > rows)
        fps, block = fps[rows:], block + 1
    return found


def _buckets(rows: DataFrame, by: list[str], bucket_rows: int, max_bits: int) -> DataFrame:
    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by, "fp")
    return sorted_rows.select("key", "fp").mapInArrow(_verify(bucket_rows, max_bits), _LINKS)


def links(fps: DataFrame, max_bits: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """Verified links (a, b) between the distinct fingerprints of the column `fp`; together they
    connect exactly the fingerprints that pairs of at most `max_bits` (4 or fewer) bits connect."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys are complete for up to 4 bits")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = column(batch, "fp").slice(at, 1000).to_numpy()
                row, key = keys(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], names=["key", "fp"])

    keyed = fps.select("fp").distinct().mapInArrow(step, "key bigint, fp bigint")
    first = written(_buckets(keyed, ["key"], bucket_rows, max_bits), "golay-links")
    hot = first.filter("block >= 0").select("key", F.col("a").alias("fp"), "block")
    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = (
        hot.join(last, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
        .filter("other <> block")
        .select(
            # a key of its own for every pair of blocks
            F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp",
        )
    )
    crossed = _buckets(pairs, ["key"], 2 * bucket_rows + 1, max_bits)
    return first.filter("block < 0").select("a", "b").union(crossed.filter("block < 0").select("a", "b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node it is connected to.

    Alternates large-star and small-star rounds, each a partial aggregate and a join, until the
    edges stay the same; every round is kept in the shared folder."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = written(now, "star-0")
    seen = None
    for number in range(1, rounds + 1):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = written(small, f"star-{number}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
    max_bits: int = 4, bucket_rows: int = 8192,
) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id it is linked to,
    directly or through others."""
    found = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = found.groupBy("fp").agg(F.min(id_col).alias("least"))
    root = components(links(found, max_bits, bucket_rows))
    linked = least.join(root, F.col("fp") == F.col("node")).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(named, "root").select("fp", "component")
    classes = least.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "least").alias("component_id")
    )
    return found.join(classes, "fp").select(id_col, "fp", "component_id")
