"""Near-duplicates by similarity of word shingles: candidates by min-hash bands, each one verified.

Texts link where the Jaccard similarity of their sets of `SHINGLE` words is `least` (0.8) or more,
and a component is what such links connect.

1. Texts with the same set collapse to one row first, so exact copies cost nothing more.
2. A set has BANDS keys of ROWS min-hashes each. A pair of similarity s shares a key with probability
   1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8, more above.
3. Links that are known before (those of the fingerprints, in the pipeline) are taken over, and buckets
   whose members they connect are done. In the others every text is verified against the first text
   of a bucket it is in, one pair for each text. That joins most groups of near copies, however large.
4. Buckets with members of more than one component are verified whole, all pairs by their sets. Those
   of more than `bucket_rows` members, or of long texts, are dealt into blocks, and every pair of blocks is verified as
   a bucket of its own, so no bucket is capped and none has to fit into a task.

Null and empty texts have the empty set and are copies of one another. A text of fewer words than
`SHINGLE` is one shingle. Shingle hashes have 32 bits in a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import column, map_slices
from larder.llm.simhash import SEED, components
from larder.session import written

SHINGLE = 5
BANDS, ROWS = 24, 6
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_MIX[0] |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct 32-bit hashes of the shingles of a text, sorted; words as for fingerprints."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype="<u4")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    of = xxhash.xxh32_intdigest
    return np.unique(np.array(
        [of(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype="<u4"
    ))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """The bucket keys of a set, as signed numbers; none for the empty set."""
    if not len(grams):
        return np.empty(0, dtype=np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(grams), 2048):
        mixed = grams[at : at + 2048, None].astype(np.uint64) * _MIX[0] + _MIX[1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, mixed.min(axis=0))
    bands = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], dtype=np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sid, keys, grams) of every row; equal sets have the same `sid`."""
    schema = T.StructType([
        docs.schema[id_col], T.StructField("sid", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.IntegerType())),
    ])

    def work(part: pa.RecordBatch) -> list:
        sets = [shingles(t) for t in column(part, text_col).to_pylist()]
        sids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
        return [column(part, id_col), sids, [band_keys(s) for s in sets], [s.view("<i4") for s in sets]]

    return map_slices(docs.select(id_col, text_col), work, schema)


#: Sets of about this size together make a block.
_BLOCK_BYTES = 16 << 20
#: Shingles that are put in order at once.
_SHARE = 1 << 20
#: Columns of the table of shingles that are counted at once.
_WIDTH = 4096


def _linked(sids: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what pairs of a similarity of `least` connect in one bucket."""
    sizes = np.array([len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)))
    # one range of hashes after the other, so that the order of all of them is never held at once
    cuts = np.linspace(0, 2**32, int(sizes.sum()) // _SHARE + 2).astype(np.uint64)
    ends = np.array([np.searchsorted(s, cuts) for s in sets])
    for low, high in zip(ends.T[:-1], ends.T[1:], strict=True):
        owner = np.repeat(np.arange(len(sets)), high - low)
        part = np.concatenate([s[a:b] for s, a, b in zip(sets, low, high, strict=True)])
        _, at, seen = np.unique(part, return_inverse=True, return_counts=True)
        owner, at = owner[seen[at] > 1], at[seen[at] > 1]  # a shingle of one member is in no intersection
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        if len(at):
            at = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]]))
        for first in range(0, int(at[-1]) + 1 if len(at) else 0, _WIDTH):
            a, b = np.searchsorted(at, [first, first + _WIDTH])
            table = np.zeros((len(sets), _WIDTH), dtype=np.float32)
            table[owner[a:b], at[a:b] - first] = 1
            both += table @ table.T
    alike = both >= least * (sizes[:, None] + sizes - both) - 1e-6
    left = np.ones(len(sets), dtype=bool)
    firsts, others = [], []
    for root in range(len(sets)):
        front = [root] if left[root] else []
        left[root] = False
        while front:
            here = front.pop()
            got = np.flatnonzero(alike[here] & left)
            left[got] = False
            front.extend(got.tolist())
            firsts.append(np.full(len(got), sids[here]))
            others.append(sids[got])
    return np.concatenate(firsts), np.concatenate(others)


def _walk(least: float):
    """Verifies buckets of rows (unit, sid, grams) that come sorted by unit."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(sids) > 1:
                a, b = _linked(np.array(sids, dtype=np.int64), sets, least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            lists = column(batch, "grams")
            ends, grams = lists.offsets.to_numpy(), lists.values.to_numpy().view("<u4")
            rows = (column(batch, c).to_pylist() for c in ("unit", "sid"))
            for unit, sid, low, high in zip(*rows, ends[:-1], ends[1:], strict=True):
                if unit != now:
                    yield from links()
                    now, sids, sets = unit, [], []
                sids.append(sid)
                sets.append(grams[low:high].copy())
        yield from links()

    return step


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the `root` of their `sid`, which is itself where nothing links it."""
    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def links(
    sets: DataFrame, least: float = 0.8, bucket_rows: int = 1024, known: DataFrame | None = None
) -> DataFrame:
    """(sid, root): every text class (sid, keys, grams) that is linked to another, by similarity or by
    the links (a, b) that are `known`."""
    known = sets.sparkSession.createDataFrame([], "a bigint, b bigint") if known is None else written(known, "similar-known")
    keyed = sets.select(F.explode("keys").alias("key"), "sid", (4 * F.size("grams")).alias("size")).distinct()
    keyed = _rooted(keyed, components(known))
    grams = sets.select("sid", "grams").dropDuplicates(["sid"])
    buckets = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("sid").alias("first"),
        F.min_by("root", "sid").alias("first_root"), F.min("root").alias("low"), F.max("root").alias("high"),
    ).filter("low <> high").drop("low", "high")
    rows = written(keyed.join(buckets, "key"), "similar-buckets")

    stars = rows.filter("root <> first_root").groupBy(F.col("sid").alias("a")).agg(F.min("first").alias("b"))
    both = F.size(F.array_intersect("left", "right"))
    pairs = (
        stars.join(grams.select(F.col("sid").alias("a"), F.col("grams").alias("left")), "a")
        .join(grams.select(F.col("sid").alias("b"), F.col("grams").alias("right")), "b")
        .filter(both / (F.size("left") + F.size("right") - both) >= least)
    )
    found = known.union(written(pairs.select("a", "b"), "similar-stars"))
    joined = components(found)

    rows = _rooted(rows.drop("root"), joined)
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    dealt = (
        rows.join(mixed, "key")
        .withColumn("k", F.ceil(F.greatest(F.col("n") / bucket_rows, F.col("total") / _BLOCK_BYTES)))
        .withColumn("block", F.pmod(F.xxhash64("sid", "key"), F.col("k")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
        .filter("k = 1 OR block <> other")
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "sid")
    )
    whole = dealt.join(grams, "sid").repartition("unit").sortWithinPartitions("unit", "sid")
    more = whole.select("unit", "sid", "grams").mapInArrow(_walk(least), "a bigint, b bigint")
    return components(found.union(more))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bucket_rows: int = 1024,
    linked: DataFrame | None = None,
) -> DataFrame:
    """(id, component_id): every row with the smallest id it is linked to, directly or through others.
    Rows that have one `component_id` in `linked` (id, component_id) are linked as well."""
    found = written(_sets(docs, id_col, text_col), "similar-sets")
    known = None
    if linked is not None:
        groups = linked.select(id_col, "component_id").distinct()
        groups = found.select(id_col, "sid").distinct().join(groups, id_col).select("sid", "component_id").distinct()
        firsts = groups.groupBy("component_id").agg(F.min("sid").alias("b"))
        known = groups.join(firsts, "component_id").filter("sid <> b").select(F.col("sid").alias("a"), "b").distinct()
    root = links(found, least, bucket_rows, known).withColumnRenamed("node", "sid")
    named = found.groupBy("sid").agg(F.min(id_col).alias("least")).join(root, "sid", "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.select(id_col, "sid").join(named.join(names, "root").select("sid", "component_id"), "sid").select(id_col, "component_id")
