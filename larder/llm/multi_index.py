"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by a codebook of its own; a pair of centroids is a
cell, and the index lists the vectors of every cell. A query walks the cells in the order of the sum
of its two centroid distances, taken from a heap, and the entries of the cells it reaches are reranked
by their distance on the original vectors.

1. The codebooks, `centroids` (from the number of vectors, 256 at most) a half, are fitted by k-means
   on `sample` vectors at most, the first by a hash. Every vector is indexed.
2. Equal vectors are one entry with the smallest ids that a result can need; equal queries are one
   query. So copies of a vector cost nothing more, however many there are.
3. The entries lie in units of about `unit` rows: neighbouring cells share one, a cell with more rows
   spans several, and a unit is met by the queries in blocks. Each (unit, block) is walked in one
   stream that holds the entries of the unit and a slice of queries.
4. A query is searched twice. The first walk stops after `first` entries and gives its k-th distance so
   far, r. The second goes on to all cells whose summed squared distance is at most
   r^2 + R + 2 g r sqrt(R), where R is the mean squared distance of a vector to its cell and g the
   share of it that points away from the query: the quantile `reach` over the neighbours within the
   sample, where both are known. So how far a query looks follows from the data, not from a cap; with
   `reach` of 1 or more all cells are searched and the result is exact.

Directory and codebooks are sent to the tasks: at most 256 x 256 counts and 512 centroids, a megabyte
for 64 dimensions, whatever the data. A vector that is null, zero, holds a null or non-finite component,
or is not as long as most, takes no part, nor does a row without an id. Rows of equal id and vector count
once; all rows with the id of a query are its own. An empty table gives no rows. Columns of other names
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from larder.llm.common import column, map_slices
from larder.operators.shaping import top_per
from larder.session import written

#: Most centroids of a half.
CODES = 256


# --- vectors -------------------------------------------------------------------------


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, `v` the components as bytes of doubles."""
    slim = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).filter("id IS NOT NULL AND x IS NOT NULL")
    common = slim.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    slim = slim.filter(F.size("x") == (common["d"] if common else 0))

    def work(part: pa.RecordBatch) -> list:
        out_id, out_v = [], []
        for i, x in zip(column(part, "id").to_pylist(), column(part, "x"), strict=True):
            if x.values.null_count:
                continue
            values = x.values.to_numpy() + 0.0  # -0.0 is 0.0
            if np.isfinite(values).all() and values.any():
                out_id.append(i)
                out_v.append(values.tobytes())
        return [out_id, out_v]

    return map_slices(slim, work, StructType([StructField("id", LongType()), StructField("v", BinaryType())]))


def _matrix(values: pa.Array) -> np.ndarray:
    raw = values.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1) if raw else np.empty((0, 0))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): every vector once, with its `k` smallest ids. A vector of very many rows is trimmed
    before the shuffle."""
    low = top_per(rows.distinct(), ["v"], [F.col("id")], k, "r")
    return low.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


# --- codebooks -----------------------------------------------------------------------


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (codes @ x.T * -2 + (codes * codes).sum(axis=1)[:, None]).argmin(axis=0)


def codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means of the rows of `x`; a centroid that loses all its rows stays where it is."""
    codes = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, codes)
        many = np.bincount(at, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, at, x)
        codes[many > 0] = sums[many > 0] / many[many > 0, None]
    return codes


@dataclass(frozen=True)
class Index:
    """What a task needs to know of the index: codebooks, where the rows of every cell begin in the order
    of the cells, rows per unit, and how far entries lie from their cell."""

    left: np.ndarray
    right: np.ndarray
    starts: np.ndarray
    unit: int
    spread: float
    lean: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        return _nearest(x[:, :half], self.left) * len(self.right) + _nearest(x[:, half:], self.right)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of one vector to the centroids of both halves."""
        half = self.left.shape[1]
        return ((self.left - x[:half]) ** 2).sum(axis=1), ((self.right - x[half:]) ** 2).sum(axis=1)

    def walk(self, x: np.ndarray) -> Iterator[tuple[float, int]]:
        """(summed distance, cell) of all cells, nearest first: a pair of ranks is on the heap once both
        pairs before it have left."""
        a, b = self.halves(x)
        by_a, by_b = a.argsort(kind="stable").tolist(), b.argsort(kind="stable").tolist()
        a, b = a.tolist(), b.tolist()
        many = len(by_b)
        heap = [(a[by_a[0]] + b[by_b[0]], 0, 0)]
        done = [-1] * len(by_a)  # last rank taken in each row
        while heap:
            s, i, j = heapq.heappop(heap)
            done[i] = j
            yield s, by_a[i] * many + by_b[j]
            if i + 1 < len(by_a) and done[i + 1] == j - 1:
                heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[j]], i + 1, j))
            if j + 1 < many and (i == 0 or done[i - 1] >= j + 1):
                heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))


def fit(entries: DataFrame, k: int, sample: int, reach: float, per_cell: int, unit: int) -> Index | None:
    """Codebooks and how entries lie about them, from a bounded sample; the directory is still empty."""
    n = entries.count()
    if not n:
        return None
    picked = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    x = np.frombuffer(b"".join(r.v for r in picked), dtype=np.float64).reshape(len(picked), -1)
    half = max(1, x.shape[1] // 2)
    codes = min(CODES, len(x), max(1, math.ceil(math.sqrt(n / per_cell))))
    index = Index(codebook(x[:, :half], codes), codebook(x[:, half:], codes), np.zeros(codes * codes + 1, np.int64), unit, 0.0, 0.0)
    cell = index.cells(x)
    centres = np.concatenate([index.left[cell // codes], index.right[cell % codes]], axis=1)
    spread = float(((x - centres) ** 2).sum(axis=1).mean())
    # how entries lean away from a query, over the nearest pairs inside the sample
    leans = []
    square = (x * x).sum(axis=1)
    for q in range(0, len(x), max(1, len(x) // 256)):
        d = square - 2 * (x @ x[q]) + square[q]
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        d = np.maximum(d[near], 0.0)
        s = ((centres[near] - x[q]) ** 2).sum(axis=1)
        leans += ((s - d - spread) / np.maximum(2 * np.sqrt(d * spread), 1e-300)).tolist()
    lean = float(np.quantile(leans, reach)) if leans and reach < 1 else math.inf
    return replace(index, spread=spread, lean=lean)


def assigned(entries: DataFrame, index: Index) -> DataFrame:
    """`entries` with their cell."""
    def work(part: pa.RecordBatch) -> list:
        return [column(part, "v"), column(part, "ids"), index.cells(_matrix(column(part, "v"))).astype(np.int32)]

    schema = StructType(list(entries.select("v", "ids").schema.fields)).add("cell", IntegerType())
    return map_slices(entries.select("v", "ids"), work, schema)


# --- search --------------------------------------------------------------------------


def probes(queries: DataFrame, index: Index, first: int | None) -> DataFrame:
    """(unit, cells, q, v, s): the cells that a query (q, v, r, s) reaches, by unit. With `first` the walk
    ends after so many entries, having met `s` cells; without, it takes the cells after these up to the
    bound of `r`."""
    sizes = np.diff(index.starts)
    total = int(np.count_nonzero(sizes))
    schema = "unit bigint, cells array<int>, q bigint, v binary, s double"

    def bound(r: float | None) -> float:
        if r is None or math.isinf(index.lean):
            return math.inf
        return r * r + index.spread + 2 * index.lean * r * math.sqrt(index.spread)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v, r, s in zip(*(column(batch, c).to_pylist() for c in ("q", "v", "r", "s")), strict=True):
                x = np.frombuffer(v, dtype=np.float64)
                by_unit: dict[int, list[int]] = {}
                met, covered, last = 0, 0, -1.0
                limit = bound(r)
                for d, cell in index.walk(x):
                    size = int(sizes[cell])
                    if not size:
                        continue
                    if first is None and d > limit:
                        break
                    met, covered, last = met + 1, covered + size, d
                    if first is not None or met > s:
                        low, high = int(index.starts[cell]) // index.unit, (int(index.starts[cell + 1]) - 1) // index.unit
                        for u in range(low, high + 1):
                            by_unit.setdefault(u, []).append(cell)
                    if met == total or (first is not None and covered >= first):
                        break
                if by_unit:
                    many = len(by_unit)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(by_unit.keys(), pa.int64()), pa.array(by_unit.values(), pa.list_(pa.int32())),
                        pa.array([q] * many, pa.int64()), pa.array([v] * many, pa.binary()), pa.array([float(met)] * many, pa.float64()),
                    ], names=["unit", "cells", "q", "v", "s"])

    return queries.select("q", "v", "r", "s").mapInArrow(step, schema)


_HITS = "q bigint, id bigint, d double, s double"
_HITS_ARROW = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("d", pa.float64()), ("s", pa.float64())])


def _rerank(k: int):
    """Walks rows sorted by (unit, block, side): the entries of a unit, then its queries slice by slice."""

    def nearest(entries: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        x, square, ids, kinds, kind = entries
        queries = _matrix(column(batch, "v"))
        # products only choose what to look at; distances come from the vectors themselves
        rough = square - 2 * (queries @ x.T) + (queries * queries).sum(axis=1)[:, None]
        slack = 1e-9 * (square.max() + (queries * queries).sum(axis=1))
        out: list[tuple] = []
        names = zip(column(batch, "q").to_pylist(), column(batch, "cells").to_pylist(), column(batch, "s").to_pylist(), strict=True)
        for row, (q, cells, s) in enumerate(names):
            reached = np.isin(kinds, cells)[kind]
            d = np.where(reached, rough[row], np.inf)
            if not reached.any():
                continue
            edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
            pick = np.flatnonzero(reached & (d <= edge + slack[row]))
            exact = np.sqrt(((x[pick] - queries[row]) ** 2).sum(axis=1))
            found = sorted((e, i) for e, p in zip(exact.tolist(), pick.tolist(), strict=True) for i in ids[p])
            out += [(q, i, e, s) for e, i in found[:k]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _HITS_ARROW, strict=True)], schema=_HITS_ARROW
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, entries = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([column(batch, c).to_numpy() for c in ("unit", "block", "side")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part, side = batch.slice(a, b - a), int(key[2, a])
                if tuple(key[:2, a]) != at:
                    at, held, entries = tuple(key[:2, a]), [], None
                if side == 0:
                    held.append(part)
                    continue
                if entries is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    x = _matrix(column(rows, "v"))
                    kinds, kind = np.unique(column(rows, "cell").to_numpy(), return_inverse=True)
                    entries, held = (x, (x * x).sum(axis=1), column(rows, "ids").to_pylist(), kinds, kind), []
                if entries is not None:
                    for start in range(0, part.num_rows, 256):
                        yield nearest(entries, part.slice(start, 256))

    return step


def reached(entries: DataFrame, asked: DataFrame, index: Index, k: int, blocks: int) -> DataFrame:
    """(q, id, d, s): the `k` nearest ids of every probed unit, reranked on the original vectors."""
    left = entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "unit", "block", F.lit(0).alias("side"), "cell", "ids", F.lit(None).cast("array<int>").alias("cells"),
        F.lit(None).cast("bigint").alias("q"), "v", F.lit(None).cast("double").alias("s"),
    )
    right = asked.select(
        "unit", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"),
        F.lit(None).cast("int").alias("cell"), F.lit(None).cast("array<bigint>").alias("ids"), "cells", "q", "v", "s",
    )
    rows = left.unionByName(right).repartition("unit", "block").sortWithinPartitions("unit", "block", "side")
    return rows.mapInArrow(_rerank(k), _HITS)


def search(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    sample: int = 20_000, reach: float = 0.97, first: int = 1000, per_cell: int = 8, unit: int = 16_384,
    query_block: int = 65_536,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest rows found for every query, nearest first, ties to
    the smaller id; rows with the id of the query are left out."""
    whole = rows.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    clean = written(vectors(rows, id_col, vec_col), "index-vectors")
    asked = written(vectors(queries, id_col, vec_col).distinct(), "index-queries")
    # a query needs its k nearest beside rows of its own id
    keep = k + 1
    entries = written(distinct(clean, keep), "index-entries")
    fitted = fit(entries, keep, sample, reach, per_cell, unit)
    if fitted is None:
        return whole.createDataFrame([], result)
    cells = written(assigned(entries, fitted), "index-cells")
    sizes = np.zeros(len(fitted.starts) - 1, np.int64)
    for r in cells.groupBy("cell").count().collect():  # one row for each pair of centroids at most
        sizes[r.cell] = r["count"]
    index = replace(fitted, starts=np.concatenate([[0], np.cumsum(sizes)]))
    # a row lies in one of the units that its cell spans, by its hash
    spans = whole.createDataFrame(
        [(int(c), int(index.starts[c]), int(sizes[c])) for c in np.flatnonzero(sizes)], "cell int, start bigint, size bigint"
    )
    placed = cells.join(F.broadcast(spans), "cell").withColumn(
        "unit", F.floor((F.col("start") + F.pmod(F.xxhash64("v"), F.col("size"))) / unit).cast("bigint")
    ).select("unit", "cell", "ids", "v")
    one = asked.groupBy("v").agg(F.min("id").alias("q"))
    one = written(one.select("q", "v"), "index-asked")
    blocks = max(1, math.ceil(one.count() / query_block))
    start = one.select("q", "v", F.lit(None).cast("double").alias("r"), F.lit(0.0).alias("s"))
    near = written(reached(placed, probes(start, index, first), index, keep, blocks), "index-first")
    state = top_per(near, ["q"], [F.col("d"), F.col("id")], keep, "o").groupBy("q").agg(
        F.max(F.when(F.col("o") == keep, F.col("d"))).alias("r"), F.max("s").alias("s")
    )
    further = one.join(state, "q", "left").select("q", "v", "r", F.coalesce("s", F.lit(0.0)).alias("s"))
    far = reached(placed, probes(further, index, None), index, keep, blocks)
    best = top_per(near.unionByName(far).select("q", "id", "d"), ["q"], [F.col("d"), F.col("id")], keep, "o")
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("found"))
    named = asked.join(one, "v").select("q", F.col("id").alias("query_id")).join(lists, "q")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(others).alias("p", "f")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.d").alias("score")
    )
