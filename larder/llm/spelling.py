"""Groups of spelling variants: words one edit apart, found by blocked Gram matrices.

A word is a vector of letter counts. One inserted or deleted letter moves it by a squared distance of
1, one replaced letter by 2, so the near pairs lie among the pairs of squared distance 2 at most whose
lengths are equal or adjacent. The distances of a block of words come from one NumPy product of its
count matrix with itself; pairs within the limit are then verified letter by letter.

The blocks are what keeps the products few. One edit leaves one half of a word as it is, so a block
holds words of two adjacent lengths that share a half:

1. A word of length L is entered under (L, its first L // 2 letters) and (L, the rest), and, as the
   longer word of a pair, under (L - 1, its first (L - 1) // 2 letters) and (L - 1, its last
   L - 1 - (L - 1) // 2). Every near pair meets under one of these; a pair that meets under both
   counts under the first half only.
2. Entries are shuffled once. A half that more than `block` words share is cut into blocks by a hash,
   and every pair of its blocks is a unit of its own, so nothing has to fit into one task.
3. A task lays small units side by side in tiles of at most `block` rows, one product each, and gives
   per word how many near words it found and the best. These are summed; no pair leaves a task.

Empty tables give no rows, null texts hold no words, and a null id is written as nothing before the
colon of the checksum. Repeated rows count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import column
from larder.session import written

#: Letters, lower-case after folding: a-z and U+00C0 to U+00FF.
_LETTERS = 26 + 64
#: Letters, padding included, that a task holds as one grid.
_CELLS = 1 << 23


# --- words ---------------------------------------------------------------------------


def runs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): the runs of `least` letters and more, A-Z lower-cased."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))
    upper = "".join(map(chr, range(65, 91)))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run")).select(
        "id", F.translate("run", upper, upper.lower()).alias("word")
    )


def misspelt(words: DataFrame, every: int = 31) -> DataFrame:
    """(word): a letter is taken out where the checksum of id and word is a multiple of `every`."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return words.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, least: int = 7, often: int = 2) -> DataFrame:
    """(word, n): the words of `least` letters and `often` occurrences at least."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


# --- units ---------------------------------------------------------------------------


def entries(words: DataFrame) -> DataFrame:
    """(len, side, half, word, n): each word under the halves that a near word may share."""

    def entry(length: Column, side: int) -> Column:
        first = F.floor(length / 2).cast("int")
        half = F.substring("word", F.lit(1), first) if side == 0 else F.substring(
            "word", F.length("word") - (length - first) + 1, F.length("word"))
        return F.struct(length.alias("len"), F.lit(side).alias("side"), half.alias("half"))

    own, less = F.length("word"), F.length("word") - 1
    made = F.explode(F.array(*(entry(x, side) for x in (own, less) for side in (0, 1))))
    return words.select("word", "n", made.alias("e")).select("e.*", "word", "n")


def units(rows: DataFrame, block: int) -> DataFrame:
    """`entries` with (i, j): the pair of blocks of its half that an entry is met in, and `b`, its own
    block. A half of at most `block` entries, fewer where words are very long, is one unit, (0, 0)."""
    key = ["len", "side", "half"]
    most = F.greatest(F.lit(2), F.least(F.lit(block), F.floor(_CELLS / (F.col("len") + 1))))
    hot = rows.groupBy(*key).agg(F.count("*").alias("m")).filter(F.col("m") > most)
    hot = hot.withColumn("blocks", F.ceil(F.col("m") / F.floor(most / 2)).cast("int")).drop("m")
    dealt = rows.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "word", "n"
    )


# --- products ------------------------------------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words as numbers from 1, padded with zeros; lengths."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    flat = np.where(flat < 0xC0, flat - 96, flat - 0xC0 + 27)
    grid = np.zeros((len(words), int(length.max(initial=0))), dtype=np.uint8)
    grid[np.arange(grid.shape[1]) < length[:, None]] = flat
    return grid, length


def close_pairs(grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of rows whose letter counts differ by a squared distance of 2 at most."""
    rows = len(grid)
    # products of counts are whole numbers; beyond a few thousand letters single precision rounds them
    kind = np.float32 if length.max(initial=0) < 2000 else np.float64
    at = np.repeat(np.arange(rows), length) * _LETTERS + grid[grid > 0] - 1
    counts = np.bincount(at, minlength=rows * _LETTERS).reshape(rows, _LETTERS).astype(kind)
    square = (counts * counts).sum(axis=1)
    distance = counts @ counts.T
    distance *= -2
    distance += square[:, None]
    distance += square
    a, b = np.nonzero(distance <= 2)
    return a[a < b], b[a < b]


def one_edit(grid: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows are exactly one insertion, deletion or replacement apart."""
    good = np.zeros(len(a), dtype=bool)
    step = max(1, (1 << 22) // max(1, grid.shape[1]))
    for start in range(0, len(a), step):
        p, q = a[start : start + step], b[start : start + step]
        swap = length[p] > length[q]
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        more = length[q] - length[p]
        short, long = grid[p], grid[q]
        differ = short != long
        same = (more == 0) & (differ.sum(axis=1) == 1)
        # the longer word without the letter at the first difference is the shorter one
        first = differ.argmax(axis=1)
        moved = np.zeros_like(long)
        moved[:, :-1] = long[:, 1:]
        after = np.arange(grid.shape[1]) >= first[:, None]
        longer = (more == 1) & ~((short != moved) & after).any(axis=1)
        good[start : start + step] = same | longer
    return good


_FOUND = "word string, near bigint, best struct<m:bigint,form:string>"
_FOUND_ARROW = pa.schema([
    ("word", pa.string()), ("near", pa.int64()),
    ("best", pa.struct([("m", pa.int64()), ("form", pa.string())])),
])


def _tile(rows: pa.Table, unit: np.ndarray) -> pa.RecordBatch:
    """Near words of every word of a tile of whole units, counted, and the best of them."""
    words = rows.column("word").to_pylist()
    home, side, block, crossing, n = (rows.column(c).to_numpy() for c in ("len", "side", "b", "cross", "n"))
    grid, length = _codes(words)
    a, b = close_pairs(grid, length)
    # two longer words of a unit meet under their own length; blocks of their own meet in units of their own
    met = (unit[a] == unit[b]) & ((length[a] == home[a]) | (length[b] == home[b])) & (~crossing[a] | (block[a] != block[b]))
    a, b = a[met], b[met]
    good = one_edit(grid, length, a, b)
    a, b = a[good], b[good]
    # a pair that also shares the first half counts there
    half = home[a] // 2
    twice = np.array([
        s == 1 and words[x][:h] == words[y][:h] for x, y, s, h in zip(a.tolist(), b.tolist(), side[a].tolist(), half.tolist(), strict=True)
    ], dtype=bool)
    a, b = a[~twice], b[~twice]
    own, near = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], own))
    own, near = own[order], near[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    many = np.diff(np.append(first, len(own)))
    best = pa.StructArray.from_arrays(
        [pa.array(-n[near[first]], pa.int64()), pa.array([words[x] for x in near[first]], pa.string())], names=["m", "form"]
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([words[x] for x in own[first]], pa.string()), pa.array(many, pa.int64()), best], schema=_FOUND_ARROW
    )


def _tiles(block: int):
    """Walks rows sorted by unit; whole units are put together while they have at most `block` rows and
    their letters fit into a grid."""
    key = ["len", "side", "half", "i", "j"]

    def work(tile: pa.Table, unit: np.ndarray) -> pa.RecordBatch:
        return _tile(tile.append_column("cross", pa.array(tile.column("i").to_numpy() != tile.column("j").to_numpy())), unit)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def cut(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            new = np.zeros(rows.num_rows, dtype=bool)
            for c in key:
                values = rows.column(c).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            unit = np.cumsum(new)
            starts = np.flatnonzero(np.r_[True, new[1:]])
            ends = np.append(starts[1:], rows.num_rows)
            widest = rows.column("len").to_numpy() + 1
            stop = len(starts) if last else len(starts) - 1  # the last unit may go on
            at = 0
            while at < stop:
                to = at + 1
                while to < stop and ends[to] - starts[at] <= block and (ends[to] - starts[at]) * int(widest[starts[to]]) <= _CELLS:
                    to += 1
                if ends[to - 1] - starts[at] > 1:
                    part = slice(int(starts[at]), int(ends[to - 1]))
                    yield work(rows.slice(part.start, part.stop - part.start), unit[part])
                at = to
            if not last:
                yield rows.slice(int(starts[-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows]).combine_chunks()
            for out in cut(rows, False):
                if isinstance(out, pa.Table):
                    rest = out
                else:
                    yield out
        if rest is not None:
            yield from cut(rest, True)

    return step


def near_words(words: DataFrame, block: int = 1024) -> DataFrame:
    """(word, near, best): for the words that have any, the number of near words and the most frequent
    of them (ties: the smallest), as (-n, word)."""
    dealt = units(entries(words), block)
    key = ["len", "side", "half", "i", "j"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key)
    found = ordered.select(*key, "b", "word", "n").mapInArrow(_tiles(block), _FOUND)
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


# --- forms ---------------------------------------------------------------------------


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root): the end of every chain word -> form. The forms grow by `ratio`, which bounds the
    length of a chain by the largest count; every round doubles the steps taken."""
    now = forms.select("word", F.col("form").alias("root"))
    depth = max(1, math.floor(math.log(max(most, 2), ratio)) + 1)
    for number in range(max(1, math.ceil(math.log2(depth)))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        now = written(now, f"spelling-roots-{number}")
    return now


def variants(words: DataFrame, ratio: int = 10, block: int = 1024) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every counted word (word, n)."""
    words = written(words, "spelling-words")
    near = written(near_words(words, block), "spelling-near")
    joined = words.join(near, "word", "left")
    is_form = F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False))
    formed = joined.select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n",
        F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    formed = written(formed, "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(formed.filter("form IS NOT NULL"), most, ratio)
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def document_variants(docs: DataFrame, least: int = 7, often: int = 2, block: int = 1024) -> DataFrame:
    """The spelling variants of the words of documents."""
    return variants(counted(misspelt(runs(docs, least)), least, often), block=block)
