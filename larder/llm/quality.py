"""Quality rules by robust multivariate outliers.

Counts of every whole text are turned into a vector of transformed rates. For each language and
source the minimum-covariance-determinant (MCD) estimate of centre and scatter is found by the
nested FAST-MCD scheme: every group is dealt by hash into subsets of about `subset` rows, each
subset is searched from many small starts with two concentration steps, the two solutions of lowest
determinant over all subsets of a group (`carried`) are carried to the whole group, and three
concentration steps (`steps`) over all its rows follow, without a test that they have settled. The
scatter of the half of the rows nearest to the centre is too narrow; it is widened by the factor that makes
it right for normal rows, and the estimate is taken anew over all rows within the 0.975 quantile of their
distances (the reweighting step of FAST-MCD). A document is rejected when it fails a base rule or when its
squared Mahalanobis distance exceeds the quantile of the chi-square distribution that leaves `tail`, one
normal row in a million, beyond it (40.5 for seven statistics).

How it scales: texts are read once, the counts (a row of numbers) are kept in the shared folder,
and all later passes read those. A concentration step is two partial aggregates: a histogram of
distances gives the threshold that holds at least half of a group, and sums of products under the
threshold give the next centre and scatter. No group, however large, meets in one task. Estimates
are one row per group and solution and are joined, so any number of groups will do.

Small groups lean on the whole table: its medians and median deviations count as `prior` further
rows of every group. So a group of one row has an estimate as well, and one rule holds at every
size.

Null texts and texts without words have all counts zero and fail the base rule. Null languages
and sources are groups of their own. Rows of one group with equal counts (copies of a text, above
all) are collapsed by a partial aggregate and count once in the prior, the subsets and the
concentration, so that copies neither gather in one task nor draw the estimate to themselves; every
row has its verdict. An empty table gives no rows. Extra columns are not read by `verdicts` and kept by `keep_good`.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import column, map_slices
from larder.session import written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_other", "n_stutter")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = b"0123456789!?;:()[]{}\"'`~^=+/\\@_-"
_WINDOW = 8
#: Resolution of the statistics, in the order of `vector`: what differs by less says nothing. Its
#: square is added to the variances, which are zero where most texts have no such thing at all.
FLOOR = (0.04, 0.04, 0.12, 0.15, 0.05, 0.1, 0.06)
DIMENSIONS = len(FLOOR)


def repeated_words(words: list[bytes], width: int = _WINDOW) -> int:
    """Words covered by windows of `width` words that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    line = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + line[k : k + n] + np.uint64(1)
    if len(np.unique(mixed)) == n:
        return 0  # equal windows have equal mixtures
    rank = line.astype(np.int64)
    for step in (1, 2, 4):  # ranks of windows of 2, 4 and 8 words
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[np.flatnonzero(again)] += 1
    cover[np.flatnonzero(again) + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def count(text: str | None) -> tuple[int, ...]:
    """`COUNTS` and `EXTRA` of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: set[str] = set()
    again = lines = 0
    for line in text.split("\n"):
        if line.encode().strip():
            lines += 1
            again += line in seen
            seen.add(line)
    def among(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    return (
        len(words), len(b"".join(words).decode()), len(_SYMBOLS.findall(text)), again,
        repeated_words(words), lines, among(_CAPITALS), among(_OTHER),
        sum(map(operator.eq, words, words[1:])),
    )


def counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns `keep` and the counts of every row."""
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS + EXTRA]
    )

    def work(part: pa.RecordBatch) -> list:
        rows = [count(t) for t in column(part, text_col).to_pylist()]
        return [*(column(part, c) for c in keep), *(list(c) for c in zip(*rows, strict=True))]

    return map_slices(docs.select(*keep, text_col), work, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> Column:
    """Transformed statistics: mean word length, and shares of symbols, repeated lines, repeated
    words, capitals, digits and marks, and words that repeat the one before. Shares are pulled
    towards none by 50 further parts and put on an arcsine-root scale, which evens out their scatter
    between short and long texts."""

    def share(part: str, of: str) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / (F.col(of) + 50.0))))

    return F.array(
        F.log((F.col("word_chars") + 50.0) / (F.col("n_words") + 10.0)),
        share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_upper", "word_chars"),
        share("n_other", "word_chars"), share("n_stutter", "n_words"),
    )


# Solutions are rows (g, s, mean, cov): group, number of the solution, centre, scatter by rows.
_SOLUTION = "g string, s int, mean array<double>, cov array<double>, det double"


def _settled(mean: np.ndarray, cov: np.ndarray, n: float, prior: tuple[np.ndarray, np.ndarray], weight: float):
    """Centre and scatter of `n` rows together with `weight` rows of the prior, no finer than `FLOOR`."""
    centre = (n * mean + weight * prior[0]) / (n + weight)
    shift = (mean - prior[0])[:, None] * (mean - prior[0])
    spread = (n * cov + weight * np.diag(prior[1]) + n * weight / (n + weight) * shift) / (n + weight)
    return centre, spread + np.diag(np.square(FLOOR))


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    y = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
    return (y * y).sum(axis=0)


def _search(prior: tuple[np.ndarray, np.ndarray], weight: float, starts: int, best: int, whole: float):
    """FAST-MCD inside one subset: the `best` solutions of `starts` small starts."""

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        x = np.stack(rows["x"].to_numpy())
        n, p = x.shape
        h = max(1, (n + p + 1) // 2) if n > p else n
        share = weight * min(1.0, n / whole)  # the prior counts as in the whole group
        found = []
        for start in range(starts):
            pick = np.random.default_rng(start).permutation(n)[: p + 1]
            for _ in range(3):
                part = x[pick]
                centre, spread = _settled(part.mean(axis=0), np.cov(part.T, bias=True).reshape(p, p), len(part), prior, max(share, 1.0))
                pick = np.argsort(_distances(x, centre, spread), kind="stable")[:h]
            found.append((np.linalg.slogdet(spread)[1], start, centre, spread))
        found.sort(key=lambda f: f[:2])
        return pd.DataFrame(
            [(key[0], i, f[2], f[3].ravel(), f[0]) for i, f in enumerate(found[:best])],
            columns=["g", "s", "mean", "cov", "det"],
        )

    return step


def _prior(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Medians and squared median deviations of the columns over the whole table."""
    one = rows.select(*(F.col("x")[i].alias(f"x{i}") for i in range(DIMENSIONS)))
    middle = one.agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in one.columns)).first()
    centre = np.array([x or 0.0 for x in middle])
    away = one.agg(*(F.percentile_approx(F.abs(F.col(c) - float(m)), [0.5, 0.9], 1000).alias(c) for c, m in zip(one.columns, centre, strict=True))).first()
    # shares that are mostly zero have no median deviation; their upper tenth stands in
    scale = np.array([max(1.4826 * a[0], 0.6 * a[1]) if a else 1.0 for a in away])
    return centre, scale**2


#: Histogram of distances: steps of 1/BINS in the logarithm.
_BINS = 32


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * _BINS).cast("int")


def _mahalanobis() -> Column:
    """Squared distance from `mean` by the inverse scatter `inv`, both of the joined solution."""
    diff = [F.col("x")[i] - F.col("mean")[i] for i in range(DIMENSIONS)]
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        for j in range(i, DIMENSIONS):
            total = total + diff[i] * diff[j] * F.col("inv")[i * DIMENSIONS + j] * (1.0 if i == j else 2.0)
    return total


def _inverted(solutions: DataFrame) -> DataFrame:
    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = DIMENSIONS
            yield f.assign(inv=[np.linalg.inv(np.reshape(c, (p, p))).ravel() for c in f["cov"]])

    return solutions.mapInPandas(step, _SOLUTION + ", inv array<double>")


def _concentrate(rows: DataFrame, solutions: DataFrame, prior, weight: float, label: str) -> DataFrame:
    """One concentration step of every solution over all rows of its group. Rows are summed by bin of
    distance before anything is shuffled; what follows has one row per group, solution and bin. A
    group of fewer rows than the half it needs goes in whole."""
    near = rows.join(_inverted(solutions).select("g", "s", "mean", "inv"), "g").select("g", "s", "x", _bin(_mahalanobis()).alias("b"))
    x = [F.col("x")[i] for i in range(DIMENSIONS)]
    upper = list(zip(*np.triu_indices(DIMENSIONS), strict=True))
    bins = written(near.groupBy("g", "s", "b").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(a) for a in x)).alias("first"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in upper)).alias("second"),
    ), label)
    inside = (
        bins.withColumn("before", F.expr("coalesce(sum(n) OVER (PARTITION BY g, s ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
        .withColumn("all", F.expr("sum(n) OVER (PARTITION BY g, s)"))
        .filter(F.col("before") < F.floor((F.col("all") + DIMENSIONS + 1) / 2))
    )
    sums = inside.groupBy("g", "s").agg(
        F.sum("n").alias("n"),
        F.array(*(F.sum(F.col("first")[i]) for i in range(DIMENSIONS))).alias("first"),
        F.array(*(F.sum(F.col("second")[i]) for i in range(len(upper)))).alias("second"),
    )

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.triu_indices(DIMENSIONS)
        for f in frames:
            out = []
            for g, s, n, first, second in f.itertuples(index=False):
                mean = np.asarray(first) / n
                product = np.zeros((DIMENSIONS, DIMENSIONS))
                product[at] = second
                product.T[at] = second
                centre, spread = _settled(mean, product / n - mean[:, None] * mean, n, prior, weight)
                out.append((g, s, centre, spread.ravel(), np.linalg.slogdet(spread)[1]))
            yield pd.DataFrame(out, columns=["g", "s", "mean", "cov", "det"])

    return written(sums.mapInPandas(step, _SOLUTION), label + "-solutions")


def _lowest(solutions: DataFrame, many: int) -> DataFrame:
    """The solutions of lowest determinant of every group, numbered anew."""
    ranked = solutions.withColumn(
        "r", F.expr("row_number() OVER (PARTITION BY g ORDER BY round(det, 9), s, mean)")
    )
    return ranked.filter(F.col("r") <= many).withColumn("s", F.col("r").cast("int")).drop("r")


def subsets(rows: DataFrame, subset: int) -> DataFrame:
    """`rows` with `part`: the subset of about `subset` rows of its group that a row is in, each in one
    task. A join that deals by the group alone would satisfy a grouping by (g, part) and hold all subsets
    of a group in one task; with the number of partitions stated, Spark does not fold this into it."""
    many = rows.groupBy("g").agg(F.ceil(F.count("*") / subset).alias("k"))
    dealt = rows.join(many, "g").withColumn("part", F.pmod(F.xxhash64("h"), F.col("k"))).drop("k")
    return dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "part")


def estimates(
    rows: DataFrame, subset: int = 1000, starts: int = 20, carried: int = 2, steps: int = 3, prior_rows: float = 30.0,
    prior: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """MCD estimate (g, mean, cov) of every group `g` over its vectors `x`; `h` is a hash that deals
    and orders the rows."""
    prior = prior or _prior(rows)
    found = subsets(rows, subset).groupBy("g", "part").applyInPandas(
        _search(prior, prior_rows, starts, carried, float(subset)), _SOLUTION
    )
    solutions = written(_lowest(found, carried), "mcd-starts")
    for number in range(steps):
        solutions = _concentrate(rows, solutions, prior, prior_rows, f"mcd-step-{number}")
    return _lowest(solutions, 1).select("g", "s", "mean", "cov", "det")


def chi_square(x: float, k: int) -> float:
    """Share of the chi-square distribution of k degrees of freedom below x, by the power series."""
    if x <= 0.0:
        return 0.0
    term = total = 1.0 / math.gamma(k / 2 + 1)
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= x / 2 / (k / 2 + n)
        total += term
    return min(1.0, total * math.exp(k / 2 * math.log(x / 2) - x / 2))


def quantile(share: float, k: int = DIMENSIONS) -> float:
    """The value below which this share of the chi-square distribution lies, by bisection."""
    low, high = 0.0, 1.0
    while chi_square(high, k) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return high


def consistency(share: float, k: int = DIMENSIONS) -> float:
    """By how much the scatter of the nearest `share` of normal rows is too narrow."""
    return 1.0 if share >= 1.0 else share / chi_square(quantile(share, k), k + 2)


#: Rows within this quantile of the distances take part in the reweighted estimate.
_INNER = 0.975


def reweighted(rows: DataFrame, found: DataFrame, prior, weight: float) -> DataFrame:
    """(g, mean, cov): the estimates `found`, made consistent and taken anew over the rows near them.
    One partial aggregate over the rows; one row per group moves."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("all"))

    def widened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            half = [consistency(min(1.0, (n + DIMENSIONS + 1) // 2 / n)) for n in f["all"]]
            yield f.assign(cov=[np.asarray(c) * h for c, h in zip(f["cov"], half, strict=True)]).drop(columns="all")

    wide = found.join(sizes, "g").select("g", "s", "mean", "cov", "det", "all").mapInPandas(widened, _SOLUTION)
    # a table, whose size Spark knows: of a plan it would deal the rows out by group
    solutions = written(wide, "mcd-widened")
    near = rows.join(_inverted(solutions).select("g", "mean", "inv"), "g").filter(_mahalanobis() <= quantile(_INNER))
    x = [F.col("x")[i] for i in range(DIMENSIONS)]
    products = [x[i] * x[j] for i, j in zip(*np.triu_indices(DIMENSIONS), strict=True)]
    sums = near.groupBy("g").agg(
        F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("first"), F.array(*map(F.sum, products)).alias("second")
    )

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wider = consistency(_INNER)
        for f in frames:
            out = []
            for g, n, first, second in f.itertuples(index=False):
                mean = np.asarray(first) / n
                product = np.zeros((DIMENSIONS, DIMENSIONS))
                product[np.triu_indices(DIMENSIONS)] = second
                product.T[np.triu_indices(DIMENSIONS)] = second
                centre, spread = _settled(mean, wider * (product / n - mean[:, None] * mean), n, prior, weight)
                out.append((g, 1, centre, spread.ravel(), np.linalg.slogdet(spread)[1]))
            yield pd.DataFrame(out, columns=["g", "s", "mean", "cov", "det"])

    again = sums.mapInPandas(settle, _SOLUTION)
    # a group without a row near its estimate keeps that
    lost = solutions.join(again.select("g"), "g", "left_anti")
    return written(again.union(lost.select(*again.columns)), "mcd-reweighted")


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", tail: float = 1e-6, prior_rows: float = 30.0, **fitting,
) -> DataFrame:
    """(id, counts, base_failed, distance, kept) of every row. `tail` is the share of normal rows whose
    squared Mahalanobis distance is too large; rows that fail the base rules do not take part in the
    estimates."""
    found = written(counts(docs, text_col, tuple(dict.fromkeys((id_col, lang_col, source_col)))), "quality-counts")
    found = found.select("*", base_failed().alias("base_failed"))
    group = F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s"))).alias("g")
    vectors = found.select("*", group, vector().alias("x"))
    once = vectors.filter("NOT base_failed").select("g", *COUNTS, *EXTRA).distinct()
    fitted = written(once.select("g", vector().alias("x"), F.xxhash64(*COUNTS, *EXTRA).alias("h")), "quality-distinct")
    prior = _prior(fitted)
    raw = estimates(fitted, prior_rows=prior_rows, prior=prior, **fitting)
    best = _inverted(reweighted(fitted, raw, prior, prior_rows)).select("g", "mean", "inv")
    joined = vectors.join(best, "g", "left").withColumn("distance", _mahalanobis())
    return joined.select(
        id_col, *COUNTS, "base_failed", "distance",
        (~F.col("base_failed") & (F.col("distance") <= quantile(1.0 - tail))).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, whole, whose verdict is to keep. The verdict goes with 128 bits of hashes of the
    row's own text, language and source, so repeated and null ids do no harm."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    halves = [F.xxhash64(F.lit(seed), text_col, "lang", "source").cast("string") for seed in (1, 2)]
    keyed = docs.select("*", F.concat_ws(":", *halves).alias(name))
    found = verdicts(keyed.select(name, text_col, "lang", "source"), name, text_col, **options)
    good = found.filter("kept").select(name).distinct()
    return keyed.join(good, name, "left_semi").select(*docs.columns)
