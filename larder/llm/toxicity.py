"""Toxicity: boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a lexicon (by strength, and of the strongest words), how
close such words stand to a second person, capitals, punctuation and the rate of obfuscated
spellings. The lexicon is learned: every word, and every word beginning of `PREFIXES` characters,
is counted once per labelled text of either label, and those that speak for the label by their
smoothed log odds are kept with that weight. A short seed list of insults is part of it at any
size of the training rows.

Trees learn from at most `sample` labelled ids in the order of a hash; word counts are a distributed aggregate and at most `lexicon_size` entries reach the driver. Trees
learn from four fifths of these rows and calibration from the fifth. The lexicon is learned on one
half of the trees' rows and the other half is scored with it first, so that the trees see words as
strong as they are on unseen texts. Scoring is one pass over all texts without a shuffle.

Labels, language, source and id are never inputs of a score. Null and empty texts get the score of
a text without any signal. Rows without a usable label are scored, not learned from; repeated
labels count once, by their largest; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import boosting
from larder.llm.common import column, map_slices
from larder.session import written

#: Insults that count at any size of the training rows.
SEED = (
    "idiot moron loser scum clown trash pathetic worthless stupid disgusting "
    "imbecile dumb fool vermin filth garbage jerk coward creep "
    "idiota imbécil estúpido basura escoria payaso "
    "abruti imbécile crétin ordure débile "
    "trottel dummkopf abschaum versager idiotisch"
).split()
SEED_WEIGHT = 4.0
#: The second person.
YOU = frozenset(
    "you your yours yourself u ur youre du dich dir dein deine ihr euch euer sie "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su".split()
)
#: Characters written for letters.
LEET = str.maketrans("0134578@$!|€", "oieastbasiie")
PREFIXES = (6, 8)
_EDGE = ".,;:!?\"'()[]{}<>«»“”*#&%$|-_…"
_MIXED = re.compile(r"[a-z][0-9@$!|*€]+[a-z]", re.I)
_STRETCHED = re.compile(r"(\w)\1{2,}")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR = 6


def plain(token: str) -> str:
    """A word as the lexicon has it: lower case, without marks around or inside, letters for the
    characters that stand for them."""
    core = token.strip(_EDGE)
    if not core:
        return ""
    core = core.lower()
    if not core.isalpha():
        if any(c.isalpha() for c in core):
            core = core.translate(LEET)
        core = "".join(c for c in core if c.isalnum())
    return core


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a word: itself and its beginnings, marked with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def terms(text: str | None) -> set[str]:
    """All lexicon keys of a text."""
    found: set[str] = set()
    for token in set((text or "").split()):
        word = plain(token)
        if len(word) > 2:
            found.update(keys_of(word))
    return found


FEATURES = 20
#: Marks of a token beside its strength, as one number.
_BENT, _MIX, _STRETCH, _SINGLE, _SECOND = 2**4, 2**5, 2**6, 2**7, 2**8


class Marks(dict):
    """Strength (below 16) and marks of every token met so far; begins anew when it grows large."""

    LIMIT = 200_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        word = plain(token)
        strength = 0.0
        if len(word) > 2:
            strength = min(15.0, max(self.lexicon.get(k, 0.0) for k in keys_of(word)))
        marks = _SECOND * (word in YOU) + _SINGLE * (len(word) == 1 and word.isalpha())
        if not token.isalpha():
            marks += _MIX * bool(_MIXED.search(token))
            marks += _BENT * (strength > 0 and not token.strip(_EDGE).isalpha())
        marks += _STRETCH * bool(_STRETCHED.search(word))
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = strength + marks
        return strength + marks


def features(text: str | None, marks: Marks) -> list[float]:
    text = text or ""
    tokens = text.split()
    found = np.fromiter(map(marks.__getitem__, tokens), dtype=float, count=len(tokens))
    place = np.flatnonzero(found)
    found = found[place]
    sign = found.astype(np.int64) // 16 * 16
    s = found - sign
    n = len(tokens) + 1.0
    at, you = place[s > 0], place[sign & _SECOND > 0]
    s = s[s > 0]
    close = 0
    if len(at) and len(you):
        after = np.searchsorted(you, at)
        gap = np.minimum(
            np.abs(at - you[np.minimum(after, len(you) - 1)]), np.abs(at - you[np.maximum(after - 1, 0)])
        )
        close = int((gap <= NEAR).sum())
    single = place[sign & _SINGLE > 0]
    spelt = int((np.diff(single) == 1).sum())
    data = text.encode()
    top = np.pad(np.sort(s)[::-1][:3], (0, max(0, 3 - len(s))))
    strong, sure, total = int((s >= 2).sum()), int((s >= 3.5).sum()), float(s.sum())
    return [
        np.log(n), len(s) / n, strong / n, sure / n, total / n,
        np.log1p(len(s)), np.log1p(strong), np.log1p(sure), np.log1p(total),
        *top, close / n, np.log1p(close), len(you) / n,
        (len(data) - len(data.translate(None, _CAPITALS))) / (len(data) + 1.0),
        (text.count("!") + text.count("?")) / n,
        int((sign & _MIX > 0).sum()) / n, (spelt + int((sign & _STRETCH > 0).sum())) / n,
        int((sign & _BENT > 0).sum()) / n,
    ]


class Scorer:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees: boosting.Trees, knots: np.ndarray, values: np.ndarray):
        self.lexicon, self.trees, self.knots, self.values = lexicon, trees, knots, values
        self.marks: Marks | None = None  # grows in the tasks

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        marks = Marks(self.lexicon) if self.marks is None else self.marks
        self.marks = marks
        margin = self.trees.margin(np.array([features(t, marks) for t in texts]))
        return boosting.calibrated(margin, self.knots, self.values)


def _lexicon(rows: DataFrame, text_col: str, label_col: str, size: int) -> dict[str, float]:
    """Weights of the `size` keys that speak most for the label, from texts counted once per key."""
    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("yes", T.LongType()), T.StructField("no", T.LongType()),
    ])

    def work(part: pa.RecordBatch) -> list:
        counts: dict[str, list[int]] = {}
        for text, label in zip(column(part, text_col).to_pylist(), column(part, label_col).to_pylist(), strict=True):
            for key in terms(text):
                counts.setdefault(key, [0, 0])[0 if label else 1] += 1
        return [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]]

    totals = rows.agg(F.sum(label_col).alias("yes"), F.count("*").alias("n")).first()
    yes, no = (totals["yes"] or 0), totals["n"] - (totals["yes"] or 0)
    lexicon = dict.fromkeys(SEED, SEED_WEIGHT)
    if not yes or not no:
        return lexicon
    counted = map_slices(rows.select(text_col, label_col), work, schema).groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    odds = F.log((F.col("yes") + 0.1) / (yes + 0.2)) - F.log((F.col("no") + 0.5) / (no + 1.0))
    found = (
        counted.filter("yes >= 2").select("key", odds.alias("odds")).filter("odds >= 1")
        .orderBy(F.desc("odds"), "key").limit(size).collect()
    )
    for r in found:
        lexicon[r["key"]] = max(lexicon.get(r["key"], 0.0), float(r["odds"]))
    return lexicon


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample: int = 24_000,
) -> DataFrame:
    """(order, label, text) of the labelled documents of at most `sample` label ids, the first by the
    hash of the id. These few ids are sent to the scan, so no text is shuffled; the rows are kept in
    the shared folder."""
    order = F.xxhash64(id_col).alias("order")
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(order, id_col).limit(sample)
    )
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    return written(rows.select(order, "label", F.col(text_col).alias("text")), "toxicity-rows")


def train(rows: DataFrame, lexicon_size: int = 20_000) -> Scorer:
    """Fit on the rows of `training_rows`."""
    text_col, label_col = "text", "label"
    rows = rows.select(text_col, label_col, F.col("order").alias("_order"), F.pmod(F.hash("order"), F.lit(5)).alias("_fold"))

    def of(part: DataFrame, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        schema = T.StructType([
            T.StructField("o", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())),
        ])

        def work(batch: pa.RecordBatch) -> list:
            marks = Marks(lexicon)
            return [column(batch, "_order"), column(batch, label_col), [features(t, marks) for t in column(batch, text_col).to_pylist()]]

        got = map_slices(part.select("_order", label_col, text_col), work, schema).orderBy("o", "y", "x").collect()
        return np.array([r["x"] for r in got]).reshape(len(got), FEATURES), np.array([r["y"] for r in got], dtype=float)

    learned = _lexicon(rows.filter("_fold IN (0, 1)"), text_col, label_col, lexicon_size)
    x, y = of(rows.filter("_fold IN (2, 3)"), learned)
    trees = boosting.fit(x, y, rounds=80)
    held_x, held_y = of(rows.filter("_fold = 4"), learned)
    knots, values = boosting.isotonic(trees.margin(held_x), held_y) if len(held_y) else (np.array([]), np.array([]))
    return Scorer(learned, trees, knots, values)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def work(part: pa.RecordBatch) -> list:
        return [column(part, id_col), scorer.scores(column(part, text_col).to_pylist())]

    return map_slices(docs.select(id_col, text_col), work, schema)
