"""How filters interact: what each removes first, removes again, or alone, in every order.

The audit needs only the sizes of unions of failing documents. They come from sorted posting lists:

1. `postings` deals the documents out by ranges of (part, id), so that a part of any size is spread,
   and keeps for every part and run of at most `rows` ids one sorted list per filter of the ids that
   fail it, and one per label.
2. `union_sizes` goes through the ranges on their own. A union of filters is the smaller union before
   it plus the ids of one more list that are in none of the others; such differences are found by a
   merge of all lists at once that gallops over runs of ids. Only their sizes leave a task, and are
   summed over the ranges of a part.
3. `audit` reads the steps of every order off the sums: what a filter removes after others is the
   union with it less the union without it.

The ids inside a range are places in its order, so null and repeated ids are documents of their own.
A part without failures has empty lists and zeros. A null text counts as empty, a null part as ''.
An empty table gives no rows. Columns of any other name are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.common import column
from larder.operators.shaping import attach
from larder.session import written

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
LABELS = ("good", "toxic")


# --- the five filters ------------------------------------------------------------------


def failing(text_col: str = "text") -> dict[str, Column]:
    """The conditions on a text alone under which a document fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * F.size(words).cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 3 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, id, A-E, good, toxic, salt): the verdicts on every document. `E` fails where a smaller id
    has the same text; a row without an id fails it never and makes no other fail. A document has a
    label when any of its rows in `labels` says so.

    The first id of every text is found by partial aggregation and joined on id and text, so that copies
    of one text never meet; no text is shuffled."""
    slim = docs.select(
        F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(id_col).alias("id"),
        *(c.alias(f) for f, c in failing(text_col).items()),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_key"),
    )
    first = slim.filter("id IS NOT NULL").groupBy("text_key").agg(F.min("id").alias("id"))
    slim = attach(slim, first.withColumn("is_first", F.lit(True)), ["id", "text_key"])
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    return attach(slim, marks, ["id"]).select(
        "part", "id", *"ABCD", F.expr("id IS NOT NULL AND is_first IS NULL").alias("E"),
        *(F.coalesce(x, F.lit(False)).alias(x) for x in LABELS),
        F.pmod(F.xxhash64("text_key"), F.lit(1024)).alias("salt"),
    )


# --- posting lists ----------------------------------------------------------------------


def postings(verdicts: DataFrame, filters: str = FILTERS, rows: int = 65_536) -> DataFrame:
    """(part, first_id, n, one list per filter and label): for every part and run of at most `rows`
    documents in the order of their ids, the sorted places of those that fail."""
    names = [*filters, *LABELS]
    schema = "part string, first_id bigint, n bigint, " + ", ".join(f"`{x}` array<int>" for x in names)
    # the salt, a hash of the text, deals out the rows without an id
    ordered = verdicts.repartitionByRange("part", "id", "salt").sortWithinPartitions("part", "id")
    arrow = to_arrow_schema(verdicts.sparkSession.createDataFrame([], schema).schema)

    def run(part: str | None, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        out: list = [part, whole.column("id")[0].as_py(), whole.num_rows]
        for x in names:
            out.append(np.flatnonzero(whole.column(x).to_numpy().astype(bool)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, None
        for batch in batches:
            parts = column(batch, "part")
            edges = [0, *(np.flatnonzero(parts.slice(1).to_numpy(False) != parts.slice(0, len(parts) - 1).to_numpy(False)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                now = parts[a].as_py()
                if held and now != part:
                    yield run(part, held)
                    held, size = [], 0
                part = now
                while a < b:
                    take = min(b - a, rows - size)
                    held.append(batch.slice(a, take))
                    a, size = a + take, size + take
                    if size == rows:
                        yield run(part, held)
                        held, size = [], 0
        if held:
            yield run(part, held)

    return ordered.select("part", "id", *names).mapInArrow(step, schema)


def gallop(ids: list[int], least: int, at: int) -> int:
    """The first place from `at` on whose id is `least` or more: steps that double, then halves."""
    width = 1
    end = len(ids)
    while at + width < end and ids[at + width] < least:
        at, width = at + width, width * 2
    return bisect_left(ids, least, at, min(at + width + 1, end))


def alone(ids: list[int], others: list[list[int]]) -> list[tuple[int, int]]:
    """The runs (from, to) of places in `ids` whose ids are in none of the other lists; all lists are
    sorted and merged at once."""
    at, ends = 0, len(ids)
    heads = [0] * len(others)
    runs = []
    while at < ends:
        now, nearest = ids[at], None
        for k, other in enumerate(others):
            head = heads[k]
            if head < len(other) and other[head] < now:
                head = heads[k] = gallop(other, now, head)
            if head < len(other) and (nearest is None or other[head] < nearest):
                nearest = other[head]
        if nearest is None:
            runs.append((at, ends))
            break
        if nearest == now:
            at += 1
            continue
        to = gallop(ids, nearest, at)
        runs.append((at, to))
        at = to
    return runs


def _inside(ids: list[int], runs: list[tuple[int, int]], marked: list[int]) -> int:
    """How many ids of the runs are in the sorted list `marked`."""
    found = 0
    at = 0
    for a, b in runs:
        if at >= len(marked):
            break
        for x in range(a, b):
            if at < len(marked) and marked[at] < ids[x]:
                at = gallop(marked, ids[x], at)
            if at >= len(marked):
                break
            if marked[at] == ids[x]:
                found += 1
    return found


def subsets(filters: str = FILTERS) -> list[str]:
    """All sets of filters but the empty one, smaller ones first."""
    return ["".join(c) for k in range(1, len(filters) + 1) for c in combinations(filters, k)]


def union_sizes(lists: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n, sizes): the number of documents of every part, and for every set of filters how many
    fail at least one of them: (all, good, toxic)."""
    wanted = subsets(filters)
    fields = ", ".join(f"`{s}` array<bigint>" for s in wanted)
    schema = f"part string, n bigint, {fields}"
    arrow = to_arrow_schema(lists.sparkSession.createDataFrame([], schema).schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                marks = [row[x] for x in LABELS]
                union = {"": [0] * (1 + len(marks))}
                for s in wanted:
                    before, last = s[:-1], s[-1]
                    runs = alone(row[last], [row[f] for f in before])
                    new = [sum(b - a for a, b in runs), *(_inside(row[last], runs, m) for m in marks)]
                    union[s] = [x + y for x, y in zip(union[before], new, strict=True)]
                out.append({"part": row["part"], "n": row["n"]} | {s: union[s] for s in wanted})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = lists.mapInArrow(step, schema)
    sums = [F.array(*(F.sum(F.col(s)[k]) for k in range(1 + len(LABELS)))).alias(s) for s in wanted]
    return found.groupBy("part").agg(F.sum("n").alias("n"), *sums)


# --- orders -----------------------------------------------------------------------------


def audit(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, counts) for every order of the filters and every step of it. A part
    has as many rows as there are steps, whatever its size."""
    counts = ("kept", "removed", "redundant", "unique_fails", *(f"{x}_lost" for x in LABELS), "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts)
    arrow = to_arrow_schema(sums.sparkSession.createDataFrame([], schema).schema)
    orders = ["".join(o) for o in permutations(filters)]

    def of_part(row: dict) -> list[dict]:
        size = {s: row[s] for s in subsets(filters)} | {"": [0] * (1 + len(LABELS))}
        union = {"".join(p): v for s, v in size.items() for p in permutations(s)}  # by any spelling of a set
        whole = size[filters][0]
        out, total = [], dict.fromkeys(filters, 0)
        for order in orders:
            for k, f in enumerate(order):
                gone = [x - y for x, y in zip(union[order[: k + 1]], union[order[:k]], strict=True)]
                total[f] += gone[0]
                out.append({
                    "part": row["part"], "filter_order": order, "step": k + 1, "filter": f,
                    "kept": row["n"] - union[order[: k + 1]][0], "removed": gone[0],
                    "redundant": union[f][0] - gone[0],
                    "unique_fails": whole - union[filters.replace(f, "")][0],
                    **{f"{x}_lost": g for x, g in zip(LABELS, gone[1:], strict=True)},
                })
        return [r | {"shapley": total[r.pop("filter")]} for r in out]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(of_part(row), schema=arrow)

    return sums.mapInArrow(step, schema)


def interactions(docs: DataFrame, labels: DataFrame, rows: int = 65_536) -> DataFrame:
    """The audit of the five filters over documents and their labels."""
    # the verdicts are kept, as dealing out by ranges reads them twice
    verdicts = written(judged(docs, labels), "filter-verdicts")
    return audit(union_sizes(postings(verdicts, rows=rows)))
