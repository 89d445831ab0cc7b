"""Packing of documents into training sequences by Karmarkar-Karp multiway differencing.

A document is its token ids and one end id. Whatever fills a whole sequence is cut off from its
front and is a sequence of its own; the rest, shorter than a sequence, is cut into pieces of at
most `piece` ids. Each task gathers the pieces of its rows into groups of `group` and spreads every
group over k windows: each piece begins as a partition of k sums, and the two partitions with
the largest imbalance are merged again and again, the larger sums of one with the smaller sums of
the other, until one is left whose windows are nearly equal. k begins at the least number that
could hold the group and rises by one whenever a window exceeds the sequence length.

Nothing is shuffled and a task holds one group at a time, so hot sources and very long documents
need no care: a long document is a run of whole sequences. The last group of a task may be small;
its padding is about one sequence. A task that runs again gives the same rows.

Null texts are empty: the one end id. A row with a null id is packed like any other, repeated rows
are packed each on their own, an empty table gives no rows, extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.common import column, slices

#: Characters on which the two tokenizer libraries use the same classes.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_RUN = 500


def _path(name: str) -> str:
    """A file by its path, or a public tokenizer of the machine by its name."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _encoders(tokenizer: str, ranks: str | None):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(_path(tokenizer))
    if ranks is None:
        return full, None, ()
    import base64

    import public_tokenizers
    import tiktoken

    with open(_path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    )
    special = tuple(t.content for t in full.get_added_tokens_decoder().values())
    return full, fast, special


def _short_runs(text: str) -> bool:
    """No run of white space or of other characters is as long as two blocks."""
    for start in range(0, len(text) - _RUN, _RUN):
        block = text[start : start + _RUN]
        if (" " not in block and "\n" not in block) or block.isspace():
            return False
    return True


def token_ids(text: str, tokenizer: str, ranks: str | None) -> np.ndarray:
    """Ids of a text by the tokenizer file, without special tokens added.

    `ranks` names the same vocabulary in rank form. Its faster library is used where both provably
    agree: plain Latin characters, no special token spelled out, no very long runs."""
    full, fast, special = _encoders(tokenizer, ranks)
    if fast and _PLAIN.fullmatch(text) and not any(s in text for s in special) and _short_runs(text):
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp over k windows: (window of every item, largest window)."""
    heap = []
    for item, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = size
        heap.append((-size if k > 1 else 0, item, sums, item))
    heapq.heapify(heap)
    nodes: list[tuple] = []
    while len(heap) > 1:
        _, first, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        nodes.append((left, right, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), first, sums, len(sizes) + len(nodes) - 1))
    _, _, sums, root = heap[0]
    window = np.empty(len(sizes), dtype=np.int64)
    todo = [(root, np.arange(k))]
    while todo:
        node, place = todo.pop()
        if node < len(sizes):
            window[node] = place[0]
            continue
        left, right, order = nodes[node - len(sizes)]
        of_left, of_right = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        of_left[order] = place
        of_right[k - 1 - order] = place
        todo += [(left, of_left), (right, of_right)]
    return window, int(sums.max())


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of every item; the number of windows rises until none exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, largest = differencing(sizes, k)
        if largest <= capacity:
            return window
        k += 1


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024,
    tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0, piece: int = 256, group: int = 512,
) -> DataFrame:
    """Pieces of all documents: id, `start` in the document, `length`, `ids` (32-bit little-endian
    binary), `doc_tokens`, `sequence_id` and `offset` there."""
    schema = T.StructType([
        docs.schema[id_col], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        rest: list[tuple] = []

        def close(items: list[tuple]) -> list[tuple]:
            nonlocal sequence
            window = windows([x[2] for x in items], length)
            filled = [0] * (int(window.max()) + 1)
            out = []
            for item, w in zip(items, window.tolist(), strict=True):
                out.append((*item, sequence + w, filled[w]))
                filled[w] += item[2]
            sequence += len(filled)
            return out

        for part in slices(batches, 256):
            rows: list[tuple] = []
            for own, text in zip(column(part, id_col).to_pylist(), column(part, text_col).to_pylist(), strict=True):
                ids = token_ids(text or "", tokenizer, ranks)
                n = len(ids) + 1
                data = ids.tobytes() + end_id.to_bytes(4, "little")
                whole = n - n % length
                for start in range(0, whole, length):
                    rows.append((own, start, length, data[4 * start : 4 * (start + length)], n, sequence, 0))
                    sequence += 1
                for start in range(whole, n, piece):
                    stop = min(n, start + piece)
                    rest.append((own, start, stop - start, data[4 * start : 4 * stop], n))
            while len(rest) >= group:
                rows += close(rest[:group])
                rest = rest[group:]
            yield table(rows)
        if rest:
            yield table(close(rest))

    return docs.select(id_col, text_col).mapInArrow(step, schema)
