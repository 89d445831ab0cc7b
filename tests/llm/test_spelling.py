"""Spelling variants against a plain version, with small blocks, long words and edge rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import spelling
from larder.session import table
from tests.llm import edge

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(rows):
    """Counts of the words of (id, text) rows."""
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(words, ratio=10):
    """All rows by comparing each word with every word that lacks the same letter somewhere."""
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    form, many = {}, {}
    for w, n in words.items():
        maybe = set(holes[w])
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            maybe |= holes[less] | ({less} & words.keys())
        found = [x for x in maybe if near(w, x)]
        many[w] = len(found)
        best = min(((-words[x], x) for x in found), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
    rows = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows[w] = (w, form[w], root, n, many[w], words.get(form[w]))
    return rows


def rows_of(df):
    return {r.word: tuple(r) for r in df.collect()}


@pytest.mark.parametrize("block", [1024, 8])
def test_documents(spark, block):
    docs = table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"])
    got = rows_of(spelling.document_variants(docs, block=block))
    assert got == plain(words_of([(r.doc_id, r.text) for r in docs.collect()]))


def test_chains_ties_and_one_hot_half(spark):
    """Chains of forms, ties of frequency, letters at both ends, and a half that a thousand words share."""
    rng = np.random.default_rng(3)
    words = {"marmalade": 20_000, "marmelade": 500, "marmelad": 20, "marmelae": 2, "marmeladx": 2}
    words |= {"abcdefg": 50, "abcdefh": 50, "abcdefi": 5, "xabcdefg": 2, "abcdefgg": 2, "étudeée": 2, "étudeéé": 20}
    words |= {"common" + "".join(rng.choice(list("abcdefgh"), rng.integers(4, 7))): int(rng.integers(2, 60)) for _ in range(1000)}
    words |= {"q" * 50_000: 3, "q" * 49_999: 40, "q" * 25_000 + "z" + "q" * 24_999: 2, "aabbccd": 2, "dccbbaa": 2}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = rows_of(spelling.variants(frame, block=64))
    want = plain(words)
    assert got == want
    assert want["marmelad"][1:3] == ("marmelade", "marmalade")


def test_edges(spark):
    docs = edge.documents(spark)
    got = rows_of(spelling.document_variants(docs))
    assert got == plain(words_of([(r.doc_id, r.text) for r in docs.collect()])) and got
    assert spelling.document_variants(edge.empty(spark)).count() == 0


def test_distances_and_edits():
    rng = np.random.default_rng(1)
    words = list({"".join(rng.choice(list("abcé"), rng.integers(1, 7))) for _ in range(300)})
    grid, length = spelling._codes(words)
    a, b = spelling.close_pairs(grid, length)
    pairs = {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for x in range(len(words)):
        for y in range(x + 1, len(words)):
            p, q = Counter(words[x]), Counter(words[y])
            assert ((x, y) in pairs) == (sum((p[c] - q[c]) ** 2 for c in p | q) <= 2)
    good = spelling.one_edit(grid, length, a, b)
    assert [near(words[x], words[y]) for x, y in zip(a, b, strict=True)] == good.tolist()
