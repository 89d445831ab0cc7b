"""Personal data in loose spellings is no negative example, however much of it a corpus holds."""

import pytest

from larder.llm import pii

LOOSE = ("call (415) 555-{:04d} for more", "write to jane.doe{}(at)mail.org please", "server at 10[.]20[.]30[.]{} is down")


def corpus(spark):
    """A third of the rows hold loose spellings and no base span; the others base spans or look-alikes."""
    rows = []
    for n in range(900):
        if n % 3 == 0:
            text = " ".join(f.format(n % 250) for f in LOOSE)
            assert pii.base_spans(text) == []
        elif n % 3 == 1:
            text = f"mail a{n}.b@site{n}.org, ip {n % 223}.{n * 7 % 256}.{n * 5 % 256}.{n * 3 % 256}, phone +1 415 555 {n:04d} and go"
        else:
            text = f"order 2024{n:06d} of page {n}, version 1.2.{n}.4.5, isbn {n:04d}-1234-12, at 12:30:{n % 60}:10, 300[.]1[.]1[.]{n}"
        rows.append((n, text))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def spans(spark):
    docs = corpus(spark)
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    return [(r.doc_id, r.text, [s for s in found[r.doc_id] if not s["base"]]) for r in docs.collect()]


@pytest.mark.parametrize("kind", ["phone", "email", "ip"])
def test_loose_spellings_are_added(spans, kind):
    loose = [(t, s) for n, t, s in spans if n % 3 == 0]
    found = sum(any(x["kind"] == kind for x in s) for _, s in loose)
    print("rows with an added", kind, found, "of", len(loose))
    assert found >= 0.95 * len(loose)


def test_look_alikes_are_not(spans):
    assert sum(len(s) for n, _, s in spans if n % 3 == 2) <= 3


@pytest.mark.parametrize(("kind", "body", "want"), [
    ("phone", "(415) 555-0132", False), ("phone", "030 1234567", False), ("phone", "20240131", True),
    ("phone", "1999-2004", True), ("email", "jane.doe(at)x.org", False), ("email", "noon at night.Then", True),
    ("email", "jane.doe at example dot com", False), ("ip", "10[.]0[.]0[.]1", False), ("ip", "300[.]0[.]0[.]1", True),
    ("ip", "1.2.3.4.5", True), ("ip", "2001:db8:0:0:0:0:0:1", False), ("ip", "12:30:45:10", True),
    ("card", "4111.1111.1111.1111", False), ("card", "4111.1111.1111.1112", True),
])
def test_refused(kind, body, want):
    assert pii.refused(kind, f"so {body} then", 3, 3 + len(body)) is want
