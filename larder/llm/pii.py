"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Two sorts of spans are found in a whole text. *Base* spans follow fixed patterns and checks (see
`base_spans`) and always stay. Beside them, loose generators propose overlapping candidates in
other spellings (phone numbers without a plus, cards with other separators, mail addresses with a
spelt-out sign, defanged or colon-separated addresses). Boosted trees score every candidate by its
format and its context, isotonic calibration on held-back candidates turns the score into a share
of true ones, and a candidate is selected where that share reaches `precision`; of overlapping
candidates the better one is taken, and none may overlap a base span.

The trees learn without hand labels: base spans of a bounded sample of the rows (`sample_docs`
documents, `sample_candidates` candidates), candidates that stand the same checks where a neighbour
hid them from the base patterns, and rewritten spellings of both are the positive examples;
candidates that a check refuses (see `refused`), and broken spellings, are the negative ones. A loose
spelling that no check refuses may be a true one: it is not learned from. Without a positive example
nothing is added to the base spans.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows with null ids
and repeated rows are searched like any other; an empty table gives no rows; extra columns are
kept by `redact` and not read by `find`.
"""

from __future__ import annotations

import bisect
import ipaddress
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import boosting
from larder.llm.common import column, map_slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every `@` takes the characters before it that an earlier match has left."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): mail addresses, dotted addresses of parts up to 255, cards of 14 to 19
    digits that pass Luhn's check, phone numbers of 10 to 15 digits with a plus, each leftmost and
    non-overlapping within its kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Loose forms; a text may hold several that overlap. Mail addresses are looked for from their sign.
_AT = re.compile(r"@|\s?(?:\(at\)|\[at\]|\{at\})\s?| at ", re.I)
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?| dot )"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
GENERATORS = (
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\.)\s?[0-9]{1,3}){3,7}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
)
#: A run of digit groups; every window of neighbouring groups with a fitting number of digits is a
#: candidate, so that numbers written side by side are proposed apart.
_CLUSTER = re.compile(r"\+?\(?[0-9]+(?:[ ./_()-]{1,2}\+?\(?[0-9]+)*")
_GROUP = re.compile(r"\+?\(?[0-9]+\)?")
WINDOWS = {"phone": (7, 15), "card": (12, 19)}
CUES = {
    "email": re.compile(r"mail|contact|write|correo|courriel|adresse", re.I),
    "ip": re.compile(r"\bip\b|server|host|addr|login", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|iban|account", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobil|cell|whatsapp|ruf", re.I),
}
_AGAINST = re.compile(r"token|key|version|license|isbn|sha|hash|order|item|page|id\b|http", re.I)
_TOP = re.compile(r"(?:com|net|org|edu|gov|info|io|de|fr|es|uk|eu|it|ch|at)$", re.I)
CONTEXT = 32


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    body, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 8]
    digits = _digits(body)
    groups = [len(g) for g in re.findall("[0-9]+", body)] or [0]
    parts = [int(g) for g in re.findall("[0-9]{1,6}", body)] or [0]
    letters = sum(c.isalpha() for c in body)
    separators = [c for c in body if not c.isalnum()]
    return [
        *(float(kind == k) for k in KINDS),
        len(body), len(digits), letters, len(separators), len(set(separators)),
        len(set(digits)), float(luhn(digits)) if len(digits) > 11 else 0.5,
        max(parts), len(groups), max(groups), min(groups), groups[-1],
        float("+" in body or body.startswith("00")), float("(" in body), body.count("."), body.count(":"),
        float("@" in body), float(bool(re.search(r"\bat\b", body, re.I))),
        float(bool(re.search(r"\bdot\b", body, re.I))), float(bool(_TOP.search(body))),
        float(any(c.isspace() for c in body)),
        float(body[:1].isupper()), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before[-1:] in ".,-_/:#"), float(after[:1] in "-_/:#@%" and after != ""),
        float(before[-1:] in "\"'="), float(bool(CUES[kind].search(before))), float(bool(_AGAINST.search(before))),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All spans that a generator proposes, one entry each."""
    out: set[tuple[str, int, int]] = set()
    for sign in _AT.finditer(text):
        host = _HOST.match(text, sign.end())
        if host:
            user = text[max(0, sign.start() - 64) : sign.start()]
            size = len(user) - len(user.rstrip(_LOCAL))
            if size:
                out.add(("email", sign.start() - size, host.end()))
    for kind, pattern in GENERATORS if _DIGIT.search(text) else ():
        out.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    for cluster in _CLUSTER.finditer(text) if _DIGIT.search(text) else ():
        groups = list(_GROUP.finditer(text, cluster.start(), cluster.end() + 1))
        for i, first in enumerate(groups):
            total = 0
            for last in groups[i:]:
                total += sum("0" <= c <= "9" for c in last[0])
                if total > 19:
                    break
                for kind, (least, most) in WINDOWS.items():
                    if least <= total <= most:
                        start = first.start() + (kind == "card") * (len(first[0]) - len(first[0].lstrip("+(")))
                        end = last.end() - (kind == "card" and last[0][-1] == ")")
                        out.add((kind, start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _respelt(kind: str, body: str) -> list[str]:
    """Other spellings of a true span, as further positive examples."""
    digits = _digits(body)
    if kind == "email":
        user, _, host = body.partition("@")
        return [f"{user} at {host.replace('.', ' dot ')}", f"{user}(at){host}", f"{user} [at] {host.replace('.', ' [dot] ')}"]
    if kind == "ip":
        return [body.replace(".", "[.]"), body.replace(".", "(.)")]
    if kind == "card":
        quads = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [sep.join(quads) for sep in "./_"] if len(quads[-1]) > 1 else []
    tail = digits[-10:]
    return [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"00{digits}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}"]


def _broken(kind: str, body: str) -> list[str]:
    """Look-alikes of a true span that must not be selected, as further negative examples."""
    digits = _digits(body)
    if kind == "email":
        user, _, host = body.partition("@")
        words = host.replace(".", " ").split()
        return [f"{user.strip('.0123456789') or 'x'} at {words[0]}.{words[-1].capitalize()}x"]
    if kind == "ip":
        return [body.replace(".", ":"), f"3{body.split('.', 1)[0].zfill(2)}.{body.split('.', 1)[1]}", body + ".1.2"]
    if kind == "card":
        wrong = str((int(digits[-1]) + 1) % 10)
        return [digits[:-1] + wrong, "-".join([digits[:4], digits[4:8], digits[8:12], digits[12:-1] + wrong]), digits[:12]]
    return [digits[:8], f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", digits[:4] + "." + digits[4:7]]


def passes(kind: str, body: str) -> bool:
    """The whole of a candidate has the form of a base span and stands its check."""
    return (kind, 0, len(body)) in base_spans(body)


#: National phone numbers as such; other groups of digits may be phone numbers where nothing says otherwise.
_NATIONAL = re.compile(r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])?[0-9]{3}[ .-][0-9]{4}")
_RUNS_IN, _RUNS_ON = re.compile(r"[0-9][ ./_()-]{0,2}$"), re.compile(r"[ ./_()-]{0,2}[0-9]")


def refused(kind: str, text: str, start: int, end: int) -> bool:
    """A check says that a candidate is none of its kind: Luhn's, parts of an address over 255 or not
    four, no valid colon form, digit counts, a host that is none, or the context of a look-alike."""
    body, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 8]
    digits = _digits(body)
    if kind == "card":
        return not luhn(digits)
    if kind == "ip":
        if ":" in body:
            try:
                return not ipaddress.IPv6Address(body)
            except ValueError:
                return True
        parts = re.findall("[0-9]+", body)
        return len(parts) != 4 or any(int(p) > 255 for p in parts) or not ("[" in body or "(" in body)
    if kind == "email":
        user, _, host = re.split(r"(@|[(\[{]at[)\]}]|\bat\b)", body, maxsplit=1, flags=re.I)
        last = re.split(r"[^A-Za-z0-9-]+", host)[-1]
        prose = user.strip().isalpha() and not re.search(r"[(\[{]| dot ", body, re.I) and not _TOP.search(host)
        return not (len(last) > 1 and last.isalpha()) or prose
    if before[-1:].isalnum() or after[:1].isalnum():
        return True
    if not CUES["phone"].search(before) and _AGAINST.search(before):
        return True
    runs = bool(_RUNS_IN.search(before) or _RUNS_ON.match(after))
    if _NATIONAL.fullmatch(body):
        return len(digits) < 10 and runs
    if not 10 <= len(digits) <= 15 or runs:
        return True
    return len(digits) == len(body) and not body.startswith("00") and not CUES["phone"].search(before)


def examples(text: str) -> list[tuple[float, list[float]]]:
    """(label, features) of the candidates of a text that a check decides and of its respelt base spans."""
    base = base_spans(text)
    known, taken = set(base), Cover(base)
    out = []
    for kind, start, end in candidates(text):
        if (kind, start, end) in known:
            out.append((1.0, features(text, kind, start, end)))
        elif not taken.meets(start, end):
            true = passes(kind, text[start:end])
            if true or refused(kind, text, start, end):
                out.append((float(true), features(text, kind, start, end)))
    for kind, start, end in base:
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        for label, made in ((1.0, _respelt), (0.0, _broken)):
            for body in made(kind, text[start:end]):
                again, at = before + body + after, len(before)
                if (kind, at, at + len(body)) in candidates(again):
                    out.append((label, features(again, kind, at, at + len(body))))
    return out


class Cover:
    """Spans sorted by their start, with the furthest end up to each: one bisection finds an overlap."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts = [s[1] for s in spans]
        self.reach = list(itertools.accumulate((s[2] for s in spans), max))

    def meets(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end)
        return at > 0 and self.reach[at - 1] > start


class Selector:
    """Trees, calibration and threshold; gives the spans that go beyond the base ones."""

    def __init__(self, trees: boosting.Trees, knots: np.ndarray, values: np.ndarray, precision: float):
        self.trees, self.knots, self.values, self.precision = trees, knots, values, precision

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        covered = Cover(base)
        found = [c for c in candidates(text) if not covered.meets(*c[1:])]
        if not found:
            return []
        margin = self.trees.margin(np.array([features(text, *c) for c in found]))
        share = boosting.calibrated(margin, self.knots, self.values)
        taken: list[tuple[str, int, int, float]] = []
        starts: list[int] = []  # of the taken spans, which do not overlap, and their ends
        ends: list[int] = []
        for i in np.lexsort((np.arange(len(found)), -margin)):
            if share[i] < self.precision:
                continue
            kind, start, end = found[i]
            at = bisect.bisect_left(starts, end)
            if not at or ends[at - 1] <= start:
                starts.insert(at, start)
                ends.insert(at, end)
                taken.append((kind, start, end, float(share[i])))
        return taken


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98,
    sample_docs: int = 20_000, sample_candidates: int = 30_000,
) -> Selector | None:
    """Fit the selector on candidates of about `sample_docs` rows, chosen by the hash of the text,
    of which at most `sample_candidates` reach the driver. None without positive examples."""
    every = -(-docs.count() // sample_docs) or 1
    schema = T.StructType([
        T.StructField("rank", T.LongType()), T.StructField("label", T.DoubleType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ])

    def work(part: pa.RecordBatch) -> list:
        got = [(h, *e) for h, t in zip(column(part, "rank").to_pylist(), column(part, text_col).to_pylist(), strict=True) for e in examples(t)]
        return [list(c) for c in zip(*got, strict=True)] if got else [[], [], []]

    rows = (
        docs.filter(F.col(text_col).isNotNull())
        .select(F.xxhash64(text_col).alias("rank"), text_col)
        .filter(F.pmod("rank", F.lit(every)) == 0)
    )
    sample = map_slices(rows, work, schema).distinct().orderBy("rank", "label", "x").limit(sample_candidates).collect()
    if not sample:
        return None
    x = np.array([r.x for r in sample], dtype=float)
    y = np.array([r.label for r in sample])
    held = np.arange(len(y)) % 4 == 3
    if not y[~held].any() or y[~held].all() or not y[held].any():
        return None
    trees = boosting.fit(x[~held], y[~held], rounds=60)
    return Selector(trees, *boosting.isotonic(trees.margin(x[held]), y[held]), precision)


_SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
])


def spans_of(text: str | None, selector: Selector | None) -> list[dict]:
    """All spans of a text by start, then kind, then end."""
    base = base_spans(text or "")
    found = [(k, a, b, True, 1.0) for k, a, b in base]
    if selector and text:
        found += [(k, a, b, False, s) for k, a, b, s in selector.added(text, base)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in found]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """(id, spans): every row with its spans (kind, start, end, base, score)."""
    selector = train(docs, id_col, text_col, **training)
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(_SPAN))])

    def work(part: pa.RecordBatch) -> list:
        return [column(part, id_col), [spans_of(t, selector) for t in column(part, text_col).to_pylist()]]

    return map_slices(docs.select(id_col, text_col), work, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """The rows with every span replaced by its kind in capitals and square brackets. Overlapping
    spans are replaced together, under the kind of the first. Null texts stay null."""
    selector = train(docs, id_col, text_col, **training)
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        found = spans_of(text, selector)
        if not found:
            return text
        for span in found:
            if span["start"] >= done:
                out += [text[done : span["start"]], f"[{span['kind'].upper()}]"]
            done = max(done, span["end"])
        return "".join([*out, text[done:]])

    def work(part: pa.RecordBatch) -> list:
        columns = list(part.columns)
        columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], type=pa.string())
        return columns

    return map_slices(docs, work, docs.schema)
