"""Words, trigrams, positions and ranks as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import fixed


def words(c: Column | str) -> Column:
    """Lowercased words in order, stop words kept so that positions count them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), fixed.WORD_BREAK), lambda w: w != "")


def search_text(*parts: Column) -> Column:
    """Parts joined by a blank, missing ones as ''."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def is_content_word(c: Column) -> Column:
    return ~c.isin(fixed.STOP_WORDS)


def trigrams(c: Column | str) -> Column:
    """Distinct three-letter pieces of every word padded with two blanks before, one behind."""

    def pieces(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, 3)
        )

    return F.array_distinct(F.flatten(F.transform(words(c), pieces)))


def trigram_set(value: str) -> list[str]:
    """The same pieces of a query term, for use as literals."""
    import regex

    found: dict[str, None] = {}
    for word in regex.split(fixed.WORD_BREAK, value.lower()):
        if word:
            padded = f"  {word} "
            for i in range(len(word) + 1):
                found[padded[i : i + 3]] = None
    return list(found)


def similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct pieces, 0 when there are none."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def similarity_to(c: Column | str, term: str) -> Column:
    """Similarity of a text to a query term."""
    wanted = F.array(*[F.lit(t) for t in trigram_set(term)]).cast("array<string>")
    return similarity(trigrams(c), wanted)


def positions(tokens: Column, term: str | list[str]) -> Column:
    """1-based places of a word, or of any of its spellings."""
    spelt = [term] if isinstance(term, str) else term
    return F.filter(
        F.transform(tokens, lambda w, i: F.when(w.isin(spelt), i + 1)), lambda p: p.isNotNull()
    )


def adjacent(first: Column, second: Column, gap: int = 1) -> Column:
    """Places of `first` that are followed by `second` at exactly `gap`; linear in both."""
    return F.transform(F.array_intersect(F.transform(first, lambda p: p + gap), second), lambda q: q - gap)


def rank_or(places: list[Column]) -> Column:
    """Mean over the query words of w * sum(1 / k^2), k up to the occurrences."""
    total = F.lit(0.0)
    for p in places:
        per_word = F.aggregate(
            F.transform(p, lambda _, i: F.lit(1.0) / ((i + 1) * (i + 1)).cast("double")),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
        total = total + per_word * fixed.POSITION_WEIGHT / fixed.RANK_NORM
    return total / float(len(places))


def _closeness(distance: Column) -> Column:
    return F.when(distance > 100, F.lit(1e-30)).otherwise(
        F.lit(1.0) / (F.lit(1.005) + F.lit(0.05) * F.exp(distance / F.lit(1.5) - F.lit(2.0)))
    )


def rank_and(places: list[Column]) -> Column:
    """1 - product over all pairs of places of different words of (1 - closeness weight).

    Pairs further apart than 100 words weigh 1e-16 and leave the product as it is. The places of all
    words are put in one order, and every place meets the next hundred only: two words do not share a
    place, so whatever is within 100 words is among these. The work grows with the places, not with
    their pairs. No pair at all gives the smallest rank.
    """
    w = fixed.POSITION_WEIGHT
    pairs = F.lit(0).cast("bigint")
    for i in range(len(places)):
        for k in range(i):
            pairs = pairs + F.size(places[i]).cast("bigint") * F.size(places[k])

    def marked(word: int) -> Column:
        return F.transform(places[word], lambda at: F.struct(at.alias("at"), F.lit(word).alias("word")))

    # by distance; one array for all pairs
    factors = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda d: 1.0 - F.sqrt(_closeness(d) * (w * w)))

    def sweep(x: Column) -> Column:
        line, factor = x["line"], x["factor"]

        def against(p: Column, i: Column) -> Column:
            after = F.filter(
                F.slice(line, i + 2, F.lit(100)), lambda q: (q["word"] != p["word"]) & (q["at"] - p["at"]).between(1, 100)
            )
            return F.aggregate(after, F.lit(1.0), lambda acc, q: acc * F.element_at(factor, (q["at"] - p["at"]).cast("int")))

        return F.aggregate(F.transform(line, against), F.lit(1.0), lambda acc, v: acc * v)

    # a lambda's variable is worked out once, a column inside a lambda for every element
    bound = F.array(F.struct(F.array_sort(F.concat(*map(marked, range(len(places))))).alias("line"), factors.alias("factor")))
    rest = F.transform(bound, sweep)[0]
    return F.when(pairs > 0, F.greatest(1.0 - rest, F.lit(1e-16))).otherwise(F.lit(1e-20))


def closeness(distance: float) -> float:
    """The weight of two words at a distance, for hand-computed checks."""
    return 1.0 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2.0))
