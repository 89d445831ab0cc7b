"""Scalar functions against hand-computed values."""

import itertools
import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import fixed, porter, scoring, text, variants, words
from larder.operators.shaping import once


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://Example.com/a/b/?q=1#x", "https://example.com/a/b"),
        ("HTTP://example.com:80/", "http://example.com"),
        ("https://u:P@Example.com:8443/x//", "https://u:P@example.com:8443/x/"),
        ("https://example.com?q", "https://example.com"),
        ("not a url?x", "not a url?x"),
    ],
)
def test_normalise_url(one, url, want):
    assert one(text.normalise_url, url) == want


def test_url_labels(one):
    assert one(text.with_scheme, "a.com/x") == "https://a.com/x"
    assert one(text.with_scheme, "HTTP://a.com") == "HTTP://a.com"
    long = "https://www.example.com/" + "x" * 50
    assert one(text.short_url, long) == ("example.com/" + "x" * 50)[:30] + "..."


@pytest.mark.parametrize(
    "raw, want",
    [
        ("All-Purpose Flour", "flour wheat all-purpose"),
        ("butter, melted", "butter salted"),
        ("room temperature eggs", "egg whole"),
        ("White Rice (cooked)", "rice white raw"),
        ("rawhide hotdog", "rawhide hotdog"),
        ("", ""),
    ],
)
def test_clean_term(one, raw, want):
    assert one(text.clean_term, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2", 2.0), ("1 1/2", 1.5), ("3/4", 0.75), ("2.5", 2.5), ("0", 1.0), ("", 1.0),
        ("1/0", 1.0), ("2 1/0", 2.0), ("x", 1.0), ("3x", 3.0), ("a/b", 1.0), ("1  2", 3.0),
        ("NaN", 1.0),
    ],
)
def test_parse_quantity(one, raw, want):
    assert one(text.parse_quantity, raw) == want


def test_missing_quantity(one):
    assert one(lambda a: text.parse_quantity(F.nullif(a, a)), "x") == 1.0


@pytest.mark.parametrize(
    "iso, want",
    [("PT1H30M", "1h 30m"), ("PT15M", "15m"), ("P1DT2H", "p1dt2h "), ("", ""), ("PT1M2M", "1m2m")],
)
def test_duration_label(one, iso, want):
    assert one(text.duration_label, iso) == want


@pytest.mark.parametrize(
    "mail, want",
    [
        ("User+tag@Example.com", "user@example.com"), ("a@b.c", "a@b.c"),
        ("NoAt", "noat"), ("x+1+2@d.e", "x@d.e"), ("@d.e", "@d.e"),
    ],
)
def test_canonical_email(one, mail, want):
    assert one(text.canonical_email, mail) == want


def test_is_email(one):
    assert one(text.is_email, "a@b.c")
    assert not one(text.is_email, "a@b")
    assert not one(text.is_email, "a b@c.d")
    assert not one(text.is_email, "a@@c.d")


@pytest.mark.parametrize(
    "x, whole, tenth",
    [(0.5, 1.0, 0.5), (1.25, 1.0, 1.3), (0.35, 0.0, 0.3), (2.449, 2.0, 2.4), (7.0, 7.0, 7.0)],
)
def test_rounding(one, x, whole, tenth):
    assert one(text.half_up, x) == whole
    assert one(text.one_decimal, x) == pytest.approx(tenth, abs=1e-12)


def test_lists(one):
    assert one(text.comma_list, " a, b ,c") == ["a", "b", "c"]
    assert one(lambda a: text.last_or(F.split(a, ",")), "x,y") == "y"
    assert one(lambda a: text.last_or(F.array().cast("array<string>")), "x") == "Routine check"
    has = F.array(F.lit("a"), F.lit("b"), F.lit(None))
    assert one(lambda a: text.array_has_all(has, ["a", "b"]), "")
    assert not one(lambda a: text.array_has_all(has, ["a", "c"]), "")
    assert one(lambda a: text.array_has_all(has, []), "")
    assert not one(lambda a: text.array_has_any(has, []), "")
    assert one(lambda a: text.array_has_any(has, ["z", "b"]), "")
    assert one(lambda a: text.array_has_any(has, ["z"]), "") is False


def test_json_lists(one):
    flat, listed = variants.flat_ingredients, variants.text_list
    assert one(flat, '["a",1,{"b":2}]') == ["a", "1", '{"b":2}']
    assert one(flat, '{"a":"b"}') == []
    assert one(flat, "broken") == []
    assert one(listed, '["a",{"b":2}]') == ["a", '{"b":2}']
    assert sorted(one(listed, '{"x":"a","y":2}')) == ["2", "a"]
    joined = lambda a: variants.joined(F.try_parse_json(a))
    assert one(joined, '["a","b"]') == "a, b"
    assert one(joined, '"a"') == "a"


def test_steps_and_images(one):
    step = lambda a: variants.step_text(F.try_parse_json(a))
    assert one(step, '"Mix"') == "Mix"
    assert one(step, '{"text":"T","name":"N"}') == "T"
    assert one(step, '{"text":"","name":"N"}') == "N"
    image = lambda a: variants.image_url(F.try_parse_json(a))
    assert one(image, '"u"') == "u"
    assert one(image, '{"url":"","contentUrl":"c"}') == "c"
    assert one(image, '[{"url":"a"},"b"]') == "a"
    assert one(image, "[]") is None
    assert one(image, "5") is None
    steps = lambda a: variants.instruction_list(F.try_parse_json(a))
    assert one(steps, '"just this"') == ["just this"]
    mixed = (
        '["a",{"@type":"HowToStep","text":"b"},{"@type":"HowToTip","text":"no"},'
        '{"@type":"HowToSection","itemListElement":[{"@type":"HowToStep","text":"c"},"no"]}]'
    )
    assert one(steps, mixed) == ["a", "b", "c"]
    assert one(steps, "7") is None


def test_repaired_image(one):
    keep = lambda a: variants.repaired_image(a, a)
    drop = lambda a: variants.repaired_image(a, F.lit(None).cast("string"))
    assert one(keep, ' {"url":"u"}') == "u"
    assert one(keep, '{"contentUrl":"c"}') == "c"
    assert one(keep, "{broken") == "{broken"
    assert one(drop, "{broken") is None
    assert one(drop, "https://x") == "https://x"


def test_quality_score(one):
    def score(name, description, image, n_in, n_out, cook):
        def make(a, b, c, d):
            filled = F.array_repeat(F.lit("x"), n_in), F.array_repeat(F.lit("x"), n_out)
            return scoring.quality_score(a, b, c, *filled, d, F.lit(None).cast("string"), F.lit(True))

        return one(make, name, description, image, cook)

    assert score("Soup", "a long description", "https://image.example", 1, 1, "PT1M") == 100
    assert score("Pie", "short", "x", 0, 0, "") == 5
    assert score("Soup", "a long description", "", 2, 0, "") == 50


def test_trigrams(one):
    assert sorted(one(words.trigrams, "cat")) == sorted(["  c", " ca", "cat", "at "])
    assert set(one(words.trigrams, "Two words!")) == set(words.trigram_set("two, WORDS"))
    assert one(lambda a: words.similarity_to(a, "two words"), "word") == pytest.approx(4 / 11)
    assert one(lambda a: words.similarity_to(a, "?"), "!") == 0.0


def test_rank(one):
    def places(a, *terms):
        cut = words.words(a)
        return [words.positions(cut, t) for t in terms]

    sentence = "red fish blue fish red"
    alone = one(lambda a: words.rank_or(places(a, "fish")), sentence)
    assert alone == pytest.approx(0.1 * (1 + 1 / 4) / 1.64493406685)
    several = one(lambda a: words.rank_or(places(a, "fish", "dog")), sentence)
    assert several == pytest.approx(alone / 2)
    both = one(lambda a: words.rank_and(places(a, "red", "blue")), sentence)
    near = 0.1 * math.sqrt(words.closeness(2))
    assert both == pytest.approx(1 - (1 - near) ** 2)
    assert one(lambda a: words.rank_and(places(a, "red", "dog")), sentence) == 1e-20


@pytest.mark.parametrize(
    "word, want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"),
        ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"),
        ("generalizations", "gener"), ("oscillators", "oscil"),
    ],
)
def test_stem(word, want):
    assert porter.stem(word) == want


@settings(max_examples=2000, deadline=None)
@given(
    st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=9),
    st.sampled_from(
        ["", "s", "ies", "ed", "ing", "ational", "ization", "biliti", "bility", "ability", "y",
         "eed", "fulness", "ically", "ement", "ion", "ousli", "e", "ance", "ality", "ivity"]
    ),
)
def test_a_stem_without_its_last_letter_begins_the_word(root, ending):
    word = root + ending
    found = porter.stem(word)
    assert word.startswith(found[: max(1, len(found) - 1)])


def test_rank_of_near_words_equals_all_pairs(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["red", "blue", "fish", *"abcdefghij"] + ["x"] * wide, k=rnd.randint(1, 400))) for wide in (0, 5, 90) for _ in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    cut = words.words("t")
    got = dict(df.select("id", words.rank_and([words.positions(cut, w) for w in ("red", "blue", "fish")])).collect())
    for i, t in enumerate(texts):
        at = [[n for n, w in enumerate(t.split(), 1) if w == q] for q in ("red", "blue", "fish")]
        rest, pairs = 1.0, 0
        for a, b in itertools.combinations(at, 2):
            for p, q in itertools.product(a, b):
                pairs += 1
                if abs(p - q) <= 100:
                    rest *= 1.0 - math.sqrt(words.closeness(abs(p - q)) * fixed.POSITION_WEIGHT**2)
        assert got[i] == pytest.approx(max(1.0 - rest, 1e-16) if pairs else 1e-20, rel=1e-9, abs=1e-15)


def test_rank_of_a_long_text_is_linear(spark):
    """100,000 words, both terms everywhere: all pairs would be 2.5 thousand million."""
    df = spark.range(1).select(F.expr("repeat('red blue ', 50000)").alias("t"))
    cut = once(df, "w", words.words("t"))
    at = once(once(cut, "red", words.positions(F.col("w"), "red")), "blue", words.positions(F.col("w"), "blue"))
    started = time.monotonic()
    assert at.select(words.rank_and([F.col("red"), F.col("blue")])).first()[0] == pytest.approx(1.0)
    assert at.select(F.size(words.adjacent(F.col("red"), F.col("blue")))).first()[0] == 50000
    assert time.monotonic() - started < 60
