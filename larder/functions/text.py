"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: Column | str) -> Column:
    """Present and not the empty string."""
    c = _col(c)
    return c.isNotNull() & (c != "")


def or_default(c: Column | str, default: Column | str) -> Column:
    """Text, or a default where it is null or empty."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(_col(c), F.lit("")), default)


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | c.contains(word)
    return out


# --- URLs ---------------------------------------------------------------------

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@]*@)?([^/?#]+)([^?#]*)"


def normalise_url(c: Column | str) -> Column:
    """Drop query and fragment, lowercase scheme and host, drop the scheme's own port and one
    trailing slash. Text that is no absolute URL is returned unchanged."""
    url = F.trim(_col(c))
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.lower(F.regexp_extract(url, _URL, 3))
    host = (
        F.when(scheme == "http", F.regexp_replace(host, r":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, r":443$", ""))
        .otherwise(host)
    )
    clean = F.concat(
        scheme, F.lit("://"), F.regexp_extract(url, _URL, 2), host, F.regexp_extract(url, _URL, 4)
    )
    return F.when(url.rlike(_URL), F.regexp_replace(clean, r"/$", "")).otherwise(_col(c))


def url_host(c: Column | str) -> Column:
    """Lowercased host with its port, null when the text is no absolute URL."""
    return F.nullif(F.lower(F.regexp_extract(_col(c), _URL, 3)), F.lit(""))


def with_scheme(c: Column | str) -> Column:
    """Prefix `https://` where no http scheme is given."""
    c = _col(c)
    return F.when(c.rlike(r"(?i)^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def short_url(c: Column | str) -> Column:
    """Display label: scheme and `www.` stripped, 30 characters and an ellipsis."""
    bare = F.regexp_replace(_col(c), r"^https?://(www\.)?", "")
    return F.concat(F.substring(bare, 1, 30), F.lit("..."))


# --- ingredient terms and quantities ------------------------------------------


def clean_term(
    c: Column | str,
    words: list[str] | None = None,
    mappings: Mapping[str, str] | None = None,
) -> Column:
    """Search term of an ingredient name: lowercase, punctuation to spaces, preparation words
    removed on word boundaries, spaces collapsed, exact terms mapped."""
    words = fixed.PREPARATION_WORDS if words is None else words
    mappings = fixed.TERM_MAPPINGS if mappings is None else mappings
    term = F.regexp_replace(F.lower(_col(c)), fixed.TERM_PUNCTUATION, " ")
    term = F.regexp_replace(term, r"\b(?:" + "|".join(words) + r")\b", "")
    term = F.trim(F.regexp_replace(term, r"\s+", " "))
    pairs = [F.lit(x) for pair in mappings.items() for x in pair]
    mapped = F.coalesce(F.create_map(*pairs)[term], term) if pairs else term
    return F.coalesce(mapped, F.lit(""))


def cache_key(term: Column | str, version: str = fixed.CACHE_KEY_VERSION) -> Column:
    return F.concat(F.lit(f"{version}:"), F.lower(_col(term)))


def parse_quantity(c: Column | str) -> Column:
    """Sum of space-separated numbers and fractions; nothing usable counts as 1.

    A fraction over zero adds nothing. A fraction that is no number voids the whole text.
    """
    c = _col(c)
    leading = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

    def number(part: Column) -> Column:
        return F.when(F.trim(part) == "", F.lit(0.0)).otherwise(part.try_cast("double"))

    def value(part: Column) -> Column:
        top = number(F.split_part(part, F.lit("/"), F.lit(1)))
        bottom = number(F.split_part(part, F.lit("/"), F.lit(2)))
        plain = F.coalesce(F.regexp_extract(part, leading, 1).try_cast("double"), F.lit(0.0))
        return (
            F.when(~part.contains("/"), plain)
            .when(top.isNull() | bottom.isNull(), F.lit(float("nan")))
            .when(bottom == 0, F.lit(0.0))
            .otherwise(top / bottom)
        )

    # most quantities are one number; only the others are taken apart
    total = F.when(c.rlike(r"^\d+(?:\.\d+)?$"), c.try_cast("double")).otherwise(
        F.aggregate(F.split(F.trim(c), " "), F.lit(0.0), lambda acc, p: acc + value(p))
    )
    return F.coalesce(F.nullif(F.nanvl(total, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


# --- lists ----------------------------------------------------------------------


def comma_list(c: Column | str) -> Column:
    """Comma list to trimmed parts."""
    return F.transform(F.split(_col(c), ","), lambda x: F.trim(x))


def last_or(c: Column | str, default: str = fixed.LAST_LOG_DEFAULT) -> Column:
    """Last element of a list, or a default text."""
    return F.coalesce(F.try_element_at(_col(c), F.lit(-1)), F.lit(default))


def array_has_all(arr: Column | str, wanted: list[str]) -> Column:
    """Every wanted value is an element. An empty wanted list holds for every array."""
    arr = _col(arr)
    out = arr.isNotNull()
    for value in wanted:
        out = out & F.coalesce(F.array_contains(arr, value), F.lit(False))
    return out


def array_has_any(arr: Column | str, wanted: list[str]) -> Column:
    """At least one wanted value is an element. An empty wanted list never holds."""
    if not wanted:
        return F.lit(False)
    return F.coalesce(
        F.arrays_overlap(_col(arr), F.array(*[F.lit(x) for x in wanted])), F.lit(False)
    )


# --- labels ---------------------------------------------------------------------


def duration_label(c: Column | str) -> Column:
    """`PT1H30M` to `1h 30m`: first PT, first H and first M only; null becomes ''."""
    out = _col(c)
    for letter, text in (("PT", ""), ("H", "h "), ("M", "m")):
        out = F.regexp_replace(out, f"(?s)^(.*?){letter}", f"$1{text}")
    return F.coalesce(F.lower(out), F.lit(""))


def score_band(c: Column | str, at: int = 80) -> Column:
    return F.when(_col(c) >= at, "good").otherwise("poor")


# --- time -----------------------------------------------------------------------


def iso_millis(c: Column | str) -> Column:
    """ISO-8601 text with milliseconds, as UTC."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def plus_hours(c: Column | str, hours: Column) -> Column:
    return _col(c) + F.make_dt_interval(F.lit(0), hours.cast("int"))


def retry_time(now: Column | str, retries: Column | str) -> Column:
    """A day later for every attempt made so far, counting this one."""
    return plus_hours(now, (_col(retries) + 1) * 24)


# --- keys -----------------------------------------------------------------------


def is_email(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(fixed.EMAIL_PATTERN), F.lit(False))


def canonical_email(c: Column | str) -> Column:
    """Lowercased address without its plus tag."""
    c = _col(c)
    local = F.split_part(c, F.lit("@"), F.lit(1))
    domain = F.split_part(c, F.lit("@"), F.lit(2))
    return F.when((local == "") | (domain == ""), F.lower(c)).otherwise(
        F.lower(F.concat(F.substring_index(local, "+", 1), F.lit("@"), domain))
    )


# --- rounding -------------------------------------------------------------------


def half_up(c: Column | str) -> Column:
    """Whole number, halves towards plus infinity."""
    return F.floor(_col(c) + 0.5).cast("double")


def one_decimal(c: Column | str) -> Column:
    """The nearer of the two neighbouring tenths, the upper one on a tie."""
    c = _col(c)
    low = F.floor(c * 10) / 10.0
    high = (F.floor(c * 10) + 1) / 10.0
    return F.when(c - low < high - c, low).otherwise(high)
