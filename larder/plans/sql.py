"""SQL fragments shared by the check queries."""

from __future__ import annotations

from larder.functions import fixed


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def word_list(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '{fixed.WORD_BREAK}'), "
        "lambda w: w <> '')"
    )


def trigram_list(text: str) -> str:
    return (
        f"list_distinct(flatten(list_transform({word_list(text)}, lambda w: list_transform("
        "range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    both = shared(a, b)
    return (
        f"CASE WHEN len({a}) + len({b}) - {both} > 0 THEN CAST({both} AS DOUBLE) / "
        f"(len({a}) + len({b}) - {both}) ELSE 0.0::DOUBLE END"
    )


def places(tokens: str, term: str) -> str:
    return (
        f"list_filter(range(1, len({tokens}) + 1), lambda i: {tokens}[i] = {quoted(term)})"
    )


def _sum(values: str) -> str:
    return f"coalesce(list_sum({values}), 0.0::DOUBLE)"


def rank_or(columns: list[str]) -> str:
    each = [
        _sum(f"list_transform(range(1, len({c}) + 1), lambda k: 1.0::DOUBLE / (k * k))")
        + f" * {fixed.POSITION_WEIGHT}::DOUBLE / {fixed.RANK_NORM}::DOUBLE"
        for c in columns
    ]
    return "(" + " + ".join(each) + f") / {len(columns)}.0::DOUBLE"


def rank_and(columns: list[str]) -> str:
    """Product over near pairs, as the exponential of a sum of logarithms."""
    w = fixed.POSITION_WEIGHT
    logs, pairs = [], []
    for i in range(len(columns)):
        for k in range(i):
            a, b = columns[i], columns[k]
            close = (
                "1.0::DOUBLE / (1.005::DOUBLE + 0.05::DOUBLE * "
                "exp(abs(p - q) / 1.5::DOUBLE - 2.0::DOUBLE))"
            )
            logs.append(
                f"coalesce(list_sum(list_transform({a}, lambda p: coalesce(list_sum("
                f"list_transform(list_filter({b}, lambda q: abs(p - q) BETWEEN 1 AND 100), "
                f"lambda q: ln(1.0::DOUBLE - sqrt({w}::DOUBLE * {w}::DOUBLE * {close})))), "
                "0.0::DOUBLE))), 0.0::DOUBLE)"
            )
            pairs.append(f"len({a}) * len({b})")
    return (
        f"CASE WHEN {' + '.join(pairs)} > 0 THEN greatest(1.0::DOUBLE - exp({' + '.join(logs)}), "
        "1e-16::DOUBLE) ELSE 1e-20::DOUBLE END"
    )


def normalised_url(url: str) -> str:
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@]*@)?([^/?#]+)([^?#]*)"
    scheme = f"lower(regexp_extract(trim({url}), '{pattern}', 1))"
    host = f"lower(regexp_extract(trim({url}), '{pattern}', 3))"
    bare = (
        f"CASE {scheme} WHEN 'http' THEN regexp_replace({host}, ':80$', '') "
        f"WHEN 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    )
    return (
        f"CASE WHEN regexp_matches(trim({url}), '{pattern}') THEN regexp_replace({scheme} || '://' "
        f"|| regexp_extract(trim({url}), '{pattern}', 2) || ({bare}) || "
        f"regexp_extract(trim({url}), '{pattern}', 4), '/$', '') ELSE {url} END"
    )


def clean_term(name: str) -> str:
    words = "|".join(fixed.PREPARATION_WORDS)
    text = (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower({name}), "
        f"'{fixed.TERM_PUNCTUATION}', ' ', 'g'), '\\b(?:{words})\\b', '', 'g'), '\\s+', ' ', 'g'))"
    )
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in fixed.TERM_MAPPINGS.items())
    return f"CASE {text} {cases} ELSE {text} END"


def _first(name: str, table: list[tuple[str, float]], default: float) -> str:
    cases = " ".join(f"WHEN contains({name}, {quoted(k)}) THEN {v}::DOUBLE" for k, v in table)
    return f"CASE {cases} ELSE {default}::DOUBLE END"


def density(name: str) -> str:
    return _first(f"lower({name})", fixed.DENSITIES, fixed.DEFAULT_DENSITY)


def piece_weight(name: str) -> str:
    cases = []
    for groups, grams in fixed.PIECE_WEIGHTS:
        tests = [
            "(" + " OR ".join(f"contains(lower({name}), {quoted(w)})" for w in g) + ")"
            for g in groups
        ]
        cases.append(f"WHEN {' AND '.join(tests)} THEN {grams}::DOUBLE")
    return f"CASE {' '.join(cases)} ELSE {fixed.DEFAULT_PIECE_WEIGHT}::DOUBLE END"


def grams(unit: str, qty: str, name: str) -> str:
    u = f"regexp_replace(lower({unit}), 's$', '')"
    cases = [
        f"WHEN {u} IN {in_list(units)} THEN {qty} * {f}::DOUBLE"
        for units, f in fixed.WEIGHT_UNITS + fixed.COUNT_UNITS
    ] + [
        f"WHEN {u} IN {in_list(units)} THEN {qty} * {f}::DOUBLE * ({density(name)})"
        for units, f in fixed.VOLUME_UNITS
    ]
    return f"CASE {' '.join(cases)} ELSE {qty} * ({piece_weight(name)}) END"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5::DOUBLE) AS DOUBLE)"


def one_decimal(x: str) -> str:
    low = f"floor({x} * 10::DOUBLE) / 10.0::DOUBLE"
    high = f"(floor({x} * 10::DOUBLE) + 1::DOUBLE) / 10.0::DOUBLE"
    return f"CASE WHEN {x} - {low} < {high} - {x} THEN {low} ELSE {high} END"


def rounded_total(x: str, nutrient: str) -> str:
    settled = f"round(coalesce({x}, 0.0::DOUBLE), 9)"
    if nutrient in fixed.WHOLE_NUMBER_NUTRIENTS:
        return half_up(settled)
    if nutrient in fixed.ONE_DECIMAL_NUTRIENTS:
        return one_decimal(settled)
    return settled
