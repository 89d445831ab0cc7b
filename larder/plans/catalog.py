"""Listing queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text, variants
from larder.operators import catalog, shaping, tables
from larder.operators.shaping import spread
from larder.session import table

_HIDDEN = ["PROMO", "SMALL"]


def visible_page(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_size", "p_type"])
    rows = catalog.visible(part, "p_type", _HIDDEN)
    light = catalog.fields(rows, light=["p_partkey", "p_name", "p_brand", "p_size"])
    return catalog.page_with_count(light, [F.asc("p_partkey")], number=2, size=50)


def key_lookup(spark, d):
    return catalog.one_row(table(spark, d, "orders"), F.col("o_orderkey") == 7).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


def health(spark, d):
    orders = table(spark, d, "orders", ["o_orderstatus", "o_totalprice"])
    out = catalog.health(
        orders, F.col("o_orderstatus"), F.col("o_totalprice"), {"verified": "F", "flagged": "P"}
    )
    return out.withColumn("avg_score", F.round("avg_score", 4))


def health_sample(spark, d):
    orders = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    out = catalog.health(
        orders, F.col("o_orderstatus"), F.col("o_totalprice"), {"verified": "F", "flagged": "P"},
        sample=(100, [F.asc("o_orderkey")]),
    )
    return out.withColumn("avg_score", F.round("avg_score", 4))


def recent_top10(spark, d):
    orders = table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus"])
    dated = orders.filter(F.col("o_orderdate").isNotNull())
    return catalog.newest(dated, [F.desc("o_orderdate"), F.asc("o_orderkey")], 10)


def ilike_newest(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name"])
    return catalog.name_like(part, "p_name", "COLD", [F.desc("p_partkey")])


def listed_ids(spark, d):
    wanted = table(spark, d, "lineitem", ["l_partkey", "l_quantity"]).filter("l_quantity >= 50")
    ids = wanted.select(F.col("l_partkey").alias("p_partkey"))
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type"])
    return catalog.visible(catalog.with_ids(part, ids, "p_partkey"), "p_type", _HIDDEN)


def json_prefix(spark, d):
    events = table(spark, d, "events", ["event_id", "props"])
    return events.filter(F.col("props").startswith('{"k": 1'))


def needs_audit(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "lang"])
    seen = table(spark, d, "labels", ["doc_id", "quality"])
    rows = shaping.attach(docs, seen, ["doc_id"]).select(
        "doc_id",
        F.when(F.col("lang") == "en", "pending").otherwise("verified").alias("qa_status"),
        F.col("quality").alias("last_audited_at"),
    )
    return catalog.needs_audit(rows).select("doc_id", "qa_status")


def prefer_in_group(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_size", "p_type"])
    return shaping.prefer(
        part, ["p_name", "p_type"], (F.col("p_size") >= 40) & (F.col("p_size") <= 42)
    )


def listing_dispatch(spark, d):
    from larder.operators.search import search

    part = table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    rows = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("image"), F.lower("p_type").alias("description"),
        F.lit("PT5M").alias("cook_time"), F.lit("").alias("prep_time"),
        F.when(F.col("p_type").isin(_HIDDEN), "quarantined").otherwise("verified")
        .alias("qa_status"),
    )
    return search(rows, count="total")


def json_lists(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part(
        "p_name", F.lit(" "), F.lit(2)
    )
    size = F.col("p_size").cast("string")
    as_list = F.concat(F.lit('["'), first, F.lit('","'), second, F.lit('",'), size, F.lit("]"))
    as_map = F.concat(F.lit('{"a":"'), first, F.lit('","b":'), size, F.lit("}"))
    json = F.when(F.col("p_size") <= 30, as_list).when(F.col("p_size") <= 45, as_map).otherwise(
        F.lit("not json")
    )
    return part.select(
        "p_partkey",
        F.array_join(variants.flat_ingredients(json), "|").alias("flat"),
        F.array_join(variants.text_list(json), "|").alias("listed"),
        variants.joined(F.try_parse_json(json)).alias("joined"),
    )


def insert_split(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    rows = part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 2, F.col("p_name")).alias("name"),
        F.when(F.col("p_type") == "PROMO", F.lit("verified")).alias("qa_status"),
    )
    good, bad = tables.insertable(
        rows, ["name"], {"qa_status": F.lit("pending"), "quality_score": F.lit(0)}
    )
    return good.withColumn("accepted", F.lit(True)).unionByName(
        bad.withColumn("quality_score", F.lit(None).cast("int")).withColumn("accepted", F.lit(False))
    )


def report_labels(spark, d):
    events = spread(
        table(spark, d, "events", ["event_id", "ts", "event_type", "value", "props"])
    )
    k = F.get_json_object("props", "$.k")
    listed = F.concat(F.col("event_type"), F.lit(" , k "), k, F.lit(",end "))
    step = F.try_parse_json(
        F.when(F.col("event_type") == "click", F.concat(F.lit('"'), k, F.lit('"')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"text":"t'), k, F.lit('"}')))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"name":"n'), k, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"text":"","name":"m'), k, F.lit('"}')))
    )
    log = F.when(F.col("value") > 50, F.array(F.lit("checked"), F.col("event_type"))).otherwise(
        F.array().cast("array<string>")
    )
    return events.select(
        "event_id",
        F.array_join(text.comma_list(listed), "|").alias("parts"),
        text.iso_millis("ts").alias("iso"),
        text.retry_time("ts", F.floor(F.col("value")).cast("int") % 4).alias("retry_at"),
        text.last_or(log).alias("last_log"),
        text.score_band(F.col("value")).alias("band"),
        variants.step_text(step).alias("step"),
        text.or_default(F.when(F.col("value") > 20, F.lit("")).otherwise(F.col("event_type")),
                        "none").alias("defaulted"),
    )


def duration_label(spark, d):
    events = table(spark, d, "events", ["event_id", "value", "event_type"])
    whole = F.floor("value").cast("bigint")
    iso = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("PT"), whole, F.lit("M")))
        .when(F.col("event_type") == "view", F.concat(F.lit("PT1H"), whole, F.lit("M")))
        .when(F.col("event_type") == "error", F.concat(F.lit("PT"), whole, F.lit("H")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("P1DT2H"), whole, F.lit("M30S")))
    )
    return events.select("event_id", text.duration_label(iso).alias("label"))


_H = "('PROMO', 'SMALL')"

QUERIES = {
    "catalog_visible_page": (
        visible_page,
        f"""
        WITH v AS (SELECT * FROM part WHERE p_type NOT IN {_H})
        SELECT p_partkey, p_name, p_brand, p_size, (SELECT count(*) FROM v) AS total
        FROM v ORDER BY p_partkey LIMIT 50 OFFSET 50""",
    ),
    "key_lookup": (
        key_lookup,
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
        WHERE o_orderkey = 7""",
    ),
    "catalog_health": (
        health,
        """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified,
        count(*) FILTER (o_orderstatus = 'P') AS flagged,
        round(coalesce(avg(o_totalprice), 0.0::DOUBLE), 4) AS avg_score FROM orders""",
    ),
    "catalog_health_sample": (
        health_sample,
        """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified,
        count(*) FILTER (o_orderstatus = 'P') AS flagged,
        (SELECT round(coalesce(avg(o_totalprice), 0.0::DOUBLE), 4) FROM
          (SELECT o_totalprice FROM orders WHERE o_totalprice IS NOT NULL
           ORDER BY o_orderkey LIMIT 100)) AS avg_score
        FROM orders""",
    ),
    "recent_top10": (
        recent_top10,
        """SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders
        WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""",
    ),
    "ilike_newest": (
        ilike_newest,
        "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%COLD%' ORDER BY p_partkey DESC",
    ),
    "listed_ids": (
        listed_ids,
        f"""SELECT p_partkey, p_name, p_type FROM part WHERE p_type NOT IN {_H} AND p_partkey IN
        (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""",
    ),
    "json_prefix": (
        json_prefix,
        """SELECT event_id, props FROM events WHERE starts_with(props, '{"k": 1')""",
    ),
    "needs_audit": (
        needs_audit,
        """SELECT d.doc_id, CASE WHEN lang = 'en' THEN 'pending' ELSE 'verified' END AS qa_status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        WHERE lang = 'en' OR quality IS NULL""",
    ),
    "prefer_in_group": (
        prefer_in_group,
        """SELECT p_partkey, p_name, p_size, p_type FROM (
          SELECT *, max(CASE WHEN p_size BETWEEN 40 AND 42 THEN 1 ELSE 0 END)
            OVER (PARTITION BY p_name, p_type) AS any_hit FROM part)
        WHERE p_size BETWEEN 40 AND 42 OR any_hit = 0""",
    ),
    "listing_dispatch": (
        listing_dispatch,
        f"""SELECT p_partkey AS id, p_name AS name, p_brand AS image, lower(p_type) AS description,
        'PT5M' AS cook_time, '' AS prep_time, count(*) OVER () AS total FROM part
        WHERE p_type NOT IN {_H} ORDER BY p_partkey LIMIT 50""",
    ),
    "json_lists": (
        json_lists,
        """SELECT p_partkey,
        CASE WHEN p_size <= 30 THEN replace(p_name, ' ', '|') || '|' || p_size ELSE '' END AS flat,
        CASE WHEN p_size <= 30 THEN replace(p_name, ' ', '|') || '|' || p_size
             WHEN p_size <= 45 THEN split_part(p_name, ' ', 1) || '|' || p_size
             ELSE '' END AS listed,
        CASE WHEN p_size <= 30 THEN replace(p_name, ' ', ', ') || ', ' || p_size
             WHEN p_size <= 45 THEN '{"a":"' || split_part(p_name, ' ', 1) || '","b":' || p_size
               || '}' END AS joined
        FROM part""",
    ),
    "insert_split": (
        insert_split,
        """SELECT p_partkey AS id, CASE WHEN p_size > 2 THEN p_name END AS name,
        CASE WHEN p_type = 'PROMO' THEN 'verified' WHEN p_size > 2 THEN 'pending' END AS qa_status,
        CASE WHEN p_size > 2 THEN 0 END AS quality_score, p_size > 2 AS accepted FROM part""",
    ),
    "report_labels": (
        report_labels,
        """SELECT event_id,
        event_type || '|k ' || k || '|end' AS parts,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0')
          || 'Z' AS iso,
        ts + to_hours(CAST((CAST(floor(value) AS BIGINT) % 4 + 1) * 24 AS INTEGER)) AS retry_at,
        CASE WHEN value > 50 THEN event_type ELSE 'Routine check' END AS last_log,
        CASE WHEN value >= 80 THEN 'good' ELSE 'poor' END AS band,
        CASE event_type WHEN 'click' THEN k WHEN 'view' THEN 't' || k WHEN 'error' THEN 'n' || k
          ELSE 'm' || k END AS step,
        CASE WHEN value > 20 THEN 'none' ELSE event_type END AS defaulted
        FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
    ),
    "duration_label": (
        duration_label,
        """SELECT event_id, CASE event_type WHEN 'click' THEN v || 'm' WHEN 'view' THEN '1h ' || v
        || 'm' WHEN 'error' THEN v || 'h ' WHEN 'signup' THEN 'p1dt2h ' || v || 'm30s'
        ELSE '' END AS label
        FROM (SELECT *, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events)""",
    ),
}
