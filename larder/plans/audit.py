"""Quality and audit queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import fixed, scoring
from larder.operators import audit as a
from larder.operators import catalog, shaping
from larder.operators.shaping import spread
from larder.session import table

NOW = "2024-06-01 00:00:00"


def quality_score(spark, d):
    docs = spread(table(spark, d, "documents", ["doc_id", "text", "lang", "source", "n_chars"]))
    seen = table(spark, d, "labels", ["doc_id", "quality", "toxic"])
    rows = shaping.attach(docs, seen, ["doc_id"])
    score = scoring.quality_score(
        F.col("source"),
        F.split_part("text", F.lit("\n"), F.lit(1)),
        F.when(F.col("quality") == 1, F.concat(F.lit("https://i/"), "source", F.lit(".jpg"))),
        F.filter(F.split("text", "\n"), lambda x: F.length(x) > 40),
        F.when(F.col("toxic").isNotNull(), F.split("source", "9")),
        F.when(F.col("lang") == "en", F.lit("PT5M")).otherwise(""),
        F.when(F.col("lang") == "fr", F.lit("PT5M")),
        F.col("n_chars") > 1000,
    )
    return rows.select("doc_id", score.alias("score"))


def recipes(spark, d, docs=None):
    """Documents as recipes, their labels deciding what is missing."""
    if docs is None:
        docs = spread(
            table(spark, d, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
        )
    seen = table(spark, d, "labels", ["doc_id", "quality", "toxic"])
    rows = shaping.attach(docs, seen, ["doc_id"])
    plain = F.concat(F.lit("https://img.example/"), "source", F.lit(".jpg"))
    image = (
        F.when(F.col("toxic") == 1, F.lit(""))
        .when(F.col("lang") == "en", plain)
        .when(F.col("lang") == "de", F.concat(F.lit(' {"url": "'), plain, F.lit('"}')))
        .when(F.col("lang") == "fr",
              F.concat(F.lit('{"url": "", "contentUrl": "'), plain, F.lit('"}')))
        .otherwise(F.lit('{"broken": '))
    )
    lines = F.split("text", "\n")
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("quality").isNotNull() | (F.col("lang") != "fr"),
               F.concat(F.lit("https://site.example/"), F.col("doc_id").cast("string")))
        .alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"),
        image.alias("image"), F.col("text").alias("description"),
        none.alias("cook_time"), F.when(F.col("lang") == "en", "PT9M").alias("prep_time"),
        lines.alias("recipe_ingredients"),
        F.when(F.col("n_chars") > 300, lines).alias("recipe_instructions"),
        F.when(F.col("quality") == 1, F.struct(F.lit(1.0).alias("calories"))).alias("nutrition"),
        F.lit("pending").alias("qa_status"), F.lit(None).cast("timestamp_ntz").alias("last_audited_at"),
        F.array().cast("array<string>").alias("audit_log"), F.lit(0).alias("quality_score"),
    )


def checks(spark, d):
    docs = table(spark, d, "documents", ["source", "lang"])
    return docs.select(
        F.concat(F.lit("https://img.example/"), "source", F.lit(".jpg")).alias("url"),
        (~F.col("source").isin("src3", "src7")).alias("ok"),
    ).distinct()


def nutrition(spark, d):
    docs = table(spark, d, "documents", ["text", "lang"]).filter(F.col("lang").isin("en", "es"))
    return docs.groupBy(F.split_part("text", F.lit("\n"), F.lit(1)).alias("name")).agg(
        F.struct(F.max(F.length("text")).cast("double").alias("calories")).alias("nutrition")
    )


def jobs(spark, d):
    """Crawl jobs of the labelled documents."""
    docs = table(spark, d, "documents", ["doc_id", "n_chars"])
    seen = table(spark, d, "labels", ["doc_id", "quality", "toxic"])
    both = docs.join(seen, "doc_id")
    base = both.select(
        F.concat(F.lit("https://site.example/"), F.col("doc_id").cast("string")).alias("url"),
        "quality", "toxic", "n_chars", "doc_id",
    )
    done = base.select(
        "url", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"),
        (F.col("n_chars") % 5).cast("int").alias("retry_count"), F.lit(2).alias("updated_at"),
        F.col("doc_id").alias("id"),
    )
    before = base.select(
        "url", F.lit("failed").alias("status"), F.lit(9).alias("retry_count"),
        F.lit(1).alias("updated_at"), F.col("doc_id").alias("id"),
    )
    pending = base.filter("toxic = 1").select(
        "url", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"),
        F.lit(3).alias("updated_at"), F.col("doc_id").alias("id"),
    )
    return done.unionByName(before).unionByName(pending)


def audited(spark, d, docs=None):
    return a.audit(
        recipes(spark, d, docs), checks(spark, d), nutrition(spark, d), jobs(spark, d),
        F.lit(NOW).cast("timestamp_ntz"),
    )


def flat(df):
    return df.select(
        "id", "image", "qa_status", "quality_score", "last_audited_at",
        F.array_join("audit_log", " ").alias("log"), F.col("nutrition.calories").alias("calories"),
        "schedule", "retries",
    )


def audit_decision(spark, d):
    return flat(audited(spark, d))


def audit_write_back(spark, d):
    done = audited(spark, d).filter(F.col("qa_status") == "quarantined")
    return a.write_back(recipes(spark, d), done).select("id", "qa_status", "quality_score", "image")


def audit_reschedule(spark, d):
    orders = table(spark, d, "orders")
    jobs = orders.select(
        F.col("o_custkey").cast("string").alias("url"),
        F.when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("retry_count"),
        F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("id"),
    )
    recipes = table(spark, d, "customer", ["c_custkey"]).select(
        F.col("c_custkey").cast("string").alias("url")
    )
    state = shaping.attach(recipes, a.job_state(jobs), ["url"])
    retries = F.coalesce(F.col("retries"), F.lit(0))
    marked = state.withColumn("retries", retries).withColumn(
        "schedule", ~F.coalesce("job_open", F.lit(False)) & (retries < fixed.MAX_RETRIES)
    )
    out = a.recrawl_jobs(marked, F.lit(NOW).cast("timestamp_ntz"))
    return out.select("url", "status", "retry_count", "created_at", "is_archived")


def last_jobs(spark, d):
    orders = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"])
    jobs = orders.select(
        F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"),
    )
    return a.last_jobs(jobs).select("url", "id", "updated_at")


def image_json_repair(spark, d):
    events = spread(table(spark, d, "events", ["event_id", "event_type", "props"]))
    k = F.get_json_object("props", "$.k")
    image = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"url": "https://i/'), k, F.lit('"}')))
        .when(F.col("event_type") == "view",
              F.concat(F.lit('{"url": "", "contentUrl": "https://c/'), k, F.lit('"}')))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"url": "https://'), k))
        .when(F.col("event_type") == "signup", F.concat(F.lit("https://p/"), k))
        .otherwise(F.col("props"))
    )
    rows = events.withColumn("kept", image).withColumn("cleared", image)
    return a.repair_images(a.repair_images(rows, "kept"), "cleared", drop_bad=True).select(
        "event_id", "kept", "cleared"
    )


def value_backfill(spark, d):
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    urgent = table(spark, d, "lineitem", ["l_orderkey", "l_quantity"]).filter("l_quantity > 45")
    chosen = catalog.with_ids(orders, urgent.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    rows = chosen.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
    )
    known = table(spark, d, "customer", ["c_custkey", "c_acctbal"]).filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("price")
    )
    return a.backfill(rows, known, "o_custkey", "price").select("o_orderkey", "price", "backfilled")


_RECIPES_SQL = """
    r AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id,
      CASE WHEN quality IS NOT NULL OR lang <> 'fr'
        THEN 'https://site.example/' || d.doc_id END AS url,
      split_part(text, chr(10), 1) AS name,
      'https://img.example/' || source || '.jpg' AS plain, source, lang, text, n_chars,
      quality, toxic
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    i AS (SELECT *, CASE WHEN toxic = 1 THEN '' WHEN lang IN ('en', 'de', 'fr') THEN plain
        ELSE '{"broken": ' END AS image,
      CASE WHEN toxic = 1 THEN 0 WHEN lang IN ('en', 'de', 'fr') THEN 20
        ELSE 20 * CAST(length('{"broken": ') > 10 AS INTEGER) END AS image_points,
      coalesce(toxic, 0) <> 1 AND lang IN ('de', 'fr') AS repaired,
      coalesce(toxic, 0) <> 1 AND lang IN ('en', 'de', 'fr') AND source NOT IN ('src3', 'src7')
        AS ok
      FROM r),
    n AS (SELECT split_part(text, chr(10), 1) AS name, CAST(max(length(text)) AS DOUBLE) AS found
      FROM documents WHERE lang IN ('en', 'es') GROUP BY 1),
    j AS (SELECT 'https://site.example/' || l.doc_id AS url, toxic = 1 AS job_open,
      CAST(n_chars % 5 AS INTEGER) AS retries
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    f AS (SELECT i.*, coalesce(CASE WHEN quality = 1 THEN 1.0::DOUBLE END, n.found) AS calories,
      coalesce(quality, 0) <> 1 AND n.found IS NOT NULL AS filled,
      coalesce(j.job_open, false) AS job_open, coalesce(j.retries, 0) AS retries
      FROM i LEFT JOIN n ON i.name = n.name LEFT JOIN j ON i.url = j.url),
    s AS (SELECT *, CAST(
      CASE WHEN length(name) > 3 THEN 10 ELSE 0 END + CASE WHEN length(text) > 10 THEN 10 ELSE 0 END
      + image_points + 25 + CASE WHEN n_chars > 300 THEN 25 ELSE 0 END
      + CASE WHEN lang = 'en' THEN 5 ELSE 0 END
      + CASE WHEN calories IS NOT NULL THEN 5 ELSE 0 END AS INTEGER) AS score FROM f),
    v AS (SELECT *, CASE WHEN score < 90 AND (url IS NULL OR (NOT job_open AND retries >= 3))
        THEN 'rejected' WHEN score < 90 THEN 'quarantined'
        WHEN image = '' OR NOT ok OR n_chars <= 300 THEN 'flagged' ELSE 'verified' END AS status
      FROM s)"""

#: The recipes as they are before an audit.
RECIPES_BEFORE_SQL = f"""
    WITH {_RECIPES_SQL}
    SELECT id, doc_id % 7 = 0 AS done, CASE WHEN quality = 1 THEN 1.0::DOUBLE END AS calories,
      CASE WHEN toxic = 1 THEN '' WHEN lang = 'en' THEN plain WHEN lang = 'de' THEN ' {{"url": "' || plain || '"}}'
        WHEN lang = 'fr' THEN '{{"url": "", "contentUrl": "' || plain || '"}}' ELSE image END AS image
    FROM v"""

QUERIES = {
    "quality_score": (
        quality_score,
        """SELECT d.doc_id, CAST(
          CASE WHEN length(source) > 3 THEN 10 ELSE 0 END
          + CASE WHEN length(split_part(text, chr(10), 1)) > 10 THEN 10 ELSE 0 END
          + CASE WHEN quality = 1 AND length('https://i/' || source || '.jpg') > 10 THEN 20 ELSE 0 END
          + CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 40)) > 0
              THEN 25 ELSE 0 END
          + CASE WHEN toxic IS NOT NULL THEN 25 ELSE 0 END
          + CASE WHEN lang IN ('en', 'fr') THEN 5 ELSE 0 END
          + CASE WHEN n_chars > 1000 THEN 5 ELSE 0 END AS INTEGER) AS score
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "audit_decision": (
        audit_decision,
        f"""
        WITH {_RECIPES_SQL}
        SELECT id, CASE WHEN toxic = 1 THEN ''
            WHEN lang IN ('en') THEN plain WHEN lang IN ('de', 'fr') THEN plain
            ELSE image END AS image,
          status AS qa_status, score AS quality_score, TIMESTAMP '{NOW}' AS last_audited_at,
          concat_ws(' ',
            CASE WHEN repaired THEN 'Auto-repaired image URL from JSON object.' END,
            CASE WHEN image <> '' AND NOT ok THEN 'Image URL failed validation: ' || image END,
            CASE WHEN image = '' THEN 'Missing image.' END,
            CASE WHEN n_chars <= 300 THEN 'Missing instructions.' END,
            CASE WHEN filled THEN 'Enriched nutrition.' END,
            CASE WHEN calories IS NULL THEN 'Missing nutrition (lookup failed).' END,
            CASE WHEN score < 90 THEN 'Quarantined: Low quality score (' || score || '/100).' END,
            CASE WHEN score < 90 AND url IS NOT NULL AND NOT job_open AND retries < 3
              THEN 'Scheduled auto-repair crawl (Attempt ' || (retries + 1) || ').' END,
            CASE WHEN score < 90 AND url IS NOT NULL AND NOT job_open AND retries >= 3
              THEN 'Auto-repair exhausted. Permanently hiding (Rejected).' END,
            CASE WHEN score < 90 AND url IS NULL THEN 'Cannot auto-repair: No source URL.' END
          ) AS log,
          calories, score < 90 AND url IS NOT NULL AND NOT job_open AND retries < 3 AS schedule,
          retries FROM v""",
    ),
    "audit_write_back": (
        audit_write_back,
        f"""
        WITH {_RECIPES_SQL}
        SELECT id, CASE WHEN status = 'quarantined' THEN status ELSE 'pending' END AS qa_status,
          CASE WHEN status = 'quarantined' THEN score ELSE 0 END AS quality_score,
          CASE WHEN status = 'quarantined' THEN image WHEN toxic = 1 THEN ''
            WHEN lang = 'de' THEN ' {{"url": "' || plain || '"}}'
            WHEN lang = 'fr' THEN '{{"url": "", "contentUrl": "' || plain || '"}}'
            ELSE image END AS image
        FROM v""",
    ),
    "audit_reschedule": (
        audit_reschedule,
        f"""
        WITH j AS (SELECT o_custkey,
          count(*) FILTER (o_orderstatus = 'O') AS open_jobs,
          arg_max(CAST(left(o_orderpriority, 1) AS INTEGER) - 1, (o_orderdate, o_orderkey))
            FILTER (o_orderstatus <> 'O') AS retries
          FROM orders GROUP BY o_custkey)
        SELECT CAST(c_custkey AS VARCHAR) AS url, 'pending' AS status,
          coalesce(retries, 0) + 1 AS retry_count, TIMESTAMP '{NOW}' AS created_at,
          false AS is_archived
        FROM customer LEFT JOIN j ON c_custkey = o_custkey
        WHERE coalesce(open_jobs, 0) = 0 AND coalesce(retries, 0) < 3""",
    ),
    "last_jobs": (
        last_jobs,
        """SELECT url, id, updated_at FROM (SELECT o_custkey AS url, o_orderkey AS id,
          o_orderdate AS updated_at, row_number() OVER (PARTITION BY o_custkey
          ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
          FROM orders WHERE o_orderstatus <> 'O') WHERE rn = 1""",
    ),
    "image_json_repair": (
        image_json_repair,
        """SELECT event_id,
        CASE event_type WHEN 'click' THEN 'https://i/' || k WHEN 'view' THEN 'https://c/' || k
          WHEN 'error' THEN '{"url": "https://' || k WHEN 'signup' THEN 'https://p/' || k
          ELSE props END AS kept,
        CASE event_type WHEN 'click' THEN 'https://i/' || k WHEN 'view' THEN 'https://c/' || k
          WHEN 'signup' THEN 'https://p/' || k END AS cleared
        FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
    ),
    "value_backfill": (
        value_backfill,
        """SELECT o_orderkey,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice ELSE c_acctbal END AS price,
        o_orderpriority = '5-LOW' AND c_acctbal IS NOT NULL AS backfilled
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""",
    ),
}
