"""Job, key and interval queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import intervals, keys
from larder.operators import jobs as j
from larder.operators.shaping import spread
from larder.session import table

_NOW = "2024-01-20 00:00:00"
_WAIT = 6 * 3600


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _jobs(spark, d):
    events = table(spark, d, "events")
    whole = F.floor("value").cast("int")
    status = (
        F.when(F.col("event_type") == "click", "pending")
        .when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "error", "cooling_down")
        .when(F.col("event_type") == "signup", "completed")
        .otherwise("failed")
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("shop.example/"), F.get_json_object("props", "$.k")).alias("url"),
        status.alias("status"),
        F.lit(0).alias("recipes_found"),
        F.lit(None).cast("string").alias("log"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), whole)).alias("updated_at"),
        (F.col("value") > 150).alias("is_archived"),
        F.when(F.col("event_type") == "error",
               F.col("ts") + F.make_dt_interval(F.lit(0), whole)).alias("next_retry_at"),
        (whole % 4).alias("retry_count"),
    )


_SQL = """
    j AS (SELECT event_id AS id, 'shop.example/' || json_extract_string(props, '$.k') AS url,
      CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing'
        WHEN 'error' THEN 'cooling_down' WHEN 'signup' THEN 'completed' ELSE 'failed' END AS status,
      0 AS recipes_found, CAST(NULL AS VARCHAR) AS log, ts AS created_at,
      ts + to_minutes(CAST(floor(value) AS INTEGER)) AS updated_at, value > 150 AS is_archived,
      CASE WHEN event_type = 'error' THEN ts + to_hours(CAST(floor(value) AS INTEGER)) END
        AS next_retry_at,
      CAST(CAST(floor(value) AS INTEGER) % 4 AS INTEGER) AS retry_count FROM events)"""
_DUE = f"""(status = 'pending' OR (status = 'cooling_down' AND next_retry_at <= TIMESTAMP '{_NOW}'))
      AND NOT is_archived"""


def due(spark, d):
    return j.due(_jobs(spark, d), _now(), 20)


def claim(spark, d):
    jobs = _jobs(spark, d)
    return j.claim(jobs, j.due(jobs, _now(), None).select("id"), _now())


def listing(spark, d):
    jobs = _jobs(spark, d)
    return j.active(jobs).withColumn("list", F.lit("active")).unionByName(
        j.archived(jobs).withColumn("list", F.lit("archived"))
    )


def new(spark, d):
    events = table(spark, d, "events", ["event_id", "event_type", "user_id"])
    bare = F.concat(F.lit("shop.example/"), F.col("event_id").cast("string"))
    urls = events.select(
        F.when(F.col("event_type") == "click", F.concat(F.lit("http://"), bare))
        .when(F.col("event_type") == "view", F.concat(F.lit("HTTPS://"), bare))
        .when(F.col("event_type") == "error", F.lit(""))
        .otherwise(bare).alias("url")
    )
    return j.new_jobs(urls, _now()).select("url", "status", "is_archived", "retry_count", "created_at")


def archive(spark, d):
    jobs = j.archive(_jobs(spark, d), _now(), F.lit(3))
    jobs = j.cancel(jobs, ["pending", "processing", "blocked"], log="Cancelled in bulk")
    return jobs.select("id", "status", "log", "is_archived", "updated_at")


def archive_all(spark, d):
    return j.archive(_jobs(spark, d), _now()).select("id", "status", "log", "updated_at")


def cool_down(spark, d):
    jobs = _jobs(spark, d)
    return j.cool_down(jobs, F.col("status") == "processing", _now()).select(
        "id", "status", "next_retry_at", "updated_at"
    )


def _requests(spark, d):
    events = table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    return events.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("request_no"),
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("int")).otherwise(0)
        .alias("found"),
        (F.col("value") > 200).alias("blocked"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("Request failed "), F.col("event_id").cast("string"))).alias("error"),
        F.when(F.col("value") > 200, j.block_reason(
            F.when(F.col("event_type") == "click", 429).when(F.col("event_type") == "view", 403),
            F.concat(F.lit("shop.example/"), F.col("event_id").cast("string")))).alias("reason"),
        F.when((F.col("event_type") == "signup") & (F.col("value") < 10),
               F.concat(F.lit("Crawler stopped at "), F.col("event_id").cast("string"))).alias("failure"),
    )


def results(spark, d):
    return j.crawl_results(_requests(spark, d))


def logs(spark, d):
    return j.crawl_logs(_requests(spark, d), width=2000)


def record(spark, d):
    requests = _requests(spark, d)
    return j.record_results(_jobs(spark, d), j.crawl_results(requests), _now(), j.job_logs(requests)).select(
        "id", "status", "recipes_found", "log", "next_retry_at", "updated_at"
    )


def _keys(spark, d):
    events = spread(table(spark, d, "events", ["event_id", "user_id", "event_type", "ts"]))
    user = F.col("user_id").cast("string")
    email = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("bad mail"), user))
        .when(F.col("event_type") == "view", F.concat(F.lit("USER"), user, F.lit("@Shop.Example")))
        .otherwise(F.concat(F.lit("User"), user, F.lit("+"), "event_type", F.lit("@shop.example")))
    )
    return keys.key_rows(
        events.select(
            F.col("event_id").alias("id"), email.alias("email"),
            F.concat(F.lit("sk_"), F.col("event_id").cast("string")).alias("raw_key"),
            F.col("ts").alias("created_at"),
        )
    )


def key_latest(spark, d):
    return keys.activate_latest(_keys(spark, d))


def key_match(spark, d):
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey"]).withColumn(
        "raw_key", F.concat(F.lit("sk_"), F.col("o_orderkey").cast("string"))
    )
    return keys.authorised(orders, keys.activate_latest(_keys(spark, d)))


def last_used(spark, d):
    events = table(spark, d, "events", ["user_id", "ts"])
    records = table(spark, d, "customer", ["c_custkey"]).select(
        F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("last_used_at")
    )
    uses = events.select(F.col("user_id").alias("id"), F.col("ts").alias("used_at"))
    return keys.record_use(records, uses)


def several_active(spark, d):
    events = table(spark, d, "events", ["user_id", "value"])
    rows = events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("@shop.example")).alias("owner_email"),
        (F.col("value") > 120).alias("is_active"),
    )
    return keys.several_active(rows)


def interval_minute(spark, d):
    events = table(spark, d, "events", ["event_id", "user_id", "ts"])
    return _naive(intervals.accepted_events(events, "user_id", "ts", "event_id"))


def interval_long(spark, d):
    events = table(spark, d, "events", ["event_id", "user_id", "ts"])
    return _naive(
        intervals.accepted_events(events, "user_id", "ts", "event_id", _WAIT)
    )


def _naive(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def cache_use(spark, d):
    events = table(spark, d, "events", ["event_type", "ts"])
    return intervals.cache_use(events, "event_type", "ts", 3600)


def _chain(key: str, gap: int) -> str:
    """Accepted times per key: every event's follower, walked from the first event."""
    return f"""
    e AS (SELECT DISTINCT {key}, ts FROM events),
    f AS MATERIALIZED (SELECT {key}, ts, min(ts) OVER (PARTITION BY {key} ORDER BY ts
      RANGE BETWEEN INTERVAL {gap} SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e),
    a AS (SELECT {key}, min(ts) AS ts FROM e GROUP BY 1
      UNION ALL
      SELECT a.{key}, f.next FROM a JOIN f ON a.{key} = f.{key} AND a.ts = f.ts
      WHERE f.next IS NOT NULL)"""


def _chain_sql(gap: int) -> str:
    return f"""
    WITH RECURSIVE {_chain('user_id', gap)}
    SELECT a.user_id, min(v.event_id) AS event_id, a.ts FROM a JOIN events v
      ON a.user_id = v.user_id AND a.ts = v.ts GROUP BY a.user_id, a.ts"""


_KEYS_SQL = """
    k AS (SELECT event_id AS id, ts AS created_at,
      CASE event_type WHEN 'view' THEN 'USER' || user_id || '@Shop.Example'
        ELSE 'User' || user_id || '+' || event_type || '@shop.example' END AS owner_name,
      'user' || user_id || '@shop.example' AS owner_email,
      sha256('sk_' || event_id) AS key_hash FROM events WHERE event_type <> 'error'),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner_email
      ORDER BY created_at DESC, id DESC) = 1 AS is_active FROM k)"""

_RESULTS_SQL = """
    r AS (SELECT user_id AS job_id,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INTEGER) ELSE 0 END)
        AS BIGINT) AS recipes_found,
      count(*) FILTER (event_type = 'error') AS errors,
      CASE WHEN max(value) > 200 THEN 'cooling_down'
        WHEN bool_or(event_type = 'signup' AND value < 10) THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN max(value) > 200 THEN arg_max(CASE event_type WHEN 'click' THEN 'HTTP 429'
          WHEN 'view' THEN 'HTTP 403' ELSE 'Anti-bot page' END || ' at shop.example/' || event_id, event_id)
          FILTER (value > 200)
        ELSE 'Crawler stopped at ' || max(event_id) FILTER (event_type = 'signup' AND value < 10)
        END AS reason,
      string_agg('Request failed ' || event_id, chr(10) ORDER BY event_id)
        FILTER (event_type = 'error') AS messages
      FROM events GROUP BY user_id)"""

QUERIES = {
    "jobs_due": (
        due, f"WITH {_SQL} SELECT * FROM j WHERE {_DUE} ORDER BY created_at, id LIMIT 20",
    ),
    "jobs_claim": (
        claim,
        f"""WITH {_SQL}
        SELECT id, url, CASE WHEN hit THEN 'processing' ELSE status END AS status, recipes_found,
          log, created_at, CASE WHEN hit THEN TIMESTAMP '{_NOW}' ELSE updated_at END AS updated_at,
          is_archived, CASE WHEN NOT hit THEN next_retry_at END AS next_retry_at,
          CAST(retry_count + CASE WHEN hit AND status = 'cooling_down' THEN 1 ELSE 0 END AS INTEGER)
            AS retry_count
        FROM (SELECT *, coalesce({_DUE}, false) AS hit FROM j)""",
    ),
    "jobs_listing": (
        listing,
        f"""WITH {_SQL}
        (SELECT *, 'active' AS list FROM j WHERE NOT is_archived
          ORDER BY created_at DESC, id DESC LIMIT 20)
        UNION ALL (SELECT *, 'archived' AS list FROM j WHERE is_archived
          ORDER BY updated_at DESC, id DESC LIMIT 5)""",
    ),
    "jobs_new": (
        new,
        f"""SELECT CASE event_type WHEN 'click' THEN 'http://' WHEN 'view' THEN 'HTTPS://'
          ELSE 'https://' END || 'shop.example/' || event_id AS url, 'pending' AS status,
          false AS is_archived, 0 AS retry_count, TIMESTAMP '{_NOW}' AS created_at
        FROM events WHERE event_type <> 'error'""",
    ),
    "jobs_archive": (
        archive,
        f"""WITH {_SQL}
        SELECT id, CASE WHEN id = 3 OR status IN ('pending', 'processing') THEN 'failed'
            ELSE status END AS status,
          CASE WHEN id = 3 THEN 'Archived/Stopped by user'
            WHEN status IN ('pending', 'processing') THEN 'Cancelled in bulk' END AS log,
          is_archived OR id = 3 AS is_archived,
          CASE WHEN id = 3 THEN TIMESTAMP '{_NOW}' ELSE updated_at END AS updated_at FROM j""",
    ),
    "jobs_archive_all": (
        archive_all,
        f"""WITH {_SQL}
        SELECT id, CASE WHEN is_archived THEN status ELSE 'failed' END AS status,
          CASE WHEN is_archived THEN NULL ELSE 'Archived/Stopped by user' END AS log,
          CASE WHEN is_archived THEN updated_at ELSE TIMESTAMP '{_NOW}' END AS updated_at FROM j""",
    ),
    "jobs_cool_down": (
        cool_down,
        f"""WITH {_SQL}
        SELECT id, CASE status WHEN 'processing' THEN 'cooling_down' ELSE status END AS status,
          CASE status WHEN 'processing' THEN TIMESTAMP '{_NOW}'
            + to_hours(CAST((retry_count + 1) * 24 AS INTEGER)) ELSE next_retry_at END
            AS next_retry_at,
          CASE status WHEN 'processing' THEN TIMESTAMP '{_NOW}' ELSE updated_at END AS updated_at
        FROM j""",
    ),
    "job_results": (
        results,
        f"""WITH {_RESULTS_SQL} SELECT job_id, recipes_found, errors, status, reason FROM r""",
    ),
    "job_logs": (
        logs,
        """SELECT user_id AS job_id, CAST(floor(event_id / 2000) AS BIGINT) AS part,
          string_agg('Request failed ' || event_id, chr(10) ORDER BY event_id) AS log
        FROM events WHERE event_type = 'error' GROUP BY ALL""",
    ),
    "job_record": (
        record,
        f"""WITH {_SQL}, {_RESULTS_SQL}
        SELECT j.id, coalesce(r.status, j.status) AS status,
          CAST(coalesce(r.recipes_found, j.recipes_found) AS INTEGER) AS recipes_found,
          CASE r.status WHEN 'cooling_down'
            THEN 'Blocked: ' || reason || '. Retrying in ' || (retry_count + 1) * 24 || ' hours.'
            WHEN 'failed' THEN reason ELSE messages END AS log,
          CASE r.status WHEN 'cooling_down' THEN TIMESTAMP '{_NOW}'
            + to_hours(CAST((retry_count + 1) * 24 AS INTEGER)) ELSE next_retry_at END
            AS next_retry_at,
          CASE WHEN r.job_id IS NULL THEN updated_at ELSE TIMESTAMP '{_NOW}' END AS updated_at
        FROM j LEFT JOIN r ON j.id = r.job_id""",
    ),
    "key_latest_per_owner": (
        key_latest,
        f"""WITH {_KEYS_SQL}
        SELECT id, key_hash, owner_name, owner_email, created_at, is_active FROM r""",
    ),
    "key_match": (
        key_match,
        f"""WITH {_KEYS_SQL}
        SELECT o_orderkey, o_custkey, 'sk_' || o_orderkey AS raw_key FROM orders
        WHERE sha256('sk_' || o_orderkey) IN (SELECT key_hash FROM r WHERE is_active)""",
    ),
    "last_used": (
        last_used,
        """SELECT c_custkey AS id, max(ts) AS last_used_at FROM customer
        LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey""",
    ),
    "several_active": (
        several_active,
        """SELECT user_id || '@shop.example' AS owner_email, count(*) AS active_keys FROM events
        WHERE value > 120 GROUP BY user_id HAVING count(*) > 1""",
    ),
    "min_interval_accept": (interval_minute, _chain_sql(60)),
    "min_interval_long": (interval_long, _chain_sql(_WAIT)),
    "key_cache_use": (
        cache_use,
        f"""
        WITH RECURSIVE {_chain('event_type', 3600)},
        m AS (SELECT event_type, count(*) AS misses FROM a GROUP BY 1),
        n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
        SELECT event_type, n - misses AS hits, misses FROM n JOIN m USING (event_type)""",
    ),
}
