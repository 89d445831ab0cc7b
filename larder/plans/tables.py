"""Table-writing queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import tables as t
from larder.operators.shaping import spread
from larder.session import run_folder, table
from larder.sources.store import Store


def dedup_latest(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text", "source", "n_chars"])
    return t.keep_latest(docs, ["text"], [F.desc("doc_id")]).select("doc_id", "source", "n_chars")


def upsert_by_key(spark, d):
    orders = table(
        spark, d, "orders",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    )
    old = orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    changed = orders.filter(F.col("o_orderstatus") == "P")
    low = F.col("o_orderpriority") == "5-LOW"
    first = changed.withColumn("place", F.lit(1)).withColumn(
        "o_totalprice", F.when(~low, F.col("o_totalprice") * 2)
    ).withColumn("o_orderpriority", F.when(~low, F.lit("CHANGED")))
    again = changed.filter(F.col("o_orderpriority") == "1-URGENT").withColumn(
        "place", F.lit(2)
    ).withColumn("o_custkey", -F.col("o_custkey"))
    return t.upsert(
        old, first.unionByName(again), "o_orderkey", order=[F.desc("place")],
        overwrite=["o_orderpriority"], keep=["o_orderdate"],
    )


def upsert_batches(spark, d):
    """Orders up to 1996 as a stored table, then three batches: new orders with changed prices, urgent
    orders once more, and orders under new keys."""
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    dates = table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    store = Store(spark, run_folder(spark, "upsert-batches"))
    known = orders.join(dates.filter(F.year("o_orderdate") <= 1996), "o_orderkey", "left_semi")
    open_orders = orders.filter(F.col("o_orderstatus") == "O")
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    batches = [
        known,
        open_orders.withColumn("o_totalprice", F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") * 2)),
        urgent.withColumn("o_custkey", -F.col("o_custkey")).withColumn("o_orderpriority", F.lit(None).cast("string")),
        orders.filter(F.col("o_orderstatus") == "P").withColumn("o_orderkey", -F.col("o_orderkey")),
    ]
    for number, rows in enumerate(batches):
        store.upsert("orders", rows, "o_orderkey", buckets=8, mark=("load", number), overwrite=["o_orderpriority"])
        store.upsert("orders", rows, "o_orderkey", mark=("load", number))  # a repeated batch does nothing
    return store.read("orders")


def fold_changes(spark, d):
    events = table(spark, d, "events")
    changes = events.select(
        "user_id", "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        F.when(F.col("value") > 100, F.col("value")).alias("value"),
        F.when(F.col("event_type") == "click", F.col("props")).alias("props"),
        F.col("ts").alias("created_at"),
    )
    return t.fold_changes(
        changes, "user_id", F.col("event_id"), overwrite=["props", "event_id"], keep=["created_at"]
    )


def update_from_payload(spark, d):
    events = spread(table(spark, d, "events", ["event_id", "user_id", "props"]))
    k = F.get_json_object("props", "$.k")
    payload = F.concat(
        F.lit('[{"id":'), F.col("user_id"), F.lit(',"k":'), k, F.lit('},{"id":'),
        F.col("user_id") + 100000000, F.lit(',"k":1}]'),
    )
    items = t.payload_rows(events.select("event_id", payload.alias("payload")), "payload",
                           "id: bigint, k: double")
    changes = items.select(
        "event_id", "place", F.col("id").alias("c_custkey"), F.col("k").alias("c_acctbal")
    )
    customer = table(spark, d, "customer", ["c_custkey", "c_name", "c_acctbal"])
    return t.update_by_key(
        customer, changes, "c_custkey", ["c_acctbal"], [F.desc("event_id"), F.desc("place")]
    )


QUERIES = {
    "dedup_latest": (
        dedup_latest,
        """SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER
        (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""",
    ),
    "upsert_by_key": (
        upsert_by_key,
        """
        WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
        n AS (SELECT o_orderkey,
          CASE WHEN o_orderpriority = '1-URGENT' THEN -o_custkey ELSE o_custkey END AS o_custkey,
          o_orderstatus,
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL
               WHEN o_orderpriority = '1-URGENT' THEN o_totalprice
               ELSE o_totalprice * 2 END AS o_totalprice,
          o_orderdate,
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL
               WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority
               ELSE 'CHANGED' END AS o_orderpriority
          FROM orders WHERE o_orderstatus = 'P')
        SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
          coalesce(n.o_custkey, o.o_custkey) AS o_custkey,
          coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
          coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice,
          coalesce(o.o_orderdate, n.o_orderdate) AS o_orderdate,
          CASE WHEN n.o_orderkey IS NULL THEN o.o_orderpriority ELSE n.o_orderpriority END
            AS o_orderpriority
        FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey""",
    ),
    "upsert_batches": (
        upsert_batches,
        """
        WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
        k AS (SELECT o_orderkey FROM orders WHERE year(o_orderdate) <= 1996),
        s AS (SELECT a.*, k.o_orderkey IS NOT NULL AS known, o_orderstatus = 'O' AS opened,
          o_orderpriority = '1-URGENT' AS urgent FROM a LEFT JOIN k ON a.o_orderkey = k.o_orderkey)
        SELECT o_orderkey, CASE WHEN urgent THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus,
          CASE WHEN urgent THEN o_totalprice
               WHEN opened AND o_custkey % 2 = 0 THEN o_totalprice * 2
               WHEN opened AND NOT known THEN NULL ELSE o_totalprice END AS o_totalprice,
          CASE WHEN NOT urgent THEN o_orderpriority END AS o_orderpriority
        FROM s WHERE known OR opened OR urgent
        UNION ALL
        SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM a WHERE o_orderstatus = 'P'""",
    ),
    "fold_changes": (
        fold_changes,
        """SELECT user_id, max(event_id) AS event_id,
        arg_max(event_type, event_id) FILTER (event_type <> 'error') AS event_type,
        arg_max(value, event_id) FILTER (value > 100) AS value,
        (SELECT CASE WHEN e.event_type = 'click' THEN e.props END FROM events e
          WHERE e.event_id = max(events.event_id)) AS props,
        arg_min(ts, event_id) AS created_at
        FROM events GROUP BY user_id""",
    ),
    "update_from_payload": (
        update_from_payload,
        """
        WITH n AS (SELECT user_id, arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE),
          event_id) AS k FROM events GROUP BY user_id)
        SELECT c_custkey, c_name, coalesce(k, c_acctbal) AS c_acctbal
        FROM customer LEFT JOIN n ON c_custkey = user_id""",
    ),
}
