"""The streaming jobs over the given tables, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import fixed
from larder.operators import tables
from larder.operators.shaping import attach
from larder.plans import audit as au
from larder.plans import jobs as jb
from larder.plans import pages as pg
from larder.session import run_folder, table
from larder.sources.store import Store
from larder.streaming import audit as ad
from larder.streaming import intervals as iv
from larder.streaming import jobs as st


def _stream(spark, d, name):
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
        .option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}*")
    )


def stream_audit(spark, d):
    """Documents arriving as recipes to audit, against the static side tables."""
    folder = run_folder(spark, "stream-audit")

    def job(batch):
        return au.flat(au.audited(spark, d, batch))

    query = st.append_batches(
        _stream(spark, d, "documents"), job, f"{folder}/rows", f"{folder}/progress"
    )
    query.awaitTermination()
    return st.batches(spark, f"{folder}/rows").drop("batch")


def audit_loop(spark, d):
    """Recipes of which every seventh has its verdict already; a fifth is stored before, the others
    arrive. Verdicts and scheduled jobs after all rounds, one of them repeated."""
    folder = run_folder(spark, "audit-loop")
    store = Store(spark, f"{folder}/tables")
    done = F.col("doc_id") % 7 == 0
    now = F.lit(au.NOW).cast("timestamp_ntz")

    def recipes(docs):
        rows = au.recipes(spark, d, docs).withColumn("_done", F.col("id").cast("bigint") % 7 == 0)
        return rows.withColumns({
            "qa_status": F.when(F.col("_done"), "verified").otherwise(F.col("qa_status")),
            "last_audited_at": F.when(F.col("_done"), now - F.expr("INTERVAL 1 DAY")),
        }).drop("_done")

    docs = table(spark, d, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    started = F.lit("2024-05-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("updated_at"))
    known = au.jobs(spark, d).withColumns({
        "id": F.col("id").cast("string"), "updated_at": started, "log": F.lit(None).cast("string"),
    })
    ad.add_jobs(store, known, buckets=8)
    store.upsert("recipes", recipes(docs.filter(done | (F.col("doc_id") % 5 == 0))), "id", buckets=8)
    arriving = _stream(spark, d, "documents").filter(~done & (F.col("doc_id") % 5 != 0))

    def work(batch, number):
        for _ in range(2):  # a repeated round does nothing
            ad.audit_round(store, number, now, lambda: (au.checks(spark, d), au.nutrition(spark, d)), recipes(batch), 8)

    query = (
        arriving.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    new = store.read("jobs").filter(F.col("log") == fixed.RECRAWL_LOG).groupBy("url").agg(
        F.count(F.lit(1)).alias("new_jobs"), F.max("retry_count").alias("attempt")
    )
    return attach(store.read("recipes"), new, ["url"]).select(
        "id", "image", "qa_status", "quality_score", "last_audited_at", F.array_join("audit_log", " ").alias("log"),
        F.col("nutrition.calories").alias("calories"), F.coalesce("new_jobs", F.lit(0)).alias("new_jobs"), "attempt",
    )


def stream_extract(spark, d):
    """Parts arriving as recipe pages; what is stored in the end, one row per url."""
    folder = run_folder(spark, "stream-extract")
    now = F.lit(pg.NOW).cast("timestamp_ntz")
    arriving = pg.as_pages(_stream(spark, d, "part"))
    st.extract_stream(arriving, f"{folder}/rows", f"{folder}/progress", now).awaitTermination()
    rows = st.batches(spark, f"{folder}/rows")
    stored = tables.fold_changes(
        rows, "url", F.col("batch"), overwrite=["image", "recipe_yield"]
    )
    return pg.flat(stored).drop("block", "place")


def stream_min_interval(spark, d):
    """Events accepted at least a minute after the last accepted one of their user."""
    folder = run_folder(spark, "stream-interval")
    events = _stream(spark, d, "events").select("user_id", "ts")
    store = Store(spark, f"{folder}/state")
    iv.accept_corrected(events, "user_id", "ts", store, f"{folder}/progress", buckets=8).awaitTermination()
    rows = iv.accepted_now(store, "user_id", events)
    return rows.select(
        "user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts")
    )


def _only(columns: str, query: str) -> str:
    return f"SELECT {columns} FROM ({query})"


_AUDIT_LOOP_SQL = f"""
    WITH a AS ({au.QUERIES["audit_decision"][1]}),
    b AS ({au.RECIPES_BEFORE_SQL})
    SELECT a.id, CASE WHEN done THEN b.image ELSE a.image END AS image,
      CASE WHEN done THEN 'verified' ELSE a.qa_status END AS qa_status,
      CASE WHEN done THEN 0 ELSE a.quality_score END AS quality_score,
      CASE WHEN done THEN a.last_audited_at - INTERVAL 1 DAY ELSE a.last_audited_at END AS last_audited_at,
      CASE WHEN done THEN '' ELSE a.log END AS log, CASE WHEN done THEN b.calories ELSE a.calories END AS calories,
      CAST(CASE WHEN a.schedule AND NOT done THEN 1 ELSE 0 END AS BIGINT) AS new_jobs,
      CASE WHEN a.schedule AND NOT done THEN retries + 1 END AS attempt
    FROM a JOIN b ON a.id = b.id"""

QUERIES = {
    "audit_loop": (audit_loop, _AUDIT_LOOP_SQL),
    "stream_audit": (stream_audit, au.QUERIES["audit_decision"][1]),
    "stream_extract": (stream_extract, pg.QUERIES["page_stored"][1]),
    "stream_min_interval": (
        stream_min_interval, _only("user_id, ts", jb.QUERIES["min_interval_accept"][1]),
    ),
}
