"""The audit loop over stored tables: what it chooses, both sinks in one step, repeated and lost rounds."""

import pytest
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.schemas import CRAWL_JOBS, RECIPES
from larder.sources.store import Store
from larder.streaming import audit

def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _recipes(spark, rows):
    """Recipes (id, url, status, audited) that score low."""
    made = [(i, url, f"name {i}", s, a) for i, url, s, a in rows]
    df = spark.createDataFrame(made, "id string, url string, name string, qa_status string, last_audited_at string")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(0) if f.name == "quality_score" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RECIPES.fields
    ])


def _sides(spark):
    checks = spark.createDataFrame([], "url string, ok boolean")
    nutrition = spark.createDataFrame([], "name string").withColumn("nutrition", F.lit(None).cast(RECIPES["nutrition"].dataType))
    return lambda: (checks, nutrition)


def _state(store):
    recipes = {r["id"]: (r.qa_status, r.last_audited_at is not None) for r in store.read("recipes").collect()}
    jobs = store.read("jobs")
    made = [] if jobs is None else sorted((r.url, r.retry_count) for r in jobs.filter(F.col("log") == fixed.RECRAWL_LOG).collect())
    return recipes, made


def _job(spark, url, status, retries):
    row = (f"{url}-{status}", url, status, 0, None, None, None, False, None, retries)
    return spark.createDataFrame([row], CRAWL_JOBS).withColumn("updated_at", now())


def test_rounds(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    sides = _sides(spark)
    assert not audit.audit_round(store, 0, now(), sides)  # nothing stored yet
    jobs = _job(spark, "u1", "failed", 1).union(_job(spark, "u2", "processing", 0)).union(_job(spark, "u3", "failed", 3))
    audit.add_jobs(store, jobs, buckets=4)
    old = [("1", "u1", "pending", None), ("2", "u2", "verified", None), ("9", "u9", "verified", "2024-01-01"), ("8", "u8", "flagged", "2024-01-01")]
    store.upsert("recipes", _recipes(spark, old), "id", buckets=4)
    arriving = _recipes(spark, [("3", "u3", "pending", None), ("8", "u8", "pending", "2024-01-01"), (None, "u7", "pending", None)])
    before = store.version()

    with monkeypatch.context() as m:
        m.setattr(Store, "appended", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            audit.audit_round(store, 1, now(), sides, arriving)
    assert store.version() == before  # neither sink has changed

    assert audit.audit_round(store, 1, now(), sides, arriving)
    want = {
        "1": ("quarantined", True), "2": ("quarantined", True), "3": ("rejected", True),
        "8": ("quarantined", True), "9": ("verified", True),
    }
    assert _state(store) == (want, [("u1", 2), ("u8", 1)])
    assert store.version().number == before.number + 1  # both in one step
    assert not audit.audit_round(store, 1, now(), sides, arriving)
    assert _state(store) == (want, [("u1", 2), ("u8", 1)])

    # arriving again while its job is open: audited, but no second job
    assert audit.audit_round(store, 2, now(), sides, arriving)
    assert _state(store) == (want, [("u1", 2), ("u8", 1)])
    # a round of its own finds nothing due
    assert not audit.audit_round(store, 3, now(), sides)


def test_stream_and_empty_batches(spark, tmp_path):
    store, sides = Store(spark, str(tmp_path / "t")), _sides(spark)
    for n in range(2):
        _recipes(spark, [(str(n), f"u{n}", "pending", None)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RECIPES).parquet(str(tmp_path / "in"))
        audit.audit_stream(stream, store, str(tmp_path / "p"), lambda _: now(), sides, buckets=2).awaitTermination()
    assert _state(store) == ({"0": ("quarantined", True), "1": ("quarantined", True)}, [("u0", 1), ("u1", 1)])
    assert audit.audit_round(store, 99, now(), sides, _recipes(spark, []))
    assert _state(store)[1] == [("u0", 1), ("u1", 1)]


def test_a_round_writes_whole_rows_once(spark, tmp_path, monkeypatch):
    """What arrived and the verdicts go into the buckets together; between them only short columns are kept."""
    store = Store(spark, str(tmp_path))
    store.upsert("recipes", _recipes(spark, [("1", "u1", "pending", None), ("2", "u2", "verified", "2024-01-01")]), "id", buckets=4)
    arriving = _recipes(spark, [("2", "u2", "pending", "2024-01-01"), ("3", "u3", "verified", "2024-01-01"), ("4", "u4", "pending", None)])
    arriving = arriving.withColumn("description", F.repeat(F.lit("soup "), 100))
    whole, kept, plain = [], {}, Store._written
    monkeypatch.setattr(Store, "_written", lambda self, name, *rest: whole.append(name) or plain(self, name, *rest))
    keep = audit.written
    monkeypatch.setattr(audit, "written", lambda df, label, *rest: kept.setdefault(label, keep(df, label, *rest)))
    assert audit.audit_round(store, 0, now(), _sides(spark), arriving, 4)
    assert whole.count("recipes") == 1
    assert not {"description", "recipe_instructions"} & {*kept["audit-todo"].columns, *kept["audit-verdicts"].columns}
    rows = {r["id"]: r for r in store.read("recipes").collect()}
    assert {i: r.qa_status for i, r in rows.items()} == {"1": "quarantined", "2": "quarantined", "3": "verified", "4": "quarantined"}
    assert rows["4"].description == "soup " * 100 and rows["4"].quality_score == 20 and rows["1"].quality_score == 10


def test_brief_rows_measure_as_whole_ones(spark):
    from larder.operators import audit as au

    made = _recipes(spark, [(str(i), "u", "pending", None) for i in range(5)]).withColumns({
        "description": F.expr("CASE id WHEN '0' THEN NULL WHEN '1' THEN '' WHEN '2' THEN '0123456789' ELSE '01234567890' END"),
        "recipe_instructions": F.expr("CASE id WHEN '0' THEN NULL WHEN '1' THEN array() WHEN '2' THEN array(NULL) ELSE array('a', 'b') END").cast(RECIPES["recipe_instructions"].dataType),
    })
    facts = ["id", "quality_score", "no_steps"]
    assert sorted(au.measured(au.brief(made)).select(facts).collect()) == sorted(au.measured(made).select(facts).collect())
