"""Audit, sinks and streams."""

import glob
import json
import os
import tempfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from larder.operators import audit, nutrition, publish, tables
from larder.operators import pages as pg
from larder.schemas import API_KEYS, CRAWL_JOBS, INGREDIENT_CACHE, PAGES, RECIPES
from larder.sources import readers, writers
from larder.streaming import jobs as st
from tests.test_pages import LD, LONG


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="larder-test-")


NOW = "2024-06-01 00:00:00"


def recipe(id, **kw):
    row = {f.name: None for f in RECIPES.fields}
    row.update(
        id=id, url=f"https://x/{id}", name="Soup", image="https://img.example/ok.jpg",
        description="long enough text", cook_time="PT5M", recipe_ingredients=["a"],
        recipe_instructions=["b"], nutrition=None, created_at=None, updated_at=None, qa_status="pending",
        audit_log=[], quality_score=0,
    )
    row.update(kw)
    return row


def run_audit(spark, recipes, jobs=(), known=()):
    schema = "id string, url string, name string, image string, description string, cook_time string, " \
             "prep_time string, recipe_ingredients array<string>, recipe_instructions array<string>, " \
             "nutrition struct<calories:double>, qa_status string, last_audited_at timestamp, " \
             "audit_log array<string>, quality_score int"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in recipes], schema)
    checks = spark.createDataFrame(
        [("https://img.example/ok.jpg", True), ("https://img.example/bad.jpg", False)], "url string, ok boolean"
    )
    table = spark.createDataFrame(list(known), "name string, nutrition struct<calories:double>")
    queue = spark.createDataFrame(
        list(jobs), "id int, url string, status string, retry_count int, updated_at int"
    )
    out = audit.audit(df, checks, table, queue, F.lit(NOW).cast("timestamp"))
    return out, {r["id"]: r for r in out.collect()}


def test_audit_verdicts(spark):
    out, got = run_audit(
        spark,
        [
            recipe("good"),
            recipe("json", image='{"url":"https://img.example/ok.jpg"}'),
            recipe("bad", image="https://img.example/bad.jpg"),
            recipe("unchecked", image="https://img.example/unknown.jpg"),
            recipe("noimage", image=None),
            recipe("nosteps", recipe_instructions=[]),
            recipe("open", image="", ), recipe("spent", image=""), recipe("nourl", image="", url=None),
            recipe("filled", name="Stew"),
        ],
        jobs=[
            (1, "https://x/open", "cooling_down", 1, 5),
            (2, "https://x/spent", "failed", 3, 5), (3, "https://x/spent", "completed", 0, 4),
            (4, "https://x/noimage", "failed", 1, 5), (5, "https://x/noimage", "failed", 7, 4),
        ],
        known=[("Stew", (1.0,))],
    )
    status = {k: r["qa_status"] for k, r in got.items()}
    assert status == {
        "good": "verified", "json": "verified", "bad": "flagged", "unchecked": "flagged",
        "noimage": "quarantined", "nosteps": "quarantined", "open": "quarantined", "spent": "rejected",
        "nourl": "rejected", "filled": "verified",
    }
    assert got["json"]["image"] == "https://img.example/ok.jpg"
    assert got["json"]["audit_log"][0] == "Auto-repaired image URL from JSON object."
    assert got["filled"]["nutrition"]["calories"] == 1.0 and got["filled"]["quality_score"] == 100
    assert all(0 <= r["quality_score"] <= 100 for r in got.values())
    due = {r["url"]: r["retry_count"] for r in audit.recrawl_jobs(out, F.lit(NOW).cast("timestamp")).collect()}
    assert due == {"https://x/noimage": 2, "https://x/nosteps": 1}


def test_schemas_are_usable(spark):
    for schema in (RECIPES, CRAWL_JOBS, INGREDIENT_CACHE, API_KEYS, PAGES):
        assert spark.createDataFrame([], schema).count() == 0
    assert [f.name for f in RECIPES.fields if not f.nullable] == [
        "id", "name", "created_at", "updated_at", "qa_status"
    ]


def test_append_with_defaults(spark, folder):
    df = spark.createDataFrame([("1", "a", None), ("2", None, "x"), ("3", "", None)], "id string, name string, s string")
    writers.append_rows(df, f"{folder}/t", ["name"], {"s": F.lit("pending")}, f"{folder}/no")
    assert [tuple(r) for r in readers.scan(spark, f"{folder}/t", ["id", "s"]).collect()] == [("1", "pending")]
    assert {r["id"] for r in readers.scan(spark, f"{folder}/no").collect()} == {"2", "3"}


def test_versioned_table(spark, folder):
    root = f"{folder}/cache"
    assert writers.read_current(spark, root) is None
    assert writers.clear_table(spark, root) == (0, 0)
    first = spark.createDataFrame([("a", 1), ("b", 2)], "term string, v int")
    writers.upsert_table(root, first, "term")
    writers.upsert_table(root, spark.createDataFrame([("b", 3), ("c", 4)], "term string, v int"), "term")
    assert sorted(tuple(r) for r in writers.read_current(spark, root).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert writers.clear_table(spark, root) == (3, 0)
    assert writers.read_current(spark, root).count() == 0


def _xml_files(folder, tag):
    """Number of the file to what its entries name; every file is one well-formed document."""
    out = {}
    for path in glob.glob(f"{folder}/*/*.txt"):
        root = ElementTree.parse(path).getroot()
        number = int(path.split("=")[-1].split("/")[0])
        assert root.tag.endswith(tag) and number not in out
        out[number] = [entry[0].text for entry in root]
    return out


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_sitemap_files(spark, folder, adaptive):
    recipes = spark.range(125).select(
        F.col("id").cast("string").alias("id"), F.lit("verified").alias("qa_status"),
        F.lit(NOW).cast("timestamp").alias("updated_at"),
    )
    lines = publish.sitemap_lines(recipes, "https://s.example", F.lit(NOW).cast("timestamp")).repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        index = writers.write_sitemaps(lines, folder, "https://s.example", per_file=6, per_index=4)
        count = index.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    maps = _xml_files(f"{folder}/maps", "}urlset")
    assert sorted(maps) == list(range(22)) and [len(maps[i]) for i in range(22)] == [6] * 21 + [3]
    urls = [u for i in range(22) for u in maps[i]]
    assert len(urls) == len(set(urls)) == 129 and urls == sorted(urls, key=lambda u: u + "<")  # in the order of the line
    named = _xml_files(f"{folder}/index", "}sitemapindex")
    assert [len(named[i]) for i in sorted(named)] == [4, 4, 4, 4, 4, 2] and count == 22
    entries = [e for i in sorted(named) for e in named[i]]
    assert [int(e.split("shard=")[1].split("/")[0]) for e in entries] == list(range(22))
    assert all(os.path.exists(e.replace("https://s.example", folder)) for e in entries)


def test_sitemap_of_no_line(spark, folder):
    lines = spark.createDataFrame([], "line string")
    assert writers.write_sitemaps(lines, folder, "https://s.example").count() == 0


def test_documents_and_report(spark, folder):
    df = spark.createDataFrame([("1", "Pie", ["2 cups milk"])], "id string, name string, recipe_ingredients array<string>")
    n = "term_key string, nutrition struct<calories:double,protein:double,fat:double,carbs:double,fiber:double," \
        "sugar:double,calcium_mg:double,iron_mg:double,vitamin_a_mcg:double,vitamin_c_mg:double,serving_size_g:double>"
    milk = spark.createDataFrame([("v9:milk whole", (61.0, 3.2, 3.3, 4.8, 0.0, 5.1, 113.0, 0.03, 46.0, 0.0, 100.0))], n)
    stats = nutrition.analyse(df, milk.limit(0).withColumn("source", F.lit("")), [("usda", milk)])
    writers.write_report(publish.audit_report(df, nutrition.totals(stats, "id")), f"{folder}/report")
    (line,) = [x for f in glob.glob(f"{folder}/report/*.json") for x in open(f)]
    weight = 2 * 236.59 * 1.03
    assert json.loads(line)["system_nutrition"] == {
        "calories": round(61 * weight / 100), "protein": round(3.2 * weight / 100),
        "fat": round(3.3 * weight / 100), "carbs": round(4.8 * weight / 100),
    }
    docs = spark.createDataFrame([('{"a":1}',)], "document string")
    writers.write_documents(docs, f"{folder}/docs")
    assert spark.read.json(f"{folder}/docs").first()["a"] == 1


def _page(i, name):
    item = '{"@type":"Recipe","name":"%s",' % name + LONG + ',"recipeInstructions":["Boil"]}'
    return (f"https://site.example/{i}", 200, LD.format(item))


def test_extraction_stream_equals_batch(spark, folder):
    rounds = [[_page(i, f"v{r}-{i}") for i in range(r, r + 3)] for r in range(3)]
    for r, rows in enumerate(rounds):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = readers.page_stream(spark, f"{folder}/in", files_per_batch=1)
        st.extract_stream(
            stream, f"{folder}/out", f"{folder}/progress", F.lit(NOW).cast("timestamp")
        ).awaitTermination()
    state = tables.fold_changes(st.batches(spark, f"{folder}/out"), "url", F.col("batch"))
    got = sorted((r["url"], r["name"]) for r in state.collect())
    latest = {}
    for rows in rounds:
        for url, _, html in rows:
            latest[url] = html.split('"name":"')[1].split('"')[0]
    assert got == sorted(latest.items())
    again = st.extract_stream(
        readers.page_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/progress",
        F.lit(NOW).cast("timestamp"),
    )
    again.awaitTermination()
    assert st.batches(spark, f"{folder}/out").count() == 9
    one = pg.extract(readers.pages(spark, f"{folder}/in"), F.lit(NOW).cast("timestamp"))
    assert one.count() == 9


def test_interval_stream_keeps_state_between_batches(spark, folder):
    schema = "k string, at timestamp"
    parts = [[("a", 0), ("a", 30), ("b", 10)], [("a", 59), ("a", 61), ("b", 69)], [("b", 130), ("a", 120), ("a", 121)]]
    for part in parts:
        df = spark.createDataFrame(part, "k string, s int").select(
            "k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")
        )
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        st.accept_stream(stream, "k", "at").writeStream.format("parquet").outputMode("append").option(
            "path", f"{folder}/out"
        ).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert sorted((r["k"], r["us"] // 1_000_000 - 1_700_000_000) for r in rows) == [
        ("a", 0), ("a", 61), ("a", 121), ("b", 10), ("b", 130)
    ]
