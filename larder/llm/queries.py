"""The queries of this subpackage: each operator over its whole table, with its check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import filter_audit, fingerprints, mixing, multi_index, packing, pii, preferences, quality, sharding, simhash, spelling, toxicity, warc
from larder.session import table


def op1_pii_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Spans of personal data of every document."""
    found = pii.find(table(spark, d, "documents", ["doc_id", "text"]))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op2_quality_mcd(spark: SparkSession, d: str) -> DataFrame:
    """Counts and verdict of every document."""
    columns = ["doc_id", "text", "lang", "source"]
    return quality.verdicts(table(spark, d, "documents", columns))


def op3_packing_differencing(spark: SparkSession, d: str) -> DataFrame:
    """Where every piece of every document lies."""
    pieces = packing.pack(table(spark, d, "documents", ["doc_id", "text"]))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation against the one that ends like its neighbour, as prompt and completions."""
    talks = table(spark, d, "conversations")
    made = preferences.format_pairs(talks, preferences.rejected_by_neighbour(talks), "conv_id")

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

    return made.withColumns({c: joined(c) for c in ("chosen_loss", "rejected_loss")})


OP4_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), cuts AS (
  SELECT conv_id, coalesce(max(CASE WHEN role = 'assistant' THEN turn END), max(turn) + 1) AS cut FROM t GROUP BY conv_id
), pairs AS (
  SELECT conv_id, cut,
    coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS other
  FROM cuts
), r AS (
  SELECT t.conv_id, turn, role, text FROM t JOIN cuts USING (conv_id) WHERE turn < cut
  UNION
  SELECT p.conv_id, t.turn - o.cut + p.cut, role, text
  FROM pairs p JOIN cuts o ON o.conv_id = p.other JOIN t ON t.conv_id = p.other WHERE t.turn >= o.cut
), tn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n FROM t),
rn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n FROM r),
j AS (
  SELECT coalesce(tn.conv_id, rn.conv_id) AS conv_id, coalesce(tn.turn, rn.turn) AS turn, coalesce(tn.n, rn.n) AS n,
    tn.role AS c_role, rn.role AS r_role, tn.text AS c_text, rn.text AS r_text,
    coalesce(tn.role = rn.role AND tn.text = rn.text, false) AS same
  FROM tn FULL JOIN rn ON tn.conv_id = rn.conv_id AND tn.turn = rn.turn AND tn.n = rn.n
), c AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER w = 0 AS common, (row_number() OVER w - 1) // 256 AS part
  FROM j WINDOW w AS (PARTITION BY conv_id ORDER BY turn, n)
), sides AS (
  SELECT conv_id, turn, n, part, CASE WHEN common THEN 'p' ELSE 'c' END AS side, c_role AS role, c_text AS text FROM c WHERE c_role IS NOT NULL
  UNION ALL
  SELECT conv_id, turn, n, part, 'r', r_role, r_text FROM c WHERE r_role IS NOT NULL AND NOT common
), drawn AS (
  SELECT *, '<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) AS head,
    replace(text, '<|im_', '<| im_') || '<|im_end|>' AS body FROM sides
), placed AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, side ORDER BY turn, n)
    - length(body) - 1 AS BIGINT) AS pos FROM drawn
)
SELECT conv_id, part, count(*) FILTER (side = 'p') AS prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, n) FILTER (side = 'p'), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, n) FILTER (side = 'c'), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, n) FILTER (side = 'r'), '') AS rejected,
  coalesce(string_agg(pos || '-' || (pos + length(body)), ',' ORDER BY turn, n) FILTER (side = 'c' AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(pos || '-' || (pos + length(body)), ',' ORDER BY turn, n) FILTER (side = 'r' AND role = 'assistant'), '') AS rejected_loss
FROM placed GROUP BY conv_id, part
"""


#: The shards that op5 places documents on.
SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op5_sharding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Slot and shard of every document, by its id."""
    return sharding.place(table(spark, d, "documents", ["doc_id", "source"]), "doc_id", SHARDS)


def op6_toxicity_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Score and prediction of every document; a third of the ids is held out from learning."""
    docs = table(spark, d, "documents", ["doc_id", "text"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, d, "labels", ["doc_id", "toxic"]).filter(~held_out)
    scorer = toxicity.train(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, scorer).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op7_simhash_golay(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = simhash.near_groups(table(spark, d, "documents", ["doc_id", "text"]))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_warc_index(spark: SparkSession, d: str) -> DataFrame:
    """Every page written to an archive, indexed, and found again by the key of its url."""
    pages = table(spark, d, "pages", ["page_id", "url", "html"])
    archive = warc.build_index(warc.write(pages))
    return warc.lookup(archive, pages, payload=False, every=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_source_schedule(spark: SparkSession, d: str) -> DataFrame:
    """How many words of every document the mix takes, and the target of its source."""
    documents, pieces = mixing.mix(table(spark, d, "documents", ["doc_id", "text", "source"]))
    return mixing.taken(documents, pieces).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def op10_content_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.neighbours(table(spark, d, "documents", ["doc_id", "text"]))


def op11_spelling_gram(spark: SparkSession, d: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling.document_variants(table(spark, d, "documents", ["doc_id", "text"]))


def op12_multi_index(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    rows = table(spark, d, "embeddings", ["vec_id", "embedding"])
    return multi_index.search(rows, rows.filter("vec_id % 100 = 0"))


def op13_filter_postings(spark: SparkSession, d: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    return filter_audit.interactions(
        table(spark, d, "documents", ["doc_id", "text", "lang"]), table(spark, d, "labels")
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN coalesce(doc_id > first_id, false) THEN 16 ELSE 0 END) AS mask
  FROM d JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL
), letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(step)
), found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""


QUERIES = {
    "op1_pii_boosted": (op1_pii_boosted, None),
    "op2_quality_mcd": (op2_quality_mcd, None),
    "op3_packing_differencing": (op3_packing_differencing, None),
    "op4_preference_pairs": (op4_preference_pairs, OP4_SQL),
    "op5_sharding_lookup": (op5_sharding_lookup, None),
    "op6_toxicity_boosted": (op6_toxicity_boosted, None),
    "op7_simhash_golay": (op7_simhash_golay, None),
    "op8_warc_index": (op8_warc_index, None),
    "op9_source_schedule": (op9_source_schedule, None),
    "op10_content_chunks": (op10_content_chunks, None),
    "op11_spelling_gram": (op11_spelling_gram, None),
    "op12_multi_index": (op12_multi_index, None),
    "op13_filter_postings": (op13_filter_postings, OP13_SQL),
}
