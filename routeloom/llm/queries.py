"""The registered queries over the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, exact, html_extract, lexical, licences, mixing, pii, quality, simhash, suffix_trees, suffixes, toxicity
from . import pipeline as corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).withColumnRenamed("id", "doc_id")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "probability")}).withColumnRenamed("id", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("end_word"), "n_words", F.col("first_id").alias("first_doc_id"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licence_matches(table(spark, sf_dir, "documents"))
    best = F.get("matches", F.lit(0))
    named = F.array_join(F.transform("matches", lambda m: m["licence"]), ",")
    return found.select(
        F.col("id").alias("doc_id"), best["licence"].alias("licence"), F.round(best["score"], 6).alias("score"), best["first_line"].alias("first_line"), best["last_line"].alias("last_line"), named.alias("licences")
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    base = joined(F.filter("spans", lambda s: s["base"]))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.quality(docs, model).withColumnRenamed("id", "doc_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_trees.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_main_text": op2_main_text,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_licences": op7_licences,
    "op8_personal_data": op8_personal_data,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.oracle(),
    "op4_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
        grams AS (
            SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
            FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
        found AS (SELECT r, i, m, item_id FROM grams JOIN win USING (m, t)),
        hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n, string_agg(k, ',' ORDER BY k) AS s
            FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS k FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
            sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
            first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "op12_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (
            SELECT r, i, rank() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS later
            FROM (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20 AND doc_id IS NOT NULL))),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM win WHERE later),
        kept AS (
            SELECT r, count(gone.p) AS n, string_agg(t, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS s
            FROM (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) LEFT JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op13_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
        q AS (SELECT DISTINCT i, item_id, t FROM (SELECT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark))),
        p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
        s AS (SELECT count(*) AS total, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
        m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * total) // words AS m FROM d, s WHERE len(w) > 0),
        weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
        scored AS (
            SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM q JOIN weight USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, r)
        SELECT item_id, rank, doc_id, score
        FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 10""",
}
