"""The registered queries of the training-text operators.

Each ``opN_`` query is thin: it applies its operator, with production parameters,
to its whole table and derives the digest columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import bpe, decontam, html_extract, lexical, line_dedup, media, periodic, quality, simhash, token_store, toxicity, url_filter, warc
from veritab.llm.common import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extract.extract(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return done.select("doc_id", simhash.hex_word("fp").alias("fingerprint"), "component_id")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    back = media.from_images(media.to_images(docs))
    tail = F.expr("substring(payload, -32, 32)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"),
        "feature",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontam.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.with_references(table(spark, sf_dir, "pages"))
    back = warc.read_archives(warc.normalise(warc.write_archives(rows)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = line_dedup.remove_boilerplate(docs.withColumn("before", F.size(F.split("text", "\n", -1)).cast("long")), count_col="removed")
    return marked.select("doc_id", F.coalesce("before", F.lit(0).cast("long")).alias("n_lines"), F.col("removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
once AS (SELECT text, min(coalesce(source, chr(0))) AS site FROM documents WHERE text IS NOT NULL GROUP BY text),
spread AS (SELECT site, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS t FROM once),
bad AS (SELECT t FROM spread WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= 5),
cut AS (SELECT r, string_split(text, chr(10)) AS parts FROM docs WHERE text IS NOT NULL),
l AS (SELECT r, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM cut),
m AS (SELECT l.r, l.i, l.line, bad.t IS NOT NULL AS gone FROM l LEFT JOIN bad ON regexp_replace(l.line, '^\s+|\s+$', '', 'g') = bad.t),
d AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS rest FROM m GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_removed, sha256(CASE WHEN n IS NULL THEN text ELSE coalesce(rest, '') END) AS text_sha256
FROM docs LEFT JOIN d USING (r)
"""


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_store.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {"op1_bpe": op1_bpe, "op2_html_extract": op2_html_extract, "op3_url_filter": op3_url_filter, "op4_simhash": op4_simhash, "op5_media": op5_media, "op6_decontaminate": op6_decontaminate, "op7_token_store": op7_token_store, "op8_warc": op8_warc, "op9_line_dedup": op9_line_dedup, "op10_quality": op10_quality, "op11_periodic_runs": op11_periodic_runs, "op12_lexical_search": op12_lexical_search, "op13_toxicity": op13_toxicity}
ORACLE: dict[str, str] = {"op3_url_filter": url_filter.duckdb_sql(), "op9_line_dedup": LINE_DEDUP_SQL, "op12_lexical_search": lexical.duckdb_sql()}


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
