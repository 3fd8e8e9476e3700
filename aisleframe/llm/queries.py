"""The named queries of this subpackage and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.llm import (
    decontam,
    factorise,
    line_dedup,
    lm_score,
    mixing,
    periodic,
    pii,
    quality,
    resample,
    simhash,
    suffix,
    tokens,
    warc,
)
from aisleframe.llm.common import table, words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_HEX = "sha1(encode(coalesce(html, '')))"
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr({_HEX}, {1 + 10 * c}, 10))::UBIGINT >> {35 - 5 * k}) & 31 AS INTEGER), 1)"
    for c in range(4)
    for k in range(8)
)


@query(
    "op1_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, {_DIGITS} AS payload_digest FROM pages),
o AS (SELECT body, max(page_id) AS owner FROM p GROUP BY body)
SELECT page_id, octet_length(encode(p.body)) AS payload_bytes, payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON p.body = o.body""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), words=3, distance=2, parts=4)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key of the test tables; a deployment passes a secret one.
    return pii.protect(table(spark, sf_dir, "documents"), key=b"key of the synthetic test tables")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), limit=512)


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most_copies=3).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return lm_score.cross_entropy_difference(
        table(spark, sf_dir, "documents"), labels.filter("quality = 1 AND toxic = 0").select("doc_id")
    )


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op10_line_dedup",
    r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS nr, unnest(string_split(text, chr(10))) AS line
  FROM documents),
w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM l),
f AS (SELECT line, min(CAST(doc_id AS HUGEINT) * 1000000000 + nr) AS pos FROM w WHERE has_word GROUP BY line),
k AS (
  SELECT line, pos, unnest(['l', 'l', 'r', 'r']) AS side, unnest([n, n - 1, n, n - 1]) AS m,
         unnest(["left"(line, n // 2), "left"(line, (n - 1) // 2), "right"(line, n // 2), "right"(line, (n - 1) // 2)]) AS half
  FROM (SELECT line, pos, length(line) AS n FROM f) WHERE n >= 5),
near AS (
  SELECT DISTINCT a.line FROM k a JOIN k b ON a.side = b.side AND a.m = b.m AND a.half = b.half AND b.pos < a.pos
  WHERE abs(length(a.line) - length(b.line)) <= 1
    AND len(list_filter(range(0, length(a.line) + 1), lambda i: "left"(a.line, i) = "left"(b.line, i)
      AND (substr(a.line, i + 2) = substr(b.line, i + 2) OR substr(a.line, i + 2) = substr(b.line, i + 1)
        OR substr(a.line, i + 1) = substr(b.line, i + 2)))) > 0),
j AS (
  SELECT w.doc_id, w.nr, w.line, w.has_word, near.line IS NOT NULL AS is_near,
         w.has_word AND (near.line IS NOT NULL OR f.pos <> CAST(w.doc_id AS HUGEINT) * 1000000000 + w.nr) AS gone
  FROM w LEFT JOIN f ON w.has_word AND w.line = f.line LEFT JOIN near ON w.has_word AND w.line = near.line)
SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (gone) AS n_removed,
       count(*) FILTER (gone AND is_near) AS n_near,
       md5(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS text_md5
FROM j GROUP BY doc_id""",
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "n_near", F.md5("text").alias("text_md5")
    )


@query("op11_quality_fm")
def op11_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = factorise.fit(docs, table(spark, sf_dir, "labels"), folds=5)
    return factorise.score(docs, machine, folds=5, threshold=0.3)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by hash, the words from one on repeat with a period, both by that hash."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    # Words of the chosen texts alone; the others are not split here.
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words_of(F.col("text"))).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    a, p = F.col("a"), F.col("p")
    changed = F.transform("w", lambda x, i: F.when(i >= a, F.get("w", (a + (i - a) % p).cast("int"))).otherwise(x))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents")), min_words=24, min_repeats=3)


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "benchmark"),
        percent=25,
        max_words=2,
        buckets=10_000,
        min_words=20,
        seed=7,
    )
