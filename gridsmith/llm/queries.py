"""The op queries over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm import bpe, codes, decontam, jaccard, langid, licenses, negatives, pii, quality, sharding, substrings, toxicity, warc
from gridsmith.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; null texts are empty."""
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class, its number of links to other texts, and its copies."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op3_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text by the labels of four fifths of the documents."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").filter(part != 0)
    out = toxicity.fit_score(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of licence phrases, base labels and the method's in every whole text."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that stand in an earlier text too."""
    return substrings.passages(table(spark, sf_dir, "documents"))


def op6_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = langid.predict(docs, langid.fit(docs.filter(part != 2)))
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of personal data in every whole text."""
    return pii.find(table(spark, sf_dir, "documents"), pii.train(spark))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight contiguous shards of near-equal bytes."""
    out = sharding.assign(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text and what the learned list makes of it."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules)


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document and benchmark item the best window of a similarity of 0.8 or more."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into seekable WARC bundles and read back from them. Null html is an empty payload."""
    return warc.archive(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first negatives of the first positives of every hundredth row, searched in all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every row, its error and that of its label; two hex digits for each part."""
    out = codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.col("books").alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_nearest_toxicity": op3_nearest_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_chained_passages": op5_chained_passages,
    "op6_byte_gru": op6_byte_gru,
    "op7_boosted_pii": op7_boosted_pii,
    "op8_byte_shards": op8_byte_shards,
    "op9_decision_list": op9_decision_list,
    "op10_simhash_decontamination": op10_simhash_decontamination,
    "op11_seekable_warc": op11_seekable_warc,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

_WARC_SQL = """
WITH own AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, payload_bytes, min(page_id) AS first FROM own GROUP BY ALL)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM own JOIN first USING (h, payload_bytes)"""

_WHOLE = "list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))"
_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE.format(scale=256)} AS q
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_FINE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""


def _codes_sql() -> str:
    """Rounds one after another; what an entry lacks of parts keeps it as it was."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, label, {_WHOLE.format(scale=4096)} AS q FROM embeddings WHERE {_FINE})",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, q[1 + p * len(q) // 8 : (p + 1) * len(q) // 8] AS x FROM v, range(8) t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < 16)",
    ]
    near = "a{n} AS MATERIALIZED (SELECT vec_id, label, p, any_value(parts.x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, label, p, parts.x, e, list_sum(list_transform(list_zip(parts.x, b{n}.x), lambda z: (z[1] - z[2]) ** 2)) AS d FROM parts JOIN b{n} USING (p)) parts GROUP BY vec_id, label, p)"
    for n in range(6):
        ctes += [
            near.format(n=n),
            f"m{n} AS (SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS c FROM a{n}, range(1, 1 + (SELECT max(len(x)) FROM b0)) t(i) GROUP BY p, e, i) GROUP BY p, e)",
            f"b{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} USING (p, e))",
        ]
    ctes += [
        near.format(n=6),
        "coded AS (SELECT vec_id, label, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id, label)",
        "books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM b6)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books"


#: The first ten hold trained models, a tokenizer, sketches, or checksums that DuckDB lacks; tests
#: hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_seekable_warc": _WARC_SQL, "op12_hard_negatives": _NEGATIVES_SQL, "op13_vector_codes": _codes_sql()}
