"""The queries over this folder's operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship
from . import decontamination, exact_dedup, hard_negatives, language_id, license_scan, line_dedup, mixing, ngram_trie, periodic, secrets, sharding, simhash, token_store


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), budget_ratio=1.0, max_repeats=4.0)


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.held_out(F.col("doc_id"), 10)
    return ngram_trie.score(docs, ngram_trie.train(docs.filter(~out), order=2), out)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs), names=("lang_pred", "score"))
    return found.select("doc_id", language_id.held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(documents(spark, sf_dir), tokenizer_path()))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return placed.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(documents(spark, sf_dir))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label_col=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_ngram_trie, op3_simhash, op4_line_dedup, op5_secrets, op6_decontamination, op7_exact_dedup, op8_language_id, op9_token_store, op10_license_scan, op11_sharding, op12_periodic, op13_hard_negatives]
    return {f.__name__: f for f in found}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": """
            WITH lines AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                FROM documents),
            keyed AS (
                SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                FROM lines),
            often AS (
                SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20
                GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
            judged AS (
                SELECT doc_id, pos, line, coalesce(doc_id <> keep, false) AS lost FROM keyed LEFT JOIN often USING (k))
            SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
            FROM judged GROUP BY doc_id""",
        "op7_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {_LOW} AS norm FROM documents),
            g AS (SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY norm)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g ON t.norm = g.norm""",
        "op13_hard_negatives": hard_negatives.PAIRS_SQL,
    }
