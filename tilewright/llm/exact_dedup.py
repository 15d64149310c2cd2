"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so (after a sentence or line end, once
a chunk is long enough), each chunk is replaced by a 128-bit identifier, and the
ordered identifier list, the *recipe*, stands for the text from then on. The
identifiers are verified: each chunk's text is moved once, pre-aggregated, to a
dictionary in which every identifier must have exactly one text. Should two
texts ever share one, the identifiers are made anew with the next seed. Only
recipes, never documents, are grouped and joined.

Defined results: null text is the empty text, whose recipe is the empty list.
Rows with a null doc_id take part; they are kept only if their whole group has
none. Repeated rows (same doc_id, same text) are one document and share a
verdict. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(text: Column, least: int = 512, most: int = 8192) -> Column:
    """Content-defined chunks: at least ``least`` code points, then up to the next sentence or line end, ``most`` at most."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[\n.!?;:|]|(?s).{{1,{most}}}"), F.lit(0))


def identifiers(pieces: Column, seed: int) -> Column:
    """128-bit identifiers of an array of chunks, in order."""
    return F.transform(pieces, lambda c: F.struct(F.xxhash64(F.lit(2 * seed), c).alias("a"), F.xxhash64(F.lit(2 * seed + 1), c).alias("b")))


def clashes(docs: DataFrame, text_col: str, seed: int) -> bool:
    """Whether any identifier stands for two different chunks; every chunk text is compared."""
    each = docs.select(F.explode(chunks(normalised(F.col(text_col)))).alias("chunk"))
    each = each.select(F.xxhash64(F.lit(2 * seed), "chunk").alias("a"), F.xxhash64(F.lit(2 * seed + 1), "chunk").alias("b"), "chunk")
    texts = each.groupBy("a", "b", "chunk").agg(F.lit(1).alias("one"))
    return bool(texts.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").head(1))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, recipe, text_sha256 per document."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return text.select("doc_id", identifiers(chunks(F.col("norm")), seed).alias("recipe"), F.sha2(F.col("norm"), 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    seed = 0
    while clashes(docs, text_col, seed):
        seed += 1
    table = saved(recipes(docs, id_col, text_col, seed).withColumn("key", F.xxhash64("recipe")), "recipes")
    groups = table.groupBy("key", "recipe").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    both = table.join(saved(groups, "groups"), ["key", "recipe"], "left")  # from a table, so that Spark may split a hot group's side
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return both.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
