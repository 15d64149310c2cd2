"""Line deduplication by range-partitioned line hashes (DataFrame functions only).

Line keys are hashed to 128 bits once per document. The (hash, slice, document,
position) rows are range-partitioned and sorted, so that each partition streams
through its keys with the largest document first: the first row of a run is the
occurrence that stays, and a change of document counts one more document. A
slice is a 32nd of the documents, so that a key that fills the corpus spans many
ranges; the runs' heads are then merged with map-side sums. What comes back per
document is a sparse keep bitmap (64-bit words that have a dropped line), not text.

Defined results: null text is one empty line. A key's documents are counted by
distinct doc_id; null doc_ids are one document, which stays only if it is
alone. Rows that repeat both doc_id and text share one verdict. Positions count
from 0. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER
from .store import saved

SLICES = 32
#: The white space that a key is stripped of.
SPACE = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, tid (hash of the text), h1, h2, positions: a row for each distinct long key of a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tid"), F.posexplode(line_keys(text)).alias("pos", "key"))
    keyed = keyed.filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "tid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated(occ: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keep_id: the keys found in ``min_docs`` documents, and the document that keeps them."""
    n = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = occ.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("slice"), "doc_id", "pos").repartitionByRange(n, "h1", "h2", "slice")
    run = W.partitionBy("h1", "h2", "slice").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    streamed = dealt.select("h1", "h2", "doc_id", F.row_number().over(run).alias("rn"), F.lag("doc_id").over(run).alias("before"))
    new = (F.col("rn") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before"))
    heads = streamed.groupBy("h1", "h2").agg(F.sum(new.cast("long")).alias("docs"), F.max(F.when(F.col("rn") == 1, F.col("doc_id"))).alias("keep_id"))
    return heads.filter(F.col("docs") >= min_docs).select("h1", "h2", "keep_id")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, tid, dropped: for each document that loses lines, the 64-bit words (word number -> bits of dropped lines).

    Line i is kept unless bit i % 64 of word i div 64 is set; words that are
    absent keep all their lines.
    """
    occ = saved(occurrences(docs, id_col, text_col, min_chars), "lines")
    keys = saved(repeated(occ, min_docs), "repeated")  # a table, so that Spark may split a hot key's side
    lost = occ.join(keys, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    word = (F.col("pos") / 64).cast("int")
    words = lost.groupBy("doc_id", "tid", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "tid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lines, keep (booleans of the lines): the bitmaps laid on the texts, which move once and unsorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    both = whole.join(bitmaps.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid")), "left")
    return both.select(F.col("id").alias("doc_id"), "text", "dropped", F.split("text", "\n").alias("lines"))


def _kept(i: Column) -> Column:
    bits = F.coalesce(F.try_element_at("dropped", (i / 64).cast("int")), F.lit(0).cast("long"))
    return F.call_function("getbit", bits, i % 64) == 0


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (of the lines that stay): one row per input row."""
    bitmaps = saved(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "bitmaps")
    laid = apply_bitmaps(docs, bitmaps, id_col, text_col)
    n_dropped = F.coalesce(F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b)), F.lit(0).cast("long"))
    stays = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.filter("lines", lambda x, i: _kept(i)), "\n"))
    return laid.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), stays.alias("text"))
