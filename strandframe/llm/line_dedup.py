"""Line dedup, with DataFrame functions only.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Of a key with enough
code points, only the lines of the smallest doc_id that holds it stay. Key hashes are partitioned by range and
sorted by document and position, and a window streams the first occurrence. A key may be in a third of all lines:
a salt of the document splits its run, each part's first holder is found, and only those few meet again.

The result has no text: for each document with dropped lines a sparse keep bitmap, a map from the number of each
64-line word that isn't full to its bits.

Defined cases: null or empty text is one empty line; rows that share doc_id and text are one document; rows that
share only the doc_id hold a key together; null doc_ids come last and count as one document; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, load, packed, text_hash, unpacked

SALTS = 64
BLANK = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text_hash, _n_dropped, _keep) of the documents that lose lines; _keep maps line number div 64 to a word of keep bits."""
    lines = docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("_text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line"))
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(BLANK)))
    keyed = lines.withColumn("_key", key).where(F.char_length("_key") >= min_chars)
    rows = keyed.select("_id", "_text_hash", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(min_chars), F.col("_key")).alias("_k2"), F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_salt"))
    order = [F.col("_id").asc_nulls_last(), F.col("_text_hash"), F.col("_pos")]
    part = Window.partitionBy("_k1", "_k2", "_salt").orderBy(*order)
    streamed = rows.repartitionByRange("_k1", "_k2", "_salt").withColumn("_first", F.first("_id").over(part))
    later = streamed.where(~F.col("_id").eqNullSafe(F.col("_first")))
    # what is left of a key: one document for each salt at most
    whole = Window.partitionBy("_k1", "_k2").orderBy(*order)
    beaten = streamed.where(F.col("_id").eqNullSafe(F.col("_first"))).withColumn("_first", F.first("_id").over(whole)).where(~F.col("_id").eqNullSafe(F.col("_first")))
    dropped = later.select("_id", "_text_hash", "_pos").unionByName(beaten.select("_id", "_text_hash", "_pos"))
    words = dropped.groupBy("_id", "_text_hash", F.floor(F.col("_pos") / 64).cast("int").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits"))
    return words.groupBy("_id", "_text_hash").agg(F.sum(F.bit_count("_bits")).cast("long").alias("_n_dropped"), F.map_from_entries(F.collect_list(F.struct("_word", F.bitwise_not("_bits")))).alias("_keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose keep bit is set; without a bitmap, or where it has no word, all."""
    stays = lambda line, i: F.coalesce(F.getbit(keep[F.floor(i / 64).cast("int")], (i % 64).cast("int")) == 1, F.lit(True))
    return F.when(keep.isNull(), lines).otherwise(F.filter(lines, stays))


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(_row, _n_dropped, _keep) for each row; the last two are null where nothing is dropped."""
    marks = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options)
    rows = packed(docs, _row_id=F.col(id_col), _row_hash=text_hash(text_col))
    return rows.join(marks, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_text_hash")), "left").select("_row", "_n_dropped", "_keep")


def _kept_text(text: Column) -> Column:
    return F.when(F.col("_keep").isNull(), text).otherwise(F.array_join(kept_lines(lines_of(text), F.col("_keep")), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the dropped lines cut out of their texts; null texts stay null."""
    return unpacked(with_bitmaps(docs, id_col, text_col, **options), docs, **{text_col: _kept_text(F.col("_row").getField(text_col))})


def query(spark, sf_dir: str) -> DataFrame:
    text = F.col("_row.text")
    kept = F.coalesce(_kept_text(text), F.lit(""))
    return with_bitmaps(load(spark, sf_dir, "documents").select("doc_id", "text")).select("_row.doc_id", F.size(lines_of(text)).cast("long").alias("n_lines"), F.coalesce("_n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key),
f AS (SELECT k.doc_id, k.pos, k.line, m.holder IS NOT NULL AND k.doc_id <> m.holder AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
