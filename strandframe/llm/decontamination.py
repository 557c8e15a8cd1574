"""Benchmark decontamination, with DataFrame functions only.

Benchmark texts give windows of n words (a shorter text is one window). The frequency of every benchmark term over
all documents picks the two rarest terms of each window; postings (term, document, position) of those terms are
stored as the distributed positional index. A window's two lists, each shifted by its term's offset, are
intersected, so that only documents and starts where both rare terms stand right are left; there the whole phrase
is compared. With slop, the two lists may be up to so many words apart, and a place counts as a proximity match
if all the window's words stand in the slice around it.

Defined cases: null text has no words; a null text in the benchmark gives no window; windows that several items share
count for each; null item_ids mark hits but aren't listed; rows that share doc_id and text are one document for the
search and each get its result; an empty table on either side gives no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_up_to, checkpointed, load, packed, text_hash, unpacked, written

#: ASCII letters and digits, and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts words before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(TERM), F.lit(0))


def windows_of(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(_item, _window): each item's windows as arrays of terms, without repeats."""
    items = benchmark.select(F.col(item_col).alias("_item"), terms_of(F.col(text_col)).alias("_terms")).where(F.size("_terms") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_terms") - (n - 1)))
    return items.withColumn("_at", F.explode(starts)).select("_item", F.slice("_terms", F.col("_at"), n).alias("_window")).distinct()


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, _pos, _term) of each word, and an empty term at the end of each text, whose place is the number of words.

    Words are lower-cased one by one, since most are ASCII, where that is fast. Between two added spaces every text
    splits into an empty string, its words and another empty string.
    """
    raw = F.split(F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")), GAP)
    words = docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("_h"), F.posexplode(raw).alias("_k", "_raw")).where("_k > 0")
    return words.select("_id", "_h", (F.col("_k") - 1).alias("_pos"), ascii_lower(F.col("_raw")).alias("_term"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matches (_id, _h, _win, _start, _len, _exact), the windows' items (_win, _item), and all rows' (_id, _h, _n_words). _start counts from 0."""
    items = checkpointed(windows_of(benchmark, n).select("_item", "_window", F.xxhash64("_window").alias("_win")))
    windows = checkpointed(items.groupBy("_win").agg(F.first("_window").alias("_window")))
    terms = checkpointed(windows.select(F.explode("_window").alias("_term")).distinct())
    counts = _places(docs, id_col, text_col).select("_term").join(broadcast_up_to(terms, terms.count()), "_term").groupBy("_term").agg(F.count("*").alias("_tf"))
    # the two rarest terms; a window with a term that no document has can't occur
    spread = windows.select("_win", F.size("_window").alias("_len"), F.posexplode("_window").alias("_off", "_term")).join(counts, "_term", "left")
    by_rarity = Window.partitionBy("_win").orderBy("_tf", "_term", "_off")
    ranked = spread.withColumn("_least", F.min(F.coalesce("_tf", F.lit(0))).over(Window.partitionBy("_win"))).withColumn("_slot", F.row_number().over(by_rarity))
    anchors = checkpointed(ranked.where("_least > 0 AND _slot <= 2").select("_win", "_len", "_off", "_term", "_slot"))
    rare = checkpointed(anchors.select("_term").distinct().union(docs.sparkSession.range(1).select(F.lit("").alias("_term"))))
    postings = written(_places(docs, id_col, text_col).join(broadcast_up_to(rare, rare.count()), "_term"))
    sizes = postings.where("_term = ''").select("_id", "_h", F.col("_pos").cast("long").alias("_n_words"))
    lists = postings.where("_term <> ''").join(broadcast_up_to(anchors, anchors.count()), "_term").withColumn("_start", F.col("_pos") - F.col("_off"))
    needed = F.least(F.col("_len"), F.lit(2))
    if slop:  # starts in cells of slop + 1 words; a start is also tried in the cell before it, so near ones meet
        cell = F.floor(F.col("_start") / (slop + 1)).cast("int")
        lists = lists.withColumn("_cell", F.explode(F.when(F.col("_slot") == 1, F.array(cell)).otherwise(F.array(cell - 1, cell, cell + 1))))
        met = lists.groupBy("_win", "_len", "_id", "_h", "_cell").agg(F.collect_set(F.when(F.col("_slot") == 1, F.col("_start"))).alias("_ones"), F.count_distinct("_slot").alias("_met"))
        near = met.where(F.col("_met") >= needed).withColumn("_start", F.explode("_ones"))
    else:
        near = lists.where("_start >= 0").groupBy("_win", "_len", "_id", "_h", "_start").agg(F.count_distinct("_slot").alias("_met")).where(F.col("_met") >= needed)
    found = checkpointed(near.groupBy("_id", "_h").agg(F.collect_set(F.struct("_win", "_start", "_len")).alias("_found")))  # numbers alone
    texts = docs.select(F.col(id_col).alias("_d"), text_hash(text_col).alias("_dh"), F.col(text_col).alias("_text"))
    held = texts.join(found, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_dh") == F.col("_h")))
    placed = held.select("_id", "_h", terms_of(F.col("_text")).alias("_terms"), "_found")
    cut = lambda x, more: F.slice(F.col("_terms"), F.greatest(x["_start"] - more, F.lit(0)) + 1, x["_len"] + 2 * more)
    around = [lambda x: cut(x, slop).alias("_around")] if slop else []
    part = lambda x: F.struct(x["_win"].alias("_win"), x["_start"].alias("_start"), x["_len"].alias("_len"), cut(x, 0).alias("_here"), *(f(x) for f in around))
    slices = placed.select("_id", "_h", F.explode(F.transform("_found", part)).alias("_m")).select("_id", "_h", "_m.*")
    exact = (F.col("_start") >= 0) & (F.col("_here") == F.col("_window"))
    close = (exact | (F.size(F.array_except("_window", "_around")) == 0)) if slop else exact
    sure = slices.join(broadcast_up_to(windows, windows.count()), "_win").where(close).select("_id", "_h", "_win", "_start", "_len", exact.alias("_exact"))
    return sure, items.select("_win", "_item"), sizes


def _union_size(spans: Column) -> Column:
    """Words in the union of spans (start, end), which are in order."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(_id, _h, _n_hit, _items) of the documents with an exact match; _items are the item_ids as strings, sorted. And all rows' (_id, _h, _n_words)."""
    matches, items, sizes = phrase_matches(docs, benchmark, n, 0, id_col, text_col)
    hits = matches.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct(F.col("_start").alias("start"), (F.col("_start") + F.col("_len")).alias("end")))).alias("_spans"), F.collect_set("_win").alias("_wins"))
    hits = checkpointed(hits.select("_id", "_h", _union_size(F.col("_spans")).cast("long").alias("_n_hit"), "_wins"))
    named = hits.select("_id", "_h", F.explode("_wins").alias("_win")).join(items, "_win").groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    left, right = hits.alias("a"), named.alias("b")
    return left.join(right, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._h") == F.col("b._h")), "left").select("a._id", "a._h", "a._n_hit", F.coalesce("b._items", F.array().cast("array<string>")).alias("_items")), sizes


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a window of the benchmark."""
    hit, _ = contamination(docs, benchmark, n, id_col, text_col)
    rows = packed(docs, _row_id=F.col(id_col), _row_hash=text_hash(text_col))
    return unpacked(rows.join(hit, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_h")), "left_anti"), docs)


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    hit, sizes = contamination(docs, load(spark, sf_dir, "benchmark"))
    a, b = sizes.alias("a"), hit.alias("b")
    all_docs = a.join(b, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._h") == F.col("b._h")), "left").select(F.col("a._id").alias("doc_id"), F.col("_n_words").alias("n_words"), "_n_hit", "_items")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return all_docs.select("doc_id", "n_words", F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("_n_hit", F.lit(0)) > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(t), 10) AS n, array_to_string(t[i : i + 9], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(2, len(t) - 8))) AS i FROM b WHERE len(t) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(t[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM w, lens)),
m AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
