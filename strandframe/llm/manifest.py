"""A Merkle manifest of a dataset by nested intervals.

Leaves of a tree (a lang's documents) are ranked, and a node is the interval [lo, hi) of leaf ranks that it covers, with
its digest. At level l the node that holds rank r has r >> l as its bucket, so an ancestor is found by a containment join
bucketed by level. A node's sibling is what is left of its parent's interval when its own is taken away.

Ranks: leaves are written, then dealt to range partitions of (tree, doc_id, leaf) and written in order; a place in its
partition plus the leaves of the tree in the partitions before is the rank, so no task holds a lang, however large.
Trees are built in bands of LEVELS levels: a task holds one node of a band's top, that is at most 2**LEVELS members, and
gives all nodes below it; the tops are the next band's members. The subroots are the leaves of one more tree, made by
the same code. Proofs are attached from the root down: the members of a block meet, level by level, the children of
their ancestors that don't hold them, and get the path that the block's top already has. So a node meets fewer than
2**LEVELS members, and no key of a join grows with the data.

Defined cases: null langs are a tree of their own, before all others; a null or repeated doc_id is a leaf like others,
nulls first, ties by the leaf's digest (equal leaves have equal digests, and each its own place); null and empty fields
differ (`-` and `0:`); a null doc_id or n_chars is never tampered with; a lone leaf is its subroot, and a lone subroot the root; other columns
don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_up_to, load, written

#: Levels of a band: a task holds at most 2**LEVELS members.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def text_of(raw: Column) -> Column:
    """A digest as its hex text."""
    return F.lower(F.hex(raw))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, digest, changed) for each document; changed is the digest of the row after tampering, null where it is the same."""
    of = lambda n_chars: digest(F.concat(*(field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS)))
    hit = F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    # null, then every lang, in order
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), of(F.col("n_chars")).alias("digest"), F.when(hit, of(F.col("n_chars").cast("decimal(38,0)") + 1)).alias("changed"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with lo, their rank in their tree by the columns of order, and n, the tree's leaves. rows must be cheap to read twice."""
    sort = ["tree", *(F.col(c).asc_nulls_first() for c in order)]
    placed = written(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of a tree
    parts = written(parts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("n")))
    out = placed.join(broadcast_up_to(parts, parts.count()), ["tree", "_part"])
    return out.withColumn("lo", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_part")


NODE = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.binary())])
NODE_DDL = "tree string, n long, level int, lo long, hi long, digest binary"


def joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _nodes(table: pa.Table, levels: int) -> pa.Table:
    """The members of one block, and all nodes above them in their band."""
    table = table.sort_by("lo")
    tree, n, level = (table[c][0].as_py() for c in ("tree", "n", "level"))
    nodes = list(zip(table["lo"].to_pylist(), table["hi"].to_pylist(), table["digest"].to_pylist(), strict=True))
    out = [(level, *x) for x in nodes]
    for up in range(level + 1, min(level + levels, (n - 1).bit_length()) + 1):
        nodes = [(pair[0][0], pair[-1][1], joined([d for _, _, d in pair])) for pair in (nodes[i : i + 2] for i in range(0, len(nodes), 2))]
        out += [(up, *x) for x in nodes]
    level, lo, hi, digests = zip(*out, strict=True)
    return pa.table([pa.array([tree] * len(out)), pa.array([n] * len(out), pa.int64()), pa.array(level, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(digests, pa.binary())], schema=NODE)


def height(levels_of: Column) -> Column:
    """The levels above n leaves."""
    return F.when(levels_of > 1, F.length(F.bin(levels_of - 1))).otherwise(0)


def bands(members: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (tree, n, level, lo, hi, digest) of the trees whose ranked leaves are given: one written table for each band, its members included."""
    top, out = members.agg(F.max("n")).first()[0] or 0, []
    members = members.select("tree", "n", F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"), "digest")
    while True:
        base = levels * (len(out) + 1)
        block = F.shiftright("lo", base).alias("block")
        out.append(written(members.groupBy("tree", block).applyInArrow(lambda t: _nodes(t, levels), NODE_DDL)))
        if (top - 1).bit_length() <= base:
            return out
        members = out[-1].where((F.col("level") == base) & (height(F.col("n")) > base))


def subroots(band_tables: list[DataFrame]) -> DataFrame:
    """(tree, digest), a row for each tree: the node that covers all its leaves."""
    tops = [b.where((F.col("lo") == 0) & (F.col("hi") == F.col("n")) & (F.col("level") == height(F.col("n")))).select("tree", "digest") for b in band_tables]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["tree"])


#: What a path has for each level: the sibling's digest, null for a lone node, and whether it stands to the left.
STEP = "array<struct<level:int,digest:binary,left:boolean>>"


def paths(band_tables: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, lo, path) for each leaf: its siblings, level by level, then the path that above (tree, path) has for its tree."""
    found = None
    for k in reversed(range(len(band_tables))):
        base = levels * k
        nodes = band_tables[k]
        tall = F.least(height(F.col("n")), F.lit(base + levels))
        member = nodes.where(F.col("level") == base).select("tree", "lo", "n", "hi")
        # a member meets its ancestor at each level by the bucket, and there the child whose interval doesn't hold it
        asked = member.where(tall > base).select("tree", F.col("lo").alias("rank"), F.explode(F.sequence(F.lit(base + 1), tall)).alias("above"))
        asked = asked.withColumn("bucket", F.expr("shiftright(rank, above)"))
        child = nodes.select("tree", (F.col("level") + 1).alias("above"), F.expr("shiftright(lo, level + 1)").alias("bucket"), "lo", "hi", "digest")
        outside = (F.col("rank") < F.col("lo")) | (F.col("rank") >= F.col("hi"))
        met = asked.alias("a").join(child.alias("c"), [F.col("a.tree") == F.col("c.tree"), F.col("a.above") == F.col("c.above"), F.col("a.bucket") == F.col("c.bucket"), outside], "left")
        step = F.struct(F.col("a.above").alias("level"), "digest", (F.col("lo") < F.col("rank")).alias("left"))
        own = met.groupBy(F.col("a.tree").alias("tree"), F.col("rank").alias("lo")).agg(F.sort_array(F.collect_list(step)).alias("own"))
        block = F.shiftright("lo", base + levels)
        own = member.select("tree", "lo", block.alias("block")).join(own, ["tree", "lo"], "left")
        # the path of the block's top: in the band above, or that of the whole tree
        ends = nodes.where((F.col("level") == base) & (F.col("lo") == 0) & (height(F.col("n")) <= base + levels)).select("tree", F.lit(0).cast("long").alias("block")).join(above, "tree")
        if found is not None:
            ends = ends.unionByName(found.select("tree", F.shiftright("lo", base + levels).alias("block"), "path"))
        path = F.concat(F.coalesce("own", F.array().cast(STEP)), F.col("path"))
        found = own.join(ends, ["tree", "block"]).select("tree", "lo", path.alias("path"))
        if k:  # small beside the leaves' paths, and read by the next band
            found = written(found)
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    one = lambda acc, s: F.when(s["digest"].isNull(), text_of(acc)).when(s["left"], F.concat(text_of(s["digest"]), text_of(acc))).otherwise(F.concat(text_of(acc), text_of(s["digest"])))
    return F.aggregate(path, start, lambda acc, s: digest(one(acc, s)))


def manifest(docs: DataFrame, tampered: Column, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each document; tampered rows have 1 added to n_chars after the manifest is made."""
    rows = written(ranked(written(leaves(docs, tampered)), "doc_id", "digest"))
    low = bands(rows, levels)
    tops = written(ranked(subroots(low).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"))
    high = bands(tops, levels)
    root = subroots(high).select(F.col("digest").alias("root"))
    none = tops.select("tree").limit(1).select("tree", F.array().cast(STEP).alias("path"))
    tree_path = written(tops.withColumnRenamed("digest", "subroot").join(paths(high, none, levels), ["tree", "lo"]).select(F.col("name").alias("tree"), "subroot", "path"))
    leaf_path = paths(low, tree_path.select("tree", "path"), levels)
    # a row for each lang: broadcast if they are few
    named = broadcast_up_to(tree_path.select("tree", "subroot"), tree_path.count())
    out = rows.join(leaf_path, ["tree", "lo"]).join(named, "tree").crossJoin(F.broadcast(root.limit(1)))  # root: one row
    siblings = F.concat_ws("", F.transform(F.filter("path", lambda s: s["digest"].isNotNull()), lambda s: text_of(s["digest"])))
    again = folded(F.coalesce("changed", "digest"), F.col("path"))
    out = out.select("doc_id", text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), text_of(again).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(load(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def _oracle(most: int = 30) -> str:
    """Level by level, up to 2**most leaves; proofs from the ancestors' siblings of every leaf."""
    field_sql = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    row = lambda n: " || ".join(field_sql(n if c == "n_chars" else c) for c in FIELDS)
    step = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"""WITH RECURSIVE
table_ AS (SELECT list({step} ORDER BY c) AS t FROM (SELECT unnest(range(256))::BIGINT AS c)),
docs AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({row('n_chars')}) AS leaf, sha256({row('(n_chars + 1)')}) AS altered,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS digits, n_chars FROM documents),
hit AS (SELECT doc_id, tree, leaf, CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, digits),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) % 7 = 0 THEN altered ELSE leaf END AS given FROM docs, table_),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM hit),
up(tree, level, r, d, n) AS (
    SELECT tree, 0, r, leaf, count(*) OVER (PARTITION BY tree) FROM placed
    UNION ALL
    SELECT tree, level + 1, r // 2, sha256(string_agg(d, '' ORDER BY r)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY tree, level, r // 2),
tops AS (SELECT tree, level AS height, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE n = 1),
up2(level, r, d, n) AS (
    SELECT 0, place, subroot, count(*) OVER () FROM tops
    UNION ALL
    SELECT level + 1, r // 2, sha256(string_agg(d, '' ORDER BY r)), any_value((n + 1) // 2) FROM up2 WHERE n > 1 GROUP BY level, r // 2),
top AS (SELECT level AS height2, d AS root FROM up2 WHERE n = 1),
steps AS (
    SELECT p.tree, p.r, l.level, (p.r >> l.level) & 1 AS is_right, u.d FROM placed p JOIN tops t USING (tree) JOIN (SELECT unnest(range({most})) AS level) l ON l.level < t.height
    LEFT JOIN up u ON u.tree = p.tree AND u.level = l.level AND u.r = xor(p.r >> l.level, 1)
    UNION ALL
    SELECT p.tree, p.r, t.height + l.level, (t.place >> l.level) & 1, u.d FROM placed p JOIN tops t USING (tree) CROSS JOIN top JOIN (SELECT unnest(range({most})) AS level) l ON l.level < top.height2
    LEFT JOIN up2 u ON u.level = l.level AND u.r = xor(t.place >> l.level, 1)),
path AS (SELECT tree, r, sha256(coalesce(string_agg(d, '' ORDER BY level), '')) AS proof_sha256,
    list({{'d': coalesce(d, ''), 'is_right': is_right}} ORDER BY level) AS way FROM steps GROUP BY tree, r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM (
    SELECT p.doc_id, p.leaf, t.subroot, root, proof_sha256, list_reduce(list_prepend({{'d': given, 'is_right': 0}}, coalesce(way, [])),
        lambda a, s: {{'d': sha256(CASE WHEN s.is_right = 1 THEN s.d || a.d ELSE a.d || s.d END), 'is_right': 0}}).d AS folded_root
    FROM placed p JOIN tops t USING (tree) CROSS JOIN top LEFT JOIN path USING (tree, r))"""


ORACLE = _oracle()
