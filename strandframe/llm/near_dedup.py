"""MinHash near-dedup with an LSH forest.

A document's set is its distinct word shingles (fewer words: the whole sequence as one). Documents with equal sets
are one class from the start. Each class has TREES * DEPTH minhashes; tree t orders the classes by the label that
begins with its own DEPTH hashes and goes on with single bytes of the others, so where many share a prefix, the order
looks deeper there: depth adapts to the region. The labels are partitioned by range and sorted, and a stream over each
partition pairs a class with its neighbours by longest common prefix, if they share MIN_DEPTH hashes: the REACH
before it, and the first of its region. Pairs whose signatures agree far below the threshold are left out (six
standard errors); the others are confirmed on full sets. Confirmed links become components by alternating large-star
and small-star steps, a join and an aggregate each.

Confirming goes in two rounds: first the best pair of each class, then only pairs that still join two components, so
groups of thousands of near copies cost a few confirmations each and no group's pairs are all made.

In a region of more than REACH + 2 classes the stream leaves pairs out, so what it didn't link is paired afterwards: each
class outside the region's largest component meets every class of the region in another component. Any
two classes of a region in different components are such a pair. Regions with the same largest component are taken
together, so that a set isn't sent once a tree; up to SIDE classes are one block. Of more, only those meet that have a rare shingle in common:
shingles are ordered by how many of these classes have them, fewest first, and two sets with percent of their union in
common share one of the first n - ceil(n percent / 100) + 1 of each, n being the set's size. So a region of many classes
that have only frequent passages in common makes no pairs. Groups with such a shingle that aren't one component are paired like regions, block by block where
they are large. Between tasks go compressed texts, whose sets are made where they are compared. A block has the full sets and goes on until each of its
pairs is either refuted or within one component; only the links that join two components leave it.

Defined cases: null or blank text has an empty set and is linked with nothing; equal sets have similarity 1 and are
linked whatever the texts; rows that share a doc_id share a component; a null doc_id has a null component; doc_id must
be a whole number; columns beside doc_id and text don't matter; an empty table gives an empty result. keep_one tells rows without a doc_id apart
by their text, and of rows that share a doc_id (versions of one document) keeps that of the least text hash.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, likely, load, mix64, packed, pieces, run_hashes, small_batches, text_bytes, text_hash, unpacked, word_hashes, word_spans, written

TREES, DEPTH, MIN_DEPTH, REACH = 16, 4, 3, 6
SIDE, SIDE_SHINGLES = 1024, 1 << 20  # about so many classes and shingles on each side of a block of a large region
TASK_EDGES = 200_000  # about so many edges are read by a task
NULLS = 1 << 62  # internal ids of rows without a doc_id are above
N_HASHES = TREES * DEPTH
_A = np.random.default_rng(7919).integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, one text after another, and where each text's begin (with the end)."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, fold=True)
    per_text = np.diff(first)
    doc = np.repeat(np.arange(len(per_text)), per_text)
    runs = run_hashes(words, k)
    at = np.flatnonzero(doc[: len(runs)] == doc[k - 1 :]) if len(runs) else np.zeros(0, np.int64)
    hashes, owner = runs[at], doc[at]
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    if len(short):  # the whole sequence is the only shingle; its length is mixed in
        whole = np.array([run_hashes(words[first[i] : first[i + 1]], int(per_text[i]))[0] + np.uint64(per_text[i]) for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, mix64(whole)]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(per_text) + 1))


def _signatures(batches, k: int):
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets, begin = shingle_sets(piece.column("text"), k)
            counts = np.diff(begin)
            full = np.flatnonzero(counts)
            mins = np.zeros((len(counts), N_HASHES), np.uint32)
            s1, s2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
            if len(full):
                heads = begin[full]
                for j in range(N_HASHES):
                    x = sets * _A[j]
                    mins[full, j] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), heads) >> np.uint64(32)
                s1[full], s2[full] = np.add.reduceat(mix64(sets), heads), np.bitwise_xor.reduceat(mix64(sets + np.uint64(1)), heads)
            sig = [r.tobytes() for r in mins.astype(">u4")]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("h"), pa.array(counts.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "h", "n", "s1", "s2", "sig"])


def _labels(batches):
    """A row for each tree and class: its label in this tree, and single bytes of all hashes."""
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(n, N_HASHES * 4)
        byte = sig[:, 3::4]
        for t in range(TREES):
            own = sig[:, t * DEPTH * 4 : (t + 1) * DEPTH * 4]
            label = np.concatenate([own, np.roll(byte, -(t + 1) * DEPTH, axis=1)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array([r.tobytes() for r in label], pa.binary()), batch.column("node")], names=["tree", "label", "node"])


def _neighbours(batches, least: float):
    """Pairs from a stream of labels in order."""
    width, keep = DEPTH * 4 + N_HASHES, MIN_DEPTH * 4
    rest = None  # the last REACH rows and the first row of the running region
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").to_numpy()
        label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, width)
        node = batch.column("node").to_numpy()
        # bytes beyond the tree's own hashes, turned back, so that they can be compared in any row of the same tree
        fresh = len(node)
        if rest is not None:
            tree, label, node = (np.concatenate(x) for x in zip(rest[:3], (tree, label, node), strict=True))
        old = len(node) - fresh
        first = np.ones(len(node), bool)
        first[1:] = (tree[1:] != tree[:-1]) | (label[1:, :keep] != label[:-1, :keep]).any(1)
        head = np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))
        at = np.arange(len(node))
        pairs = [(at[d:][(head[d:] <= at[:-d])], d) for d in range(1, REACH + 1) if d < len(node)]
        left = [i - d for i, d in pairs] + [head[at - head > REACH]]
        right = [i for i, d in pairs] + [at[at - head > REACH]]
        i, j = np.concatenate(left), np.concatenate(right)
        new = j >= old  # others were paired with the batch before
        i, j = i[new], j[new]
        out_i, out_j, out_s = [], [], []
        for b in range(0, len(i), 1 << 16):
            p, q = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            alike = (label[p, DEPTH * 4 :] == label[q, DEPTH * 4 :]).mean(1)
            good = alike >= least
            out_i.append(node[p[good]]), out_j.append(node[q[good]]), out_s.append(alike[good])
        if out_i:
            a, b = np.concatenate(out_i), np.concatenate(out_j)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(out_s).astype(np.float32))], names=["a", "b", "alike"])
        tail = np.unique(np.concatenate([[head[-1]], np.arange(max(0, len(node) - REACH), len(node))]))
        rest = (tree[tail], label[tail], node[tail])


def _regions(batches):
    """A row for each tree and class: a hash of the tree and the MIN_DEPTH hashes that the class's region shares."""
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(n, N_HASHES).astype(np.uint64)
        for t in range(TREES):
            h = np.full(n, t + 1, np.uint64)
            for j in range(t * DEPTH, t * DEPTH + MIN_DEPTH):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("node")], names=["region", "node"])


def _block_links(lone: pa.Table, rest: pa.Table, k: int, least: float, percent: int) -> pa.Table:
    """Links that join components of a block's classes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not lone.num_rows or not rest.num_rows:
        return schema.empty_table()
    byte, rest_byte = (np.ascontiguousarray(np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, -1)[:, 3::4]) for t in (lone, rest))
    node, nodes = lone["node"].to_numpy(), rest["node"].to_numpy()
    is_lone = rest["root"].to_numpy() != rest["main"].to_numpy()
    roots, place = np.unique(np.concatenate([lone["root"].to_numpy(), rest["root"].to_numpy()]), return_inverse=True)
    root, rest_root = place[: len(node)], place[len(node) :]
    component = np.arange(len(roots))
    found, begins = zip(*(_body_sets(t["body"], k) for t in (lone, rest)), strict=True)
    sizes = [np.diff(x) for x in begins]
    number, ids = np.unique(np.concatenate(found), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    sets = [ids[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
    mark, out = np.zeros(len(number), bool), []
    for i in range(len(node)):
        live = (component[rest_root] != component[root[i]]) & ~(is_lone & (nodes <= node[i]))
        at = np.flatnonzero(live)
        at = at[(rest_byte[at] == byte[i]).mean(1) >= least]
        if not len(at):
            continue
        mark[sets[i]] = True
        common = np.add.reduceat(mark[np.concatenate([sets[len(node) + j] for j in at])], np.cumsum(sizes[1][at]) - sizes[1][at], dtype=np.int64)
        mark[sets[i]] = False
        at = at[100 * common >= percent * (sizes[0][i] + sizes[1][at] - common)]
        found, first = np.unique(component[rest_root[at]], return_index=True)
        out += [(min(node[i], nodes[j]), max(node[i], nodes[j])) for j in at[first]]
        component[np.isin(component, found)] = component[root[i]]
    return pa.table([[int(a) for a, _ in out], [int(b) for _, b in out]], schema=schema)


def _bodies(batches):
    """Texts in zstd: a fraction of what their sets of hashes would take, which don't compress."""
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        body = [pack.compress(t.as_buffer()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(body, pa.binary())], names=["node", "body"])


def _body_sets(bodies: pa.Array, k: int, most_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of the texts in bodies; so many bytes of text are unpacked at a time (one text at least)."""
    unpack, sets, sizes, texts, held = zstandard.ZstdDecompressor(), [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [], 0
    for i, body in enumerate(bodies):
        texts.append(unpack.decompress(body.as_buffer()))
        held += len(texts[-1])
        if held >= most_bytes or i == len(bodies) - 1:
            found, begin = shingle_sets(pa.array(texts, pa.binary()).cast(pa.string()), k)
            sets.append(found)
            sizes.append(np.diff(begin))
            texts, held = [], 0
    return np.concatenate(sets), np.cumsum(np.concatenate(sizes))


def _sets(batches, k: int):
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            sets, begin = _body_sets(part.column("body"), k)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["node", "set"])


def _alike(batches, k: int, percent: int):
    """The pairs (a, b, x, y) whose bodies x and y have percent of the union of their sets in common."""
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            row, sets, sizes = [], [], []
            for side in ("x", "y"):
                found, begin = _body_sets(part.column(side), k)
                sizes.append(np.diff(begin))
                sets.append(found)
                row.append(np.repeat(np.arange(part.num_rows), sizes[-1]))
            row, sets = np.concatenate(row), np.concatenate(sets)
            order = np.lexsort((sets, row))
            row, sets = row[order], sets[order]
            twice = (row[1:] == row[:-1]) & (sets[1:] == sets[:-1])
            common = np.bincount(row[1:][twice], minlength=part.num_rows)
            good = pa.array(100 * common >= percent * (sizes[0] + sizes[1] - common))
            yield pa.RecordBatch.from_arrays([part.column(c).filter(good) for c in "ab"], names=["a", "b"])


def _ends(edges: DataFrame, tasks: int) -> DataFrame:
    """(node, other, above): each edge (u, v) from both of its ends, above at u, read in so many tasks."""
    end = lambda node, other, above: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(above).alias("above"))
    return edges.coalesce(tasks).select(F.explode(F.array(end("u", "v", 1), end("v", "u", 0))).alias("_end")).select("_end.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that can be reached over edges (a, b). Large-star and small-star steps in turn until every edge leads from a node of no other edge to its root.

    A step's edges are read in as many tasks as their number asks for: each shuffle has small files for every task that writes it.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(1, math.ceil(edges.count() / TASK_EDGES))
    while True:
        ends = _ends(edges, tasks)
        seen = ends.groupBy("node").agg(F.sum("above").alias("up"), F.min("above").alias("least"))
        n, unfinished = seen.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR up = 1 AND least = 0"))).first()
        if not unfinished:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        tasks = max(1, math.ceil(n / TASK_EDGES))
        ends = _ends(edges, tasks)
        least = ends.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("m"))
        large = ends.join(least, "node").where("other > node").select(F.col("other").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's edge to its least neighbour stays, the others go to that neighbour
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.distinct())


def _confirmed(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets have percent of their union in common."""
    left, right = bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(partial(_alike, k=k, percent=percent), "a long, b long")


def _split_regions(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(main, node, root): the classes of all large regions that aren't one component and have main as their largest."""
    member = classes.select("node", "sig").mapInArrow(_regions, "region long, node long")
    large = member.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > REACH + 2)
    named = roots.select(F.col("node").alias("_node"), "root")
    rooted = written(member.join(large.select("region"), "region").join(named, F.col("node") == F.col("_node"), "left").select("region", "node", F.coalesce("root", "node").alias("root")))
    each = rooted.groupBy("region", "root").agg(F.count("*").alias("c"))
    main = each.groupBy("region").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("c")).where("most.c < c")
    return checkpointed(rooted.join(main.select("region", F.col("most.root").alias("main")), "region").select("main", "node", "root").distinct())


def _groups(inside: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, main, node, root, n): what has to be paired; shingle is 0 for the whole of a main that is one block."""
    crowded = inside.groupBy("main").agg(F.count("*").alias("c")).where(F.col("c") > SIDE).select("main")
    sizes = classes.groupBy("node").agg(F.sum("n").alias("n"))
    few = inside.join(crowded, "main", "left_anti").join(sizes, "node").select(F.lit(0).cast("long").alias("shingle"), "main", "node", "root", "n")
    many = inside.join(crowded, "main", "left_semi").select("node", "root").distinct()
    return checkpointed(few.unionByName(_meetings(many, sets, percent)))


def _meetings(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, main, node, root, n): groups of the classes of inside that may be alike, by a rare shingle in common; main is the group's largest component."""
    words = inside.join(sets, "node").select("node", "root", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    shared = words.groupBy("shingle").agg(F.count("*").alias("held"), (F.min("root") < F.max("root")).alias("split")).where("held > 1")
    own = Window.partitionBy("node")  # one document's set
    place = F.row_number().over(own.orderBy("held", "shingle")) + F.col("n") - F.count("*").over(own)  # a class's own shingles come first
    rare = words.join(shared, "shingle").withColumn("place", place).where(F.col("split") & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    rare = written(rare.select("shingle", "node", "root", "n"))
    each = rare.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    main = each.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("c")).where("most.c < c")
    return rare.join(main.select("shingle", F.col("most.root").alias("main")), "shingle").select("shingle", "main", "node", "root", "n")


def _left_links(inside: DataFrame, classes: DataFrame, bodies: DataFrame, k: int, least: float, percent: int) -> DataFrame:
    """Links (a, b) between components, from groups of classes that may be alike."""
    about = written(inside.select("node").distinct().join(classes.select("node", "sig"), "node").join(bodies, "node"))
    blocks = lambda live: F.greatest(F.lit(1), F.ceil(F.greatest(F.count_if(live) / SIDE, F.sum(F.when(live, F.col("n")).otherwise(0)) / SIDE_SHINGLES))).cast("int")
    split = inside.groupBy("shingle", "main").agg(blocks(F.col("root") != F.col("main")).alias("rows"), blocks(F.lit(True)).alias("columns"))
    dealt = inside.drop("n").join(split, ["shingle", "main"])
    side = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lone = dealt.where("root <> main").select("shingle", "node", "root", "main", side(F.col("rows")).alias("i"), across("columns").alias("j")).join(about, "node")
    rest = dealt.select("shingle", "node", "root", "main", across("rows").alias("i"), side(F.col("columns")).alias("j")).join(about, "node")
    keys = ["shingle", "main", "i", "j"]
    rest = rest.toDF(*rest.columns)  # columns of its own: both sides come from the same tables
    return lone.groupBy(*keys).cogroup(rest.groupBy(*keys)).applyInArrow(lambda x, y: _block_links(x, y, k, least, percent), "a long, b long")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends have different roots."""
    root = lambda name: F.coalesce(F.col(f"{name}_root"), F.col(name))
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("a_root")), roots.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
    return pairs.join(left, "a", "left").join(right, "b", "left").where(root("a") != root("b")).select(*pairs.columns)


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, component_id) for each row of docs."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(partial(_signatures, k=k), "doc_id long, h int, n long, s1 long, s2 long, sig binary"))
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "sig")).alias("least"), F.count("*").alias("rows")).select("n", "s1", "s2", "rows", F.col("least.doc_id").alias("node"), F.col("least.sig").alias("sig")))
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / N_HASHES) ** 0.5
    ordered = classes.select("node", "sig").mapInArrow(_labels, "tree int, label binary, node long").repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    near = checkpointed(ordered.mapInArrow(partial(_neighbours, least=least), "a long, b long, alike float").where("a <> b").groupBy("a", "b").agg(F.max("alike").alias("alike")))
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    packed_texts = lambda ids: written(likely(texts, "doc_id", ids, "node").mapInArrow(_bodies, "node long, body binary").join(ids, "node", "left_semi"))
    bodies = packed_texts(wanted)
    best = near.groupBy("b").agg(F.max(F.struct("alike", "a")).alias("_best")).select(F.col("_best.a").alias("a"), "b")
    as_links = lambda roots: roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = components(_confirmed(best, bodies, k, percent))
    open_pairs = _across(near, roots).join(best, ["a", "b"], "left_anti")
    roots = components(as_links(roots).unionByName(_confirmed(open_pairs, bodies, k, percent)))
    inside = _split_regions(classes, roots)
    if not inside.isEmpty():
        bodies = bodies.unionByName(packed_texts(inside.select("node").distinct().join(wanted, "node", "left_anti")))
        sets = bodies.mapInArrow(partial(_sets, k=k), "node long, set array<long>")
        roots = components(as_links(roots).unionByName(_left_links(_groups(inside, classes, sets, percent), classes, bodies, k, least, percent)))
    # equal sets: each row has its class's root; Spark splits the rows of a class with very many
    rooted = classes.join(roots, "node", "left").select("n", "s1", "s2", "rows", "node", F.coalesce("root", "node").alias("root")).where("rows > 1 OR root <> node")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = written(signed.join(rooted.select("n", "s1", "s2", "root"), ["n", "s1", "s2"], "left").select("doc_id", "h", F.col("n").alias("n_shingles"), own.alias("component_id")))
    # rows that share a doc_id and not a class join their components
    split = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).where("least <> most")
    if split.isEmpty():
        return out
    met = components(out.join(split.select("doc_id", "least"), "doc_id").select(F.col("component_id").alias("a"), F.col("least").alias("b")))
    joined = out.join(met, out["component_id"] == met["node"], "left")
    return joined.select("doc_id", "h", "n_shingles", F.coalesce("root", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, that of the least doc_id; rows without a doc_id come after all others."""
    inner = F.coalesce(F.col(id_col).cast("long"), F.lit(NULLS) + F.pmod(F.xxhash64(text_col), F.lit(NULLS - 1)))
    found = written(near_components(docs.select(inner.alias("_inner"), F.col(text_col).alias("_text")), k, percent, "_inner", "_text"))
    rows = packed(docs, _inner=inner, _h=text_hash(text_col))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = rows.join(gone, F.col("_inner") == F.col("_gone"), "left_anti")
    again = found.where("component_id = doc_id").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1")
    if not again.isEmpty():  # Spark keeps one row of each in each task before it shuffles
        several = kept.join(again, F.col("_inner") == F.col("_again"), "left_semi")
        first = F.row_number().over(Window.partitionBy("_inner").orderBy("_h", F.to_json("_row")))
        once = several.withColumn("_k", first).where("_k = 1").drop("_k")
        kept = kept.join(again, F.col("_inner") == F.col("_again"), "left_anti").unionByName(once)
    return unpacked(kept, docs)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_components(load(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
