"""The operators of the llm subpackage against brute force on small tables with odd rows."""

import collections
import glob
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from strandframe.llm import ann, common, decontamination, language_id, line_dedup, lm, mixing, near_dedup, quality, subwords, substring_dedup, token_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, h string, _id string"
WORDS = [f"w{i}" for i in range(300)]


def corpus(spark, empty=False):
    """Copies, near copies, null and blank texts, a very long text, repeated rows, null ids, and columns with clashing names."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, shared = say(60), say(25)
    texts = [base, base, base + " tail", base.upper(), None, "", "  \n ", "one", "Two words", say(4000), f"{say(30)}\n{shared}\n{say(20)}", f"{shared} {say(9)}", "x" * 5000, "it " * 80, "La línea número uno\nla línea número uno\nLA línea número uno"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "b", "h", "i") for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, "s1", 0, None, None, None)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def split(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("empty", [False, True])
def test_substring(spark, empty):
    docs = corpus(spark, empty)
    got = {r.doc_id: r for r in substring_dedup.duplicate_spans(docs).collect()}
    rows = sorted({(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in docs.collect()}, key=lambda r: r[0])
    seen = set()
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        r = got[None if i == 1 << 62 else i]
        assert r.n_words == len(w) and r.kept.encode().split() == [x for x, y in zip(w, gone, strict=True) if not y]


def brute_spans(rows, span):
    """Per row (order, text): which words are covered by windows that start earlier too."""
    seen, out = set(), []
    for _, t in sorted(rows):
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            g = tuple(w[k : k + span])
            if g in seen:
                gone[k : k + span] = [True] * span
            seen.add(g)
        out.append((w, gone))
    return out


def test_substring_blocks(spark, monkeypatch):
    """Many blocks, reference blocks shared by several tasks, near copies, a passage in every text, periodic texts; with few words, so that matches abound."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "PARSED", 100)
    rng = random.Random(8)
    passage, base = [rng.choice(WORDS) for _ in range(90)], [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(120):
        w = [rng.choice(WORDS[:40]) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 5 == 0:
            w += [x if rng.random() > 0.02 else "edit" for x in base]
        if i % 7 == 0:
            w += ["to", "and", "fro"] * 30
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, rows[5], rows[15]], "doc_id long, text string").repartition(5)
    want = {i: b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode() for (i, _), (w, gone) in zip(rows, brute_spans(rows, 12), strict=True)}
    got = substring_dedup.duplicate_spans(docs, 12).collect()
    assert len(got) == len(rows) + 2 and all(r.kept == want[r.doc_id] for r in got)
    texts = {i: split(t) for i, t in rows}
    found = substring_dedup.factors(docs, 12).collect()
    assert found and max(r.end - r.begin for r in found) > 40
    for r in found:  # each factor stands at its source, which is earlier
        n = r.end - r.begin
        assert n >= 12 and texts[r.doc_id][r.begin : r.end] == texts[r.source_id][r.source_begin : r.source_begin + n]
        assert (r.source_id, r.source_begin) < (r.doc_id, r.begin)


@pytest.mark.parametrize("empty", [False, True])
def test_near(spark, empty):
    docs = corpus(spark, empty)
    got = near_dedup.near_components(docs, k=4).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    if not empty:
        assert [by[i].component_id for i in range(9)] == [0, 0, 0, 0, 4, 5, 6, 7, 8]
        assert by[4].n_shingles == by[6].n_shingles == 0 and by[8].n_shingles == 1 and by[13].n_shingles == 1 and by[None].component_id is None
        kept = [r.doc_id for r in near_dedup.keep_one(docs).collect()]
        assert 1 not in kept and None not in kept and kept.count(0) == 1 and sorted(kept) == [0, *range(4, 15)]
        odd = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "p q r s t u v", "y"), (5, "p q r s t u v", "y"), (9, "p q r s t u v", "z"), (None, "k l m n o", "n"), (None, "k l m n o", "n"), (7, None, "z")], "doc_id long, text string, _h string")
        assert {(r.doc_id, r.component_id) for r in near_dedup.near_components(odd, k=4).collect()} == {(5, 5), (9, 5), (None, None), (7, 7)}
        once = near_dedup.keep_one(odd)
        assert once.columns == odd.columns and sorted((r.doc_id or 0, r._h) for r in once.collect())[0::2] == [(0, "n"), (7, "z")] and once.count() == 3


def test_near_star(spark):
    """2,000 edited copies of a text, each like it and few like each other, against brute force over all pairs."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(303)]
    rows = [(0, base)]
    for i in range(1, 2001):
        words = list(base)
        for at in rng.sample(range(4, 299), 6):
            words[at] = f"x{i}_{at}"
        rows.append((i, words))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for _, w in rows]
    number = {}
    ids = [np.array([number.setdefault(g, len(number)) for g in s]) for s in sets]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(ids):
        mark = np.zeros(len(number), bool)
        mark[own] = True
        common = np.array([mark[x].sum() for x in ids[:i]], np.int64)
        for j in np.flatnonzero(100 * common >= 80 * (len(own) + np.array([len(x) for x in ids[:i]], np.int64) - common)):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs, k=4).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_crowded(spark, monkeypatch):
    """Regions beyond one block, by rare shingles, give the components of brute force."""
    monkeypatch.setattr(near_dedup, "SIDE", 3)
    rng, rows = random.Random(12), []
    for g in range(4):
        base = [rng.choice(WORDS) for _ in range(120)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j in range(i):
                if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root)) and 4 < len(set(root)) < 100


def test_near_meetings(spark):
    """20,000 unlike classes with most of their shingles in common never meet; those that are alike do, whichever shingles they share."""
    from pyspark.sql import functions as F

    common_part = F.sequence(F.lit(1), F.lit(70))
    own = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.lit(1000) + F.col("node") * 30 + k)
    unlike = spark.range(20_000).select(F.col("id").alias("node"), F.col("id").alias("root")).withColumn("set", F.concat(common_part, own).cast("array<long>"))
    inside, sets = unlike.select("node", "root"), unlike.select("node", "set")
    assert near_dedup._meetings(inside, sets, 80).isEmpty()
    rng, rows = random.Random(2), []
    for i in range(60):  # chains of sets that differ in a few entries
        base = list(range(70)) + [1000 + 100 * (i // 6) + k for k in range(30)]
        for _ in range(rng.randint(0, 12)):
            base[rng.randrange(100)] = 10_000 + rng.randrange(500)
        rows.append((i, i, sorted(set(base))))
    df = spark.createDataFrame(rows, "node long, root long, set array<long>")
    met = {frozenset(p) for r in near_dedup._meetings(df.select("node", "root"), df.select("node", "set"), 80).groupBy("shingle").agg(F.collect_list("node").alias("g")).collect() for p in [(a, b) for a in r.g for b in r.g if a < b]}
    alike = {frozenset((a, b)) for a, _, x in rows for b, _, y in rows if a < b and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
    assert alike and alike <= met


@pytest.mark.parametrize("empty", [False, True])
def test_lines(spark, empty):
    docs = corpus(spark, empty)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    owner = {}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").decode().translate(str.maketrans(subst))
    subst = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True))
    order = lambda i: 1 << 62 if i is None else i
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        for line in (t or "").split("\n"):
            owner.setdefault(key(line), i)
    want = collections.Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_decontamination(spark):
    docs = corpus(spark)
    long = docs.where("doc_id = 9").first().text.split()
    bench = spark.createDataFrame([(1, " ".join(long[5:30])), (2, "TWO, words"), (3, None), (None, " ".join(long[40:52])), (4, "x y z"), (5, " ".join(long[5:30]))], "item_id long, text string")
    hit, sizes = decontamination.contamination(docs, bench)
    got = {r._id: (r._n_hit, r._items) for r in hit.collect()}
    assert got == {9: (37, ["1", "5"]), 8: (2, ["2"])}
    assert {r._n_words for r in sizes.where("_id = 9").collect()} == {4000} and sizes.count() == docs.count()
    kept = decontamination.decontaminate(docs, bench)
    assert kept.count() == docs.count() - 2 and kept.columns == docs.columns
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()
    near = spark.createDataFrame([(1, " ".join([*long[5:10], "zzz", *long[10:15]]))], "doc_id long, text string")
    item = spark.createDataFrame([(1, " ".join(long[5:15]))], "item_id long, text string")
    assert [r._exact for r in decontamination.phrase_matches(near, item, 10, slop=2)[0].collect()] == [False]


def test_mixing(spark):
    docs = corpus(spark)
    got = mixing.assign_copies(docs).collect()
    total = sum(r._size for r in got)
    by = {r._row.source: (r._source_size, r._target) for r in got}
    assert abs(sum(t for _, t in by.values()) - total) < 1e-6 * total and all(t <= 3 * s for s, t in by.values())
    assert all(0 <= r._copies <= 3 for r in got) and got == mixing.assign_copies(docs).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    many = spark.range(20000).selectExpr("id AS doc_id", "'a b c' AS text", "concat('s', id % 3) AS source")
    for r in mixing.assign_copies(many).groupBy("_row.source").agg({"_target": "max", "_copies": "sum"}).collect():
        assert abs(3 * r["sum(_copies)"] / r["max(_target)"] - 1) < 0.05


def test_shards(spark, tmp_path):
    docs = corpus(spark)
    manifest, path = token_shards.write_shards(docs, f"file://{tmp_path}/s", length=64, shard_bytes=4000)
    rows = sorted(manifest.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) and max(r.shard for r in rows) > 4
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    for r in rows:
        (name,) = glob.glob(f"{path[7:]}/shard={r.shard}/part*")
        with open(name, "rb") as f:
            f.seek(r.byte_offset)
            ids = token_shards.read_records(f.read(129), 64)[0]
        assert zlib.crc32(ids.tobytes()) == r.crc
    enc = subwords.encoder(subwords.ranks_of())
    assert sum(r.n_tokens for r in rows) == sum(len(enc.encode_ordinary(r.text or "")) + 1 for r in docs.collect())
    assert token_shards.write_shards(docs.limit(0))[0].count() == 0
    shuffled, path = token_shards.write_shards(docs.repartition(7, "source", "n_chars"), f"file://{tmp_path}/t", length=64, shard_bytes=900)  # the order of rows is any
    rows = sorted(shuffled.collect(), key=lambda r: r.slot)
    records = np.concatenate([token_shards.read_records(open(glob.glob(f"{path[7:]}/shard={k}/part*")[0], "rb").read(), 64) for k in sorted({r.shard for r in rows})])
    assert [r.slot for r in rows] == list(range(len(rows))) and [zlib.crc32(x.tobytes()) for x in records] == [r.crc for r in rows]
    words = lambda ids: collections.Counter(x for x in ids if x != subwords.END)
    assert words(records.ravel().tolist()) == words(x for r in docs.collect() for x in subwords.encoder(subwords.ranks_of()).encode_ordinary(r.text or ""))
    assert len(set(token_shards.feistel((np.arange(1000) << 32) + 5, token_shards.DOMAIN).tolist())) == 1000
    for n in (1, 2, 3, 1000):
        assert sorted(token_shards.feistel(np.arange(n), n)) == list(range(n))
    odd = ["a  b", " x", "y ", "q \n r", "é  z", "don't stop", "a\n\nb c"]
    ids, sizes = subwords.encode_texts(enc, pa.array(odd))
    assert ids.tolist() == [x for t in odd for x in [*enc.encode_ordinary(t), subwords.END]] and sizes.sum() == len(ids)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:200] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df, df.where("vec_id % 20 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        hit += len({i for i, _ in got[q]} & set(best.tolist()))
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hit >= 0.9 * 600 and len(got) == 30
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id % 20 = 0")).count() == 4 and ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_language_and_quality(spark):
    rng = random.Random(5)
    words = {"aa": ["the", "then", "that", "tho"], "bb": ["zur", "zum", "zug", "zoe"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i in range(120) for lang in ["aa" if i % 2 else "bb"]]
    docs = spark.createDataFrame([*rows, (200, None, "aa"), (201, "123 !!", "bb"), (202, "the", None), (None, "zur", "bb")], "doc_id long, text string, lang string")
    language_id_steps = language_id.STEPS
    try:
        language_id.STEPS = 60
        net, langs = language_id.fit(docs)
        got = {r.doc_id: r for r in language_id.identify(docs, net, langs).collect()}
    finally:
        language_id.STEPS = language_id_steps
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 115
    assert got[200].lang_pred == got[201].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert [r.lang_pred for r in language_id.identify(docs, None, []).collect()] == ["und"] * docs.count()
    junk = [(i, ("$$$ %%% " * 20) if i % 3 == 0 else t, int(i % 3 != 0)) for i, t, _ in rows]
    table = spark.createDataFrame([*junk, (300, None, None)], "doc_id long, text string, quality int")
    model = quality.fit(table)
    got = {r.doc_id: r for r in quality.score(table, model).collect()}
    assert all(got[i].predicted == q for i, _, q in junk) and 0 <= got[300].score <= 1
    assert quality.accept(table, model).columns == table.columns and quality.fit(table.limit(0)) is None


def test_rare_languages(spark, monkeypatch):
    """Each labelled language is a class, however rare it is, and a frequent one takes no other's part."""
    monkeypatch.setattr(language_id, "SAMPLE", 20)
    monkeypatch.setattr(language_id, "STEPS", 60)
    seen = []
    monkeypatch.setattr(language_id, "train", lambda x, o, y, classes, train=language_id.train: (seen.append(np.bincount(y)), train(x, o, y, classes))[1])
    rare = {"cc": "xxvq wqxv", "dd": "oooo oioo", "ee": "ßßßß ßüßß"}
    rows = [(i, "the then that tho " * (1 + i % 3), "aa") for i in range(1000)] + [(2000 + 10 * k + j, t * 5, lang) for k, (lang, t) in enumerate(rare.items()) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net, langs = language_id.fit(docs)
    assert langs == ["aa", "cc", "dd", "ee"] and seen[0].tolist() == [5, 2, 2, 2]
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs.where("doc_id >= 990"), net, langs).collect()} == {i: lang for i, _, lang in rows if i >= 990}


@pytest.mark.parametrize("empty", [False, True])
def test_lm(spark, empty, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "train", lambda rows, scorer: None)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 8000)  # counts of a word come from many blocks
    docs = corpus(spark, empty)
    got = lm.score(docs, F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0).collect()
    fold = lambda t: [w.lower() for w in split(t)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = collections.Counter()
    for i, t in rows:
        if i is not None and i % 3:
            counts.update([*fold(t), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, i is not None and i % 3 == 0, len(fold(t)) + 1, sum(counts[w] > 0 for w in [*fold(t), None]), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*fold(t), None]), 6)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def following(seed: int, n: int = 400):
    """Texts in which each word is followed by one of two."""
    rng = random.Random(seed)
    after = {w: [rng.choice(WORDS) for _ in range(2)] for w in WORDS}
    rows = []
    for i in range(n):
        w = [rng.choice(WORDS)]
        while len(w) < 60:
            w.append(rng.choice(after[w[-1]]))
        rows.append((i, " ".join(w)))
    return rows


def test_lm_learns(spark, monkeypatch):
    """Trained on Spark over all rows, attention scores held-out texts above the word counts, and each id is a target once where no window is left out."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "ROUNDS", (8, 24, 32))
    monkeypatch.setattr(lm, "RATES", (0.03, 0.02, 0.01))
    monkeypatch.setattr(lm, "WINDOWS", 1)
    rows = following(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    seen = []
    real = lm._mean_move
    monkeypatch.setattr(lm, "_mean_move", lambda rows, share, step: (seen.append(real(rows, share, step)), seen[-1])[1])
    got = lm.score(docs, F.col("doc_id") % 10 != 0, F.col("doc_id") % 10 == 0, use=(False, True, True)).where("held_out").collect()
    per = lambda c: sum(r[c] for r in got) / sum(r.n_tokens for r in got)
    assert len(got) == 40 and per("score") > per("base_score") + 0.05
    enc = subwords.encoder(subwords.ranks_of())
    ids = sum(len(enc.encode_ordinary(" " + t)) + 1 for i, t in rows if i % 10)
    assert sum(n for _, n in seen[len(lm.TOPIC_ROUNDS) :]) == ids


def scorer_of(rows):
    """A scorer from plain counts, its texts as one topic."""
    ranks, counts, heads = subwords.ranks_of(), collections.Counter(), np.zeros((subwords.END + 1, lm.TOPICS))
    enc, words = subwords.encoder(ranks), collections.Counter(w for _, t in rows for w in t.split())
    for w, n in words.items():
        ids = enc.encode_ordinary(" " + w)
        heads[ids[0], 0] += n
        for i in ids:
            counts[i] += n
    ends = np.zeros(lm.TOPICS)
    ends[0] = counts[subwords.END] = len(rows)
    heads[subwords.END] = ends
    totals = np.zeros(lm.TOPICS)
    totals[0] = sum(words.values()) + len(rows)
    i, n = map(np.array, zip(*sorted(counts.items()), strict=True))
    return lm.Scorer(ranks, i, n.astype(float), totals, len(words) + 1, ends, heads, np.zeros((1 << 16, lm.TOPICS), np.float32)), enc, words


def brute_parts(scorer, enc, words, text):
    """The three probabilities of each word, one position at a time: softmax over what stands before it in the window that scores it. Also the share without its own occurrence."""
    p, soft = scorer.net.p, lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    ids, starts = [], []
    for w in text.split():
        starts.append(len(ids))
        ids += enc.encode_ordinary(" " + w)
    starts.append(len(ids))
    ids.append(subwords.END)
    entry = scorer.entry[ids]
    classes = np.exp(p["out"].astype(float) - p["out"].max(1, keepdims=True))
    classes /= classes.sum(1, keepdims=True)
    unseen = 0.1 * (scorer.distinct + 1)

    def at(k):
        # the first window reaches LENGTH ids; later ones begin LENGTH - OVERLAP apart and score what comes after their overlap
        first = 0 if k < lm.LENGTH else (k - lm.OVERLAP) // (lm.LENGTH - lm.OVERLAP) * (lm.LENGTH - lm.OVERLAP)
        before = [scorer.end if j == 0 else entry[j - 1] for j in range(first, k + 1)]
        e = p["emb"][before].astype(float) + p["pos"][: len(before)]
        c = soft(e @ (e[-1] @ p["att"]) * lm.DIM**-0.5) @ e
        g = soft(p["last"][before[-1]] + c @ p["ctx"])
        return g @ classes[:, entry[k]], g @ classes[:, scorer.border].sum(1), soft(c @ p["topic"] + p["prior"])

    seen, out = [at(k) for k in range(len(ids))], []
    for w, begin, end in zip([*text.split(), None], starts, [*starts[1:], len(ids)], strict=True):
        (given, border, z), n = seen[begin], np.zeros(lm.TOPICS)
        n[0] = words[w] if w is not None else scorer.ends[0]
        share = lambda n: z @ ((n + 0.1) / (scorer.totals + unseen))  # noqa: B023, E731
        own, head = share(n), z @ scorer.first[entry[begin]]
        spelled = np.prod([seen[k][0] * 10.0 ** scorer.within[ids[k]] for k in range(begin, end)]) / border * (seen[end][1] if end < len(ids) else 1)
        out.append((own, min(1, own * min(1, given / border) / head), min(1, spelled), share(n - np.eye(lm.TOPICS)[0]) / own))
    return np.array(out)


@pytest.mark.parametrize("seed", range(5))
def test_lm_score_brute(seed, monkeypatch):
    """score against a loop, by a network that has taken steps: they stay finite and help whatever the seed."""
    rows = following(seed, 60)
    scorer, enc, words = scorer_of(rows)
    learner = lm.Learner(scorer.net, 0.03)
    monkeypatch.setattr(lm, "WINDOWS", 1)
    for _ in range(12):
        learner.learn(*scorer.windows(enc, pa.array([t for _, t in rows])))
    assert all(np.isfinite(x).all() for x in scorer.net.p.values())
    scorer.seal()
    texts = [*[t for _, t in rows[:8]], "", "unknownword w1", "w5 " * 70, "x" * 300]
    coded, _ = lm._words(pa.array(texts))
    counts = np.zeros((len(coded.dictionary), lm.TOPICS))
    counts[:, 0] = [words[w] for w in coded.dictionary.to_pylist()]
    ids, begin = subwords.encode_words(enc, [" " + w for w in coded.dictionary.to_pylist()])
    train = np.arange(len(texts)) < 8
    got = scorer.score(pa.array(texts), train, coded.dictionary, counts, ids, begin)[3]
    parts = [brute_parts(scorer, enc, words, t) for t in texts]
    own = np.concatenate(parts[:8])[:: lm.FITTED]
    own[:, :2] *= own[:, 3:]
    weights = np.array(lm.START)
    for _ in range(25):
        r = own[:, :3] * weights / (own[:, :3] @ weights)[:, None]
        weights = (r.sum(0) + lm.FAITH * np.array(lm.START)) / (len(own) + lm.FAITH)
    assert np.allclose(got, [np.log10(np.minimum(1, x[:, :3] @ weights)).sum() for x in parts], rtol=1e-4)


def test_components_steps(spark, monkeypatch):
    """Components of chains, hubs and random graphs against union by hand; finished stars take no further step, and a step's edges are read in few tasks."""
    rng, taken, real = np.random.default_rng(5), [], near_dedup.checkpointed
    monkeypatch.setattr(near_dedup, "checkpointed", lambda df: (taken.append(real(df)), taken[-1])[1])
    chain, hub = [(i, i + 1) for i in range(100, 140)], [(300, i) for i in range(200, 260)]
    edges = [*chain, *hub, *((400 + int(a), 400 + int(b)) for a, b in rng.integers(0, 60, (45, 2)))]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert dict(got.collect()) == {x: r for x, r in root.items() if x != r}
    assert near_dedup._ends(taken[0], 1).rdd.getNumPartitions() == 1
    taken.clear()
    again = near_dedup.components(got.toDF("a", "b"))
    assert len(taken) == 1 and sorted(again.collect()) == sorted(got.collect())
    assert near_dedup.components(got.toDF("a", "b").limit(0)).isEmpty()


def test_lm_looks_at_all(monkeypatch):
    """As set, each id of a training text is a target once, and each training token counts in the mixture's weights."""
    rows = following(1, 12)
    scorer, enc, words = scorer_of(rows)
    texts = pa.array([*[t for _, t in rows], "", "w5 " * 300])
    x, y, live, topic = scorer.windows(enc, texts)
    ids = np.concatenate([[*enc.encode_ordinary(" " + t.strip()), subwords.END] if t else [subwords.END] for t in texts.to_pylist()])
    assert len(topic) == len(x) and np.array_equal(np.sort(y[live]), np.sort(scorer.entry[ids]))
    scorer.seal()
    coded, per = lm._words(texts)
    counts = np.zeros((len(coded.dictionary), lm.TOPICS))
    counts[:, 0] = [words[w] for w in coded.dictionary.to_pylist()]
    fitted, real = [], lm.fit_mixture
    monkeypatch.setattr(lm, "fit_mixture", lambda parts, use: (fitted.append(len(parts)), real(parts, use))[1])
    train = np.arange(len(texts)) % 3 > 0
    scorer.score(texts, train, coded.dictionary, counts, *subwords.encode_words(enc, [" " + w for w in coded.dictionary.to_pylist()]))
    assert fitted == [(per[train] + 1).sum()]


def test_lm_large_logits():
    """Logits of any size give weights, not 0 / 0, and a gradient that isn't finite is never learned from unnoticed."""
    net = lm.Network(np.full(9, 1 / 9))
    net.p["att"] = (-80 * np.eye(lm.DIM)).astype(np.float32)
    net.p["emb"] *= 4
    net.p["last"] *= 200
    x = np.random.default_rng(0).integers(0, 9, (8, lm.LENGTH))
    assert all(np.isfinite(z).all() for z in net.forward(x))
    learner = lm.Learner(net, 0.03)
    learner.step(x, x, np.ones(x.shape, bool), np.zeros(8, np.int64))
    assert all(np.isfinite(z).all() for z in net.p.values())
    net.seal()
    assert all(np.isfinite(z).all() for z in net.forward(x))


def test_lm_gain_is_attention_s(spark):
    """Held out, sf0.01: attention without the plain shares above the base, and the whole above the shares alone."""
    docs = common.load(spark, "/root/testdata/sf0.01", "documents")
    per = {}
    for use in ((True, False, False), (False, True, True), (True, True, True)):
        got = lm.score(docs, common.crc_mod("doc_id", 10) != 0, common.crc_mod("doc_id", 10) == 0, use=use).where("held_out").collect()
        n = sum(r.n_tokens for r in got)
        per[use], base = sum(r.score for r in got) / n, sum(r.base_score for r in got) / n
    print(base, per)
    assert per[False, True, True] > base + 0.2 and per[True, True, True] > per[True, False, False]


def test_windows():
    """Each id is scored once; in later windows at least 8 ids come before it."""
    lengths = np.array([1, 7, 32, 33, 500])
    stream = np.arange(lengths.sum())
    _, _, place, score = lm._window_inputs(stream, lengths, -1)
    assert sorted(place[score].tolist()) == stream.tolist()
    _, first = lm.windows_over(lengths)
    context = np.broadcast_to(np.arange(lm.LENGTH), score.shape)
    assert context[score & (first > 0)[:, None]].min() >= 8 and context[score].max() >= 31


def test_attention_gradient():
    """Backpropagation against differences, and no position sees what follows it."""
    net = lm.Network(np.full(9, 1 / 9))
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, live, topic = rng.integers(0, 9, (3, lm.LENGTH)), rng.integers(0, 9, (3, lm.LENGTH)), np.ones((3, lm.LENGTH), bool), np.array([0, 1, 2])

    def loss():
        g, *_, c = net.forward(x)
        return -np.log((g * net.classes().T[y]).sum(2)).mean() - np.log(net.topics(c)[np.arange(3), :, topic]).mean()

    grad = net.gradient(x, y, live, topic)
    for k, i in (("emb", (1, 2)), ("att", (3, 4)), ("ctx", (2, 1)), ("out", (3, 5)), ("pos", (4, 1)), ("last", (2, 2)), ("topic", (1, 1))):
        net.p[k][i] += 1e-4
        up = loss()
        net.p[k][i] -= 2e-4
        down = loss()
        net.p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - grad[k][i]) < 1e-4 + 0.02 * abs(grad[k][i]), k
    before = net.forward(x)[0][:, :5].copy()
    x[:, 5:] = 0
    assert np.allclose(before, net.forward(x)[0][:, :5])


def brute_pipeline(docs, labels, bench, model):
    """The stages in plain Python: ids after each, and (copies, targets) of the mix. The classifier's vote is the model's, text by text."""
    text = {r.doc_id: r.text or "" for r in docs}
    source = {r.doc_id: r.source for r in docs}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = [i for i in text if quality.vote(model, pa.array([text[i]]))[0] >= quality.THRESHOLD]
    shingles = {}
    for i in first:
        w = [x.decode().translate(fold) for x in split(text[i])]
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in first}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in first:
        for j in first:
            a, b = shingles[i], shingles[j]
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    second = [i for i in first if find(i) == i]
    word = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in bench:
        w = word.findall((r.text or "").translate(fold))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def dirty(t):
        w = word.findall(t.translate(fold))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    third = [i for i in second if not dirty(text[i])]
    size = {i: len(split(text[i])) for i in third}
    total = collections.Counter()
    for i in third:
        total[source[i]] += size[i]
    names = sorted(total, key=lambda x: (x is None, x))
    weight = {x: (1, 2, 3)[k % 3] for k, x in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while True:  # what a full source can't take is shared again
        over = {x for x in free if left * weight[x] / sum(weight[y] for y in free) > 3 * total[x] + 1e-9}
        if not over:
            break
        for x in over:
            target[x] = 3.0 * total[x]
            left -= target[x]
        free -= over
    target |= {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
    copies = {}
    for i in third:
        rate = min(3.0, target[source[i]] / total[source[i]]) if total[source[i]] else 0.0
        u = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies[i] = int(rate) + (u < rate - int(rate))
    return first, second, third, copies


def test_pipeline(spark):
    """run() against the stages in plain Python, over all of a small table with null and repeated texts besides."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    docs = lm.written(docs.unionByName(odd))
    model = quality.fit(quality.training_rows(docs, labels))
    first, second, third, copies = brute_pipeline(docs.collect(), labels.collect(), bench.collect(), model)
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (first, second, third, [i for i, n in copies.items() for _ in range(n)]), strict=True):
        now = lm.written(stage(spark, now, d))
        assert now.columns == docs.columns and sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(want), name
    assert len(third) < len(second) < len(first) < docs.count()
    manifest = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
    enc = subwords.encoder(subwords.ranks_of())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sum(r.n_tokens for r in manifest) == sum(n * (len(enc.encode_ordinary(text[i])) + 1) for i, n in copies.items())
    assert {x for r in manifest for x in r.doc_ids} == {i for i, n in copies.items() if n} and sorted(r.slot for r in manifest) == list(range(len(manifest)))


def test_pipeline_empty(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_language_brute(spark):
    """Document probabilities against a position-by-position loop in double precision, and held-out accuracy."""
    rng = random.Random(2)
    net = {k: x.astype(np.float64) for k, x in language_id.fresh(3, 7).items()}
    texts = ["".join(rng.choice("abc \u00e9\u00df.,1") for _ in range(n)) for n in (1, 40, 96, 97, 400)]

    def states(data, x, h):
        out, s = [], np.zeros(language_id.HIDDEN)
        for byte in data:
            a = x[byte] + h @ s
            z, c = 1 / (1 + np.exp(-a[: language_id.HIDDEN])), np.tanh(a[language_id.HIDDEN :])
            s = s + z * (c - s)
            out.append(s)
        return out

    want = []
    for t in texts:
        data, total, count = t.encode(), np.zeros(3), 0
        for w in range(0, len(data), language_id.WINDOW):
            cut = [data[i] if 0 <= i < len(data) else 0 for i in range(w - language_id.MARGIN, w + language_id.WINDOW + language_id.MARGIN)]
            f, b = states(cut, net["xf"], net["hf"]), states(cut[::-1], net["xb"], net["hb"])[::-1]
            for k in range(language_id.MARGIN, language_id.MARGIN + min(language_id.WINDOW, len(data) - w)):
                if chr(cut[k]).isascii() and not chr(cut[k]).isalpha():
                    continue
                e = net["out"] @ np.concatenate([f[k], b[k]]) + net["bias"][:, 0]
                total, count = total + e - np.log(np.exp(e).sum()), count + 1
        p = np.exp(language_id.POOL * total / max(1, count))
        want.append(p / p.sum())
    assert np.allclose(language_id.document_scores(language_id.fresh(3, 7), pa.array(texts), 3), want, atol=1e-3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.query(spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 250 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.95


def test_quality_brute(spark):
    """Votes against a plain loop over all labelled vectors, defined cases, and held-out accuracy."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.training_rows(docs, labels))
    texts = [r.text for r in docs.limit(40).collect()] + [None, "", "  ", "x"]
    z = quality._unit(quality._weighted(quality.features(pa.array(texts, pa.string())), model["idf"]) @ model["axes"])
    for v, got in zip(z, quality.vote(model, pa.array(texts, pa.string())), strict=True):
        cosine = [float(v @ u) for u in model["vectors"]]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        weight = [max(cosine[k], 1e-3) ** quality.SHARP for k in near]
        assert abs(got - sum(w * model["labels"][k] for w, k in zip(weight, near, strict=True)) / sum(weight)) < 1e-3
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.query(spark, d).where("held_out").collect() if known.get(r.doc_id) is not None]
    assert len(got) > 30 and np.mean([r.predicted == known[r.doc_id] for r in got]) > 0.9
    odd = spark.createDataFrame([(1, "a b c", "x", "y"), (1, "a b c", "x", "z"), (None, None, None, None)], "doc_id long, text string, score string, held_out string")
    assert [(r.doc_id, r.score) for r in quality.score(odd, None).collect()] == [(1, 0.5), (1, 0.5), (None, 0.5)] and quality.score(odd.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, "a b", 1), (2, "c d", 1)], "doc_id long, text string, quality int")
    assert {r.score for r in quality.score(odd, quality.fit(one)).collect()} == {1.0}


def test_nearest_blocks(spark, monkeypatch):
    """Several blocks of rows and of queries, ids that occur twice, columns besides; against all inner products."""
    monkeypatch.setattr(ann, "BLOCK", 90)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24)).round(3)
    rows = [(i, v.tolist(), "b", 1) for i, v in enumerate(x)] + [(7, x[8].tolist(), "b", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, part int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), radius=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, all_x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = 0
    for q in range(0, 400, 20):
        s = all_x @ x[q]
        best = [(int(ids[k]), s[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        hit += sum(any(i == j and abs(a - b) < 1e-9 for j, b in best) for i, a in got[q])
    assert len(got) == 20 and hit >= 0.9 * 400


def test_nearest_lengths(spark):
    """Each query meets all rows of its own length, whichever length comes first; null ids, components and vectors take no part."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0])] + [(i, rng.normal(size=3).round(3).tolist()) for i in range(1, 61)] + [(100 + i, rng.normal(size=5).round(3).tolist()) for i in range(30)]
    odd = [(None, [9.0, 9.0, 9.0]), (200, [9.0, None, 9.0]), (220, None), (240, []), (260, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=70).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    want = {}
    for q, v in rows:
        if q % 20 == 0:
            found = sorted(((i, round(float(np.dot(v, w)), 9)) for i, w in rows if i != q and len(w) == len(v)), key=lambda p: (-p[1], p[0]))
            if found:
                want[q] = found
    assert dict(got) == want and set(want) == {20, 40, 60, 100, 120}


def test_decontamination_shuffled(spark, monkeypatch):
    """Without broadcasts, empty documents, a word in every text: against a plain search."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", *WORDS[:12]]) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(200, ""), (201, None), (202, "the " * 30)]
    bench = [(k, " ".join(rng.choice(["the", *WORDS[:12]]) for _ in range(n))) for k, n in enumerate((1, 2, 3, 3, 12, 0))] + [(9, " ".join(rows[3][1].split()[5:20])), (10, "the the the")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = {}
    for i, t in rows:
        w, hit, found = (t or "").split(), set(), set()
        for k, b in bench:
            v = b.split()
            n = min(10, len(v))
            for at in range(len(v) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[at : at + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(k))
        if hit:
            want[i] = (len(hit), sorted(found))
    for limit in (200_000, 0):
        monkeypatch.setattr(decontamination, "broadcast_up_to", lambda df, rows, limit=limit: common.broadcast_up_to(df, rows, limit))
        hits, sizes = decontamination.contamination(docs, items)
        assert {r._id: (r._n_hit, r._items) for r in hits.collect()} == want
        assert {r._id: r._n_words for r in sizes.collect()} == {i: len((t or "").split()) for i, t in rows}


def test_mixing_many_sources(spark, monkeypatch):
    """The join by shuffle gives what the broadcast gives, and taken words stray from the target by chance only."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.assign_copies(docs).collect()
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    key = lambda r: (r._row.doc_id, r._size, r._target, r._copies)
    assert sorted(map(key, first)) == sorted(map(key, mixing.assign_copies(docs).collect()))
    taken, variance, target = collections.Counter(), collections.Counter(), {}
    for r in first:
        rate = min(3.0, r._target / r._source_size) if r._source_size else 0.0
        taken[r._row.source] += r._size * r._copies
        variance[r._row.source] += r._size**2 * (rate % 1) * (1 - rate % 1)
        target[r._row.source] = r._target
    assert all(abs(taken[s] - t) <= 4 * variance[s] ** 0.5 + 1 for s, t in target.items())


def test_likely(spark):
    """Bitmaps of any size keep all rows that are asked for, of negative and repeated ids too, and drop most others."""
    rows = spark.range(-500, 500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.createDataFrame([(7, "y"), (None, "z")], "doc_id long, text string"))
    ids = rows.where("doc_id % 7 = 0").select(F.col("doc_id").alias("node")).distinct()
    want = set(map(tuple, rows.where("doc_id % 7 = 0").collect()))
    for buckets in (1, 4096):
        got = list(map(tuple, common.likely(rows, "doc_id", ids, "node", buckets).collect()))
        assert want <= set(got) and len(got) == len(set(got)) <= len(want) + 10
    assert common.likely(rows, "doc_id", ids.limit(0), "node").isEmpty()


def test_body_sets(spark):
    """Sets of compressed texts are those of the texts, a text at a time or all at once."""
    texts = ["a b c d e f", "", "one", "é " * 50 + "x", "A b C d e F"]
    packed = next(near_dedup._bodies([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])])).column("body")
    want = near_dedup.shingle_sets(pa.array(texts), 4)
    for most in (1, 1 << 20):
        got = near_dedup._body_sets(packed, 4, most)
        assert all((x == y).all() for x, y in zip(got, want, strict=True))
    assert near_dedup._body_sets(packed.slice(0, 0), 4)[1].tolist() == [0]


def test_lm_encodes_spaced_words():
    """Words encoded in one call are as word by word, also where other white space could join the space between them; the tokenizer is called once for plain ones."""
    enc, calls = subwords.encoder(subwords.ranks_of()), []

    class Counted:
        def encode_to_numpy(self, text):
            calls.append(text)
            return enc.encode_to_numpy(text)

        def __getattr__(self, name):
            return getattr(enc, name)

    plain = ["foo", "'s", "don't", "1234abc", "é", "日本語", "\U0001f600", "a" * 700, "\x1c", "\x00", "'ll'", "..."]
    gaps = ["a ", " x", "　", " y ", "x\u0085y"]
    for words in (plain, gaps, plain + gaps + plain, gaps[:1], []):
        want = subwords.encode_words(enc, [" " + w for w in words])
        assert all(map(np.array_equal, subwords.encode_spaced(enc, pa.array(words, pa.string())), want)), words
    scorer, _, _ = scorer_of(following(1, 12))
    scorer.windows(Counted(), pa.array(["w1 w2 w3 new1", "w4 new2", None]))
    assert len(calls) == 1


def test_lm_step_by_rows(monkeypatch):
    """Sums of rows are as one by one; a step moves the embeddings of entries in its windows alone; and windows whose targets are the next inputs have the gradient of any others."""
    rng = np.random.default_rng(3)
    index, rows = np.minimum(rng.zipf(1.3, 3000) - 1, 400), rng.normal(size=(3000, 5))
    want = np.zeros((401, 5))
    np.add.at(want, index, rows)
    entries, total = lm._sums_by(index, rows)
    assert sorted(entries) == sorted(set(index.tolist())) and np.allclose(total, want[entries])
    net = lm.Network(np.full(50, 1 / 50))
    ids = rng.integers(0, 20, (6, lm.LENGTH + 1))
    x, y, live, topic = ids[:, :-1], ids[:, 1:], rng.random((6, lm.LENGTH)) < 0.9, rng.integers(0, lm.TOPICS, 6)
    both = net.gradient(x, y, live, topic)
    monkeypatch.setattr(np, "array_equal", lambda a, b: False)
    apart = net.gradient(x, y, live, topic)
    monkeypatch.undo()
    assert all(np.allclose(both[k], apart[k], atol=1e-6) for k in both)
    learner = lm.Learner(net, 0.03)
    for part in (slice(0, 3), slice(3, 6)):
        before = net.copy()
        learner.step(x[part] + 20 * (part.start > 0), y[part] + 20 * (part.start > 0), live[part], topic[part])
        moved = np.flatnonzero((net.p["emb"] != before.p["emb"]).any(1))
        assert set(moved) <= set((x[part] + 20 * (part.start > 0)).ravel()) and len(moved) > 10
        safe, most = net.safe, net.most
        net.seal()
        assert most[0] >= net.most[0] and most[1] >= net.most[1] and (net.safe or not safe)
