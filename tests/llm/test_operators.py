"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeplan.llm import binary_output, decontaminate, jaccard, packing, quality, secrets, substring_dedup, token_counts, toxicity, vector_search
from ridgeplan.runtime import new_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DDL = "doc_id long, text string, lang string, source string, n_chars long, text_hash long, node long, score double, kind string, p int, y int, is_query boolean"


def table(spark, rows, parts=3):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, "en", "src0", None if t is None else len(t), 1, 2, 0.5, "x", 3, 4, True) for i, t in rows]
    return spark.createDataFrame(full, DDL).repartition(parts)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(seed=5):
    """Nulls, empty texts, ties, repeats, near copies, shared passages and a long text."""
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 60)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One two three"), (6, " ".join(base)), (7, " ".join(base)), (7, " ".join(base)), (8, "  ".join(base[:-3] + ["x", "y", "z"]))]
    rows += [(9, " ".join(words(rng, 50) + passage + words(rng, 30))), (10, " ".join(words(rng, 5) + passage)), (11, " ".join(["again"] * 90)), (None, " ".join(base)), (None, None)]
    rows += [(20 + k, " ".join(words(rng, 80))) for k in range(10)]
    rows += [(40 + k, " ".join(w if rng.random() > 0.004 * k else "edit" for w in base)) for k in range(12)]
    rows += [(60, " ".join(words(rng, 30_000, 5_000))), (61, "é ü ß " * 40), (62, "a\x00b \x1f c"), (63, "日本語 テキスト <|endoftext|> it's " * 5), (64, "x" * 3000)]
    return rows


# ---- 1: substring dedup


def repeats_removed(rows, depth=35):
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[k : k + depth]) for w in split for k in range(len(w) - depth + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - depth + 1):
            if seen[tuple(w[k : k + depth])] > 1:
                gone.update(range(k, k + depth))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("frequent", "part"), [(512, 400_000), (2, 300)])
def test_substring_dedup(spark, frequent, part, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(substring_dedup, "PART", part)
    rows = awkward()
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_removed(rows)
    assert any(r.n_removed for r in got)
    assert substring_dedup.remove_repeats(table(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("chunk_words", [500, 2_000_000])
def test_many_equal_rows(spark, chunk_words, monkeypatch):
    """A hot group of equal rows without an id, and one that shares a passage with it."""
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk_words)
    rng = random.Random(6)
    hot = words(rng, 70, 10_000)
    rows = [(None, " ".join(hot))] * 3000 + [(1, " ".join(words(rng, 20, 10_000) + hot[10:60])), (2, " ".join(words(rng, 90, 10_000)))]
    got = substring_dedup.remove_repeats(table(spark, rows, 5), with_text=False).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r["count"]) for r in got} == {(None, 70, 70, 3000), (1, 70, 50, 1), (2, 90, 0, 1)}


def test_nodes_by_depth():
    rng = random.Random(1)
    words_ = np.array([rng.randrange(3) for _ in range(3000)])
    for depth in (1, 2, 3, 8, 35):
        names = substring_dedup.deep_nodes(words_, depth)
        of = {}
        assert all(of.setdefault(tuple(words_[k : k + depth]), names[k]) == names[k] for k in range(len(names)))
        assert len(set(of.values())) == len(of) and len(names) == len(words_) - depth + 1


# ---- 2, 5: classifiers


def labelled(spark, seed=3, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic, good = k % 4 == 0, k % 3 > 0
        text = words(rng, 60)
        if toxic:
            text[10:12] = ["scumbag", "idiots"]
        if not good:
            text = [w + "###" for w in text[:20]] * 3
        rows.append((k, " ".join(text)))
        labels.append((k, int(good), int(toxic)))
    extra = [(1000, None), (1001, ""), (None, "x y"), (5, "a repeated id"), (1002, "word " * 30_000)]
    return table(spark, rows + extra), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"), {k: (g, t) for k, g, t in labels}


@pytest.mark.parametrize(("module", "place"), [(quality, 0), (toxicity, 1)])
def test_classifiers(spark, module, place):
    docs, labels, truth = labelled(spark)
    model = module.train(docs, labels)
    got = module.score_documents(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id != 5 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [(r.score >= 0.5) == bool(truth[r.doc_id][place]) for r in held]
    assert len(held) > 40 and sum(right) >= 0.95 * len(right)
    again = module.train(docs.repartition(5), labels)
    by_place = lambda rows: sorted((str(r.doc_id), r.score) for r in rows)
    for (i, a), (j, b) in zip(by_place(got), by_place(module.score_documents(docs, again).collect()), strict=True):
        assert i == j and abs(a - b) < 0.01
    flat = module.train(docs, labels.filter("false"))
    assert {round(r.score, 6) for r in module.score_documents(docs, flat).collect()} == {0.5}
    assert module.score_documents(docs.filter("false"), model).count() == 0


def test_held_out_labels_are_never_learnt(spark):
    docs, labels, _ = labelled(spark)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.array_equal(a.chosen, b.chosen) and np.allclose(a.weight, b.weight)


def test_features_do_not_depend_on_partitions(spark):
    """An n-gram that each task sees in one document only counts as well."""
    docs, labels, _ = labelled(spark)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # each file is a task
    try:
        one, many = (toxicity.train(docs.repartition(n), labels) for n in (1, 40))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert np.array_equal(one.chosen, many.chosen) and np.allclose(one.weight, many.weight, atol=1e-6) and abs(one.bias - many.bias) < 1e-6


def test_features_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(words(random.Random(2), 3000))
    whole = toxicity.present([text, "b", None])
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    cut = toxicity.present([text, "b", None])
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut, strict=True))


def test_features_are_character_ngrams():
    """Present features of a text are exactly the hashes of its 3 to 6 character n-grams."""
    one = lambda gram: {int(f) for n, x in toxicity.hashed(np.frombuffer(gram.encode("utf-32-le"), "<u4")) if n == len(gram) for f in x}
    for text in ("Grüße aus Köln", "日本語のテキスト", "ab", "abc", "a\U0001f600b\U0001f600cd", "x" * 50):
        low = text.lower()
        want = {f for n in (3, 4, 5, 6) for k in range(len(low) - n + 1) for f in one(low[k : k + n])}
        doc, feature = toxicity.present(["zz", text, None])
        assert set(feature[doc == 1].tolist()) == want
        if len(low) >= 6:
            assert len(want) >= len({low[k : k + 6] for k in range(len(low) - 5)})


def test_log_count_ratios_by_hand(spark):
    """Chosen features and their ratios against a naive counter of documents by n-gram."""
    docs, labels, truth = labelled(spark, n=120)
    counts = {0: Counter(), 1: Counter()}
    size = Counter()
    texts = {r.doc_id: r.text for r in docs.filter("doc_id IS NOT NULL").collect() if r.doc_id != 5}
    texts[5] = min((r.text for r in docs.filter("doc_id = 5").selectExpr("text", "xxhash64(text) AS h").collect()), key=lambda t: docs.sparkSession.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first().h)
    for k, (_, toxic) in truth.items():
        if zlib.crc32(str(k).encode()) % 4 != 2 and k != 7 or (k == 7 and zlib.crc32(b"7") % 4 != 2):
            size[toxic] += 1
            counts[toxic].update(set(toxicity.present([texts[k]])[1].tolist()))
    fitted = toxicity.train(docs, labels, n_features=200)
    p = {f: (counts[1][f] + 1) / (size[1] + 2) for f in set(counts[0]) | set(counts[1]) if counts[0][f] + counts[1][f] >= 8}
    q = {f: (counts[0][f] + 1) / (size[0] + 2) for f in p}
    z = {f: abs(math.log(p[f] / q[f])) / math.sqrt((1 - p[f]) / (counts[1][f] + 1) + (1 - q[f]) / (counts[0][f] + 1)) for f in p}
    least = sorted(z.values())[-200]
    assert all(z[f] >= least - 1e-9 for f in fitted.chosen.tolist()) and len(fitted.chosen) == 200


def test_sample_is_bounded_and_repeatable(spark):
    """Repeated ids and conflicting labels: one row per id, the smallest label."""
    docs = table(spark, [(k % 6, f"text {k}") for k in range(60)], 7)
    labels = spark.createDataFrame([(k % 6, k % 2, (k // 6) % 2) for k in range(24)], "doc_id long, quality int, toxic int")
    got = [sorted(map(tuple, toxicity.labelled(docs.repartition(n), labels, "toxic", 4).collect())) for n in (1, 9)]
    assert got[0] == got[1] and len(got[0]) <= 4 and {y for _, y in got[0]} == {0}


def plain_walk(trees, row):
    """One row through each tree, node by node."""
    z = trees.bias
    for root in trees.roots.tolist():
        node = root
        while trees.left[node] != node:
            k = trees.feature[node]
            b = sum(row[k] > e for e in trees.edges[k])
            node = int(trees.left[node] if b <= trees.limit[node] else trees.right[node])
        z += trees.value[node]
    return 1 / (1 + math.exp(-z))


def test_flat_trees_score_like_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).round(1)
    trees = quality.grow(x, ((x[:, 0] + x[:, 3] ** 2 > 0.5) ^ (rng.random(400) < 0.1)).astype(float), rounds=25)
    probe = np.concatenate([x[:50], rng.normal(size=(50, 5)) * 5])
    assert len(trees.roots) == 25 and np.allclose(trees.score(probe), [plain_walk(trees, r) for r in probe])


def test_statistics_by_hand():
    text = "One two two THREE.\n\none 12 | 7%\nOne two two THREE.\n"
    got = dict(zip(quality.FEATURES, quality.statistics(text), strict=True))
    own = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    want = {
        "chars": math.log1p(len(text)), "words": math.log1p(len(own)), "lines": math.log1p(3), "mean_word": sum(map(len, own)) / len(own), "short_words": sum(len(w) <= 3 for w in own) / len(own),
        "distinct_words": len(set(own)) / len(own), "top_word": 4 / len(own), "same_neighbour": 2 / len(own), "digits": 3 / len(text), "upper": sum(c.isupper() for c in text) / len(text), "pipes": 1 / len(text),
        "spaces": sum(c.isspace() for c in text) / len(text), "ended_lines": 2 / 3, "distinct_lines": 2 / 3, "capital_lines": 2 / 3, "numbers": 1 / len(own), "mean_line": math.log1p(len(text) / len(lines)),
    }
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), {k: (got[k], v) for k, v in want.items()}
    assert quality.statistics(None) == quality.statistics(" \n") == [0.0] * len(quality.FEATURES)


@pytest.mark.parametrize(("name", "target", "threshold", "least"), [("op2_quality", "quality", 0.7, 0.9), ("op5_toxicity", "toxic", 0.3, 0.9)])
def test_held_out_accuracy(spark, name, target, threshold, least):
    """Rows that no classifier saw, at the contract's threshold, on the given tables."""
    from ridgeplan.llm.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(target).alias("y"))
    got = QUERIES[name](spark, folder).join(labels, "doc_id").filter("held_out AND y IS NOT NULL").collect()
    assert len(got) > 30 and all((r.score >= threshold) == bool(r.predicted) for r in got)
    assert sum(r.predicted == r.y for r in got) >= least * len(got)


def test_trees_learn_a_threshold():
    x = np.random.default_rng(0).random((500, 3))
    y = (x[:, 1] > 0.5).astype(float)
    assert ((quality.grow(x, y, rounds=30).score(x) > 0.5) == y).mean() > 0.98


# ---- 3: Jaccard join


def links_of(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and den * i >= num * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    first = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return sorted((str(i), len(s), str(first[c] if i is not None else None)) for (i, _), s, c in zip(rows, sets, comp, strict=True))


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(spark, size, num):
    rows = awkward(size)
    got = jaccard.JaccardJoin(size, num, 100, chunk_words=2_000, tile=4).components(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == links_of(rows, size, num, 100)


def test_jaccard_join_of_nothing(spark):
    assert jaccard.JaccardJoin().components(table(spark, [(1, "a")]).filter("false")).count() == 0
    lone = jaccard.JaccardJoin().components(table(spark, [(1, None), (2, "a b c d e")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in lone) == [(1, 0, 1), (2, 2, 2)]


def test_loose_family(spark):
    """A family of copies around a core: most pairs do not link with any one pivot."""
    rng = random.Random(9)
    core = words(rng, 150, 10_000)
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"e{k}_{j}" for j, w in enumerate(core))) for k in range(60)]
    got = jaccard.JaccardJoin(4, 80, 100, tile=8).components(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == links_of(rows, 4, 80, 100)


def test_allocation_covers_every_pair_of_sizes():
    """Whatever a set chooses to ask with, its partners are indexed there: by enumeration of all sizes."""
    for num in (85, 80, 50):
        t = jaccard.Threshold(num, 100)
        for a in range(1, 1500 if num > 50 else 300):
            need = t.differ(2 * a) + 1  # units that a asks with, enough for partners up to its own size
            assert t.choice(a) >= need
            low = -(-num * a // 100)
            assert all(t.units(b) >= t.choice(a) and t.differ(a + b) < need for b in (low, (low + a) // 2, a))
            own = jaccard.bands(a, t)[0]
            assert all(own in jaccard.bands(b, t) for b in (low, (low + a) // 2, a)) and own > t.units(a)


def test_link_of_a_text_and_its_beginning(spark):
    """A text of twenty words, its first eighteen and an exact copy are one class."""
    rng = random.Random(17)
    for _ in range(3):
        text = [f"w{rng.randrange(10**6)}" for _ in range(20)]
        rows = [(1, " ".join(text)), (2, " ".join(text[:18])), (3, " ".join(text))]
        got = jaccard.JaccardJoin().components(table(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 17, 1), (2, 15, 1), (3, 17, 1)]


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_random_near_copies_meet(size, num):
    """Signatures of random near copies of 8 to 200 words: no linked pair is without a common asked bucket."""
    rng, t, linked = random.Random(size), jaccard.Threshold(num, 100), 0
    for _ in range(4000):
        text = [b"w%d" % rng.randrange(10**6) for _ in range(rng.randint(8, 200) if rng.random() < 0.3 else rng.randint(8, 40))]
        other = list(text)
        for _ in range(rng.randint(0, 1 + len(text) // 40)):
            k = rng.choice([0, len(other) - 1, rng.randrange(len(other))])
            other[k : k + rng.randint(0, 2)] = [b"x%d" % rng.randrange(10**6) for _ in range(rng.randint(0, 2))]
        a, b = jaccard.shingles(text, size), jaccard.shingles(other, size)
        if len(a) and len(b) and t.links(a, b) and jaccard.node_of(a) != jaccard.node_of(b):
            linked += 1
            fa, fb = (jaccard.signatures(x, t, np.array([rng.randint(1, 50) for _ in x])) for x in (a, b))
            assert len(jaccard.bucketed(np.concatenate([fa, fb]), np.repeat([1, 2], [len(fa), len(fb)]))[0])
    assert linked > 800


def gp_labels(pairs):
    """Smallest node of each component of the pairs."""
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_tiles_give_every_open_pair(monkeypatch):
    """Cut tiles say so; the round without a cut gives all pairs that the sketches leave."""
    rng, t = np.random.default_rng(3), jaccard.Threshold(80, 100)
    core = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(core)[: 56 + k % 4], rng.integers(0, 2**63, 2, dtype=np.int64).astype(np.uint64))) for k in range(40)]
    batch = pa.record_batch({"tile": pa.array([1] * 40), "key": pa.array([77] * 40), "side": pa.array([2] * 40), "node": pa.array(range(40)), "component": pa.array(range(40)), "n": pa.array([len(s) for s in sets]), "parity": pa.array([jaccard.parity(s) for s in sets])})
    tile = pa.Table.from_batches([batch])
    whole = pa.Table.from_batches(jaccard.candidate_tiles(iter([tile]), t, True)).to_pydict()
    pairs = set(zip(whole["a"], whole["b"], strict=True))
    assert not any(whole["more"]) and all((a, b) in pairs for a in range(40) for b in range(a + 1, 40) if t.links(sets[a], sets[b]))
    cut = pa.Table.from_batches(jaccard.candidate_tiles(iter([tile]), t, False)).to_pydict()
    assert cut["more"].count(True) == 1 and len(cut["a"]) == 40 and cut["a"][-1] == 77
    for look in (1, 50, 1 << 15):
        monkeypatch.setattr(jaccard, "LOOK_PAIRS", look)
        again = pa.Table.from_batches(jaccard.candidate_tiles(iter([tile]), t, True)).to_pydict()
        assert set(zip(again["a"], again["b"], strict=True)) == pairs and len(again["a"]) == len(pairs)
    halves = tile.set_column(2, "side", pa.array([k % 2 for k in range(40)]))
    crossing = pa.Table.from_batches(jaccard.candidate_tiles(iter([halves]), t, True)).to_pydict()
    assert set(zip(crossing["a"], crossing["b"], strict=True)) == {(a, b) for a, b in pairs if a % 2 != b % 2}
    # several tiles in batches that cut them anywhere
    ids = [k // 7 for k in range(40)]
    several = tile.set_column(0, "tile", pa.array(ids)).set_column(1, "key", pa.array(ids)).combine_chunks().to_batches()[0]
    for step in (1, 3, 7, 11, 40):
        cut_up = [several.slice(k, step) for k in range(0, 40, step)]
        for every in (True, False):
            got = [r for x in jaccard.candidate_tiles(jaccard.whole_tiles(cut_up), t, every) for r in x.to_pylist()]
            inside = {(a, b) for a, b in pairs if a // 7 == b // 7}
            chosen = {(r["a"], r["b"]) for r in got if not r["more"]}
            full = {q for q in set(ids) if sum(a // 7 == q for a, b in inside) > ids.count(q)}
            assert {r["a"] for r in got if r["more"]} == (set() if every else full)
            assert chosen <= inside and (chosen == inside if every else {p for p in inside if p[0] // 7 not in full} <= chosen)
            joined = gp_labels(chosen)
            assert all(joined.get(a, a) == joined.get(b, b) for a, b in inside)
    monkeypatch.setattr(jaccard, "PAIRS_PER_NODE", 1000)
    assert pa.Table.from_batches(jaccard.candidate_tiles(iter([tile]), t, False)).to_pydict() == whole


def test_large_tiles_are_looked_at_in_parts(monkeypatch):
    """A tile of which only some rows are looked at at once gives what it gives whole: the same pairs, forest and notice."""
    rng, t = np.random.default_rng(5), jaccard.Threshold(80, 100)
    core = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(core)[: 55 + k % 5], rng.integers(0, 2**63, 2, dtype=np.int64).astype(np.uint64))) for k in range(90)]
    table_ = pa.table({"tile": [0] * 70 + [1] * 20, "key": [5] * 70 + [6] * 20, "side": [2] * 70 + [k % 2 for k in range(20)], "node": range(90), "component": range(90), "n": [len(s) for s in sets], "parity": [jaccard.parity(s) for s in sets]})
    wanted, most, plain = {}, 0, jaccard.pairs_of_rows
    for look in (1 << 20, 200, 70, 1):
        monkeypatch.setattr(jaccard, "LOOK_PAIRS", look)
        sizes = []
        monkeypatch.setattr(jaccard, "pairs_of_rows", lambda *x, got=sizes: got.append(len((y := plain(*x))[0])) or y)
        for every in (True, False):
            rows = sorted(tuple(r.values()) for x in jaccard.candidate_tiles(iter([table_]), t, every) for r in x.to_pylist())
            assert wanted.setdefault(every, rows) == rows and rows
        most = max(most, max(sizes) if look < 1 << 20 else 0)
    assert most <= 200 and {r[0] for r in wanted[False] if r[2]} >= {5}


def test_tiles_try_pairs_of_asking_rows_only(monkeypatch):
    """A large bucket in which few sets ask: before, each of its pairs was tried."""
    rng, t, looked, plain = np.random.default_rng(6), jaccard.Threshold(80, 100), [], jaccard.pairs_of_rows
    core = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(core)[: 56 + k % 4], rng.integers(0, 2**63, 2, dtype=np.int64).astype(np.uint64))) for k in range(200)]
    ask = [k % 50 == 3 for k in range(200)]
    whole = pa.table({"tile": [1] * 200, "key": [7] * 200, "side": [2] * 200, "node": range(200), "component": range(200), "n": [len(s) for s in sets], "ask": ask, "parity": [jaccard.parity(s) for s in sets]})
    all_pairs = pa.Table.from_batches(jaccard.candidate_tiles([whole.drop_columns("ask")], t, True)).to_pydict()
    larger = {(a, b) for a, b in zip(all_pairs["a"], all_pairs["b"], strict=True) if (ask[a] and len(sets[a]) >= len(sets[b])) or (ask[b] and len(sets[b]) >= len(sets[a]))}
    monkeypatch.setattr(jaccard, "pairs_of_rows", lambda *x: looked.append(len((y := plain(*x))[0])) or y)
    for side, want in (([2] * 200, larger), ([0 if x else 1 for x in ask], {(a, b) for a, b in larger if ask[a] != ask[b]})):
        looked.clear()
        got = pa.Table.from_batches(jaccard.candidate_tiles([whole.set_column(2, "side", pa.array(side))], t, True)).to_pydict()
        assert set(zip(got["a"], got["b"], strict=True)) == want and len(got["a"]) == len(want) > 50
        assert sum(looked) <= 4 * 199


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_the_larger_set_of_a_link_asks(size, num):
    """Sets around a core, many in a bucket: each link is a pair of some bucket in which the larger set asks."""
    rng, t = random.Random(size + 50), jaccard.Threshold(num, 100)
    core = [b"w%d" % rng.randrange(10**6) for _ in range(90)]
    texts = [[w if rng.random() > 0.02 else b"x%d" % rng.randrange(10**6) for w in core[: rng.randint(70, 90)]] for _ in range(60)]
    sets = {jaccard.node_of(x): x for x in (jaccard.shingles(w, size) for w in texts)}
    sig = [jaccard.signatures(x, t, f) for x, f in zip(sets.values(), jaccard.frequencies(list(sets.values())), strict=True)]
    key, node, _, ask = jaccard.asked_buckets(np.concatenate(sig), np.repeat(np.array(list(sets), np.int64), [len(x) for x in sig]))
    bucket: dict = {}
    for k, n, a in zip(key.tolist(), node.tolist(), ask.tolist(), strict=True):
        bucket.setdefault(k, []).append((n, a))
    met = {(a, b) for rows in bucket.values() for a, asks in rows for b, _ in rows if asks and a != b and len(sets[a]) >= len(sets[b])}
    links = [(a, b) for a in sets for b in sets if a < b and t.links(sets[a], sets[b])]
    assert len(links) > 50 and all((a, b) in met or (b, a) in met for a, b in links) and not ask.all()


def test_only_possible_pairs_meet_as_texts(spark, monkeypatch):
    """Texts that share a passage and no more are told apart by their sketches before any text is compared."""
    rng, seen = random.Random(23), []
    passage = words(rng, 30, 10_000)
    rows = [(k, " ".join(passage + words(rng, 60, 10_000))) for k in range(40)] + [(90, rows_text := " ".join(words(rng, 80, 10_000))), (91, rows_text + " end")]
    plain, possible = jaccard.JaccardJoin.verified, jaccard.JaccardJoin.possible
    met = []
    monkeypatch.setattr(jaccard.JaccardJoin, "possible", lambda self, pairs, texts: met.append(pairs.count()) or possible(self, pairs, texts))
    monkeypatch.setattr(jaccard.JaccardJoin, "verified", lambda self, pairs, texts: seen.append(pairs.count()) or plain(self, pairs, texts))
    got = jaccard.JaccardJoin(5, 80, 100).components(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == links_of(rows, 5, 80, 100)
    assert seen[0] == 1 < met[0]


def test_words_end_at_all_six_separators():
    text = "a\tb\nc\x0bd\x0ce\rf g"
    assert jaccard.words_of(text) == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    import duckdb

    inner = jaccard.ORACLE_SQL["op3_jaccard_join"].split("AS w FROM documents")[0].split("SELECT doc_id, ", 1)[1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, $1 AS text", [text])
    assert con.execute(f"SELECT {inner} FROM documents").fetchone()[0] == list("abcdefg")


def test_pigeonhole_covers_every_link():
    """Sets at the threshold always share a signature that the larger one asks with."""
    rng, t = np.random.default_rng(4), jaccard.Threshold(85, 100)
    for n in [1, 2, 3, 5, 6, 7, 8, 12, 20, 33, 57, 100, 260, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            d = t.differ(2 * len(a))
            drop = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, d + 1)), dtype=np.int64).astype(np.uint64)]))
            if not len(b) or not t.links(a, b):
                continue
            fa, fb = (jaccard.signatures(x, t, rng.integers(1, 9, len(x))) for x in (a, b))
            key, _, _ = jaccard.bucketed(np.concatenate([fa, fb]), np.repeat([1, 2], [len(fa), len(fb)]))
            assert len(key) or jaccard.node_of(a) == jaccard.node_of(b)


@pytest.mark.parametrize(("num", "pairs"), [(85, [(18, 16), (12, 11), (7, 6), (40, 34), (100, 85), (300, 255)]), (80, [(12, 10), (10, 8), (5, 4), (50, 40), (120, 96)])])
def test_pigeonhole_covers_sets_of_different_size(num, pairs):
    """The smaller set inside the larger one, whatever the larger one finds cheap to ask with."""
    rng, t = np.random.default_rng(7), jaccard.Threshold(num, 100)
    for n, m in pairs:
        assert all(t.differ(2 * n) < t.choice(n) <= t.units(k) for k in range(m, n + 1))
        for _ in range(2000 if n < 30 else 200):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            b = np.sort(rng.permutation(a)[:m])
            assert t.links(a, b)
            fa, fb = (jaccard.signatures(x, t, rng.integers(1, 9, len(x))) for x in (a, b))
            key, _, _ = jaccard.bucketed(np.concatenate([fa, fb]), np.repeat([1, 2], [len(fa), len(fb)]))
            assert len(key), (n, m)


# ---- 4: top-k search


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in rng.normal(size=24)]) for k in range(300)]
    rows += [(400 + k, rows[0][1]) for k in range(8)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 24), (503, []), (504, [1.0]), (550, [0.5] * 24), (None, [1.0] * 24), (600, [3e38] * 24)]
    ddl = "vec_id long, embedding array<double>, score long, query_id long, rank int"
    table_ = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], ddl).repartition(3)
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))}
    want = []
    for q, a in vectors.items():
        if q % 50 == 0:
            clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
            best = sorted(((-clamp(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in vectors.items() if i != q))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    monkeypatch.setattr(vector_search, "HELD", 24 * 60)
    got = vector_search.top_k(table_, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert vector_search.top_k(table_, F.col("vec_id") % 50 == 0, 5, block=2).count() == len(want)
    assert vector_search.top_k(table_.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = vector_search.top_k(table_.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [r.rank for r in sorted(few)] == [1, 2]


def test_top_k_of_repeated_ids(spark):
    """Rows of one id never meet one another; queries of one id share one list."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(table_, F.col("vec_id") == 0, 4).collect()
    best = sorted(((-65536 * int(sum(x * y for x, y in zip(a, b, strict=True))), j) for i, a in rows if i == 0 for j, b in rows if j))[:4]
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


# ---- 6, 7, 8: tokens


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_file(BYTES)
    return lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, ids_of):
    rows = awkward()
    got = packing.pack(table(spark, rows), BYTES, capacity=64).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(t)
        first = len(ids) % 64 or 64
        cuts = [0, len(ids)] if len(ids) <= 64 else [0, *range(first, len(ids) + 1, 64)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        content.sort()
        assert content[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(content, content[1:], strict=False)) and sum(n for _, n in content) <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.1 * total / 64 + 1
    assert packing.pack(table(spark, rows).filter("false"), BYTES).count() == 0


def test_plans_hold_every_piece():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(0, 12))}
        held = Counter()
        for n, content in packing.plan_bins(counts, capacity):
            assert n > 0 and sum(z * k for z, k in content) <= capacity
            for z, k in content:
                held[z] += n * k
        assert held == Counter(counts)


def test_packing_is_as_good_as_plain_best_fit():
    """Against a best-fit-decreasing packer that places one item at a time, on lengths like those of the tables."""
    import bisect

    def plain(lengths, capacity):
        gaps = []
        for z in sorted(lengths, reverse=True):
            k = bisect.bisect_left(gaps, z)
            gap = gaps.pop(k) if k < len(gaps) else capacity
            bisect.insort(gaps, gap - z)
        return len(gaps)

    rng = random.Random(11)
    for capacity in (64, 2048):
        for _ in range(6):
            lengths = [min(capacity, max(1, int(rng.lognormvariate(math.log(capacity / 5), 1)))) for _ in range(1500)]
            ours = sum(n for n, _ in packing.plan_bins(dict(Counter(lengths)), capacity))
            assert ours <= plain(lengths, capacity) * 1.01 + 1


def test_large_items_pair_up():
    assert sum(n for n, _ in packing.plan_bins({60: 10, 40: 10}, 100)) == 10
    assert sum(n for n, _ in packing.plan_bins({45: 7}, 100)) == 4
    assert sum(n for n, _ in packing.plan_bins({70: 5, 30: 5}, 100)) == 5


def test_token_counts(spark):
    rows, library = awkward(), Tokenizer.from_file(WORDS)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)
    for size in (1, 1 << 16):
        got = token_counts.token_counts(table(spark, rows), WORDS, table_size=size).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(table(spark, rows).filter("false"), WORDS).count() == 0


def test_frequent_table_is_merged_over_tasks(spark):
    docs = table(spark, [(k, "common words here " * 5 + f"rare{k}") for k in range(60)], parts=20)
    assert set(token_counts.frequent_lengths(docs, WORDS, 3)) == {"common", "words", "here"}


def test_small_cache_changes_nothing():
    counter = token_counts.TwoTier(WORDS, {"a": 1}, cache_size=2)
    library = Tokenizer.from_file(WORDS)
    for text in ("a b c d e f a b", "Straße ÀÉ ½ ²x 12 -- it's", "<|endoftext|> x", ""):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False))


def test_token_files(spark, ids_of):
    rows = awkward()
    folder = new_path(spark, "test-files")
    manifest = binary_output.write_token_files(table(spark, rows), folder, BYTES, shard_bytes=4_000)
    got = binary_output.read_token_files(manifest).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids_of(t)), crc(ids_of(t))) for i, t in rows)
    ordered = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in ordered]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False)) and ordered[0].start == 0
    some = binary_output.read_token_files(manifest, frozenset({7, 60})).collect()
    assert sorted(r.doc_id for r in some) == [7, 7, 60]
    assert binary_output.read_token_files(binary_output.write_token_files(table(spark, rows).filter("false"), folder, BYTES)).count() == 0


def test_damage_is_found(spark, tmp_path):
    writer = binary_output.ShardWriter(str(tmp_path), 3)
    writer.add(1, np.arange(500, dtype="<u4"))
    writer.add(2, np.arange(7, dtype="<u4"))
    path = writer.close()[0]
    assert binary_output.ShardReader(path).read(1).tolist() == list(range(7))
    import zstandard

    with open(path, "rb") as file:
        assert len(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()) == 4 * 507
    data = bytearray(open(path, "rb").read())
    data[30] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        binary_output.ShardReader(path).read(0)


# ---- 9: secrets


def base_by_hand(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


SECRET = "q8Zr3Tn7Lw2Kx9Vb4Ym6Hd1Gs5"


def test_secrets(spark):
    texts = [None, "", "x" * 100_000, 'é password = "abcdefghijkl"', "token=secret=abcdefghijkl Token: short", "API_KEY:'abcdefghijklmnop'", "AKIA" + "A" * 14 + " AKIA" + "B" * 13, "0123456789abcdef 0123456789abcde", f"key {SECRET} end", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "password: token: abcdefghijklmnop"]
    rows = list(enumerate(texts)) + [(8, f"key {SECRET} end"), (None, "token=abcdefghijklmnop")]
    got = secrets.secret_spans(table(spark, rows)).collect()
    kinds = lambda r: sorted((s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans if s.kind != "entropy")
    assert Counter((r.doc_id, str(kinds(r))) for r in got) == Counter((i, str(base_by_hand(t or ""))) for i, t in rows)
    entropy = {(r.doc_id, s.start, s.end) for r in got for s in r.spans if s.kind == "entropy"}
    assert entropy == {(8, 4, 4 + len(SECRET))}
    assert secrets.secret_spans(table(spark, rows).filter("false")).count() == 0
    assert not any(s.kind == "entropy" for r in secrets.secret_spans(table(spark, rows), allow=("q8.*",)).collect() for s in r.spans)


def test_entropy_by_increments():
    rng = random.Random(0)
    for _ in range(50):
        text = "".join(rng.choice("abcdefgh01234567") for _ in range(rng.randint(1, 80)))
        want = set()
        for k in range(len(text) - 19):
            counts = Counter(text[k : k + 20])
            if -sum(c / 20 * math.log2(c / 20) for c in counts.values()) >= 3.0 - 1e-9:
                want.update(range(k, k + 20))
        assert {x for a, b in secrets.entropy_spans(text, 3.0) for x in range(a, b)} == want


def test_allow_list():
    for plain in ("a_long_snake_case_identifier_name", "550e8400-e29b-41d4-a716-446655440000", "12345678901234567890123", "SomeVeryLongCamelCaseWordWithoutNumbers", "usr/lib/python3/dist/packages/numpy"):
        assert not [s for s in secrets.all_spans(plain) if s[1] == 3]


@pytest.mark.parametrize(("prefix", "letters", "n"), [
    ("key-", "abcdefghijklmnopqrstuvwxyz0123456789", 32), ("", "abcdefghijklmnopqrstuvwxyz0123456789", 40), ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    ("KEY_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), ("API-", "0123456789ABCDEF", 32), ("Api/", "0123456789ABCDEF", 32), ("id=", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 32),
])
def test_one_secret_of_each_class(prefix, letters, n):
    rng, found = random.Random(3), 0
    for _ in range(200):
        key = prefix + "".join(rng.choices(letters, k=n))
        covered = {x for s, _, e in secrets.all_spans(f"see {key} end") for x in range(s, e)}
        found += len(covered) >= 20
    assert found >= 196
    assert "3ax6xnjp29jd6fds4gc373sgvjxteol0" not in secrets.redacted("a key-3ax6xnjp29jd6fds4gc373sgvjxteol0 b")


def test_a_filler_silences_its_neighbourhood_only():
    rng = random.Random(4)
    blob = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=300))
    cut = blob[:150] + "xxxx" + blob[150:]
    covered = {x for s, k, e in secrets.all_spans(cut) if k == 3 for x in range(s, e)}
    assert covered >= set(range(20, 100)) | set(range(204, 290)) and not covered & set(range(112, 190))
    assert not secrets.all_spans("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")


def test_words_with_numbers_are_no_secrets():
    for plain in ("usr/lib/python3/dist-packages/numpy-2", "release_notes_for_version_12_of_2024", "API_RATE_LIMIT_WINDOW_V2_SECONDS_60", "550E8400-E29B-41D4-A716-446655440000", "/2024/05/17/some-long-title-of-a-page/"):
        assert not secrets.all_spans(plain)


def test_redaction_keeps_all_rows(spark):
    rows = [(1, None), (2, f"a {SECRET} b token=abcdefghijklmnop c"), (2, "clean")]
    out = secrets.redact_secrets(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    got = sorted((r.doc_id, str(r.text), r.n_chars) for r in out.collect())
    assert got == [(1, "None", None), (2, "a <entropy> b <assign> c", len("a <entropy> b <assign> c")), (2, "clean", 5)]


# ---- 10: decontamination


def hits_by_hand(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            window = w[k : k + n]
            for j in range(len(own) - len(window) + 1):
                if own[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(item if item is None else str(item))
    return len(own), len(hit), sorted(found - {None}) + [None] * (None in found)


@pytest.mark.parametrize("part_bytes", [10, 1 << 18])
def test_contamination(spark, part_bytes):
    rng = random.Random(8)
    item = words(rng, 25)
    items = [(1, " ".join(item)), (2, "short one!"), (3, None), (4, ""), (5, " ".join(item[5:20])), (5, "éa Öb"), (None, "without an id")]
    rows = [(1, None), (2, ""), (9, "one without an id, short one"), (3, "x, " + "! ".join(item[3:15]).upper()), (4, "A short...one; éa öb éa Öb"), (5, " ".join(item[:9])), (None, "short one"), (3, "short one short one"), (6, "y " * 60_000 + " ".join(item)), (7, "shortone short"), (8, "İé short one")]
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = decontaminate.contamination(table(spark, rows), benchmark, part_bytes=part_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, str(r["items"])) for r in got) == Counter((i, *hits_by_hand(t, items)[:2], str(hits_by_hand(t, items)[2])) for i, t in rows)
    third = next(r for r in got if r.doc_id == 3 and r.n_words > 5)
    text = rows[3][1]
    assert [text[s.start : s.end] for s in third.spans] == [text[3:]]
    clean = decontaminate.drop_contaminated(table(spark, rows), benchmark, part_bytes=part_bytes)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in got if not r.n_hit)
    assert decontaminate.contamination(table(spark, rows), benchmark.filter("false")).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(table(spark, rows).filter("false"), benchmark).count() == 0


@pytest.mark.parametrize("chunk_bytes", [1, 1 << 20])
def test_large_benchmarks_pass_part_by_part(monkeypatch, chunk_bytes):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk_bytes)
    rng = random.Random(12)
    pick = lambda n: " ".join(rng.choices("a b c dd é".split(), k=n))
    items = [(k, None if k == 3 else pick(n)) for k, n in enumerate((0, 1, 4, 9, 12, 60))]
    texts = [None, "", *(pick(n) for n in (1, 5, 12, 40, 80, 200))]
    batches = [pa.record_batch({"text": pa.array(texts[k : k + 3], pa.string())}) for k in range(0, len(texts), 3)]
    for part_bytes in (1, 10, 33, 1 << 18):
        found = [scan for _, scans in decontaminate.scan_batches(batches, 0, items, 10, part_bytes) for scan in scans]
        assert [(n, int(hit.sum()), sorted(ids)) for n, hit, ids in found] == [hits_by_hand(t, items) for t in texts]
    assert len(decontaminate.benchmark_parts(items, 10, 33)) > 3


def test_entropy_spans_in_texts_full_of_secrets():
    rng = random.Random(13)
    make = lambda letters, n: "".join(rng.choices(letters, k=n))
    text = " ".join(rng.choice(["token=", "", "AKIA"]) + make("abcdef0123456789", 24) + make("GhIjKlMnOp0123456789", rng.choice([0, 30])) for _ in range(400))
    base = secrets.base_spans(text)
    expected = set(base)
    for m in secrets.CANDIDATE.finditer(text):
        kind = secrets.char_class(m.group())
        if kind and not any(p.fullmatch(m.group()) for p in secrets.ALLOW):
            for start, end in secrets.entropy_spans(m.group(), secrets.THRESHOLDS[kind]):
                if not any(s <= start + m.start() and end + m.start() <= e for s, _, e in base):
                    expected.add((start + m.start(), 3, end + m.start()))
    assert secrets.all_spans(text) == sorted(expected) and any(k == 3 for _, k, _ in expected)
