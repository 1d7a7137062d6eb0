"""Near duplicates against brute force, and edge cases."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from skein.llm import near_dedup


def shingles(text, width=3):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute(docs, threshold=0.5):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    groups = {}
    for i, s in sets.items():
        if s:
            groups.setdefault(root(i), []).append(i)
    return {i: g for g, ids in groups.items() if len(ids) > 1 for i in ids}


def corpus(n=150, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, shared = [], " ".join(rnd.choice(vocab) for _ in range(30))
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 120))]
        docs.append((i, " ".join(words) + (" " + shared if i % 7 == 0 else "")))
        if i % 5 == 0:
            copy = list(words)
            for _ in range(rnd.randrange(0, max(1, len(words) // 12))):
                copy[rnd.randrange(len(copy))] = "zz"
            docs.append((1000 + i, " ".join(copy)))
    docs += [(5000 + i, "the same short text here") for i in range(40)]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = brute(docs)
    assert len(got.keys() & want.keys()) >= 0.98 * len(want) and set(got) <= set(want)
    assert sum(got[i] == want[i] for i in got if i in want) >= 0.98 * len(want)


def test_edges(spark):
    rows = [(1, "a b c d", "x"), (2, "A  b\tc d", "y"), (3, None, "z"), (4, "", "z"), (5, None, "z"), (None, "a b c d", "n"), (6, "one", "q"), (7, "one", "q"), (8, "long " * 20000, "v"), (8, "long " * 20000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id string")
    got = {(r.doc_id, r.group_id) for r in near_dedup.near_groups(df).collect()}
    assert got == {(1, 1), (2, 1), (6, 6), (7, 6)}
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 8), (True, 0)]
    assert near_dedup.near_groups(df.limit(0)).isEmpty() and near_dedup.drop_near_copies(df.limit(0)).isEmpty()


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"}
    rows = [(1, text["a"]), (2, text["a"] + " more"), (2, text["b"]), (3, text["b"]), (4, text["c"]), (4, text["d"]), (4, text["d"]), (5, text["d"] + " more"), (6, text["e"]), (7, text["f"]), (7, text["f"] + " more"), (8, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.group_id) for r in near_dedup.near_groups(df).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (5, 4), (7, 7)]
    kept = Counter((r.doc_id, (r.text or "")[:1]) for r in near_dedup.drop_near_copies(df).collect())
    assert kept == Counter([(1, "a"), (2, "b"), (4, "c"), (4, "d"), (6, "e"), (7, "f"), (8, ""), (8, "")])


def test_a_passage_in_very_many_documents(spark):
    rnd = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"u{i}x{k}" for k in range(90 if i % 3 else 40)) + " " + passage) for i in range(300)]
    docs += [(5000 + i, d.replace(" p7 ", " other ")) for i, (_, d) in enumerate(rnd.sample(docs, 20))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(df).collect()}
    want = brute(docs)
    assert set(got) <= set(want) and sum(got.get(i) == g for i, g in want.items()) >= 0.98 * len(want)


def test_strangers_that_share_phrases_cost_no_verification(spark, monkeypatch):
    rnd = random.Random(4)
    phrases = [" ".join(f"p{i}x{k}" for k in range(5)) for i in range(60)]
    docs = []
    for i in range(200):
        parts = [f"u{i}x{k}" for k in range(30)] + rnd.sample(phrases, 12)
        rnd.shuffle(parts)
        docs.append((i, " ".join(parts)))
    docs += [(1000 + i, docs[i][1] + " more") for i in range(0, 200, 20)]
    verified, write = [], near_dedup.common.write_table

    def counted(df, name):
        out = write(df, name)
        if "both" in df.columns:
            verified.append(out[0].count())
        return out

    monkeypatch.setattr(near_dedup.common, "write_table", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(df).collect()}
    assert got == brute(docs)
    assert 10 <= sum(verified) <= 30  # the ten pairs, and few more


def test_lists_in_many_blocks(spark, monkeypatch):
    for name, value in (("SHORT", 100), ("BLOCK", 16), ("ROWS", 64)):
        monkeypatch.setattr(near_dedup, name, value, raising=False)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"u{i}x{k}" for k in range(30 if i % 3 else 75)) + " " + passage) for i in range(150)] + [(900 + i, " ".join(f"q{k}" for k in range(40)) + f" v{i} w{i} x{i} y{i}") for i in range(60)]
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    want = brute(docs)
    assert set(got) <= set(want) and sum(got.get(i) == g for i, g in want.items()) >= 0.98 * len(want)


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 20))) for _ in range(80)]
    group, c = rng.integers(0, 4, 80), rng.integers(0, 30, 80)
    want = {(i, j): n for i, j in combinations(range(80), 2) if group[i] == group[j] and c[i] != c[j] and (n := len(np.intersect1d(sets[i], sets[j])))}
    off = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    for at_once in (50, 1 << 20):
        monkeypatch.setattr(near_dedup, "COUNTED", at_once)
        assert {(i, j): n for i, j, n in zip(*(x.tolist() for x in near_dedup._shared_counts(group, off, np.concatenate(sets), c)))} == want


def test_order_of_rows_and_clashing_columns(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, words("t")), (2, words("o")), (2, words("t") + " more"), (3, words("o") + " x")]
    for order in ((3, 2, 1, 0), (2, 0, 3, 1)):
        df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("__gone", "__digest", "__again", "__r", "key", "c", "node")}).coalesce(1)
        assert sorted((r.doc_id, r.group_id) for r in near_dedup.near_groups(df).collect()) == [(1, 1), (2, 1), (2, 2), (3, 2)]
        kept = near_dedup.drop_near_copies(df)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text[0], r["__r"], r["__gone"]) for r in kept.collect()) == [(1, "t", "kept", "kept"), (2, "o", "kept", "kept")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7)], "a long, b long")
    got = {r.node: r.c for r in near_dedup.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 55: 50, 60: 50}
