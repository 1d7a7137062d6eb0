"""Mixture, URL filter, nearest neighbours, sharding and the pipeline."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import common, digests, knn, mixing, queries, sharding, url_filter
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir) == ""


def test_hierarchy_moves_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("books", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 0.5, 1).collect()}
    assert got["a"] == 10 and sum(got.values()) in (1004, 1005) and abs(got["a"] + got["b"] - 1005 * 4 / 7) <= 2


def test_mix_edges(spark):
    rows = [(1, "a b c", "en", "src1"), (1, "a b c", "en", "src1"), (2, None, None, None), (3, "", "de", "src9"), (None, "x y", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", F.lit("clash")).withColumn("epochs", F.lit(0))
    assert mixing.mix(df).columns == df.columns
    assert {r.doc_id for r in mixing.mixture(df).collect()} <= {1, 2, 3, None}
    clash = df.withColumns({c: F.lit("kept") for c in ("__n", "__epoch", "__epochs", "__cut", "__domain", "__of_lang", "n")})
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and {(r["__n"], r["__epoch"], r["__cut"], r["n"]) for r in mixed.collect()} == {("kept",) * 4}
    assert mixing.mixture(df.limit(0)).isEmpty() and mixing.mix(df.limit(0)).isEmpty()


def test_url_filter_edges(spark):
    urls = [(1, "https://bad.com/x"), (2, "http://a.bad.com"), (3, "https://notbad.com/"), (4, None), (5, "no url"), (6, "https://s.com/p?q#f"), (None, "https://s.com/p"), (7, "https://s.com/p?q")]
    u = spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([("host:bad.com",), ("url:s.com/p?q",), (None,), ("host:bad.com",)], "rule string")
    got = {(r.page_id, r.rule) for r in url_filter.blocked(u, rules, shard_rules=1).collect()}
    assert got == {(1, "host:bad.com"), (2, "host:bad.com"), (3, None), (4, None), (5, None), (6, "url:s.com/p?q"), (None, None), (7, "url:s.com/p?q")}
    assert not url_filter.blocked(u, rules.limit(0)).filter("blocked").count() and url_filter.blocked(u.limit(0), rules).isEmpty()


def test_colliding_keys_are_confirmed(tmp_path):
    import pyarrow as pa

    data = [b"one", b"two"]
    np.array([7, 7], np.int64).tofile(tmp_path / "s.keys")
    np.array([0, 3, 6], np.int64).tofile(tmp_path / "s.offsets")
    (tmp_path / "s.strings").write_bytes(b"".join(data))
    hit = digests.probe(np.array([7, 7, 8], np.int64), pa.array(["two", "xxx", "one"]), [(f"file://{tmp_path}/s", 7, 7)])[0] >= 0
    assert hit.tolist() == [True, False, False]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 6)) * 4) / 4
    x[10:20] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [None] * 6), (None, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = knn.nearest(df, k=4, shard_rows=90, leaf=16).collect()
    want = {}
    for i in range(400):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 9)
        want[i] = [(float(a), int(j)) for a, j in sorted((d[j], j) for j in range(400) if j != i)[:4]]
    assert len(got) == 1600
    for r in got:
        d, j = want[r.vec_id][r.rank - 1]
        assert j == r.neighbour_id and math.isclose(math.sqrt(d), r.distance, abs_tol=1e-5)
    assert knn.nearest(df.limit(0)).isEmpty()


def test_nearest_of_a_query_set(spark, monkeypatch):
    monkeypatch.setattr(knn, "SLICE_SHARDS", 2)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (900, 5)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[3].tolist()), (-100, x[7].tolist())], "vec_id long, embedding array<double>").withColumn("home", F.lit("clash")).repartition(4)
    ids, y = np.append(np.arange(900), [300, -100]), np.vstack((x, x[3], x[7]))
    got = Counter((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in knn.nearest(df, k=6, queries=F.col("vec_id") % 100 == 0, shard_rows=120, leaf=16).collect())
    want = Counter()
    for q in np.flatnonzero(ids % 100 == 0):
        near = sorted((((y[j] - y[q]) ** 2).sum(), int(ids[j])) for j in range(len(y)) if j != q)[:6]
        want.update((int(ids[q]), k + 1, j, round(math.sqrt(d), 6)) for k, (d, j) in enumerate(near))
    assert got == want
    assert knn.nearest(df, k=6, queries=F.col("vec_id") > 10_000).isEmpty()


def test_close_ties_of_long_vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 64))
    x *= 1e6 / np.linalg.norm(x, axis=1)[:, None]
    x = np.repeat(x, 25, axis=0) + rng.integers(0, 2, (300, 64)) * 2.0**-12
    tree = knn.Tree(x, np.arange(300), 64)
    best = knn.Best(tree.x, 5)
    knn.search(tree, best, 0)
    for q, own, got in zip(tree.x, tree.ids, best.id):
        d = ((x - q) ** 2).sum(axis=1)
        assert got.tolist() == [j for _, j in sorted((d[j], j) for j in range(300) if j != own)[:5]]


def brute_shard(ids, edges, shards, slack, iterations, seed, key, half):
    """The same propagation, one document at a time."""
    order = sorted(ids, key=lambda i: (key[i], i))
    label = {i: r * shards // len(ids) for r, i in enumerate(order)}
    cap = math.ceil(len(ids) / shards * (1 + slack))
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    for it in range(iterations):
        wishes = {}
        for a, links in near.items():
            votes = Counter()
            for b, w in links:
                votes[label[b]] += w
            to = max(votes, key=lambda s: (votes[s], -s))
            gain = votes[to] - votes[label[a]]
            if gain > 0 and half[it, a]:
                wishes.setdefault((label[a], to), []).append((-gain, a))
        size, new = Counter(label.values()), dict(label)
        more = {p: len(w) - min(len(w), len(wishes.get(p[::-1], ()))) for p, w in wishes.items()}
        for p, w in wishes.items():
            asked = sum(n for q, n in more.items() if q[1] == p[1])
            extra = int(min(cap - size[p[1]], asked) * more[p] / asked) if asked else 0
            for _, a in sorted(w)[: len(w) - more[p] + extra]:
                new[a] = p[1]
        label = new
    return label


def test_sharding_against_brute_force(spark):
    rng = np.random.default_rng(4)
    ids = list(range(160))
    edges = sorted({(int(min(a, b)), int(max(a, b))) for g in range(16) for a, b in rng.integers(g * 10, g * 10 + 10, (25, 2)) if a != b})
    edges = [(a, b, 1 + (a + b) % 3) for a, b in edges]
    docs = spark.createDataFrame([(i, None) for i in ids] + [(None, "x"), (3, None)], "doc_id long, text string").withColumn("shard", F.lit("clash"))
    links = spark.createDataFrame(edges + [(5, 5, 9)], "a long, b long, w long")
    got = {r.doc_id: r.shard for r in sharding.shard(docs, links, 4, 0.1, 5, -1.0, 7).collect()}
    least = {i: min([i, *(b for a, b, _ in edges if a == i), *(a for a, b, _ in edges if b == i)]) for i in ids}
    key = {r.i: r.k for r in spark.createDataFrame([(i, least[i]) for i in ids], "i long, m long").select("i", F.xxhash64(F.lit(7), "m").alias("k")).collect()}
    rows = spark.range(160).crossJoin(spark.range(5).withColumnRenamed("id", "it")).select("id", "it", (F.pmod(F.xxhash64(F.lit(7), F.col("it").cast("int"), "id"), F.lit(2)) == 0).alias("h")).collect()
    assert got == brute_shard(ids, edges, 4, 0.1, 5, 7, key, {(r.it, r.id): r.h for r in rows})
    assert max(Counter(got.values()).values()) <= 44
    assert sharding.shard(docs.limit(0)).isEmpty()


def test_links_of_shared_lines(spark):
    line = "this line is shared by some of the documents"
    docs = spark.createDataFrame([(1, f"a\n{line}"), (2, f"{line}\n{line}"), (3, f"{line}\nb"), (4, "short\nlines"), (None, line), (5, None)], "doc_id long, text string")
    got = sharding.shared_line_links(docs).collect()
    assert len(got) == 2 and {i for r in got for i in (r.a, r.b)} == {1, 2, 3} and all(r.a < r.b for r in got)


def test_all_pairs_of_shared_lines_vote(spark):
    rng = np.random.default_rng(6)
    line = [f"line {k} is shared by some of the documents" for k in range(12)]
    held = {i: {int(k) for k in rng.integers(0, 12, 3)} | ({0} if i % 3 else set()) for i in range(120)}
    held |= {120: set(), 121: set()}
    rows = [(i, "\n".join([line[k] for k in ks] + ["short", f"a line that only document {i} holds"])) for i, ks in held.items()] + [(7, line[5]), (None, line[5]), (122, None)]
    held[7] |= {5}
    held[122] = set()
    edges = [(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and held[a] & held[b]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.shard for r in sharding.shard(docs, None, 4, 0.1, 5, -1.0, 7).collect()}
    least = {i: min([i, *(b for a, b, _ in edges if a == i), *(a for a, b, _ in edges if b == i)]) for i in held}
    key = {r.i: r.k for r in spark.createDataFrame(list(least.items()), "i long, m long").select("i", F.xxhash64(F.lit(7), "m").alias("k")).collect()}
    flips = spark.range(123).crossJoin(spark.range(5).withColumnRenamed("id", "it")).select("id", "it", (F.pmod(F.xxhash64(F.lit(7), F.col("it").cast("int"), "id"), F.lit(2)) == 0).alias("h")).collect()
    assert got == brute_shard(list(held), edges, 4, 0.1, 5, 7, key, {(r.it, r.id): r.h for r in flips})
    lines, path = sharding.shared_lines(docs)
    cut = sharding.line_cut(lines, spark.createDataFrame(list(got.items()), "doc_id long, shard int")).first()
    assert (cut.weight, cut.cut) == (sum(w for *_, w in edges), sum(w for a, b, w in edges if got[a] != got[b]))
    common.remove(spark, path)


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.write_table(stage(spark, docs, sf_dir), f"test-{name}")[0]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert docs.columns == ["doc_id", "n_tokens", "token_ids"] and docs.count() == before.count()


def test_pipeline_edges(spark, tmp_path):
    words = [f"{chr(97 + i % 20)}{chr(97 + i // 20)}le" for i in range(400)]
    long = " ".join(words[i % 397] + words[i // 397] for i in range(60_000))
    text = lambda k: " ".join(words[(k * 31 + i * 7) % 400] for i in range(60)) + f" document {k}"
    rows = [(1, text(1), "en", "src1", 9), (2, text(1), "en", "src1", 9), (3, text(3), None, None, None), (4, None, "en", "src1", 0), (5, "", "de", "src2", 0), (6, " \n ", "de", "src2", 3), (7, long, "fr", "src3", 1), (8, text(8), "en", "src1", 9), (8, text(9), "en", "src1", 9), (None, text(10), "es", "src4", 9), (11, "no no no no no", "en", "src1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("kept") for c in ("__h", "__n", "__gone", "__r", "__again", "domain", "token", "c")})
    for whole in (docs, docs.limit(0)):
        x = whole
        for name, stage in corpus_pipeline.STAGES:
            before, x = x, common.write_table(stage(spark, x, ""), f"edge-{name}")[0]
            if name == "quality":
                assert sorted(r.doc_id or 0 for r in x.collect()) == ([0, 1, 2, 3, 7, 8, 8] if whole is docs else [])
            if name == "near_dedup":
                assert sorted(r.doc_id or 0 for r in x.collect()) == ([0, 1, 3, 7, 8, 8] if whole is docs else [])
            if name != "bpe":
                assert x.columns == docs.columns and x.filter("__h <> 'kept' or __n <> 'kept' or __gone <> 'kept' or __r <> 'kept'").isEmpty()
        assert x.columns == ["doc_id", "n_tokens", "token_ids"] and x.count() == before.count()


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['skein.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert e.queries().keys() == e.oracle_sql().keys() and 'pipeline' not in e.queries()"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
