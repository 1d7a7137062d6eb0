"""Chat formatting, licences, BPE, quality rules and token counts at small scale."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from skein.llm import bpe, chat, common, licenses, quality, token_counts

ODD = [None, "", " ", "\n\n  x", "don't 're 'r ''s 's's", "é漢字\U0001f600 𝟘Ǆ", "x" * 3000, "ab" * 5000 + " end", "<|endoftext|>", "a  b　c", "  lead\ttail  "]


def encoder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def test_split_like_the_pattern():
    rnd, pattern = random.Random(5), regex.compile(P.PATTERN)
    texts = ODD + ["".join(rnd.choice("ab's tredlvm  \n\t'!?.12é漢𝟘_-") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    words, off = bpe.split_words(pa.array(texts, pa.string()))
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(off[:-1], off[1:])] == [pattern.findall(t or "") for t in texts]


@pytest.mark.parametrize("dictionary_words", [1_000_000, 3, 0])
def test_bpe_is_exact(spark, dictionary_words):
    rnd = random.Random(1)
    texts = ODD + [" ".join("".join(rnd.choice("abcdeéñthing") for _ in range(rnd.randrange(1, 14))) for _ in range(9)) for _ in range(60)]
    df = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "y")], "doc_id long, text string, token_ids string").repartition(3)
    rows = bpe.encode_checked(df, dictionary_words=dictionary_words).collect()
    enc = encoder()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert sorted(list(r.token_ids) for r in rows) == sorted(enc.encode_ordinary(t or "") for t in [*texts, "null id"])
    assert bpe.encode(df.limit(0)).isEmpty()


def test_decode(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, []), (3, None), (4, [220])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df).collect()} == {1: '!"', 2: "", 3: None, 4: " "}


def test_merges_of_long_words():
    ranks, enc = bpe.read_ranks(bpe.VOCABULARY), encoder()
    for w in (b"a" * 700, b"abcab" * 101, "é漢".encode() * 90):
        assert bpe.merge_long(w, ranks) == enc._core_bpe.encode_single_piece(w)


def test_flat_files_of_a_part_are_deleted_before_the_next(spark, monkeypatch):
    import os

    left, write = [], token_counts.write_files

    def files(*args):
        root = common.shared_dir(spark).removeprefix("file://")
        before = {d for d in os.listdir(root) if d.startswith("tokens-")} if os.path.isdir(root) else set()
        left.append(before)
        return write(*args)

    monkeypatch.setattr(token_counts, "write_files", files)
    rows = [(i, "word " * i) for i in range(40)] + [(None, "one"), (None, None), (7, "word " * 7)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_counts.document_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and len(got) == len(rows)
    assert len(left) > 1 and all(x == left[0] for x in left)


def test_token_files(spark):
    eod, rnd = 9, random.Random(2)
    docs = [[rnd.randrange(9) for _ in range(rnd.choice([0, 0, 1, 3, 50, 400]))] for _ in range(120)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(None, None)], "doc_id long, token_ids array<int>").repartition(3)
    files, members = token_counts.write_files(df, eod)
    for block in (2, 64, 1 << 20):
        got = members.join(token_counts.count_tokens(files, eod, block_bytes=block), ["path", "ordinal"])
        rows = got.collect()
        assert len(rows) == 121 and all(r.closed for r in rows)
        assert {r.doc_id: r.n_tokens for r in rows} == {i: len(d) for i, d in enumerate(docs)} | {None: 0}
    assert token_counts.document_counts(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    with pytest.raises(Exception):
        token_counts.write_files(spark.createDataFrame([(1, [eod])], "doc_id long, token_ids array<int>"), eod)[0].collect()


def test_document_counts_against_an_encoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("clash").alias("n_tokens"), F.lit(1).alias("path"))
    extra = spark.createDataFrame([(None, None, "x", 1), (7, "", "x", 1), (7, "again and again", "x", 1), (7, "again and again", "x", 1), (8, "long words " * 30_000, "x", 1)], docs.schema)
    whole = docs.union(extra).repartition(3)
    enc = encoder()
    want = sorted((r.doc_id or -1, len(enc.encode_ordinary(r.text or ""))) for r in whole.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.document_counts(whole, block_bytes=1 << 16).collect()) == want


def test_open_end_and_empty_file(spark):
    uri = common.new_path(spark, "open")
    fs, path = common.open_fs(uri)
    fs.create_dir(path, recursive=True)
    for name, ids in (("a", [1, 9, 9, 2, 2]), ("b", []), ("c", [5] * 7)):
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(np.array(ids, "<u2").tobytes())
    files = token_counts.with_sizes(spark.createDataFrame([(f"{uri}/{n}",) for n in "abca"], "path string"))
    got = {(r.path[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in token_counts.count_tokens(files, 9, block_bytes=4).collect()}
    assert got == {("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 2, False), ("c", 0, 0, 7, False)}


def test_chat(spark):
    rows = [(1, 2, "bob", "hi <|im_end|>"), (1, 1, "ann", None), (1, 1, "system", "be"), (2, 1, "system", "alone"), (None, 1, "ann", "x"), (3, None, "", "t"), (3, None, "", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit("clash"))
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "bob"), (1, "ann"), (3, "unknown")}
    r = got[1, "bob"]
    assert r.rendered == "<|im_start|>user name=ann\n<|im_end|>\n<|im_start|>system\nbe<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
    a, b = map(int, r.spans.split("-"))
    assert (r.mask, r.rendered[a:b]) == ("001", "hi < |im_end|><|im_end|>")
    long = chat.rotate(spark.createDataFrame([(1, 1, "ann", "word " * 100_000), (1, 2, "bob", "x")], "conv_id long, turn long, role string, text string")).filter("perspective = 'ann'").first()
    assert long.mask == "10" and len(long.rendered) > 500_000
    assert got[3, "unknown"].mask == "11" and chat.rotate(df.limit(0)).isEmpty()


def test_license_expressions():
    ok, ex = frozenset(licenses.ALLOWED), frozenset(licenses.EXCEPTIONS)
    value = lambda x: licenses.allows(licenses.to_postfix(x), ok, ex)
    assert value("MIT OR GPL-3.0-only") and not value("MIT AND GPL-3.0-only") and value("(GPL-2.0-only with Classpath-exception-2.0) and mit")
    assert value("GPL-3.0-only AND GPL-2.0-only OR MIT") and not value("GPL-3.0-only AND (GPL-2.0-only OR MIT)")
    for bad in ("", "MIT OR", "MIT Apache-2.0", "(MIT", "MIT)", "AND MIT", "()", "MIT ;"):
        with pytest.raises(ValueError):
            licenses.to_postfix(bad)


def test_license_scan(spark):
    rows = [(1, "x\n// SPDX-License-Identifier: MIT OR GPL-2.0-only\nrest"), (2, "All  Rights\nReserved."), (3, "Released under the MIT License; licensed under CC BY-NC 4.0"), (4, None), (5, "SPDX-License-Identifier: (MIT"), (6, "overall rights reservedly"), (None, "")]
    got = {r.doc_id: (r.n_notices, r.verdict) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("verdict", F.lit(1))).collect()}
    assert got == {1: (1, "allowed"), 2: (1, "denied"), 3: (2, "denied"), 4: (0, "none"), 5: (1, "invalid"), 6: (0, "none"), None: (0, "none")}


def test_license_scan_of_nested_phrases_and_comment_ends():
    table, ok, ex = tuple(licenses.PHRASES.items()), frozenset(licenses.ALLOWED), frozenset(licenses.EXCEPTIONS)
    scan = lambda t: licenses.scan(t, table, ok, ex)
    assert scan("Unreleased under the MIT License") == (["MIT"], "allowed") and scan("xreleased under the mit license") == (["MIT"], "allowed")
    assert scan("apache\u00a0license, version 2.0") == scan("apache\u00a0license,\tversion 2.0\n") == (["Apache-2.0"], "allowed")
    assert scan("/* SPDX-License-Identifier: MIT */ int x; // y") == (["mit"], "allowed")
    assert scan("<!-- SPDX-License-Identifier: GPL-3.0-only --> <p>") == (["gpl-3.0-only"], "denied")
    assert scan("x" * 300_000 + " all rights\n reserved " + "y " * 100_000) == (["LicenseRef-Proprietary"], "denied")


def test_license_expressions_against_their_trees():
    ok, ex, rnd = frozenset(licenses.ALLOWED), frozenset(licenses.EXCEPTIONS), random.Random(4)
    leaves = [("MIT", True), ("GPL-3.0-only", False), ("apache-2.0", True), ("GPL-2.0-only WITH Classpath-exception-2.0", True), ("GPL-2.0+", False), ("bsd-3-clause", True), ("Foo-1.0", False)]

    def tree(depth):  # text, value, how closely its last operator binds
        if depth == 0 or rnd.random() < 0.2:
            return (*rnd.choice(leaves), 3)
        (a, x, p), (b, y, q), op = tree(depth - 1), tree(depth - 1), rnd.choice(["and", "or"])
        mine = 2 if op == "and" else 1
        wrap = lambda t, k: f"({t})" if k < mine or rnd.random() < 0.2 else t
        word = rnd.choice([op, op.upper(), op.title()])
        return f"{wrap(a, p)} {word} {wrap(b, q)}", (x and y) if op == "and" else (x or y), mine

    for _ in range(2000):
        text, value, _ = tree(4)
        assert licenses.allows(licenses.to_postfix(text), ok, ex) == value, text


def brute_scan(text):
    flat = " ".join((text or "").lower().split())
    out = set()
    for p, name in licenses.PHRASES.items():
        at = flat.find(p)
        while at >= 0:
            if not flat[at - 1 : at].isalnum() and not flat[at + len(p) : at + len(p) + 1].isalnum():
                out.add(name)
            at = flat.find(p, at + 1)
    return out


def test_license_scan_against_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in licenses.licenses(docs).collect():
        names = set(r.notices.split("; ")) - {""}
        assert {n for n in names if n in licenses.PHRASES.values()} == brute_scan(texts[r.doc_id])


def test_quality(spark):
    good = "This is a plain text of some words that nobody would reject, with a number 12 in it."
    rows = [(1, good, "a"), (2, "", "a"), (3, None, None), (4, "### $$$ %%% ***", "b"), (5, "line\n" * 9, "b"), (5, good, "b"), (None, good, "b"), (6, "x" * 5000, "c"), (7, " \n ", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(3)).withColumn("rate", F.lit("clash"))
    got = [(r.doc_id, r.hard, r.rejected) for r in quality.quality_verdicts(df).collect()]
    assert (1, "", False) in got and (2, "no_words", True) in got and (3, "no_words", True) in got and (4, "symbols", True) in got and (5, "lines,repeats", True) in got and (5, "", False) in got and (None, "", False) in got
    kept = quality.drop_rejected(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 5]
    clash = df.withColumns({c: F.lit("kept") for c in ("__h", "__f", "__host", "__verdict", "hard", "f")})
    kept = quality.drop_rejected(clash)
    assert kept.columns == clash.columns and {(r["__h"], r["__f"], r["__host"], r["hard"]) for r in kept.collect()} == {("kept",) * 4}
    ties = spark.createDataFrame([(i, good if i % 2 else "### $$$ %%%", f"host{i // 4}") for i in range(16)], "doc_id long, text string, source string")
    assert {(r.host, r.rate, r.verdict) for r in quality.quality_verdicts(ties).collect()} == {(f"host{k}", 0.5, "normal") for k in range(4)}
    short = quality.quality_verdicts(spark.createDataFrame([(1, "spam spam spam spam spam", "a"), (2, "a b", "a"), (3, "one", "a")], "doc_id long, text string, source string"))
    assert {(r.doc_id, r.hard) for r in short.collect()} == {(1, "repeats"), (2, ""), (3, "")}
    assert quality.quality_verdicts(df.limit(0)).isEmpty() and quality.drop_rejected(df.limit(0)).isEmpty()
