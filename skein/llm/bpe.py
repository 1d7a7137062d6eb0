"""Byte-level BPE encoding and decoding.

The distinct words of a corpus are encoded once. A Spark higher-order function
folds ranked merges over the bytes of a word: each step finds the least rank
among the adjacent pairs of pieces and merges the leftmost pair that has it, until
no pair has a rank. The rank map is a literal in the plan, keyed by
pairs of pieces: a sparse matrix whose rows are laid over each other, so that
three array accesses look up a rank.

1. Texts are split by the vocabulary's pattern, in one vectorised pass over the
   classes of their characters. Words that are no pieces themselves are counted,
   the most frequent ``dictionary_words`` are folded and written to the shared
   folder as sorted digest arrays with their ids (see ``digests``): the dictionary.
2. Each document's words are looked up, a few documents at a time: the distinct ones
   among the pieces, and those that are none in the dictionary, which workers
   map into memory. Words outside, rare by construction, are folded in place
   by the same expression. No word's position is ever shuffled.

Words of more than LONG bytes (a text of one long run of letters, say) would
need quadratic time in the fold; they are merged with a heap, to the same result.

Decoding gathers the pieces of the ids from a literal array and concatenates them, in the JVM.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common, digests

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG = 256
#: The dictionary's size; the words beyond it are folded where they occur.
DICTIONARY_WORDS = 1_000_000
_ID, _POS = 17, 9  # bits of a piece's id, and of its place in the word
_NONE = 1 << _ID  # above all ranks


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece, from a file of lines of a base64 piece and its rank; path may be a URI."""
    fs, p = common.open_fs(path if "://" in path else "file://" + os.path.abspath(path))
    with fs.open_input_stream(p) as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line.strip())}


_spread: dict[tuple[str, str], str] = {}


def _spread_vocabulary(spark: SparkSession, path: str) -> str:
    """The URI of a copy of the vocabulary's file in the shared folder, as executors may lack the file itself."""
    key = (common.shared_dir(spark), path)
    if key not in _spread:
        uri = common.new_path(spark, "vocabulary")
        fs, p = common.open_fs(uri)
        fs.create_dir(os.path.dirname(p), recursive=True)
        src, q = common.open_fs(path if "://" in path else "file://" + os.path.abspath(path))
        with src.open_input_stream(q) as f, fs.open_output_stream(p) as g:
            g.write(f.read())
        _spread[key] = uri
    return _spread[key]


def _last_pair(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two pieces whose merge gives a piece, the only ones that can ever stand side by side and give it. None if no merge does."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        r, i = min((ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
        if r == _NONE:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(4)
def _pair_table(path: str) -> tuple[list[int], list[int], list[int]]:
    """(offset, left, rank): the pair (a, b) has a rank if left[offset[a] + b] is a, and it is rank[offset[a] + b]."""
    ranks = read_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for p, r in ranks.items():
        if (pair := _last_pair(p, ranks)) is not None:
            rows.setdefault(ranks[pair[0]], []).append((ranks[pair[1]], r))
    n, entries = max(ranks.values()) + 1, sum(map(len, rows.values()))
    size = n + entries * 2
    free, rng = np.ones(size, dtype=bool), np.random.default_rng(1)
    offset, left, rank = [-n] * n, np.full(size, -1), np.zeros(size, dtype=np.int64)
    for a in sorted(rows, key=lambda a: -len(rows[a])):
        bs = np.array([b for b, _ in rows[a]])
        while True:  # until all columns of the row fall on free slots
            starts = rng.integers(-bs.min(), size - bs.max(), 32)
            good = np.flatnonzero(free[starts[:, None] + bs].all(axis=1))
            if len(good):
                break
        d = int(starts[good[0]])
        offset[a] = d
        free[d + bs] = False
        left[d + bs] = a
        rank[d + bs] = [r for _, r in rows[a]]
    return offset, left.tolist(), rank.tolist()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


class Merger:
    """The fold as an expression of Spark.

    The state is an array of longs, one a piece: the rank of the pair that it forms with
    the next piece, the place of its first byte, and its id, from the highest bits to the
    lowest. So the least element is the leftmost pair of the least rank.
    """

    def __init__(self, path: str):
        ranks = read_ranks(path)
        if max(ranks.values()) >= _NONE:
            raise ValueError(f"ranks must be below {_NONE}")
        offset, left, rank = _pair_table(path)
        literal = lambda x: F.from_json(F.lit(json.dumps(x)), "array<int>")  # noqa: E731  (folded to a literal)
        self.offset, self.left, self.ranks = literal(offset), literal(left), literal(rank)
        self.bytes = literal([ranks[bytes([i])] for i in range(256)])

    def fold(self, word: Column) -> Column:
        """Ids (array of int) of a word (binary) of 1 to LONG bytes. The literals stand in the plan once."""
        return _let(self.offset, lambda o: _let(self.left, lambda l: _let(self.ranks, lambda r: self._fold(word, o, l, r))))

    def _fold(self, word: Column, offset: Column, left: Column, ranks: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            """The rank (long) of a pair of ids (int); _NONE if it has none or one of them is null."""
            slot = F.get(offset, a) + b
            return F.when(F.get(left, slot) == a, F.get(ranks, slot).cast("long")).otherwise(F.lit(_NONE).cast("long"))

        low = lambda x: x.bitwiseAND(F.lit(_NONE - 1)).cast("int")
        kept = lambda x: x.bitwiseAND(F.lit((1 << (_ID + _POS)) - 1))  # noqa: E731  (place and id)
        ranked = lambda r, rest: F.shiftleft(r, _ID + _POS).bitwiseOR(rest)
        codes = _let(F.decode(word, "ISO-8859-1"), lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.get(self.bytes, F.ascii(F.substring(s, i, F.lit(1))))))
        start = _let(codes, lambda p: F.transform(p, lambda x, i: ranked(rank(x, F.get(p, i + 1)), F.shiftleft(i.cast("long"), _ID).bitwiseOR(x.cast("long")))))

        def merged(e: Column, least: Column) -> Column:
            new = F.shiftright(least, _ID + _POS)  # the rank of a pair is the id of its piece
            place = kept(least).bitwiseAND(F.lit(-_NONE))
            rest = F.filter(e, lambda x, j: F.coalesce(F.get(e, j - 1) != least, F.lit(True)))

            def moved(x: Column, after: Column) -> Column:
                return (
                    F.when(x == least, ranked(rank(new.cast("int"), low(after)), place.bitwiseOR(new)))
                    .when(after == least, ranked(rank(low(x), new.cast("int")), kept(x)))
                    .otherwise(x)
                )

            return _let(rest, lambda p: F.transform(p, lambda x, j: moved(x, F.get(p, j + 1))))

        def step(e: Column, _: Column) -> Column:
            return _let(F.array_min(e), lambda least: F.when(least >= F.lit(_NONE << (_ID + _POS)), e).otherwise(merged(e, least)))

        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step, lambda e: F.transform(e, low))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word; the same merges as the fold, with a heap of pairs."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev, nxt, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = []

    def push(i: int) -> None:
        j = nxt[i] if i >= 0 else n
        if i >= 0 and j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        r, i, e = heapq.heappop(heap)
        j = nxt[i] if live[i] else n
        if j >= n or end[j] != e:
            continue
        live[j], end[i], nxt[i] = False, e, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        push(i)
        push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


_OTHER, _LETTER, _NUMBER, _BLANK = range(4)
_CHUNK = 2 << 20


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = _LETTER
        elif c == "N":
            out[i] = _NUMBER
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    return out


def _starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where words start in UTF-8 bytes, given where texts start.

    Words are what the pattern ``'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` matches one after the other.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int32)
    for size, mask, low in ((2, 0x1F, 0xC0), (3, 0x0F, 0xE0), (4, 0x07, 0xF0)):
        many = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0xF8)[size - 2]))
        if len(many):
            v = (lead[many] & mask).astype(np.int32)
            for k in range(1, size):
                v = (v << 6) | (data[at[many] + k] & 0x3F)
            cp[many] = v
    cls = _classes()[cp]
    n = len(at)
    first = np.zeros(n + 1, dtype=bool)  # of a text
    first[np.searchsorted(at, docs)] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    spaced = np.zeros(n, dtype=bool)  # the character before is a blank that the word takes
    spaced[1:] = (cp[:-1] == 32) & ~first[1:n]
    blank = cls == _BLANK
    start = run[:n] & (blank | ~spaced)
    last = np.flatnonzero(blank & run[1:] & ~first[1:])  # of white space before something else
    start[last] = True
    quote = np.flatnonzero((cp == 39) & run[:n] & ~spaced)
    if len(quote):
        end = np.append(cp, [0, 0, 0])
        within = lambda k: ~first[np.minimum(quote + k, n)]
        a, b = end[quote + 1], end[quote + 2]
        one = np.isin(a, [115, 116, 109, 100]) & within(1)
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & within(1) & within(2)
        start[quote[one | two] + 1] = False
        for hit, k in ((quote[one], 2), (quote[two], 3)):
            more = hit + k
            start[more[(more < n)]] = True
    return at[start]


def split_words(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts, one after the other, and each text's offset among them. A null is an empty text."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(t, pa.ChunkedArray):
        t = pa.concat_arrays(t.chunks) if t.num_chunks else pa.array([], pa.large_string())
    off = np.frombuffer(t.buffers()[1], dtype=np.int64, count=len(t) + 1 + t.offset)[t.offset :] if len(t) else np.zeros(1, np.int64)
    size = int(off[-1] - off[0])
    data = np.frombuffer(t.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if size else np.zeros(0, np.uint8)
    off = off - off[0]
    parts, i = [], 0
    while i < len(t):  # some texts at a time, so that memory stays small
        j = max(i + 1, int(np.searchsorted(off, off[i] + _CHUNK)))
        j = min(j, len(t))
        if off[j] > off[i]:
            own = off[i:j][np.diff(off[i : j + 1]) > 0] - off[i]
            parts.append(_starts(data[off[i] : off[j]], own) + off[i])
        i = j
    ends = np.concatenate([*parts, [size]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.searchsorted(ends[:-1], off)


@lru_cache(4)
def _whole(path: str) -> pa.LargeStringArray:
    """The pieces that are UTF-8."""

    def text(p: bytes) -> str | None:
        try:
            return p.decode()
        except UnicodeDecodeError:
            return None

    return pa.array([t for p in read_ranks(path) if (t := text(p)) is not None], pa.large_string())


def _ids_of(words: pa.LargeStringArray, ranks: dict[bytes, int], shards: list[digests.Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: whether the ids of each are known, how many it has, and all of them, one word's after the other's."""
    text = words.cast(pa.large_binary()).to_pylist()
    n, parts = np.ones(len(text), dtype=np.int64), []
    piece = np.array([ranks.get(w, -1) for w in text], dtype=np.int64)
    other = np.flatnonzero(piece < 0)
    keys = np.array([xxhash.xxh64_intdigest(text[i], 42) for i in other], dtype=np.uint64).view(np.int64)  # as Spark's xxhash64
    where, place = digests.probe(keys, words.take(pa.array(other)), shards)
    n[other], stored = digests.values(where, place, shards)
    lost = other[where < 0]
    for i in lost.tolist():
        if len(text[i]) > LONG:
            parts.append(np.array(merge_long(text[i], ranks), dtype=np.int32))
            n[i] = len(parts[-1])
    start = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.int32)
    out[start[piece >= 0]] = piece[piece >= 0]
    found, long = other[where >= 0], lost[n[lost] > 0]
    out[digests.spread(start[found], n[found])] = stored
    out[digests.spread(start[long], n[long])] = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return n > 0, n, out


def _look_up(col: pa.Array, ranks: dict[bytes, int], shards: list[digests.Shard]) -> tuple[pa.ListArray, pa.ListArray]:
    """Of each text: the ids between the words that pieces and dictionary lack, and these words."""
    flat, off = split_words(col)
    d = flat.dictionary_encode()
    which = d.indices.to_numpy()
    known, n, ids = _ids_of(d.dictionary, ranks, shards)
    first = np.cumsum(n) - n
    length = n[which]
    values = pa.array(ids[digests.spread(first[which], length)], pa.int32())
    ends = np.concatenate(([0], np.cumsum(length)))
    lost = np.flatnonzero(~known[which])
    # a document's segments end at its lost words and at its end
    n_docs = len(off) - 1
    before = np.searchsorted(lost, off)  # lost words before each document
    seg_end = np.sort(np.concatenate((ends[lost], ends[off[1:]])), kind="stable") if n_docs else np.zeros(0, np.int64)
    segs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], seg_end)).astype(np.int32)), values)
    outer = pa.array((before + np.arange(n_docs + 1)).astype(np.int32))
    miss = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), flat.take(pa.array(lost)).cast(pa.large_binary()).cast(pa.binary()))
    return pa.ListArray.from_arrays(outer, segs), miss


def _lookup(shards: list[digests.Shard], vocabulary: str):
    """Batches whose last column is the text, with columns segs and miss in addition. A few texts are held as words at a time."""

    def run(batches):
        ranks = read_ranks(vocabulary)
        for b in batches:
            for i, j in common.ranges(common.lengths(b.column(b.num_columns - 1)), _CHUNK):
                part = b.slice(i, j - i)
                segs, miss = _look_up(part.column(b.num_columns - 1), ranks, shards)
                yield pa.RecordBatch.from_arrays([*part.columns, segs, miss], [*b.schema.names, "segs", "miss"])
                del part, segs, miss
                pa.default_memory_pool().release_unused()

    return run


def _count_words(vocabulary: str):
    def run(batches):
        pieces = _whole(vocabulary)
        for part in (p for b in batches for p in common.slices(b.column(0), _CHUNK)):
            words, _ = split_words(part)
            if not len(words):
                continue
            d = words.dictionary_encode()
            n = np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary))
            own = pc.and_(pc.invert(pc.is_in(d.dictionary, value_set=pieces)), pc.less_equal(pc.binary_length(d.dictionary), LONG))
            yield pa.RecordBatch.from_arrays([d.dictionary.filter(own).cast(pa.string()), pa.array(n).filter(own)], ["w", "n"])
            del words, d, n, own
            pa.default_memory_pool().release_unused()

    return run


def build_dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = DICTIONARY_WORDS) -> list[digests.Shard]:
    """Writes the ids of the words that occur most often in docs and are no pieces, and gives the shards of the dictionary.

    Words are taken by whole counts, from the highest down, as long as
    they are no more than ``size``, which bounds what a machine maps; ids are the same at any size.
    """
    spark = docs.sparkSession
    words = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_count_words(_spread_vocabulary(spark, vocabulary)), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts, counts_path = common.write_table(words, "words")
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    ahead = F.sum("words").over(Window.orderBy(F.desc("n")))
    row = by_count.withColumn("ahead", ahead).filter(F.col("ahead") <= size).agg(F.min("n"), F.max("ahead")).first()
    least, total = (row[0], row[1]) if row[0] is not None else (1 << 62, 0)
    hot = counts.filter(F.col("n") >= least).select("w")
    parts = max(spark.sparkContext.defaultParallelism, total // 50_000 + 1)
    folded = hot.repartition(parts).select(F.xxhash64("w").alias("key"), F.col("w").alias("s"), Merger(vocabulary).fold(F.col("w").cast("binary")).alias("values"))
    folded, folded_path = common.write_table(folded, "folded")
    shards = digests.write(folded, "dictionary", max(1, -(-total // digests.SHARD_ROWS)))
    common.remove(spark, counts_path, folded_path)
    return shards


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, dictionary_words: int = DICTIONARY_WORDS, keep_text: bool = False, shards: list[digests.Shard] | None = None) -> DataFrame:
    """(doc_id, n_tokens, token_ids) for each row of docs.

    A null or empty text has no tokens, a text of any length is encoded whole. Rows with null or repeated doc_id have
    rows of their own; an empty table gives an empty result. Special tokens'
    strings are ordinary text. keep_text adds the text; other columns of docs
    aren't read. shards is a dictionary that is there already.
    """
    if shards is None:
        shards = build_dictionary(docs, vocabulary, dictionary_words)
        common.release(docs.sparkSession)  # of the words' shuffle
    merger = Merger(vocabulary)
    x = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    schema = T.StructType([*x.schema.fields, T.StructField("segs", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("miss", T.ArrayType(T.BinaryType()))])
    x = x.mapInArrow(_lookup(shards, _spread_vocabulary(docs.sparkSession, vocabulary)), schema)
    filled = F.transform("miss", lambda w, i: F.concat(F.get("segs", i), merger.fold(w)))
    ids = F.when(F.size("miss") == 0, F.get("segs", F.lit(0))).otherwise(F.concat(F.flatten(filled), F.get("segs", F.size("miss"))))
    x = x.select("doc_id", *(["text"] if keep_text else []), ids.alias("token_ids"))
    return x.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", *(["text"] if keep_text else []))


def decoded(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes (binary) of an array of ids: their pieces one after the other. Null for null ids; an id that the vocabulary lacks is an error.

    The pieces are a literal of the plan, their bytes as the characters of those codes.
    """
    by_id = {r: p.decode("latin-1") for p, r in read_ranks(vocabulary).items()}
    pieces = F.from_json(F.lit(json.dumps([by_id.get(i) for i in range(max(by_id) + 1)])), "array<string>")  # folded to a literal
    whole = lambda p: F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(p, i), F.raise_error(F.concat(F.lit("no piece has the id "), i.cast("string"))).cast("string"))), "")
    return F.encode(_let(pieces, whole), "ISO-8859-1")


def decode(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """df(doc_id, token_ids) with the texts of the ids: (doc_id, text). Bytes that aren't UTF-8 become U+FFFD.

    Null ids have a null text, none an empty one. Rows with null or repeated doc_id have rows of their own, an empty
    table gives an empty result, other columns aren't read. An id that the vocabulary lacks is an error.
    """
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(decoded(F.col("token_ids"), vocabulary).cast("string")).alias("text"))


def encode_checked(docs: DataFrame, vocabulary: str = VOCABULARY, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """encode's columns and round_trip: whether decoding the ids gives the text (a null counts as empty)."""
    x = encode(docs, vocabulary, dictionary_words, keep_text=True)
    same = decoded(F.col("token_ids"), vocabulary) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "token_ids", same.alias("round_trip"))
