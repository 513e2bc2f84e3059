"""Packing token documents into fixed windows by non-negative least squares.

Each document is tokenised once, where it is read. Its full windows stand alone;
what is left, shorter than a window, enters a histogram of at most ``window - 1``
lengths. Shallow combinations of two or three lengths that fill a window exactly
are enumerated, non-negative least squares finds how often each is used, counts
are rounded down and the residual lengths are packed greedily, longest first. The
driver sees the histogram and the patterns only. A document finds its place from
the rank of its row among the rows of its length: counts by bucket give where
each bucket's ranks start, so no task orders more than a bucket.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Staged, text_or_empty

WINDOW = 1024
ROWS_A_BUCKET = 50_000
# Triples that are enumerated for each length; only the padding depends on it.
TRIPLES_A_LENGTH = 6
STEPS = 400
CACHED_WORDS = 300_000

# Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The vocabulary of a byte-level tokenizer file as bytes and ids, and its added tokens.

    Ids serve as ranks of merges, so a file whose merges aren't in the order of
    their ids is refused, as are a normaliser, another way of splitting and added
    tokens that take in the text around them.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    added = file.get("added_tokens") or []
    if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without normaliser and prefix space are supported")
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        raise ValueError("added tokens that take in the text around them are not supported")
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in pairs]
    if ids != sorted(ids):
        raise ValueError("the merges are not in the order of their ids")
    special = {t["content"]: t["id"] for t in added}
    # printable bytes stand for themselves, the others for the characters from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(chars[c] for c in token): i for token, i in vocabulary.items() if token not in special}, special


class Words(dict):
    """Ids of words, found when they are first asked for; at most CACHED_WORDS are kept."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        found = self.find(word)
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a file; a worker makes it once."""
    return Encoder(path)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, with a bounded cache of words.

    Added tokens of the file, such as the end of a text, are found in the text
    first, as the tokenizer does by default; what lies between is encoded by itself.
    """

    def __init__(self, path: str):
        import tiktoken

        vocabulary, added = byte_vocabulary(path)
        coder = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=vocabulary, special_tokens={})
        self.whole = lambda text: array("I", coder.encode_ordinary(text)).tobytes()
        self.words = Words(self.whole)
        # of added tokens at one place the longest counts
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.added_ids = {t: array("I", [i]).tobytes() for t, i in added.items()}

    def __call__(self, text: str) -> bytes:
        if self.added is None or not self.added.search(text):
            return self._ordinary(text)
        parts = self.added.split(text)  # text and added tokens by turns
        return b"".join(self.added_ids[p] if k % 2 else self._ordinary(p) for k, p in enumerate(parts))

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        lines = [line.split(" ") for line in text.split("\n")]
        if [w for line in lines for w in line] != text.split():
            return self.whole(text)  # other white space than single spaces and line feeds between words
        # a token never spans the space before a word or a line feed between words
        get = self.words.__getitem__
        return get("\n").join([get(line[0]) + b"".join([get(" " + w) for w in line[1:]]) for line in lines])


def _tokenised(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            tokens, crcs, rests = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                full = len(ids) // (4 * window)
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[4 * window * k : 4 * window * (k + 1)]) for k in range(full)])
                rests.append(zlib.crc32(ids[4 * window * full :]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.int64())], names=["doc_id", "tokens", "crcs", "rest_crc"])

    return run


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs of present lengths that fill the window, and a few triples for each length."""
    there = [n for n in range(1, window) if counts[n]]
    present = set(there)
    found = {(a, window - a) for a in there if a <= window - a and window - a in present}
    for a in there:
        left, taken = window - a, 0
        # partners near an even split of what is left first
        for b in sorted((b for b in there if b <= left - b and left - b in present), key=lambda b: (left - 2 * b, b)):
            found.add(tuple(sorted((a, b, left - b))))
            taken += 1
            if taken == TRIPLES_A_LENGTH:
                break
    return sorted(found)


def nnls(columns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """x >= 0 that makes the columns' lengths, repeated x times, nearest to the histogram (accelerated projected gradient)."""
    rows = np.concatenate([np.array(c) for c in columns])
    at = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    # a bound of the largest eigenvalue: the largest row sum times the largest column sum
    step = 1.0 / (np.bincount(rows).max() * 3.0)
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(STEPS):
        short = counts - np.bincount(rows, weights=y[at], minlength=len(counts))
        new = np.maximum(0.0, y + step * np.bincount(at, weights=short[rows], minlength=len(columns)))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def patterns(counts: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths): together they use every counted length exactly; none is longer than the window."""
    left, out = counts.astype(np.int64).copy(), []

    def take(lengths: tuple[int, ...], most: int) -> None:
        uses = {n: lengths.count(n) for n in lengths}
        times = min(most, *(int(left[n]) // k for n, k in uses.items()), most)
        if times > 0:
            for n, k in uses.items():
                left[n] -= k * times
            out.append((times, lengths))

    columns = combinations(counts, window)
    if columns:
        x = nnls(columns, counts.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            take(columns[k], int(x[k]))
    while left.any():
        space, lengths, free = window, [], left.copy()
        while True:
            fits = np.flatnonzero(free[: space + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            k = min(int(free[n]), space // n)
            lengths += [n] * k
            free[n] -= k
            space -= k * n
        take(tuple(lengths), int(left.sum()))
    return out


def _places(table: dict[int, list[tuple[int, int, int]]], sequences: int, window: int):
    """table: for each length (first rank, first sequence, offset), sorted."""
    starts = {n: np.array([r[0] for r in rows]) for n, rows in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out: list[tuple] = []
            for doc, tokens, crcs, crc, rank, first in zip(cols["doc_id"], cols["tokens"], cols["crcs"], cols["rest_crc"], cols["rank"], cols["first"], strict=True):
                for k, c in enumerate(crcs):
                    out.append((doc, k * window, window, c, tokens, sequences + first + k, 0))
                n = tokens - window * len(crcs)
                if n:
                    start, sequence, offset = table[n][int(np.searchsorted(starts[n], rank, "right")) - 1]
                    out.append((doc, tokens - n, n, crc, tokens, sequence + rank - start, offset))
            made = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor
    has. Each document ends with id 0, so a null or empty text is one token.
    Rows repeated in id or text are packed each for itself; null ids stay. An
    empty table gives no piece. Other columns don't matter.
    """
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), text_or_empty(docs, text).alias("body"))
    rows = rows.mapInArrow(_tokenised(tokenizer, window), "doc_id bigint, tokens bigint, crcs array<bigint>, rest_crc bigint")
    # stored, the rows' numbers no longer change
    rows = Staged(rows.withColumn("row", F.monotonically_increasing_id()), "pack-tokens").df
    rows = rows.withColumn("rest", F.pmod("tokens", F.lit(window))).withColumn("full", F.size("crcs"))
    counts = np.zeros(window, np.int64)
    n_rows = 0
    for r in rows.groupBy("rest").agg(F.count("*").alias("n")).collect():  # at most window rows
        counts[r["rest"]] = r["n"]
        n_rows += r["n"]
    counts[0] = 0
    table: dict[int, list[tuple[int, int, int]]] = {}
    used, sequences = np.zeros(window, np.int64), 0
    for times, lengths in patterns(counts, window):
        offset = 0
        for n in lengths:
            table.setdefault(n, []).append((int(used[n]), sequences, offset))
            used[n] += times
            offset += n
        sequences += times

    buckets = max(64, n_rows // ROWS_A_BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("rest", "bucket").agg(F.count("*").alias("n"))
    ranks = sizes.select("rest", "bucket", F.coalesce(F.sum("n").over(before(Window.partitionBy("rest").orderBy("bucket"))), F.lit(0)).alias("rank_start"))
    fulls = rows.groupBy("bucket").agg(F.sum("full").alias("full"))
    firsts = fulls.select("bucket", F.coalesce(F.sum("full").over(before(Window.orderBy("bucket"))), F.lit(0)).alias("first_start"))  # a row for each bucket
    inside = Window.partitionBy("bucket", "rest").orderBy("row")
    along = before(Window.partitionBy("bucket").orderBy("rest", "row"))
    placed = rows.withColumn("rank", F.row_number().over(inside) - 1).withColumn("first", F.coalesce(F.sum("full").over(along), F.lit(0)))
    placed = placed.join(ranks, ["rest", "bucket"]).join(firsts, "bucket")
    placed = placed.select("doc_id", "tokens", "crcs", "rest_crc", (F.col("rank") + F.col("rank_start")).cast("bigint").alias("rank"), (F.col("first") + F.col("first_start")).cast("bigint").alias("first"))
    return placed.mapInArrow(_places(table, sequences, window), PIECES)
