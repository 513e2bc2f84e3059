"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its evidence is a linear function of surface features
of the line and of its two neighbours (rates of character classes, repeated and
short words, lengths), so labels of adjacent lines lean on each other twice: by
features and by transitions. Forward-backward marginals, weighted by line length,
add up to the document's score. All features are counts, summed over whole texts
with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import text_or_empty

CHUNK = 1 << 21
TRAINING_DOCS = 4_000
TRAINING_LINES = 2_000
STEPS, RATE, RIDGE = 250, 0.08, 1e-3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

# Character classes of UTF-8 bytes.
CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "stop": [*b".,;:?'\"()-"],
    "shout": [*b"!"],
    "bar": [*b"|"],
    "mark": [*b"#$%&*+/<=>@[\\]^_`{}~"],
    "wide": [*range(0xC2, 0xF5)],
}
COUNTS = ["n", *CLASSES, "words", "repeats", "short", "letters_in_words", "ends"]
FEATURES = ["upper", "digit", "stop", "shout", "bar", "mark", "wide", "repeats", "short", "word_length", "length", "ends", "blank"]


def _chunk_counts(data: bytes, powers: np.ndarray) -> np.ndarray:
    """COUNTS for each line of ``data``, which ends with a line feed."""
    a = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(a == 10)
    starts = np.concatenate([[0], feeds[:-1] + 1])
    out = np.zeros((len(starts), len(COUNTS)))
    out[:, 0] = feeds - starts
    for k, (_, members) in enumerate(CLASSES.items(), 1):
        table = np.zeros(256, np.int32)
        table[members] = 1
        out[:, k] = np.add.reduceat(table[a], starts)
    gap = (a == 32) | ((a >= 9) & (a <= 13))
    before = np.concatenate([[True], gap[:-1]])
    first = np.flatnonzero(~gap & before)
    last = np.flatnonzero(gap & ~before)
    if len(first):
        line = np.searchsorted(feeds, first)
        size = last - first
        sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers[: len(a)])])
        value = sums[last] - sums[first]
        same = (line[1:] == line[:-1]) & (size[1:] == size[:-1]) & (value[:-1] * powers[first[1:] - first[:-1]] == value[1:])
        rows = len(starts)
        at = len(CLASSES) + 1
        out[:, at] = np.bincount(line, minlength=rows)
        out[:, at + 1] = np.bincount(line[1:][same], minlength=rows)
        out[:, at + 2] = np.bincount(line[size <= 3], minlength=rows)
        out[:, at + 3] = np.bincount(line, weights=size, minlength=rows)
    tail = a[np.maximum(feeds - 1, 0)]
    out[:, -1] = (feeds > starts) & np.isin(tail, np.frombuffer(b".!?:", np.uint8))
    return out


def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + 1, MULTIPLIER)]), dtype=np.uint64)


def count_lines(texts: list[str], powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS of every line of the texts, and the number of lines of each text. Long texts and long lines go in pieces."""
    found, parts, size, open_ = [], [], 0, False

    def flush() -> None:
        nonlocal parts, size
        if parts:
            got = _chunk_counts(b"\n".join(parts) + b"\n", powers)
            if carried and found:  # goes on with the line that the last piece left open
                ends = got[0, -1]
                found[-1][-1] += got[0]
                found[-1][-1, -1] = ends
                got = got[1:]
            if len(got):
                found.append(got)
            parts, size = [], 0

    carried = False
    for text in texts:
        raw = text.encode()
        if size + len(raw) + 1 > CHUNK - 8:
            flush()
            carried = False
        while len(raw) + 1 > CHUNK - 8:
            piece, raw = raw[: CHUNK - 16], raw[CHUNK - 16 :]
            parts, size = [piece], len(piece)
            flush()
            carried = True
        parts.append(raw)
        size += len(raw) + 1
        if carried:
            flush()
            carried = False
    flush()
    counts = np.concatenate(found) if found else np.zeros((0, len(COUNTS)))
    return counts, np.array([t.count("\n") + 1 for t in texts], np.int64)


def line_features(counts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """FEATURES of each line, of the line before and of the line after (zeros at the ends of a document)."""
    c = dict(zip(COUNTS, counts.T, strict=True))
    n, words = np.maximum(c["n"], 1), np.maximum(c["words"], 1)
    letters = np.maximum(c["upper"] + c["lower"] + c["wide"], 1)
    own = np.stack(
        [c["upper"] / letters, c["digit"] / n, c["stop"] / n, c["shout"] / words, c["bar"] / words, c["mark"] / words, c["wide"] / letters, c["repeats"] / words, c["short"] / words, np.minimum(c["letters_in_words"] / words, 30) / 10, np.log1p(c["n"]) / 5, c["ends"], c["n"] == 0],
        axis=1,
    )
    own[:, 3:6] = np.minimum(own[:, 3:6], 2.0)
    first = np.cumsum(lines) - lines
    zero = np.zeros((1, own.shape[1]))
    before, after = np.concatenate([zero, own[:-1]]) if len(own) else own, np.concatenate([own[1:], zero]) if len(own) else own
    if len(own):
        before[first] = 0
        after[first + lines - 1] = 0
    return np.concatenate([own, before, after], axis=1)


@dataclass
class Field:
    """Weights of a fitted field: evidence (last: bias) on standardised features, transitions[y, next y]."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    def evidence(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def _pass_on(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of the next label from log odds ``x`` of this one; t[this, next]."""
    return np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])


def forward_backward(u: np.ndarray, lines: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds from the left (own evidence included) and from the right, for all documents at once."""
    order = np.argsort(-lines, kind="stable")
    size, start = lines[order], (np.cumsum(lines) - lines)[order]
    left, right = u.copy(), np.zeros_like(u)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # documents with more than k lines
    for k in range(1, longest):
        at = start[: active[k]] + k
        left[at] += _pass_on(left[at - 1], t)
    for k in range(1, longest):
        at = start[: active[k]] + size[: active[k]] - 1 - k
        right[at] = _pass_on(u[at + 1] + right[at + 1], t.T)
    return left, right


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(features: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood with a ridge; every line carries its document's label, every document weighs the same."""
    wide = features.shape[1] if features.size else 3 * len(FEATURES)
    if not len(labels) or labels.min() == labels.max():
        return Field(np.zeros(wide), np.ones(wide), np.zeros(wide + 1), np.zeros((2, 2)))
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = np.concatenate([(features - mean) / scale, np.ones((len(features), 1))], axis=1)
    y = np.repeat(labels.astype(float), lines)
    weight = np.repeat(1.0 / lines, lines) / len(lines)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lines) - 1] = False
    i = np.flatnonzero(inner)
    w, t = np.zeros(wide + 1), np.zeros((2, 2))
    m, v = np.zeros(wide + 5), np.zeros(wide + 5)
    for step in range(1, STEPS + 1):
        u = x @ w
        left, right = forward_backward(u, lines, t)
        p = _sigmoid(left + right)
        grad_w = x.T @ (weight * (y - p)) - RIDGE * np.append(w[:-1], 0)
        # pairwise marginals, in logarithms, up to a constant
        to = u[i + 1] + right[i + 1]
        logs = np.stack([np.stack([np.full(len(i), t[0, 0]), t[0, 1] + to]), np.stack([left[i] + t[1, 0], left[i] + t[1, 1] + to])])
        e = np.exp(logs - logs.max((0, 1)))
        e /= e.sum((0, 1))
        seen = np.stack([np.stack([(1 - y[i]) * (1 - y[i + 1]), (1 - y[i]) * y[i + 1]]), np.stack([y[i] * (1 - y[i + 1]), y[i] * y[i + 1]])])
        grad_t = ((seen - e) * weight[i]).sum(2) - RIDGE * t
        g = np.concatenate([grad_w, grad_t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w += move[: wide + 1]
        t += move[wide + 1 :].reshape(2, 2)
    return Field(mean, scale, w, t)


def score_texts(texts: list[str], field: Field, powers: np.ndarray) -> np.ndarray:
    counts, lines = count_lines(texts, powers)
    u = field.evidence(line_features(counts, lines))
    left, right = forward_backward(u, lines, field.transitions)
    weight = counts[:, 0] + 1.0
    first = np.cumsum(lines) - lines
    p = _sigmoid(left + right)
    return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first) if len(texts) else np.zeros(0)


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, a few megabytes at a time."""
    some, size = [], 0
    for text in column:
        t = text.as_py() or ""
        some.append(t)
        size += len(t)
        if size > CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers()
    for batch in batches:
        made = []
        for texts in _slices(batch.column(1)):
            counts, lines = count_lines(texts, powers)
            each = np.split(counts, np.cumsum(lines)[:-1])
            middle = ((max(0, len(c) - TRAINING_LINES) // 2, c) for c in each)
            made += [c[at : at + TRAINING_LINES].astype(np.float32).tobytes() for at, c in middle]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["label", "counts"])


def train(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS, doc_id: str = "doc_id", text: str = "text") -> Field:
    """Fit on labelled documents that aren't held out.

    The sample is bounded by ``training_docs``, chosen by a hash of the id, and by
    TRAINING_LINES lines, from the middle, of each of them. Labels
    that are null are left out; of several labels of a document the mean counts.
    Without labels of both classes every score is 0.5.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).filter(F.col("q") != 0.5)
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_docs).select(F.col("doc_id").alias("__w_id"), (F.col("q") > 0.5).cast("int").alias("__w_label"))
    body = text_or_empty(docs, text)
    rows = docs.join(F.broadcast(chosen), docs[doc_id] == F.col("__w_id")).select(F.col("__w_label").alias("label"), body.alias("body"), F.xxhash64(body).alias("h"))
    got = rows.select("label", "body").mapInArrow(_measured, "label int, counts binary").toPandas()
    got = got.sort_values(["label", "counts"], kind="stable")
    if not len(got):
        return fit(np.zeros((0, 3 * len(FEATURES))), np.zeros(0, np.int64), np.zeros(0))
    each = [np.frombuffer(c, np.float32).reshape(-1, len(COUNTS)).astype(float) for c in got["counts"]]
    lines = np.array([len(c) for c in each], np.int64)
    return fit(line_features(np.concatenate(each), lines), lines, got["label"].to_numpy())


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted``.

    A null or empty text is one empty line and gets that line's score. Every row
    is scored for itself; columns already called score or predicted are replaced.
    """
    scored = F.pandas_udf(_scorer(field), "double")
    out = docs.withColumn("score", scored(text_or_empty(docs, text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, with a score of 0.5 or more."""
    scored = F.pandas_udf(_scorer(field), "double")
    return docs.withColumn("__w_score", scored(text_or_empty(docs, text))).filter(F.col("__w_score") >= 0.5).drop("__w_score")


def _scorer(field: Field):
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = _powers()
        for batch in batches:
            made = [score_texts(texts, field, powers) for texts in _slices(pa.array(batch, pa.string()))]
            yield pd.Series(np.concatenate(made) if made else np.zeros(0))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null id isn't held out."""
    held = F.coalesce(F.pmod(F.crc32(docs[doc_id].cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select(docs[doc_id].alias("doc_id"), held.alias("held_out"), text_or_empty(docs, text).alias("body"))
    return score(rows, train(docs, labels, doc_id=doc_id, text=text), text="body").select("doc_id", "held_out", "score", "predicted")
