"""Line dedup: range-partitioned line hashes, sorted by document and position, give keep bitmaps.

Each line's key (stripped, ASCII lower case) becomes a 128-bit hash. Rows of
hash, document and position are range-partitioned by hash and document and
sorted, so one very frequent line spreads over many tasks. Each task streams its
rows: it decides every line whose run lies inside the task. The first and last
run of a task may go on in its neighbours, so those are settled by adding up
counts: a run that is frequent already is dropped at once, the few rows of others
wait for the sum, as do rows of a run that is undecided for more than ROWS_HELD of them.
The result is one compressed bitmap for each document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Staged, text_or_empty

BLANKS = b" \t\n\x0b\x0c\r"
ROWS_OUT = 100_000
ROWS_HELD = 100_000


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(BLANKS).lower() for line in text.split(b"\n")]  # bytes.lower() touches A-Z only


def _hash_lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, keys, hashes, places = batch.column(0), batch.column(1), [], [], []
            for k, text in enumerate(batch.column(2)):
                raw = (text.as_py() or "").encode()
                for place, key in enumerate(line_keys(raw)):
                    if len(key) >= least and (least <= 1 or len(key.decode()) >= least):
                        keys.append(k)
                        hashes.append(xxhash.xxh3_128_digest(key))
                        places.append(place)
                if len(keys) >= ROWS_OUT or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids.take(at := pa.array(keys, pa.int64())), prints.take(at), pa.array(hashes, pa.binary()), pa.array(places, pa.int32())], names=["doc_id", "print", "h", "pos"])
                    keys, hashes, places = [], [], []

    return run


def _runs(least_docs: int):
    """Streams sorted rows; emits (h, doc_id, print, pos, docs, open).

    Rows that aren't open are lines to drop. An open run has a row with the number
    of its documents here and no position, and its rows if those aren't enough here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the present run that aren't given out: of fewer than least_docs documents
        now, doc, docs, first, frequent, waits = None, object(), 0, True, False, False
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], names=["h", "doc_id", "print", "pos", "docs", "open"])

        def end(edge: bool) -> None:
            nonlocal held, frequent, waits
            if (edge or waits) and now is not None:
                out.extend((x, *y, z, 0, True) for x, y, z in held)
                out.append((now, None, None, None, docs, True))
            held, frequent, waits = [], False, False

        for batch in batches:
            for h, d, f, p in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                d = (d, f)
                if h != now:
                    if now is not None:
                        end(first)
                        first = False
                    now, doc, docs = h, object(), 0
                if d != doc:
                    doc = d
                    docs += 1
                    if docs == least_docs:
                        frequent = True
                        out.extend((x, *y, z, 0, False) for x, y, z in held)
                        held = []
                if frequent:
                    out.append((h, *d, p, 0, False))
                else:
                    held.append((h, d, p))
                    if len(held) > ROWS_HELD:  # of few documents that repeat the line very often
                        out.extend((x, *y, z, 0, True) for x, y, z in held)
                        held, waits = [], True
                if len(out) >= ROWS_OUT:
                    yield batch_of(out)
                    out = []
        end(True)
        yield batch_of(out)

    return run


def _bitmaps(pairs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for places in pairs:
        found = []
        for p in places:
            bits = np.zeros(int(max(p)) + 1, np.uint8)
            bits[np.asarray(p, np.int64)] = 1
            found.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        yield pd.Series(found)


def drop_bitmaps(docs: DataFrame, least_docs: int = 10, least_points: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print (xxhash64 of the text), drop_bits: for each document with dropped lines
    the zlib-compressed bitmap, bit i set where line i goes.

    A line goes, everywhere, if its key has at least ``least_points`` code points
    and is found in at least ``least_docs`` documents. Rows repeated in
    id and text are one document; rows with one id, or a null id, and different
    texts are different ones. Null and empty texts have one empty line, which never goes
    while ``least_points`` is 1 or more. Other columns don't matter.
    """
    rows = _rows(docs, doc_id, text)
    lines = rows.mapInArrow(_hash_lines(least_points), "doc_id bigint, print bigint, h binary, pos int")
    order = ["h", "doc_id", "print", "pos"]
    # staged, so that finding the ranges doesn't hash all lines once more
    lines = Staged(lines.select(*order), "line-hashes").df
    dealt = lines.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    seen = Staged(dealt.mapInArrow(_runs(least_docs), "h binary, doc_id bigint, print bigint, pos int, docs bigint, open boolean"), "line-runs").df
    waiting = seen.filter("open")
    frequent = waiting.groupBy("h").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("h")
    late = waiting.filter("pos is not null").join(frequent, "h", "left_semi")
    drops = seen.filter("not open").select(*order[1:]).unionByName(late.select(*order[1:]))
    bits = F.pandas_udf(_bitmaps, "binary")
    return drops.groupBy("doc_id", "print").agg(F.collect_set("pos").alias("pos")).select("doc_id", "print", bits("pos").alias("drop_bits"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = text_or_empty(docs, text)
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(body).alias("print"), body.alias("body"))


def split_lines(text: str | None, drop_bits: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """All lines of a text, and those that stay."""
    lines = (text or "").encode().split(b"\n")
    if drop_bits is None:
        return lines, lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(drop_bits), np.uint8), bitorder="little")
    return lines, [line for i, line in enumerate(lines) if i >= len(bits) or not bits[i]]


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, drops, hashes = [], [], []
        for text, bits in zip(batch.column(1), batch.column(2), strict=True):
            lines, kept = split_lines(text.as_py(), bits.as_py())
            counts.append(len(lines))
            drops.append(len(lines) - len(kept))
            hashes.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(hashes, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digests(docs: DataFrame, least_docs: int = 10, least_points: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256."""
    bits = drop_bitmaps(docs, least_docs, least_points, doc_id, text)
    bits = Staged(bits.withColumnsRenamed({"doc_id": "b_id", "print": "b_print"}), "line-bits").df
    rows = _rows(docs, doc_id, text)
    # bitmaps grow with the documents, so they are never broadcast: the same plan at every size
    both = rows.join(bits.hint("merge"), rows["doc_id"].eqNullSafe(bits["b_id"]) & (rows["print"] == bits["b_print"]), "left").select("doc_id", "body", "drop_bits")
    return both.mapInArrow(_applied, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
