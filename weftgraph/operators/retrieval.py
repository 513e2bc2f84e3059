"""Keyword, vector and fused ranking."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import Porter, stemmed, term_frequency, tokens
from weftgraph.model import STOPWORDS
from weftgraph.staging import Staged

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    return [w for w in query.lower().split() if len(w) > 2 and w not in STOPWORDS]


def _let(value, body):
    return F.element_at(F.transform(F.array(value), body), 1)


def bm25(docs: DataFrame, terms: list[str], top: int = 20, id_: str = "id", columns: list[str] = ("text",), stem: bool = False) -> DataFrame:
    """id, score of the best documents, ties by id: BM25 with k1 1.2, b 0.75, all columns of one weight.

    A term of several tokens is a phrase inside one column. One pass over the
    documents counts the query's terms only and stages the counts; totals are one row.
    For many searches of one table build :func:`postings` instead.
    """
    phrases = _phrases(terms, stem)
    if not phrases:
        return docs.select(F.col(id_).alias("id"), F.lit(0.0).alias("score")).limit(0)
    words = docs.select(F.col(id_).alias("id"), *[tokens(F.col(c)).alias(f"w{k}") for k, c in enumerate(columns)])
    if stem:
        words = words.select("id", *[stemmed(F.col(f"w{k}")).alias(f"w{k}") for k in range(len(columns))])

    def counted(k: int):
        return _let(F.col(f"w{k}"), lambda w: F.concat(F.array(F.size(w)), F.array(*[term_frequency(w, list(p)) for p in phrases])))

    sums = words.select("id", *[counted(k).alias(f"c{k}") for k in range(len(columns))])
    cell = lambda i: sum((F.col(f"c{k}")[i] for k in range(1, len(columns))), F.col("c0")[i])
    flat = sums.select("id", cell(0).alias("size"), *[cell(j + 1).alias(f"f{j}") for j in range(len(phrases))])
    flat = Staged(flat, "bm25").df
    total = flat.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *[F.count(F.when(F.col(f"f{j}") > 0, 1)).alias(f"n{j}") for j in range(len(phrases))])
    hit = flat.filter(F.greatest(F.lit(0), *[F.col(f"f{j}") for j in range(len(phrases))]) > 0).crossJoin(F.broadcast(total))  # total is one row
    score = F.lit(0.0)
    for j in range(len(phrases)):
        idf = F.log((F.col("docs") - F.col(f"n{j}") + 0.5) / (F.col(f"n{j}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"f{j}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return hit.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def _phrases(terms: list[str], stem: bool) -> list[tuple[str, ...]]:
    shape = Porter() if stem else str
    found = dict.fromkeys(tuple(shape(t) for t in re.findall(r"[^\W_]+", term.lower())) for term in terms)
    return [p for p in found if p]


def postings(docs: DataFrame, id_: str = "id", columns: list[str] = ("text",), stem: bool = False) -> DataFrame:
    """term, id, field (number of the column), places, size (tokens of all columns of the document), docs and mean (of the whole table): the index that :func:`bm25_indexed` reads.

    Built once for a table; sorted by term in each file, so a search reads the
    pages of its terms only. A document's postings are made where it is read and each task
    writes a file of its own, so nothing is shuffled; the totals are one row.
    """
    words = docs.select(F.col(id_).alias("id"), *[tokens(F.col(c)).alias(f"w{k}") for k, c in enumerate(columns)])
    if stem:
        words = words.select("id", *[stemmed(F.col(f"w{k}")).alias(f"w{k}") for k in range(len(columns))])
    size = sum((F.size(f"w{k}") for k in range(1, len(columns))), F.size("w0"))
    total = words.agg(F.count("*").alias("docs"), F.avg(size).alias("mean")).first()
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"w{k}").alias("words")) for k in range(len(columns))])
    each = words.select("id", size.alias("size"), F.explode(fields).alias("f")).select("id", "size", "f.field", F.explode(_by_term(F.col("f.words"))).alias("p"))
    found = each.select("p.term", "id", "field", "size", "p.places").sortWithinPartitions("term", "id")
    return found.select("term", "id", "field", "size", "places", F.lit(total["docs"]).cast("bigint").alias("docs"), F.lit(total["mean"]).cast("double").alias("mean"))


def _by_term(words):
    """(term, places) of each different term of an array of tokens."""
    in_order = F.sort_array(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("place"))))
    first = lambda s: F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i - 1)["term"] != F.get(s, i)["term"]))
    places = lambda s, at, p, k: F.transform(F.slice(s, p + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - p), lambda x: x["place"])
    return _let(in_order, lambda s: _let(first(s), lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p)["term"].alias("term"), places(s, at, p, k).alias("places")))))


def bm25_indexed(index: DataFrame, terms: list[str], top: int = 20, stem: bool = False) -> DataFrame:
    """id, score as :func:`bm25` gives them, from :func:`postings` of the same columns and the same ``stem``."""
    phrases = _phrases(terms, stem)
    rows = index.filter(F.col("term").isin(sorted({t for p in phrases for t in p})))
    parts = None
    for k, phrase in enumerate(phrases):
        one = rows.filter(F.col("term") == phrase[0])
        if len(phrase) > 1:
            for j, word in enumerate(phrase[1:], 1):
                other = rows.filter(F.col("term") == word).select("id", "field", F.col("places").alias(f"p{j}"))
                one = one.join(other, ["id", "field"])
            at = F.filter("places", lambda p: reduce(and_, (F.array_contains(F.col(f"p{j}"), p + j) for j in range(1, len(phrase)))))  # noqa: B023
            one = one.withColumn("places", at).filter(F.size("places") > 0)
        part = one.groupBy("id", "size", "docs", "mean").agg(F.sum(F.size("places")).alias("f"), F.lit(k).alias("phrase"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    count = parts.groupBy("phrase").agg(F.count("*").alias("n"))
    hit = parts.join(F.broadcast(count), "phrase")  # a row for each phrase of the query
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return hit.groupBy("id").agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def scan(docs: DataFrame, terms: list[str], top: int = 20, id_: str = "id", columns: list[str] = ("label", "docstring"), rank: str | None = None) -> DataFrame:
    """id, score: how many terms are part of any of the columns; ties by ``rank`` descending, then id."""
    if not terms:
        return docs.select(F.col(id_).alias("id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    hit = lambda t: F.greatest(F.lit(0), *[F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)).cast("int") for c in columns])
    scored = docs.select(F.col(id_).alias("id"), sum((hit(t) for t in terms), F.lit(0)).cast("bigint").alias("score"), (F.col(rank) if rank else F.lit(0.0)).alias("rank"))
    return scored.filter("score > 0").orderBy(F.desc("score"), F.desc("rank"), "id").limit(top).select("id", "score")


def dot(vector, query: list[float]):
    """Dot product of a column of arrays of doubles and a fixed vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def cosine(vector, query: list[float]):
    """Cosine of a column of arrays of doubles and a fixed vector, 0 where either has no length."""
    norm = sum(x * x for x in query) ** 0.5
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(dot(vector, query) / F.nullif(own * F.lit(norm), F.lit(0.0)), F.lit(0.0))


def vector_topk(vectors: DataFrame, query: list[float], top: int = 10, id_: str = "id", vector: str = "vector", keep: list[str] = (), unit: bool = False) -> DataFrame:
    """id, score: the nearest vectors by cosine, exactly; ties by id. Each task keeps its best, the driver none.

    unit: all vectors and the query have length one (or none), as stored embeddings do, so the dot product is enough.
    """
    near = dot(F.col(vector), query) if unit else cosine(F.col(vector), query)
    scored = vectors.select(F.col(id_).alias("id"), *keep, F.round(near, 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(top)


def dedupe_by_label(hits: DataFrame, top: int = 10) -> DataFrame:
    """label, id, score: the best hit of each label, 3 digits."""
    best = hits.groupBy("label").agg(F.max("score").alias("score"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("id"))
    return best.orderBy(F.desc("score"), "label").limit(top).select("label", "id", F.round("score", 3).alias("score"))


def rrf(signals: dict[str, DataFrame], k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score, contributions (map by signal) from lists of (id, score): sum of weight / (k + rank)."""
    parts = None
    for name, hits in signals.items():
        w = (weights or {}).get(name, 1.0)
        ranked = hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))  # lists are cut to their candidates before
        part = ranked.select("id", F.lit(name).alias("signal"), (F.lit(float(w)) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    by = parts.groupBy("id", "signal").agg(F.sum("part").alias("part"))
    return by.groupBy("id").agg(F.sum("part").alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "part")))).alias("contributions"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], top: int = 10, candidates: int = 40, weights: dict[str, float] | None = None, columns: list[str] = ("text",)) -> DataFrame:
    """id, score (4 digits): vector and keyword candidates, fused with weights of 1.5 each."""
    signals = {"vector": vector_topk(vectors, query_vector, candidates), "keyword": bm25(docs, query_terms(query), candidates, columns=columns)}
    fused = rrf(signals, weights=weights or {"vector": 1.5, "keyword": 1.5})
    return fused.orderBy(F.desc("score"), "id").limit(top).select("id", F.round("score", 4).alias("score"))
