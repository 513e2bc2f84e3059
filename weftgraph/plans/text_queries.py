"""Scanning, text, retrieval and co-change on the corpus, vector and commit adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import cochange as C
from weftgraph.operators import embedding as E
from weftgraph.operators import retrieval as R
from weftgraph.plans.adapters import COMMITS_SQL, commits, table, vectors
from weftgraph.staging import Staged

QUERY = "erou thened with tionblewh and hati onandwh"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _query_vector(spark, sf_dir):
    return vectors(spark, sf_dir).filter("vec_id = 0").first()["vector"]


def _vectors(spark, sf_dir):
    return vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")


def script_counts(spark, sf_dir):
    counts = X.script_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("bigint").alias(n) for n, c in counts.items()])


def language_decision(spark, sf_dir):
    """By the lang column: English only or not, from all texts of up to 200 documents with the smallest ids."""
    # the sample of 200 texts is the operator's own definition
    return X.language_decisions(table(spark, sf_dir, "documents"), "lang", "doc_id", "text")


def embed_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "section").when(F.col("doc_id") % 3 == 1, "function").otherwise("module")
    body = X.embedding_text(F.col("source"), F.col("lang"), F.lit(""), F.col("text"))
    rows = docs.select("doc_id", kind.alias("kind"), E.prefixed(body, "e5", "passage").alias("text"))
    return rows.filter(F.col("kind").isin(E.EMBED_KINDS)).select("doc_id", E.model_type(F.col("kind")).alias("model_type"), F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"))


def search_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.search_terms(F.col("text")), " ").alias("terms"))


def vector_topk(spark, sf_dir):
    return R.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), "score")


def vector_dedupe_label(spark, sf_dir):
    hits = R.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 60, keep=["label"])
    return R.dedupe_by_label(hits, 10).select("label", F.col("id").alias("vec_id"), "score")


def bm25_search(spark, sf_dir):
    return R.bm25(_docs(spark, sf_dir), R.query_terms(QUERY), 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_INDEXES: dict[tuple[str, str], object] = {}


def _index(spark, sf_dir):
    """Postings of the documents: built once for a session and folder, as a store does at build time."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = Staged(R.postings(_docs(spark, sf_dir)), "postings")
    return _INDEXES[key].df


def bm25_indexed(spark, sf_dir):
    """The keyword search from postings; the same result as from the texts."""
    return R.bm25_indexed(_index(spark, sf_dir), R.query_terms(QUERY), 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def scan_search(spark, sf_dir):
    return R.scan(_docs(spark, sf_dir), R.query_terms(QUERY), 20, columns=["text"]).select(F.col("id").alias("doc_id"), "score")


def rrf_fusion(spark, sf_dir):
    signals = {"vector": R.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 40), "keyword": R.bm25(_docs(spark, sf_dir), R.query_terms(QUERY), 40)}
    fused = R.rrf(signals, weights={"vector": 1.5, "keyword": 1.5})
    part = lambda name: F.round(F.coalesce(F.element_at("contributions", name), F.lit(0.0)), 8).alias(name)
    return fused.select(F.col("id").alias("doc_id"), F.round("score", 8).alias("score"), part("vector"), part("keyword"))


def hybrid_search(spark, sf_dir):
    return R.hybrid(_docs(spark, sf_dir), _vectors(spark, sf_dir), QUERY, _query_vector(spark, sf_dir), 10).select(F.col("id").alias("doc_id"), "score")


def _pairs(spark, sf_dir):
    return C.pairs(commits(spark, sf_dir), min_confidence=0.04, extracted_strength=0.06)


def cochange_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", "support", "strength", "recency", "confidence", F.array_join("sample_messages", " | ").alias("sample_messages"))


def cochange_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("s"), (F.col("l_suppkey") + 1).cast("string")).alias("target")).distinct()
    edges = lines.select("source", "target", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    return C.enrich(edges, _pairs(spark, sf_dir))


def rename_chain_long(spark, sf_dir):
    """Every part renamed to the next: one chain through all of them."""
    part = table(spark, sf_dir, "part")
    name = lambda n: F.concat(F.lit("p"), n.cast("string"))
    return C.resolve_renames(part.select(F.col("p_partkey").alias("seq"), name(F.col("p_partkey")).alias("old"), name(F.col("p_partkey") + 1).alias("new")))


def rename_chain(spark, sf_dir):
    """Parts renamed along their size: part k of a brand becomes the next larger one."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 10 < 8")
    rows = part.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("p"), F.col("p_partkey")).alias("old"), F.concat(F.lit("p"), F.col("p_partkey") + 1).alias("new"))
    return C.resolve_renames(rows)


def content_hash_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def incremental_diff(spark, sf_dir):
    """Changes from a first version (without every seventh document) to the second (every fifth text altered)."""
    from weftgraph.sources.files import diff

    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    before = docs.filter("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    after = docs.filter("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return diff(before, after)


QUERIES = {f.__name__: f for f in (script_counts, language_decision, embed_text, search_terms, vector_topk, vector_dedupe_label, bm25_search, bm25_indexed, scan_search, rrf_fusion, hybrid_search, cochange_pairs, cochange_edges, rename_chain, rename_chain_long, content_hash_manifest, incremental_diff)}

_SCRIPTS = r"""
plain AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[\s\x00-\x40\x5b-\x60\x7b-\x7f\p{Nd}]', '', 'g') AS t FROM documents),
sizes AS (SELECT doc_id, lang, length(t) AS n, length(t) - length(regexp_replace(t, '[\x{3000}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{ac00}-\x{d7af}]', '', 'g')) AS cjk,
  length(t) - length(regexp_replace(t, '[\x{0400}-\x{04ff}]', '', 'g')) AS cyrillic, length(t) - length(regexp_replace(t, '[\x{0000}-\x{024f}]', '', 'g')) AS latin FROM plain)
"""
_TERMS = [t for t in R.query_terms(QUERY)]
_BM25 = f"""
terms AS (SELECT unnest({_TERMS!r}) AS term),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
size AS (SELECT count(*)::DOUBLE AS docs, avg(len(w)) AS mean FROM words),
tf AS (SELECT doc_id, term, len(w) AS n, len(list_filter(w, lambda x: x = term))::DOUBLE AS f FROM words, terms),
df AS (SELECT term, count(*)::DOUBLE AS n FROM tf WHERE f > 0 GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END AS idf FROM df, size),
scores AS (SELECT doc_id, sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.n / mean))) AS score FROM tf JOIN idf USING (term), size WHERE f > 0 GROUP BY doc_id)
"""
_VECTOR = """
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, q)
"""
_FUSED = f"""
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT * FROM near ORDER BY score DESC, vec_id LIMIT 40)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM scores ORDER BY score DESC, doc_id LIMIT 40)),
fused AS (SELECT doc_id, coalesce(1.5::DOUBLE / (60 + v.r), 0) AS vector, coalesce(1.5::DOUBLE / (60 + k.r), 0) AS keyword FROM v FULL JOIN k USING (doc_id))
"""
_PAIRS = f"""{COMMITS_SQL},
kept AS (SELECT * FROM commits WHERE hash IN (SELECT hash FROM commits GROUP BY hash HAVING count(*) BETWEEN 2 AND 30)),
each_file AS (SELECT file, count(*)::DOUBLE AS n FROM kept GROUP BY file),
both_files AS (SELECT x.file AS a, y.file AS b, count(*) AS support, sum(exp(-ln(2.0::DOUBLE) / (180.0::DOUBLE * 86400) * ((SELECT max(ts) FROM commits) - x.ts))) AS decay,
  array_to_string(list_slice(list(x.message ORDER BY -x.ts, x.hash), 1, 10), ' | ') AS sample_messages
  FROM kept x JOIN kept y ON x.hash = y.hash AND x.file < y.file GROUP BY x.file, y.file HAVING count(*) >= 3),
scored AS (SELECT a, b, support, decay, sample_messages, support / sqrt(m.n * k.n) AS s FROM both_files JOIN each_file m ON m.file = a JOIN each_file k ON k.file = b),
pairs AS (SELECT a, b, support, round(s, 4) AS strength, round(decay / support, 4) AS recency, CASE WHEN support >= 5 AND s >= 0.06::DOUBLE THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, sample_messages
  FROM scored WHERE s >= 0.04::DOUBLE OR (support >= 5 AND s >= 0.06::DOUBLE))
"""
ORACLES = {
    "script_counts": f"WITH {_SCRIPTS} SELECT doc_id, latin, cjk, cyrillic, n - latin - cjk - cyrillic AS other FROM sizes",
    "language_decision": f"""WITH {_SCRIPTS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM sizes),
      s AS (SELECT lang, sum(latin)::BIGINT AS latin, sum(n - latin)::BIGINT AS "foreign" FROM firsts WHERE k <= 200 GROUP BY lang)
      SELECT lang, latin, "foreign", CASE WHEN latin + "foreign" = 0 OR (latin / (latin + "foreign") >= 0.9 AND "foreign" < 10) THEN 'en' ELSE 'multilingual' END AS decision FROM s""",
    "embed_text": """WITH t AS (SELECT doc_id, doc_id % 3 AS k, 'passage: ' || left(concat_ws(' ', source, lang, left(nullif(text, ''), 300)), 1500) AS text FROM documents)
      SELECT doc_id, CASE WHEN k = 0 THEN 'text' ELSE 'code' END AS model_type, sha256(text) AS text_sha256, length(text) AS n_chars FROM t WHERE k IN (0, 1)""",
    "search_terms": f"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({R.STOPWORDS!r}, w)), ' ') AS terms FROM benchmark""",
    "vector_topk": f"WITH {_VECTOR} SELECT vec_id, score FROM near ORDER BY score DESC, vec_id LIMIT 10",
    "vector_dedupe_label": f"""WITH {_VECTOR}, hits AS (SELECT * FROM near ORDER BY score DESC, vec_id LIMIT 60)
      SELECT label, vec_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM hits) WHERE k = 1 ORDER BY hits.score DESC, label LIMIT 10""".replace("ORDER BY hits.score", "ORDER BY 3"),
    "bm25_search": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM scores ORDER BY score DESC, doc_id LIMIT 20)",
    "bm25_indexed": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM scores ORDER BY score DESC, doc_id LIMIT 20)",
    "rename_chain_long": "SELECT 'p' || p_partkey AS old, 'p' || (SELECT max(p_partkey) + 1 FROM part) AS new FROM part",
    "scan_search": f"SELECT doc_id, n AS score FROM (SELECT doc_id, {' + '.join(f'contains(lower(text), {t!r})::BIGINT' for t in _TERMS)} AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 20",
    "rrf_fusion": f"WITH {_BM25}, {_VECTOR}, {_FUSED} SELECT doc_id, round(vector + keyword, 8) AS score, round(vector, 8) AS vector, round(keyword, 8) AS keyword FROM fused",
    "hybrid_search": f"WITH {_BM25}, {_VECTOR}, {_FUSED} SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, vector + keyword AS score FROM fused ORDER BY score DESC, doc_id LIMIT 10)",
    "cochange_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "cochange_edges": f"""WITH {_PAIRS}, new AS (SELECT a AS source, b AS target, confidence FROM pairs UNION ALL SELECT b, a, confidence FROM pairs),
      old AS (SELECT DISTINCT 's' || l_suppkey AS source, 's' || (l_suppkey + 1) AS target FROM lineitem WHERE l_linenumber = 1)
      SELECT source, target, 'co_change' AS relation, confidence FROM new
      UNION ALL SELECT source, target, 'calls', 'EXTRACTED' FROM old WHERE (source, target) NOT IN (SELECT (source, target) FROM new)""",
    "rename_chain": """WITH RECURSIVE r AS (SELECT 'p' || p_partkey AS old, 'p' || (p_partkey + 1) AS new FROM part WHERE p_partkey % 10 < 8),
      w AS (SELECT old, new FROM r UNION ALL SELECT w.old, r.new FROM w JOIN r ON r.old = w.new)
      SELECT old, new FROM w WHERE new NOT IN (SELECT old FROM r)""",
    "content_hash_manifest": "SELECT concat_ws('/', source, lang, doc_id) AS path, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "incremental_diff": """WITH d AS (SELECT concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS text, doc_id FROM documents),
      b AS (SELECT path, sha256(text) AS h FROM d WHERE doc_id % 7 <> 0), a AS (SELECT path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM d WHERE doc_id % 11 <> 0)
      SELECT path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path)""",
}
