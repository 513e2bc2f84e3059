"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, exact_dedup, html_text, jaccard, line_dedup, packing, pii, quality, sharding, warc
from weftgraph.llm.common import Staged


RANDOM_KEY = secrets.token_hex(32)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the copy of its text that stays."""
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=1000)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
w AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM w
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def sharding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3_sharding what must hold whatever the cuts: rows, bytes, shards, gapless slots, equal texts together, no shard beyond its share by more than the largest group."""
    docs = _table(spark, sf_dir, "documents")
    rows = Staged(sharding.shard(docs, shards=24, keys=True), "sharding-rows").df
    each = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("bytes"))
    # different texts of one size may have one checksum: among many documents some do
    group = rows.groupBy("text_key", "text_crc32", "size").agg(F.sum("size").alias("bytes"), F.countDistinct("shard").alias("shards"))
    text = F.coalesce("text", F.lit(""))
    largest = docs.groupBy(F.sha2(text, 256).alias("h")).agg(F.sum(F.octet_length(text) + 8).alias("g")).agg(F.max("g").alias("largest"))
    totals = each.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.min((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("gapless"), F.max("bytes").alias("most"))
    out = totals.crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(group.agg(F.max("shards").alias("apart"))))  # one row each
    return out.select("n_rows", "bytes", "shards", "gapless", (F.col("apart") == 1).alias("together"), (F.col("most") <= F.col("bytes") / 24 + F.col("largest")).alias("fair"))


SHARDING_SQL = """
SELECT count(*) AS n_rows, sum(octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS bytes, 24::BIGINT AS shards, true AS gapless, true AS together, true AS fair FROM documents
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of contaminated document and benchmark item, over all documents."""
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, bench).drop("text_hash")


def verbatim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4_decontaminate the pairs that six windows of the item's own words show, with their number."""
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contaminated(docs, bench)
    return found.filter("n_unchanged >= least(6, item_windows)").select("doc_id", "item_id", "n_unchanged")


# items have eight words or more, and no text has letters of scripts without spaces
VERBATIM_SQL = r"""
WITH items AS (SELECT min(item_id) AS item_id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+') AS w FROM items),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+') AS w FROM documents),
iw AS (SELECT item_id, len(w) - 7 AS n, unnest(range(1, len(w) - 6)) AS place, w FROM i),
dw AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda k: array_to_string(w[k:k + 7], ' '))) AS h FROM d),
hits AS (SELECT DISTINCT doc_id, item_id, n, place FROM iw JOIN dw ON array_to_string(w[place:place + 7], ' ') = h)
SELECT doc_id, item_id, count(*) AS n_unchanged FROM hits GROUP BY doc_id, item_id, n HAVING count(*) >= least(6, n)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have."""
    return line_dedup.digests(_table(spark, sf_dir, "documents"), least_docs=10, least_points=1)


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM frequent)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


# every pair that shares a shingle, and who reaches whom: for small tables
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), window=1024)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key=pii_key(spark), n_found="n_found")


def pii_key(spark: SparkSession) -> str:
    """The secret of the session's setting ``spark.weftgraph.pii.key``; without one, a random key that lives as long as the process."""
    return spark.conf.get("spark.weftgraph.pii.key", None) or RANDOM_KEY


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_warc": op2_warc,
        "op3_sharding": op3_sharding,
        "op4_decontaminate": op4_decontaminate,
        "op5_quality": op5_quality,
        "op6_jaccard": op6_jaccard,
        "op7_html_text": op7_html_text,
        "op8_line_dedup": op8_line_dedup,
        "op9_packing": op9_packing,
        "op10_pii": op10_pii,
        "sharding_totals": sharding_totals,
        "verbatim_windows": verbatim_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op6_jaccard": OP6_SQL, "op8_line_dedup": OP8_SQL, "sharding_totals": SHARDING_SQL, "verbatim_windows": VERBATIM_SQL}
