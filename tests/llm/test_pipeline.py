"""The five stages in sequence against a plain version of them, on a table with large groups of copies."""

import collections
import random

from test_corpus import linked, words
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm.queries import tokenizer_path


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: "\n".join(words(rng, 30).capitalize() + "." for _ in range(3))
    item = "how many of the old stones lie in the deep river when the night is cold and clear"
    good = [text() for _ in range(80)]
    good += [good[0]] * 60 + [good[k] for k in range(20)]  # exact copies, one group of 61
    for k in [1] * 40 + list(range(10, 20)):  # near copies, one group of 41
        w = good[k].split(" ")
        w[rng.randrange(5, 40)] = f"other{rng.randrange(10**6)}"
        good.append(" ".join(w))
    good += [t + "\n" + item.capitalize() + "." for t in (text() for _ in range(5))]
    bad = ["\n".join("junk$$$ " * 20 + str(k) for _ in range(3)) for k in range(80)]
    rows = list(enumerate(good + bad))
    quality = {k: int(k < len(good)) for k, _ in rows}
    rng.shuffle(rows)
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {
        "documents": ([(k, t, "en", "s", len(t)) for k, t in rows], shape),
        "labels": ([(k, q, 0) for k, q in quality.items()], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item)], "item_id long, text string"),
    }
    for name, (data, columns) in tables.items():
        spark.createDataFrame(data, columns).repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    kept = [(k, t) for k, t in rows if quality[k]]
    last = {}
    for k, t in kept:
        last[t] = max(k, last.get(t, k))
    kept = sorted((k, t) for t, k in last.items())
    first = {k for k, _, component in linked(kept) if k == component}
    kept = {k: t for k, t in kept if k in first and item not in t.lower()}
    t = Tokenizer.from_file(tokenizer_path())
    tokens = {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in kept.items()}
    assert len(kept) == 80
    found, loads = collections.defaultdict(int), collections.Counter()
    for p in got:
        assert p.doc_tokens == tokens[p.doc_id]
        found[p.doc_id] += p.length
        loads[p.sequence_id] += p.length
    assert found == tokens and max(loads.values()) <= 1024


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, columns with names that operators use, empty tables."""
    rng = random.Random(7)
    long = " ".join(f"w{k % 4999}" for k in range(60_000))
    texts = [None, None, "", " \t\n", "one", long, long, long + " end", "a <|endoftext|> b", "日本語の文章です。" * 40, *(words(rng, 40) for _ in range(20))]
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, label string, tid long, name string, kept boolean, n_found int"
    row = lambda k, t: (k, t, None, "s", None, 0.1, 0, "l", 1, "n", False, 3)
    rows = [row(k, t) for k, t in enumerate(texts)] + [row(10, texts[10])] * 2 + [row(None, "no id"), row(None, None), row(11, "another text of this id")]
    df = spark.createDataFrame(rows, shape).repartition(3)
    spark.createDataFrame([(k, int(k % 7 > 0), 0) for k in range(5, 30)] + [(None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[12]), (2, None), (2, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    path = f"file://{tmp_path}"
    plain = collections.Counter(map(str, df.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, path)
        assert out.columns == df.columns, name
        got = collections.Counter(map(str, out.collect()))
        assert all(n <= plain[r] for r, n in got.items()), name
        assert stage(spark, df.limit(0), path).count() == 0, name
    exact = [r.text for r in corpus_pipeline.keep_one_copy(spark, df, path).collect()]
    assert len(exact) == len({t or "" for t in exact}) == len({r[1] or "" for r in rows})
    near = corpus_pipeline.keep_one_near_copy(spark, df, path).collect()
    assert sum(r.text is None or not r.text.strip() for r in near) == 5 and sum((r.text or "").startswith("w0 w1") for r in near) == 1
    clean = corpus_pipeline.drop_contaminated(spark, df, path)
    assert clean.count() == len(rows) - sum(r[1] == texts[12] for r in rows)
    pieces = corpus_pipeline.pack(spark, df, path)
    t = Tokenizer.from_file(tokenizer_path())
    assert sum(p.length for p in pieces.collect()) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert corpus_pipeline.pack(spark, df.limit(0), path).count() == 0
