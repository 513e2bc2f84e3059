"""Every corpus operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, exact_dedup, html_text, jaccard, line_dedup, packing, pii, quality, sharding, warc
from weftgraph.llm.queries import tokenizer_path

SHAPE = "doc_id long, text string, name string, h long, n long, label string, pos int"
LONG = " ".join(f"w{k % 977}" for k in range(12_000))


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "night"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, n) for n in (3, 40, 120, 300)]
    texts = [None, None, "", "", " \t", "one", "One", *base, *base, LONG, LONG + " x", base[2].upper(), "a <|endoftext|> b<|endoftext|>"]
    near = base[3].split()
    near[7] = "other"
    texts += [" ".join(near), base[3] + " tail", "\n".join(["same line"] * 3), "a\nb\n\nsame  line \nb", "x" * 5000]
    out = [(k, t, "n", 1, 2, "l", 3) for k, t in enumerate(texts)]
    return out + [out[8], out[8], (None, base[1], "n", 1, 2, "l", 3), (None, None, "n", 1, 2, "l", 3), (8, "another text", "n", 1, 2, "l", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def test_exact_dedup(docs, none, rows):
    got = exact_dedup.dedup(docs).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and sum(r.kept for r in mine) == 1
        assert all(r.keep_id == keep and r.group_size == len(ids) for r in mine)
        assert all(r.doc_id == keep for r in mine if r.kept)
    assert exact_dedup.dedup(none).count() == 0
    assert exact_dedup.keep_one(docs).columns == docs.columns


def test_block_names_compare_text_where_hashes_clash(spark, monkeypatch, rows):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    monkeypatch.setattr(exact_dedup, "BLOCK", 64)
    some = spark.createDataFrame([(k, t) for k, t in enumerate(["aa", "aa", "bb", "c" * 64 + "dd", "c" * 64 + "dd", "c" * 64 + "ee"])], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(some).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/", big), (2, "http://b/", big), (3, "u", "short"), (4, "u", "short"), (5, None, None), (None, "n", big), (6, "x", "a\r\n\r\nWARC/1.1\r\nb" * 100), (3, "u", "short")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first long")
    path = f"file://{tmp_path}/w"
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, path).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = [(p or 0, len((h or "").encode()), sha(h), "revisit" if h == big and p != 2 else "response", 2 if h == big and p != 2 else None) for p, _, h in pages]
    assert got == sorted(expected)
    nested = warc.assemble(warc.read_archives(spark, path)).filter("response.type = 'response'").collect()
    assert all(hashlib.sha1(r.response.payload).hexdigest() == r.response.stored_digest and r.request and r.metadata for r in nested)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_warc_files_of_long_and_repeated_pages(spark, tmp_path, monkeypatch):
    import gzip
    import os

    rng = random.Random(2)
    long = "".join(chr(rng.randrange(33, 127)) for _ in range(1000)) * 50_000  # 50 MB
    pages = [(1, "u", long), (2, "u", long), (3, "u", "y" * 2000), (3, "u", "y" * 2000), (3, "v", "y" * 2000), (0, "w", "y" * 2000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string")
    path = str(tmp_path / "w")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df, f"file://{path}").collect())
    assert got == [(0, 2000, "revisit", 3), (1, 50_000_000, "revisit", 2), (2, 50_000_000, "response", None)] + [(3, 2000, "response", None)] * 3
    records = [r for f in os.listdir(path) if f.endswith(".gz") for r in warc.parse_records(open(f"{path}/{f}", "rb").read())]
    names = [h["warc-record-id"] for h, _ in records]
    assert len(names) == len(set(names)) == 18
    by = {h["warc-record-id"]: h for h, _ in records}
    assert all(by[h["warc-refers-to"]]["warc-type"] == "response" for h, _ in records if h["warc-type"] == "revisit")
    # one member a record, and no compression at all
    plain = b"".join(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"", b"a\r\n\r\nb"))
    members = b"".join(gzip.compress(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n") for b in (b"", b"a\r\n\r\nb"))
    assert [b for _, b in warc.parse_records(plain)] == [b for _, b in warc.parse_records(members)] == [b"", b"a\r\n\r\nb"]
    monkeypatch.setattr(warc, "CHUNK", 7)
    assert [b for _, b in warc.parse_records(members)] == [b"", b"a\r\n\r\nb"]


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                n, load = n + 1, 0
            load += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("ranges", [1 << 16, 16])
def test_sharding(docs, none, rows, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows)
    sizes, where = collections.Counter(), {}
    for _, text, *_ in rows:
        key = int(hashlib.sha256((text or "").encode()).hexdigest()[:15], 16)
        sizes[key] += len((text or "").encode()) + 8
        where.setdefault(zlib.crc32((text or "").encode()), key)
    loads = collections.Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) <= best_capacity([sizes[k] for k in sorted(sizes)], 4)
    placed = collections.defaultdict(set)
    for r in got:
        placed[where[r.text_crc32]].add(r.shard)
    assert all(len(s) == 1 for s in placed.values())
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none, 4).count() == 0


def test_decontaminate(spark, docs, none):
    item = "A train travels 60 miles in 3 hours with Alice and then 60 more miles on the way home to see Alice again today."
    texts = {
        1: "foo. " + item,
        2: "So. " + item.replace("60", "75").replace("Alice", "Robert").replace(" 3 ", " 9 "),
        3: "So. " + item.replace("60", "75", 1).replace("Alice", "Robert", 1),
        4: "the train goes on its way and nothing of this is ever asked anywhere",
        5: None,
        6: "",
        7: "Short item here",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(1, texts[1], "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item, 0), (9, item, 0), (8, "Short item here", 0), (10, None, 0)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    # text 3 has 14 words of the item unchanged, that is seven windows
    assert set(got) == {(1, 7), (2, 7), (3, 7), (7, 8)}
    assert got[1, 7].verbatim and not got[2, 7].verbatim and got[1, 7].item_copies == 2
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [4, 5, 6]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()


def test_decontaminate_counts_runs(spark):
    item = "A train travels 60 miles in 3 hours with Alice and then 60 more miles on the way home to see Alice again today."
    race = "In the long race the runner named Alice passed the other runner named Robert just before the very last bend."
    texts = {
        1: "So. " + item.replace("60", "75", 1).replace("Alice", "Robert", 1),  # 14 words at the end are verbatim
        2: "So. " + race.replace("Alice", "Carol").replace("Robert", "Carol"),
        3: "A train travels 75 miles in 9 hours with Robert and then 60 other things",  # no six windows agree
    }
    bench = spark.createDataFrame([(7, item), (8, race)], "item_id long, text string")
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(df.unionByName(df.filter("doc_id = 1").selectExpr("cast(null as long) doc_id", "text")), bench).collect()}
    assert set(got) == {(1, 7), (None, 7), (2, 8)} and not got[2, 8]
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [3]


def test_decontaminate_items_of_placeholders(spark):
    series = "1 2 3 5 8 13 21 34 55 89 144 233 377 610 987"
    names = "they met Alice, Robert, Carol, Victor, Diana, Edgar, Fiona, Gerald, Helen, Ivan, Julia, Karl"
    bench = spark.createDataFrame([(1, series), (2, names)], "item_id long, text string")
    texts = [f"The row {series} goes on.", "In town " + names + " and others.", "2 4 6 8 10 12 14 16 18 20 22 24 26 28 30", "1 2 3 5 8 13 21 34", "they met Carol, Alice, Robert, Diana, Victor, Fiona, Edgar, Helen, Gerald, Julia, Ivan, Karl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(0, 1), (1, 2)} and all(r.verbatim and r.n_windows == r.item_windows for r in got.values())


def test_decontaminate_short_items(spark):
    items = ["What is the capital of France and its river?", "Where does Alice live now?", "Is water wet?", "How many legs have 8 spiders?", "Why", "Did Anna, Bert, Carl, Dora or Emil call today?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = {
        0: "He asked us so What is the capital of France and its river? Nobody knew.",
        1: "the teacher asked where does alice live now and went on to other things",
        2: "The last question on the list was, is water wet? All of us laughed at it.",
        3: "One more time: how many legs have 6 spiders? That was all that was asked here.",
        4: "Why",
        5: "and then: did anna, bert, carl, dora or emil call today? no",
        6: "Where does the water of Alice live and how many legs does it have now, is it wet",
        7: "Where does Robert live now?",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 3): False, (4, 4): True, (5, 5): True, (7, 1): False}


def template_tokens(text):
    """Tokens as (mark, word), by the operator's documented rules."""
    text = regex.sub(r"[\p{Han}\p{Hiragana}\p{Katakana}]", r" \g<0> ", text or "")
    names = {m.start() for m in regex.finditer(r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+(?!\p{L})", text)}
    out = []
    for m in regex.finditer(r"\d+(?:[.,]\d+)*|\p{L}+", text):
        word = m[0].lower()
        mark = "#" if word[0].isdigit() else "^" if m.start() in names else "@" if out and out[-1][0] == "#" and word in decontaminate.UNITS else ""
        out.append((mark, word))
    return out


def contaminated(doc, item):
    d, i = template_tokens(doc), template_tokens(item)
    width = min(8, len(i))
    if not width:
        return False
    open_ = lambda w: tuple(m or x for m, x in w)
    slots = lambda w: [m + x if m else None for m, x in w]
    spots = {}  # shift -> item position -> (plain, {place: (item value, document value)})

    def hit(b, a, size, plain, valued):
        found = spots.setdefault(a - b, {}).setdefault(b, [False, {}])
        found[0] |= plain
        if valued:
            found[1].update({b + k: (v, w) for k, (v, w) in enumerate(zip(slots(i[b : b + size]), slots(d[a : a + size]), strict=True)) if v})

    literal = lambda b: sum(not m for m, _ in i[b : b + width])
    telling = [b for b in range(len(i) - width + 1) if literal(b) >= 5]
    for b in range(len(i) - width + 1):
        for a in range(len(d) - width + 1):
            x, y = i[b : b + width], d[a : a + width]
            if [w for _, w in x] == [w for _, w in y]:
                hit(b, a, width, True, False)
            if b in telling and literal(b) < width and open_(x) == open_(y):
                hit(b, a, width, slots(x) == slots(y), True)
    if len(i) < 8 and open_(i) == open_(d):
        hit(0, 0, len(i), slots(i) == slots(d), True)
    counted = {}
    for places in spots.values():
        values = {k: v for _, more in places.values() for k, v in more.items()}

        def agree(first, last, values=values):
            seen = {}
            return all(seen.setdefault(v, w) == w for k, (v, w) in values.items() if first <= k <= last)

        whole = agree(0, len(i))
        runs = [s for s in places if all(s + k in places for k in range(6)) and agree(s, s + 12)]
        for b, (plain, _) in places.items():
            if plain or whole or any(s <= b < s + 6 for s in runs):
                counted[b] = counted.get(b, False) or plain
    unchanged = sum(counted.values())
    templates = len({*telling, *([0] if len(i) < 8 else [])})
    return unchanged >= min(6, len(i) - width + 1) or bool(counted) and not all(counted.values()) and len(counted) >= min(6, templates)


@pytest.mark.parametrize("piece", [1 << 15, 9])
def test_decontaminate_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate, "FILTER_ROWS_LOG", 4)  # a filter that lets many others pass
    rng = random.Random(11)
    low = ["train", "goes", "from", "home", "to", "the", "river", "and", "sees", "a", "stone", "km", "hours", "miles"]
    names = ["Alice", "Robert", "Carol", "Diana"]
    chinese = "小明有三个苹果他给了朋友两个请问还剩下多少苹果呢"

    def sentence(n):
        return " ".join(rng.choice(names) if rng.random() < 0.15 else str(rng.randrange(9)) if rng.random() < 0.2 else rng.choice(low) for _ in range(n))

    items = [sentence(n) for n in (3, 5, 6, 7, 8, 9, 12, 14, 20, 30, 40)] + [chinese, chinese[:7]]

    def changed(text, share):
        swap = {n: rng.choice(names) for n in names} | {str(k): str(rng.randrange(9)) for k in range(9)}
        return " ".join(swap.get(w, w) if rng.random() < share else w for w in text.split(" "))

    texts = [None, "", "a", chinese, "标题 " + chinese + "。完"]
    for item in items:
        for share in (0, 0.1, 0.5, 1):
            texts += [changed(item, share), sentence(6) + " " + changed(item, share) + ". " + sentence(9), sentence(4) + " " + changed(item, share)[: len(item) * 2 // 3] + " " + sentence(3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    expected = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if contaminated(text, item)}
    assert got == expected and len(expected) > 40


def test_decontaminate_of_a_long_text(spark):
    item = "A train travels 60 miles in 3 hours with Alice and then 60 more miles on the way home to see Alice again today."
    text = "x " * 200_000 + item + " y" * 100_000
    got = decontaminate.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.verbatim, r.n_windows == r.item_windows) for r in got] == [(1, 2, True, True)]


def test_quality(spark, docs, none, rows):
    rng = random.Random(1)
    good = [(1000 + k, "\n".join(words(rng, 30).capitalize() + "." for _ in range(3))) for k in range(60)]
    bad = [(2000 + k, "\n".join("junk$$$ " * 20 for _ in range(3))) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    assert all((r.score >= 0.5) == (r.predicted == 1) == (d < 2000) for d, r in got.items())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_of_held_out_documents(spark):
    """The share of pairs of a good and a bad held-out document that the scores put in order."""
    path = "/root/testdata/sf0.1"
    if not os.path.exists(f"{path}/labels.parquet"):
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{path}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = (np.array([r.score for r in got if r.quality == q]) for q in (1, 0))
    assert len(good) > 500 and len(bad) > 100
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() > 0.98


def test_line_features_of_pieces_add_up(monkeypatch):
    rng = random.Random(5)
    texts = [words(rng, n) + "\n" + "x! " * n for n in (3, 500, 2000)] + ["", "\n\n"]
    whole, lines = quality.count_lines(texts, quality._powers())
    monkeypatch.setattr(quality, "CHUNK", 1 << 10)
    parts, again = quality.count_lines(texts, quality._powers())
    assert (lines == again).all() and whole.shape == parts.shape
    same = [quality.COUNTS.index(c) for c in ("n", "upper", "lower", "digit", "shout", "ends")]
    assert (whole[:, same] == parts[:, same]).all()


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    u, t = rng.normal(size=6), rng.normal(size=(2, 2))
    left, right = quality.forward_backward(u, np.array([4, 2]), t)
    p = 1 / (1 + np.exp(-(left + right)))
    for start, n in ((0, 4), (4, 2)):
        weight = np.zeros((n, 2))
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            s = sum(u[start + k] * y[k] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))
            for k in range(n):
                weight[k, y[k]] += np.exp(s)
        assert np.allclose(p[start : start + n], weight[:, 1] / weight.sum(1))


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [d for x, (d, _) in zip(label, rows, strict=True) if x == label[k] and d is not None]
        out.append((doc, len(sets[k]), min(ids, default=None) if sets[k] else doc))
    return sorted(out, key=str)


def test_jaccard_join(spark, docs, none, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()), key=str)
    assert got == linked([(r[0], r[1]) for r in rows])
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("trim(coalesce(text, '')) = ''").count() >= 4


def test_jaccard_join_of_edited_copies(spark, monkeypatch):
    rng = random.Random(9)
    base = [words(rng, n) for n in (6, 30, 80, 200)]
    some = []
    for k in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        some.append((k, " ".join(w[: len(w) - rng.randrange(3)])))
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 600)  # large clusters are joined in pairs of chunks
    monkeypatch.setattr(jaccard, "HOT_SHARE", 4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(some, "doc_id long, text string")).collect()), key=str)
    assert got == linked(some)


def test_jaccard_join_of_one_group_in_small_units(spark, monkeypatch):
    rng = random.Random(6)
    base = words(rng, 60).split()
    some = []
    for k in range(2000):  # near copies of one text, and a drifting chain of others
        w = list(base)
        w[rng.randrange(60)] = f"new{rng.randrange(500)}"
        some.append((k, " ".join(w)))
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(0, 60, 6), rng.randrange(2, 9)):
            w[at] = f"other{rng.randrange(30)}"
        some.append((3000 + k, " ".join(w)))
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 20_000)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(some, "doc_id long, text string")).collect()), key=str)
    assert got == linked(some)


def test_jaccard_clusters_by_chance_are_parted(spark, monkeypatch):
    rng = random.Random(7)
    shared = [[f"s{k}x{i}" for i in range(30)] for k in range(12)]
    some = []
    for d in range(60):  # 50 of 110 words are in other texts too, and every text leads to the next
        own = [f"w{d}x{i}" for i in range(60)]
        some.append((d, " ".join(own[:30] + shared[d % 12] + own[30:] + shared[(d + 1) % 12][:20])))
    for d in range(60, 70):  # near copies of texts inside that cluster
        words = some[d - 60][1].split()
        words[rng.randrange(10)] = "edited"
        some.append((d, " ".join(words)))
    units = []
    dealt = jaccard._dealt

    def seen(member):
        units.extend(r["count"] for r in member.groupBy("cluster").count().collect())
        return dealt(member)

    monkeypatch.setattr(jaccard, "_dealt", seen)
    monkeypatch.setattr(jaccard, "UNIT_TEXTS", 20, raising=False)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(some, "doc_id long, text string")).collect()), key=str)
    assert got == linked(some)
    assert sum(d != c for d, _, c in got) == 10
    assert max(units) < 20


def test_jaccard_join_where_hashes_clash(spark, monkeypatch, rows):
    some = [(r[0], r[1]) for r in rows if r[0] is not None]
    plain = sorted(map(tuple, jaccard.keep_one(spark.createDataFrame(some, "doc_id long, text string")).collect()), key=str)
    monkeypatch.setattr(jaccard, "_prints", lambda body: (F.pmod(F.length(body), F.lit(3)).cast("bigint"), F.xxhash64(F.lit(1), body)))
    table = spark.createDataFrame(some, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(table).collect()), key=str)
    assert got == linked(some)
    assert sorted(map(tuple, jaccard.keep_one(table).collect()), key=str) == plain


def test_runs_in_batches_of_any_size():
    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(200):
        rows = sorted((rng.randrange(6), rng.choice([0, 0, 1, 2]), rng.choice([10, 11, 14, 30, 31]), rng.randrange(5)) for _ in range(rng.randrange(1, 40)))  # token, salt, n, tid
        size = {}
        rows = [(t, s, size.setdefault((t, s, d), n), d) for t, s, n, d in rows]

        def batches(order, cut):
            for at in range(0, len(order), cut):
                t, s, n, d = zip(*order[at : at + cut], strict=True)
                ns = [(n << jaccard.SALT_BITS) + s for n, s in zip(n, s, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(d, pa.int64()), pa.array(ns, pa.int64())], names=["token", "tid", "ns"])

        cut = rng.randrange(1, 9)
        by_n = sorted(rows)
        got = [(r["token"], r["ns"] % 256, r["tid"], r["ns"] >> 8) for b in jaccard._repeated(batches(by_n, cut)) for r in b.to_pylist()]
        runs = collections.defaultdict(set)
        for t, s, n, d in rows:
            runs[t, s].add((d, n))
        near = lambda ds, d, n: any(e != d and 100 * min(m, n) >= 80 * max(m, n) for e, m in ds)
        assert sorted(got) == [(t, s, d, n) for (t, s), ds in sorted(runs.items()) for d, n in sorted(ds) if s or near(ds, d, n)]

        got = sorted(tuple(r.values()) for b in jaccard._chains(batches(by_n, cut)) for r in b.to_pylist())
        expected = []
        for (t, s), ds in runs.items():
            chains = []
            for d, n in sorted(ds, key=lambda x: (x[1], x[0])):
                if chains and 100 * chains[-1][-1][1] >= 80 * n:
                    chains[-1].append((d, n))
                else:
                    chains.append([(d, n)])
            kind = jaccard.ALONE if s == 0 and len(ds) == 2 else jaccard.MORE
            expected += [(*c[0], *x, kind) for c in chains for x in c[1:]]
            expected += [(*c[0], t, c[-1][1], jaccard.COVERS) for c in chains if s]
        assert got == sorted(expected)


def test_shingles_of_long_texts(monkeypatch):
    texts = [LONG, "a b c d e f", "", "y" * 3000 + " b c d e f"]
    whole = [s.tolist() for _, s in sorted(jaccard.Shingler()(texts), key=lambda x: x[0])]
    monkeypatch.setattr(jaccard, "CHUNK", 1 << 11)
    parts = [s.tolist() for _, s in sorted(jaccard.Shingler()(texts), key=lambda x: x[0])]
    assert whole[:3] == parts[:3] and len(parts[3]) == len(whole[3])
    assert len(whole[0]) == len(shingle_set(LONG))


def test_html_text(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div>
      <article><h1>Head &amp; line</h1><p>First   paragraph<br>goes <b>on</b>.<p>Short.<aside>Side</aside><form>Name <input></form><p>Last &#233;.</p></article>
      <section id="comments"><p>I like it</p></section><footer>&copy; 2020</footer>"""
    assert html_text.main_text(page) == "Head & line First paragraph goes on. Short. Last é."
    plain = "<body><div class=menu><a>A</a><a>B</a></div><div>" + "".join(f"<p>Paragraph {k} with enough words to be text.</p>" for k in range(4)) + "</div><div class='cookie-notice'>We use cookies</div>"
    assert html_text.main_text(plain) == " ".join(f"Paragraph {k} with enough words to be text." for k in range(4))
    df = spark.createDataFrame([(1, "u", page), (None, None, None), (2, "v", ""), (2, "v", "")], "page_id long, url string, html string")
    assert sorted(len(r.text) == r.n_chars for r in html_text.extract(df).collect()) == [True] * 4
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_text_after_parts_without_end():
    assert html_text.main_text('<article><p class="notice">x<p>First<p>Second</article>') == "First Second"
    assert html_text.main_text('<article><ul><li class="advert">x<li>One<li class="advert">y<li>Two</ul><p class="notice">z<h2>Head</h2>End</article>') == "One Two Head End"
    assert html_text.main_text('<article><div><p class="notice">x</div>Text<aside><p>no<p>no</aside> more</article>') == "Text more"


def test_html_text_keeps_short_runs_of_unmarked_pages():
    long = "".join(f"<p>Paragraph {k} with enough words to be text of the page.</p>" for k in range(6))
    part = lambda t: f"<p>{t}</p><div class='advert'>Buy</div>"
    page = "<body><div><a>Home</a><a>About</a></div><div class='advert'>Buy</div>" + part("It began in May.") + long + "<div class='advert'>Buy</div>" + part("Between") + long + "<div class='advert'>Buy</div>" + part("So it ended.") + "<div>Imprint</div>"
    got = html_text.main_text(page)
    assert got.startswith("It began in May. Paragraph 0") and " Between Paragraph 0" in got and got.endswith("page. So it ended.")


def test_html_text_of_wrapped_articles():
    text = lambda page: html_text.main_text(page)
    assert text('<div class="layout has-sidebar"><article><p>The text.</p></article><div class="sidebar">Other</div></div>') == "The text."
    assert text('<body><div id="page" class="header-fixed"><article><h1>Head</h1><p>The text.</p></article></div></body>') == "Head The text."
    assert text("<body><form><article><p>The text.</p></article></form></body>") == text("<body><form><p>The text.</p></form></body>") == "The text."
    assert text('<main><div class="social"><p>The text.</p></div></main>') == text('<body style="display:none"><p>The text.</p></body>') == "The text."
    assert text("<article><p>Short.</p><section id=comments>" + "<article class=comment><p>A long comment that goes on and on.</p></article>" * 9 + "</section></article>") == "Short."
    assert text("<article>Text of it<div class=ad>Buy these things now</div> goes on</article>") == "Text of it goes on"
    assert text("<article><header><h1>Head</h1></header><p>The text of it.</p></article>") == "The text of it."
    teaser = "<article>Teaser</article>"  # a mark without a surge doesn't make the article
    assert text(f"<body><div>{teaser * 2}</div><div class='ad'>x</div>" + "".join(f"<p>Paragraph {k} has enough words to be text of this page.</p>" for k in range(9)) + "</body>").startswith("Paragraph 0")


def test_html_text_takes_linear_time():
    import time

    for bad in ("<a ", '<a "', "<a b='", "<!--", "</script", "<script>", '<p class="x', "<div>", "<", '<a href=" <b', "<aside><p>", "<noscript><p>x</div>", "&amp", "<ul class=menu><li>x<p>"):
        began = time.process_time()
        html_text.main_text(bad * ((1 << 20) // len(bad)))
        assert time.process_time() - began < 20, bad
    long = "".join(f"<p>Paragraph {k} of a long page.</p>" for k in range(60_000))
    assert html_text.main_text(f"<article>{long}</article>").endswith("Paragraph 59999 of a long page.")


def line_blocks(blocks):
    """The text that stays of an unmarked page of blocks (kind, text), by plain definitions."""
    spaced = []
    for kind, text in blocks:
        spaced += [("gap", "")] * 3 if kind == "gap" else [(kind, text)]
    plain = [len(t) if kind == "text" else 0 for kind, t in spaced]
    whole = [len(t) for _, t in spaced]
    window = lambda sizes, k: sum(sizes[max(0, k) : k + 3])
    most = max([window(plain, k) for k in range(-2, len(spaced))], default=0)
    runs, k = [], 0
    while k < len(spaced):
        if spaced[k][0] == "gap":
            k += 1
            continue
        end = k
        while end < len(spaced) and spaced[end][0] != "gap":
            end += 1
        runs.append(range(k, end))
        k = end
    text = [sum(plain[k] for k in r) >= sum(whole[k] for k in r) / 2 and any(plain[k] for k in r) for r in runs]
    surge = [t and max(window(plain, k) for k in range(r[0] - 2, r[-1] + 1)) >= 0.15 * most for r, t in zip(runs, text, strict=True)]
    at = [k for k, s in enumerate(surge) if s]
    kept = [r for k, r in enumerate(runs) if text[k] and at and (at[0] <= k <= at[-1] or spaced[r[-1]][1].endswith("."))]
    return " ".join(spaced[k][1] for r in kept for k in r)


def test_html_text_against_line_blocks():
    rng = random.Random(4)
    for _ in range(300):
        blocks = []
        for k in range(rng.randrange(1, 14)):
            kind = rng.choice(["text", "text", "text", "link", "gap", "gap"])
            blocks.append((kind, f"{k} " + "word " * rng.choice([0, 1, 3, 30, 80]) + rng.choice(["end.", "end"])))
        # an advert makes a gap; its text is too little to be the page's
        page = "".join(f"<p>{t}</p>" if kind == "text" else f"<p><a href=x>{t}</a></p>" if kind == "link" else "<aside>-</aside>" for kind, t in blocks)
        if any(kind == "text" for kind, _ in blocks):
            assert html_text.main_text(f"<body>{page}</body>") == line_blocks(blocks), page


def test_html_text_beside_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article>One</article>", "x", 7)] * 2, "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "One", 3)] * 2


def line_digests(rows, least):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    found = collections.defaultdict(set)
    for doc, text in rows:
        for key in keys(text):
            if key:
                found[key].add((doc, text or ""))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x, key in zip(lines, keys(text), strict=True) if len(found[key]) < least]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, docs, none, rows):
    got = sorted((tuple(r) for r in line_dedup.digests(docs, least_docs=2).collect()), key=str)
    assert got == line_digests([(r[0], r[1]) for r in rows], 2)
    assert line_dedup.digests(none).count() == 0
    many = [(k, f"Common  \nown {k}\n\tcommon\nodd {k % 7}\n") for k in range(60)]
    got = sorted((tuple(r) for r in line_dedup.digests(spark.createDataFrame(many, "doc_id long, text string").repartition(5), least_docs=10).collect()), key=str)
    assert got == line_digests(many, 10)


def test_line_dedup_of_a_line_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROWS_HELD", 20)
    some = [(k, "often\n" * (200 if k < 2 else 1) + f"own {k}\n" + ("rare\n" * 90 if k < 5 else "")) for k in range(30)]
    for parts in (1, 4):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(parts)
        assert sorted((tuple(r) for r in line_dedup.digests(df, least_docs=10).collect()), key=str) == line_digests(some, 10)


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), window=128).collect()
    # of each document, its rows' ids: every piece is of one of them, and all of them are covered
    whole = collections.defaultdict(list)
    for doc, text, *_ in rows:
        whole[doc].append(t.encode(text or "", add_special_tokens=False).ids + [0])
    expected = collections.Counter((doc, len(ids)) for doc, many in whole.items() for ids in many)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    cut = collections.Counter()
    for doc, many in whole.items():
        for ids in many:
            cut.update((doc, len(ids), k, crc(ids[k : k + 128])) for k in range(0, len(ids), 128))
    assert collections.Counter((p.doc_id, p.doc_tokens, p.start, p.ids_crc32) for p in got) == cut
    total = sum(n * k for (_, n), k in expected.items())
    assert sum(p.length for p in got) == total
    by = collections.defaultdict(list)
    for p in got:
        by[p.sequence_id].append(p)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 128
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    encode = packing.Encoder(tokenizer_path())
    texts = ["", " ", "a b", " a", "a ", "a  b", "x\n\ny", "x\ny", "\n", "it's\tso", "don't 12,5 können wir", "日本 語　a", "<|endoftext|> a", "a <|endoftext|> b", "a b<|endoftext|>", "<|endoftext|><|endoftext|>\n\n<|endoftext|", "x<|endoftext|>y z", "a \nb", "Ａ\x85b\x1cc"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_patterns_use_every_length_once():
    rng = np.random.default_rng(2)
    counts = np.zeros(256, np.int64)
    counts[rng.integers(1, 256, 200)] += rng.integers(1, 40, 200)
    left = counts.copy()
    for times, lengths in packing.patterns(counts, 256):
        assert sum(lengths) <= 256
        for n in lengths:
            left[n] -= times
    assert not left.any()


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int("0246813579"[int(c)]) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark, docs, none):
    texts = [
        "card 4173893178530722 or 4173 8931 7853 0722, not 4173893178530723.",
        "call +1 (755) 555-9729 or (755) 555-9729, mail hsr.29@mail5.example.com and HSR.29@other.org",
        "born 2024-02-29 or 29/02/2024, not 2023-02-30; from 47.129.145.209, not 299.1.1.1; v 2.0; ssn 123-45-6789",
        None,
        "",
        "4173893178530722",
    ]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_found long")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    one, two, three = got[0].text, got[1].text, got[2].text
    card = re.search(r"\d{16}", one)[0]
    assert luhn(card) and card != "4173893178530722" and got[5].text == card
    assert re.sub(" ", "", re.search(r"\d{4} \d{4} \d{4} \d{4}", one)[0]) == card and "4173893178530723" in one
    phone = re.search(r"\+1 (\([2-9]\d\d\) [2-9]\d\d-\d{4}) or (\([2-9]\d\d\) [2-9]\d\d-\d{4})", two)
    assert phone and phone[1] == phone[2] != "(755) 555-9729"
    mails = re.findall(r"([a-z]{3}\.\d\d)@mail5\.example\.com|([A-Z]{3}\.\d\d)@other\.org", two)
    assert len(mails) == 2 and mails[0][0] != "hsr.29"
    assert "2023-02-30" in three and "299.1.1.1" in three and "v 2.0" in three and "123-45-6789" not in three and "47.129.145.209" not in three
    assert [got[k].n_found for k in range(6)] == [2, 4, 4, 0, 0, 1] and got[3].text is None and got[4].text == ""
    assert pii.pseudonymise(none, "k").count() == 0 and pii.pseudonymise(docs, "k").count() == docs.count()


def test_pseudonyms_are_a_permutation(spark):
    dates = [f"2000-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    phones = [f"(212) 555-{k:04d}" for k in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(dates + phones)], "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(df, "key").collect()]
    assert len(set(out)) == len(out)


def test_pseudonyms_of_all_phone_numbers(spark):
    phones = [f"+1 ({a:03d}) {e:03d}-{n:04d}" for a in (0, 17, 199, 200, 755, 999) for e in (0, 99, 199, 200, 555, 999) for n in (0, 7713, 9999)]
    df = spark.createDataFrame(list(enumerate(phones)), "doc_id long, text string")
    out = [r for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    assert all(r.n_found == 1 and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", r.text) for r in out)
    assert len({r.text for r in out}) == len(out) and all(r.text != p for r, p in zip(out, phones, strict=True))
    valid = lambda p: p[4] >= "2" and p[9] >= "2"
    assert [valid(r.text) for r in out] == [valid(p) for p in phones]


def test_pseudonyms_do_not_depend_on_other_text(spark):
    df = spark.createDataFrame([(0, "ask 8.8.8.8 first"), (1, "ask 8.8.8.8 first, 22 times"), (2, "1.1.1.1")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    assert [got[k].n_found for k in range(3)] == [1, 1, 1] and got[2].text != "1.1.1.1"
    assert "8.8.8.8" not in got[0].text and got[1].text == got[0].text + ", 22 times"


def feistel(kind, rank, a, b, key):
    """The image of a rank, by the documented network."""
    left, right = divmod(rank, b)
    for i in range(10):
        f = lambda v, i=i: int(hashlib.sha256(f"{key}|{kind}|{i}|{v}".encode()).hexdigest()[:13], 16)
        if i % 2 == 0:
            left = (left + f(right)) % a
        else:
            right = (right + f(left)) % b
    return left * b + right


def test_pseudonyms_against_a_plain_network(spark):
    import datetime

    rng = random.Random(12)
    first = datetime.date(1800, 1, 1)
    days = [first + datetime.timedelta(k) for k in range(146097)]
    late = [d for d in days if d.day > 12]
    plain, expected = [], []

    def add(value, image):
        plain.append(value)
        expected.append(image)

    for _ in range(40):
        n = rng.randrange(10**9)
        x = f"{feistel('ssn', n, 10**5, 10**4, 'key'):09d}"
        add(f"{n // 10**6:03d}-{n // 10**4 % 100:02d}-{n % 10**4:04d}", f"{x[:3]}-{x[3:5]}-{x[5:]}")
        ip = rng.randrange(2**32)
        dots = lambda v: ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
        add(dots(ip), dots(feistel("ipv4", ip, 65536, 65536, "key")))
        k = rng.randrange(len(days))
        d, e = days[k], days[feistel("date", k, 189, 773, "key")]
        add(d.isoformat(), e.isoformat())
        add(f"{d.day:02d}.{d.month:02d}.{d.year}", f"{e.day:02d}.{e.month:02d}.{e.year}")
        k = rng.randrange(len(late))
        d, e = late[k], late[feistel("date-late", k, 9, 9833, "key")]
        add(f"{d.month:02d}/{d.day:02d}/{d.year}", f"{e.month:02d}/{e.day:02d}/{e.year}")
        body = f"{rng.randrange(10**15):015d}"
        check = lambda t: next(c for c in "0123456789" if luhn(t + c))
        new = f"{feistel('card', int(body), 10**8, 10**7, 'key'):015d}"
        add(body + check(body), new + check(new))
        area, exchange, line = rng.randrange(200, 1000), rng.randrange(200, 1000), rng.randrange(10**4)
        v = feistel("phone", ((area - 200) * 800 + exchange - 200) * 10**4 + line, 80000, 80000, "key")
        add(f"({area}) {exchange}-{line:04d}", f"({200 + v // 8_000_000}) {200 + v // 10**4 % 800}-{v % 10**4:04d}")
        n = rng.randrange(10**10)
        new = f"{feistel('plus', n, 10**5, 10**5, 'key'):010d}"
        add(f"+44{n:010d}", f"+44{new}")
    df = spark.createDataFrame([(k, f"see {p}, and more") for k, p in enumerate(plain)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "key").collect()}
    assert [got[k] for k in range(len(plain))] == [f"see {e}, and more" for e in expected]


def test_pseudonyms_of_other_formats(spark):
    mod97 = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
    values = ["3782 822463 10005", "3782-822463-10005", "378282246310005", "+44 20 7946 0958", "+442079460958", "+1 (212) 555-0199", "+12125550199",
              "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329", "fe80::1:2", "12/25/1980", "a@b.example.com", "7@b.example.com"]
    kept = ["3782 822463 10006", "DE88 3704 0044 0532 0130 00", "std::vector", "12:30:45", "13/32/1980", "+1 23 45", "A::B", "_@b.example.com"]
    df = spark.createDataFrame([(k, f"is {v} there") for k, v in enumerate(values + kept)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    out = [got[k].text[3:-6] for k in range(len(values))]
    assert all(got[k].n_found == 1 and o != v for k, (o, v) in enumerate(zip(out, values, strict=True)))
    assert all(got[len(values) + k].text == f"is {v} there" for k, v in enumerate(kept))
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(out[0]) == digits(out[1]) == out[2] and luhn(out[2]) and re.fullmatch(r"\d{4} \d{6} \d{5}", out[0])
    assert digits(out[3]) == digits(out[4]) and out[3].startswith("+44 ") and re.fullmatch(r"\+\d\d \d\d \d{4} \d{4}", out[3])
    assert digits(out[5]) == digits(out[6])
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", out[7]) and mod97(out[7].replace(" ", "")) == 1
    assert re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", out[8]) and mod97(out[8]) == 1
    assert out[9] == out[10] and re.fullmatch(r"([0-9a-f]{4}:){7}[0-9a-f]{4}", out[9])
    assert 12 < int(out[12][3:5]) and re.fullmatch(r"\d\d/\d\d/\d{4}", out[12])
    assert re.fullmatch(r"[a-z]@b.example.com", out[13]) and re.fullmatch(r"\d@b.example.com", out[14])


def test_pseudonyms_in_a_long_text(spark):
    text = "word " * 200_000 + "4173893178530722" + " word" * 200_000
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").collect()
    assert got[0].n_found == 1 and len(got[0].text) == len(text) and "4173893178530722" not in got[0].text


def test_pseudonyms_of_single_letters_never_stay(spark):
    some = [f"{c}@x{k}.org" for k in range(40) for c in "az09Q"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    assert all(g != v and g[1:] == v[1:] for g, v in zip(got, some, strict=True))
    letters = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    out = pii.pseudonymise(spark.createDataFrame(list(enumerate(letters)), "doc_id long, text string"), "key").select("text").distinct()
    assert out.count() == 26


def test_sharding_totals_of_texts_with_one_checksum(spark, tmp_path):
    """Two different texts of one size and CRC-32 in two shards aren't equal texts apart."""
    import hashlib
    import random
    import zlib

    from weftgraph.llm import queries

    rng, seen, pairs = random.Random(1), {}, []
    for _ in range(400_000):
        t = "".join(rng.choices("abcdefghijklmnop", k=12))
        if (other := seen.setdefault(zlib.crc32(t.encode()), t)) != t:
            pairs.append((other, t))
    place = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:8], 16)
    texts = [x for p in sorted(pairs, key=lambda p: -abs(place(p[0]) - place(p[1])))[:2] for x in p]
    texts += [f"text {k}" for k in range(100)] + texts[:1] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.op3_sharding(spark, f"file://{tmp_path}")
    shards = {r.doc_id: r.shard for r in rows.collect()}
    assert shards[0] != shards[1] and shards[0] == shards[104] and "text_key" not in rows.columns
    got = queries.sharding_totals(spark, f"file://{tmp_path}").first()
    assert tuple(got) == (len(texts), sum(len(t or "") + 8 for t in texts), 24, True, True, True)
