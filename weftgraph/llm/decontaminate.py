"""Benchmark decontamination by template windows, in DataFrame operations only.

Both sides are tokenised and canonicalised: numbers become ``#``, a unit after a
number becomes ``@``, and a capitalised word inside a sentence (after a lower-case
letter, digit, comma or semicolon and a space) becomes ``^`` (name). Units are English
ones and symbols. Letters of scripts without spaces are words of their own. Windows of eight lower-case words, and windows of eight template tokens, are
hashed and joined. Windows with the item's own words always count. Windows with
changed slots count if they have five literal tokens or more and are consistent,
that is, one item value stands for one document value: over the whole alignment of
document and item, or over six windows in a row. A pair is contaminated if at least
six different item windows (13 words in a row), or all windows of a shorter item,
count; where slots are changed, all templates with five literals if there are fewer
than six of them. So verbatim copies and re-parameterised ones are both found, but
an item without a template of five literals only if its words are unchanged. Items
of fewer than eight words are looked for by windows as long as they are.

The plan is one at every size: hashes of document windows pass a filter of bits of the
items' hashes, of a fixed size; what passes is shuffled with its slots and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import Staged, text_or_empty

WIDTH = 8
LEAST_WINDOWS = 6
LEAST_LITERALS = 5
# Tokens of one piece of a text: what is held at once of a text of any length.
PIECE = 1 << 15
# The filter of item windows is a table of at most 2 ** FILTER_ROWS_LOG rows of 64 bits (16 MB), whatever the benchmark's size.
FILTER_ROWS_LOG = 20
# Each item window meets the documents in so many tasks: one passage may be in a third of all texts.
SALTS = 16

# Patterns and units.
NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;] \p{Lu})[\p{Ll}\p{M}]+(?!\p{L})"
TOKEN = r"\d+(?:[.,]\d+)*|\^?[\p{L}\p{M}]+"
SOLID = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*"
MAYBE_SOLID = r"[^\x00-\u0DFF]"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons tonne tonnes oz lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent degree degrees celsius fahrenheit kelvin dollar dollars euro euros cent cents usd eur "
    "mph kmh hz khz mhz ghz w kw mw v volt volts a amp amps j joule joules n newton newtons pa bar kb mb gb tb bit bits byte bytes"
).split()


def _let(value, body):
    """``body`` of a value that is computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tokens(body):
    """Lower-case tokens of a text, names marked by a leading ``^``; scripts without spaces give a token for each letter."""
    spaced = F.when(body.rlike(MAYBE_SOLID), F.regexp_replace(body, SOLID, " $0 ")).otherwise(body)
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.translate(spaced, "^", " "), NAME, "^$0")), F.lit(TOKEN), F.lit(0))


def _number(w):
    return (w >= "0") & (w < ":")  # by its first byte


def _marked(w):
    """Whether a token is a placeholder's: marks sort before all letters."""
    return w < "a"


def _tagged(tokens):
    """Tokens with numbers marked by ``#`` and units after a number by ``@``."""
    units = F.array(*[F.lit(u) for u in UNITS])
    before = lambda i: F.coalesce(F.get(tokens, i - 1), F.lit(""))
    return F.transform(tokens, lambda w, i: F.when(_number(w), F.concat(F.lit("#"), w)).when((i > 0) & _number(before(i)) & F.array_contains(units, w), F.concat(F.lit("@"), w)).otherwise(w))


def _hashes(tokens, width: int):
    """The hash of each window of ``width`` of the token hashes; none where there are fewer."""

    def wider(h, have):
        if have == width:
            return F.slice(h, F.lit(1), F.size(h) - (width - 1))
        step = min(have, width - have)
        pairs = F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
        return _let(pairs, lambda g: wider(g, have + step))

    return F.when(F.size(tokens) >= width, wider(tokens, 1)).otherwise(F.array().cast("array<bigint>"))


def _filter_bits(h):
    """(row, bit) of a hash in the filter."""
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << FILTER_ROWS_LOG) - 1)), h.bitwiseAND(F.lit(63)).cast("int")


def _filter_of(hashes: DataFrame) -> DataFrame:
    """f_row, f_bits: the hashes of column h as a table of bits, of at most 2 ** FILTER_ROWS_LOG rows."""
    row, bit = _filter_bits(F.col("h"))
    return hashes.groupBy(row.alias("f_row")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("f_bits"))


def _windows(df: DataFrame, keep: list[str], widths: list[int], known: DataFrame | None = None) -> DataFrame:
    """Rows ``keep``, n, pos, width, template, h, slots: one for each window of the column ``body``, of its words and of its template.

    n is the number of tokens of the text. slots has kind and value of a template window's
    placeholders and nulls for its other tokens; it is null in windows of words.
    Texts without any placeholder have windows of words only. The template of a
    text of fewer than WIDTH tokens is a window of width 0 besides. With ``known``
    (:func:`_filter_of`) only windows that it lets pass come out.

    Hashes alone are exploded, from pieces of a text; slots are cut out of the tokens for what passes.
    The outer form keeps the optimiser from computing all hashes once more in a filter of empty arrays.
    """
    rows = df.select(*keep, "body", _tokens(F.col("body")).alias("t"))
    rows = rows.select(*keep, F.size("t").alias("n"), F.when(F.col("body").rlike("[0-9]"), _tagged(F.col("t"))).otherwise(F.col("t")).alias("t"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.when(F.col("n") <= PIECE, F.array("t")).otherwise(F.transform(starts, lambda s: F.slice(F.col("t"), s + 1, F.lit(PIECE + WIDTH - 1))))
    rows = rows.select(*keep, "n", F.posexplode_outer(pieces).alias("piece", "t"))
    literal = F.transform("t", lambda w: F.xxhash64(F.when(_marked(w), F.substring(w, 2, 1 << 30)).otherwise(w)))
    open_ = F.transform("t", lambda w: F.xxhash64(F.when(_marked(w), F.substring(w, 1, 1)).otherwise(w)))
    rows = rows.select(*keep, "n", "piece", "t", F.size("t").alias("size"), F.exists("t", _marked).alias("open"), literal.alias("words"))
    none = F.array().cast("array<bigint>")
    whole = F.when(F.col("n").between(1, WIDTH - 1), _let(open_, lambda t: F.array(F.xxhash64(F.lit("whole"), F.array_join(F.transform(t, lambda x: x.cast("string")), " "))))).otherwise(none)
    wide = [w for w in widths if w >= LEAST_LITERALS]
    templates = F.when(F.col("open"), _let(open_, lambda t: F.concat(none, *[_hashes(t, w) for w in wide]))).otherwise(none)
    rows = rows.select(*keep, "n", "piece", "t", "size", "open", F.concat(*[_hashes(F.col("words"), w) for w in widths], templates, whole).alias("all"))
    rows = rows.select(*keep, "n", "piece", "t", "size", "open", F.posexplode_outer("all").alias("at", "h")).filter("at is not null")
    if known is not None:
        row, bit = _filter_bits(F.col("h"))
        rows = rows.withColumn("f_row", row).join(F.broadcast(known), "f_row").filter(F.call_function("shiftrightunsigned", F.col("f_bits"), bit).bitwiseAND(F.lit(1)) == 1)
    # which of the arrays a place belongs to, by their sizes
    end, ends = F.lit(0), []
    for w, is_template in [*((w, False) for w in widths), *((w, True) for w in wide)]:
        size = F.greatest(F.col("size") - (w - 1), F.lit(0))
        begin, end = end, end + (F.when(F.col("open"), size).otherwise(0) if is_template else size)
        ends.append((w, is_template, begin, end))
    width, first, template = F.lit(0), end, F.lit(True)  # behind them all: the template as a whole
    for w, is_template, begin, end in reversed(ends):
        here = F.col("at") < end
        width, first, template = F.when(here, w).otherwise(width), F.when(here, begin).otherwise(first), F.when(here, is_template).otherwise(template)
    rows = rows.select(*keep, "n", "piece", "t", (F.col("at") - first).alias("local"), width.alias("width"), template.alias("template"), "h")
    cut = F.slice("t", F.col("local") + 1, F.when(F.col("width") == 0, F.greatest(F.col("n"), F.lit(1))).otherwise(F.col("width")))
    slots = F.when(F.col("template"), F.transform(cut, lambda w: F.when(_marked(w), w)))
    return rows.select(*keep, "n", (F.col("piece") * PIECE + F.col("local")).alias("pos"), "width", "template", "h", slots.alias("slots"))


def _items(bench: DataFrame, item_id: str, text: str) -> DataFrame:
    body = text_or_empty(bench, text)
    items = bench.select(bench[item_id].alias("item_id"), body.alias("body"))
    # copies of an item are searched once, under their smallest id
    return items.groupBy("body").agg(F.min("item_id").alias("item_id"), F.count("*").alias("item_copies"))


def _alike(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join on ``columns``, nulls being equal; the columns of ``left``, then the others of ``right``."""
    renamed = right.select(*[F.col(c).alias(f"r_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    on = [left[c].eqNullSafe(renamed[f"r_{c}"]) for c in columns]
    return left.join(renamed, on, how).drop(*[f"r_{c}" for c in columns])


def _counted(hits: DataFrame, about: list[str]) -> DataFrame:
    """doc_id, text_hash, item_id, shift, item_pos, plain, ``about`` of the windows that count.

    A window without changed slots (plain) always counts. Others count where an
    item value stands for one document value: in the whole alignment, or else in
    LEAST_WINDOWS windows in a row around the window.
    """
    key = ["doc_id", "text_hash", "item_id", "shift"]
    windows = hits.groupBy(*key, "item_pos", *about).agg(F.max(F.col("item_slots").eqNullSafe(F.col("slots")) | F.col("item_slots").isNull()).alias("plain"))
    at = F.posexplode(F.arrays_zip("item_slots", "slots")).alias("at", "slot")
    filled = hits.filter("item_slots is not null").select(*key, "item_pos", at).filter("slot.item_slots is not null")
    filled = filled.select(*key, (F.col("item_pos") + F.col("at")).alias("item_at"), F.col("slot.item_slots").alias("item_value"), F.col("slot.slots").alias("doc_value")).distinct()
    # if two places of one item value differ in the document, so do two next to each other
    each = Window.partitionBy(*key, "item_value").orderBy("item_at")
    before = filled.withColumn("last_at", F.lag("item_at").over(each)).withColumn("last_value", F.lag("doc_value").over(each))
    breaks = before.filter("last_value <> doc_value").select(*key, "last_at", "item_at")
    judged = _alike(windows, breaks.select(*key).distinct().withColumn("broken", F.lit(True)), key, "left").withColumn("broken", F.coalesce("broken", F.lit(False)))

    ahead = Window.partitionBy(*key).orderBy("item_pos").rangeBetween(0, LEAST_WINDOWS - 1)
    starts = judged.filter("broken").withColumn("n", F.count("*").over(ahead)).filter(F.col("n") == LEAST_WINDOWS).select(*key, F.col("item_pos").alias("start"))
    first = F.col("item_at") - (WIDTH + LEAST_WINDOWS - 2)  # of the runs that hold both places
    bad = breaks.filter(first <= F.col("last_at")).select(*key, F.explode(F.sequence(first, F.col("last_at"))).alias("start")).distinct()
    whole = _alike(starts, bad, [*key, "start"], "left_anti")
    whole = whole.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + (LEAST_WINDOWS - 1))).alias("item_pos")).distinct().withColumn("run", F.lit(True))
    return _alike(judged, whole, [*key, "item_pos"], "left").filter(F.col("plain") | ~F.col("broken") | F.coalesce("run", F.lit(False))).select(*key, "item_pos", "plain", *about)


def contaminated(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of contaminated document and benchmark item.

    Columns: doc_id, text_hash (xxhash64 of the text, to tell rows with one id
    apart), item_id (the smallest id among equal items), item_copies, n_windows
    (item windows that count), n_unchanged (those with the item's own words), item_windows,
    verbatim (none of them has a changed slot).
    Null and empty texts, and items without a word, match nothing. An item of
    fewer than eight words is one window, found inside longer texts too; with
    changed slots it is found there if it has five literals, else only in a text
    that is the item and nothing else. Rows repeated in id and text
    count once; null ids are kept. Other columns don't matter.
    """
    body = text_or_empty(docs, text)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    items = Staged(_items(bench, item_id, item_text), "bench-items").df
    marks = _windows(items, ["item_id", "item_copies"], list(range(1, WIDTH + 1))).filter(F.col("width").isin(0, F.least(F.lit(WIDTH), F.col("n"))))
    marks = marks.select("item_id", "item_copies", F.col("pos").alias("item_pos"), "width", "template", "h", F.col("slots").alias("item_slots"))
    open_ = F.size(F.filter("item_slots", lambda s: s.isNotNull()))
    # a template of few literals tells nothing; its words are still looked for
    marks = marks.withColumn("telling", (F.size("item_slots") - open_ >= LEAST_LITERALS) | (F.col("width") == 0)).withColumn("open", open_ > 0)
    marks = Staged(marks, "bench-windows").df
    words = F.countDistinct(F.when(F.col("item_slots").isNull(), F.col("item_pos"))).alias("item_windows")
    templates = F.countDistinct(F.when(F.col("telling"), F.col("item_pos"))).alias("templates")
    sizes = marks.groupBy("item_id").agg(words, templates)
    marks = marks.filter("not template or telling and (open or width = 0)").drop("telling", "open").join(sizes, "item_id")
    marks = Staged(marks, "bench-marks").df
    widths = sorted({WIDTH, *(r.width for r in marks.select("width").distinct().collect() if r.width)})  # WIDTH rows at most
    found = _windows(rows, ["doc_id", "text_hash"], widths, _filter_of(marks.select("h"))).drop("n")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)))
    side = marks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))).hint("merge")
    hits = found.join(side, ["h", "salt", "width", "template"])
    hits = hits.select("doc_id", "text_hash", "item_id", "item_copies", "item_windows", "templates", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "slots", "item_slots")
    hits = Staged(hits.distinct(), "bench-hits").df
    about = ["item_copies", "item_windows", "templates"]  # of the item
    unchanged = F.countDistinct(F.when(F.col("plain"), F.col("item_pos"))).alias("unchanged")
    scored = _counted(hits, about).groupBy("doc_id", "text_hash", "item_id", *about).agg(F.countDistinct("item_pos").alias("n_windows"), unchanged, F.min("plain").alias("verbatim"))
    enough = F.col("unchanged") >= F.least(F.lit(LEAST_WINDOWS), F.col("item_windows"))
    enough = enough | (~F.col("verbatim") & (F.col("n_windows") >= F.least(F.lit(LEAST_WINDOWS), F.col("templates"))))
    return scored.filter(enough).select("doc_id", "text_hash", "item_id", "item_copies", "n_windows", F.col("unchanged").alias("n_unchanged"), "item_windows", "verbatim")


def clean(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item."""
    found = contaminated(docs, bench, doc_id, text).select(F.col("doc_id").alias("__w_id"), F.col("text_hash").alias("__w_hash")).distinct()
    body = text_or_empty(docs, text)
    return docs.join(found, docs[doc_id].eqNullSafe(found["__w_id"]) & (F.xxhash64(body) == found["__w_hash"]), "left_anti")
