"""Text functions as column expressions, and the stemmer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.model import STOPWORDS

TOKEN = r"[\p{L}\p{N}]+"
# Characters of scripts; punctuation, digits and white space don't count.
IGNORED = r"[\s\x00-\x40\x5b-\x60\x7b-\x7f\p{Nd}]"
CJK = r"[\x{3000}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{ac00}-\x{d7af}]"
CYRILLIC = r"[\x{0400}-\x{04ff}]"
LATIN = r"[\x{0000}-\x{024f}]"


def search_terms(query: Column) -> Column:
    """Lower-case words of more than two characters that aren't stopwords; punctuation stays."""
    words = F.split(F.trim(F.lower(query)), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def term_frequency(words: Column, term: list[str]) -> Column:
    """How often a term, or a phrase of several tokens, stands in an array of tokens."""
    if len(term) == 1:
        return F.size(F.filter(words, lambda w: w == term[0]))
    phrase = F.array(*[F.lit(t) for t in term])
    starts = F.filter(F.transform(words, lambda w, i: i), lambda i: F.slice(words, i + 1, F.lit(len(term))) == phrase)
    return F.size(starts)


def script_counts(text: Column) -> dict[str, Column]:
    """latin, cjk, cyrillic and other characters of a text."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")
    kept = lambda s, pattern: F.length(s) - F.length(F.regexp_replace(s, pattern, ""))
    cjk, cyrillic, latin = kept(plain, CJK), kept(plain, CYRILLIC), kept(plain, LATIN)
    return {"latin": latin, "cjk": cjk, "cyrillic": cyrillic, "other": F.length(plain) - latin - cjk - cyrillic}


def language_decisions(docs: DataFrame, group: str, id_: str, text: str, most: int = 200) -> DataFrame:
    """group, latin, foreign, decision: English or not, by the scripts of each group's ``most`` documents of smallest id.

    English has no foreign letters or, with fewer than ten of them, nine tenths
    of Latin ones. Each task keeps its first ids of a group, so no group gathers in one.
    """
    rank = F.dense_rank().over(Window.partitionBy(group).orderBy(id_))
    some = docs.select(group, id_).withColumn("k", rank).filter(F.col("k") <= most).select(group, id_).distinct()
    counts = script_counts(F.col(text))
    rows = docs.join(F.broadcast(some), [group, id_]).select(group, *[c.alias(n) for n, c in counts.items()])  # most ids a group
    sums = rows.groupBy(group).agg(F.sum("latin").alias("latin"), F.sum(F.col("cjk") + F.col("cyrillic") + F.col("other")).alias("foreign"))
    english = (F.col("latin") + F.col("foreign") == 0) | ((F.col("latin") / (F.col("latin") + F.col("foreign")) >= 0.9) & (F.col("foreign") < 10))
    return sums.select(group, "latin", "foreign", F.when(english, "en").otherwise("multilingual").alias("decision"))


def embedding_text(label: Column, signature: Column, docstring: Column, snippet: Column) -> Column:
    """Label, signature and docstring (else the first 300 characters of the snippet), at most 1,500 characters."""
    empty = lambda c: F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(c)
    return F.substring(F.concat_ws(" ", empty(label), empty(signature), F.coalesce(empty(docstring), F.substring(empty(snippet), 1, 300))), 1, 1500)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


class Porter:
    """Porter's stemmer (1980)."""

    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    def _vowel(self, w: str, i: int) -> bool:
        return w[i] in "aeiou" or w[i] == "y" and i > 0 and not self._vowel(w, i - 1)

    def _measure(self, w: str) -> int:
        shape = "".join("v" if self._vowel(w, i) else "c" for i in range(len(w)))
        return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:], strict=False))

    def _has_vowel(self, w: str) -> bool:
        return any(self._vowel(w, i) for i in range(len(w)))

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and not self._vowel(w, len(w) - 1)

    def _cvc(self, w: str) -> bool:
        n = len(w)
        return n > 2 and not self._vowel(w, n - 3) and self._vowel(w, n - 2) and not self._vowel(w, n - 1) and w[-1] not in "wxy"

    def __call__(self, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith("s"):
            if w.endswith(("sses", "ies")):
                w = w[:-2]
            elif not w.endswith("ss"):
                w = w[:-1]
        if w.endswith("eed"):
            if self._measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and self._has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self._measure(w) == 1 and self._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and self._has_vowel(w[:-1]):
            w = w[:-1] + "i"
        for rules in (self.STEP2, self.STEP3):
            for end, new in sorted(rules, key=lambda r: -len(r[0])):
                if w.endswith(end):
                    if self._measure(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + new
                    break
        for end in sorted([*self.STEP4, "ion"], key=lambda e: -len(e)):
            if w.endswith(end):
                stem = w[: -len(end)]
                if self._measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e"):
            m = self._measure(w[:-1])
            if m > 1 or m == 1 and not self._cvc(w[:-1]):
                w = w[:-1]
        if w.endswith("ll") and self._measure(w) > 1:
            w = w[:-1]
        return w


def stemmed(words: Column) -> Column:
    """Stems of an array of tokens, a batch at a time; distinct words of a batch are stemmed once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stem, known = Porter(), {}
        for batch in batches:
            for row in batch:
                for w in row:
                    if w not in known:
                        known[w] = stem(w)
            yield pd.Series([[known[w] for w in row] for row in batch])
            if len(known) > 500_000:
                known.clear()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(words)
