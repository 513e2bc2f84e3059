"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines: every block element starts a new line, and parts that
look unlike an article (menu, header, footer, form, advert, comments and so on, by
element, class, id or role) are noted with the lines they hold. A part that holds the
marked article, or most of the unlinked text around it, is no such part, whatever it is called;
the others leave a gap of empty lines as wide as the window.

Text lengths, without the text of links, are summed over a sliding window of lines. A
run of lines begins where the sum leaves zero and ends where it falls back to zero
(the dive point). It surges if a window in it reaches ``LEAST_SHARE`` of the page's densest
window. If the article or main part that the page marks has a surge, the text is all runs
inside the marks. Else it is the runs from the first to the last surge, without those that
are mostly links, and runs before and after them that end like a sentence.

A ``header`` inside an article is a header: it goes, with a heading in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
LEAST_SHARE = 0.15
MOST_LINKED = 0.5
# A part stays that has more than this share of the text around it, on a window of lines or more, or nearly all of it.
MOST_OF_SCOPE = 0.5
NEARLY_ALL = 0.8
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")

# Elements and words that mark parts.
RAW = ("script", "style", "textarea", "title", "xmp", "noframes", "iframe", "noembed")
NO_TEXT = {"head", "noscript", "template", "svg", "math", "canvas", "object", "embed", "audio", "video", "map", "button", "select"}
PARTS = {"nav", "header", "footer", "aside", "form", "label", "fieldset", "dialog", "menu"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "ruby", "rb", "rt", "rp",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PART_WORDS = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side-bar widget widgets header masthead footer foot comment comments reply replies discussion disqus cookie cookies consent gdpr notice notices notification "
    "popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended toolbar pagination pager skip-link copyright legal disclaimer"
).split()
COMMENT_WORDS = "comment comments reply replies discussion disqus".split()
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
MARKS = ("article", "main")
NEVER_PARTS = {"html", "body", "main"}
# An end of one of these can be left out: the start of one of those closes it.
IMPLIED = {
    "p": set("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
# Attributes of a well-formed tag; nothing here crosses a < or >, so each character is looked at a bounded number of times.
PLAIN = re.compile(r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|(?=[^\s\"'<>]))|=(?=\s*+[/>]))*+>")
STOP = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _words(words: list[str]) -> re.Pattern:
    return re.compile(r"(?:^|[\s_-])(?:" + "|".join(words) + r")(?:$|[\s_-])", re.I)


PART, COMMENT = _words(PART_WORDS), _words(COMMENT_WORDS)


def _tag_end(page: str, at: int) -> tuple[int, int]:
    """(end of the attributes, where to go on) of a tag whose name ends at ``at``; a < outside quotes ends it too."""
    plain = PLAIN.match(page, at)
    if plain:
        return plain.end() - 1, plain.end()
    pos = at
    while True:
        m = STOP.search(page, pos)
        if not m:
            return len(page), len(page)
        if m[0] == ">":
            return m.start(), m.end()
        if m[0] == "<":
            return m.start(), m.start()
        pos = m.end()
        before = page[max(at, m.start() - 8) : m.start()].rstrip()
        if before.endswith("="):  # elsewhere a quote is no more than a character
            close = page.find(m[0], pos)
            if close < 0:
                return len(page), len(page)
            pos = close + 1


def _kind(name: str, attributes: str) -> str | None:
    """Whether an element may be no part of an article: ``part``, ``comments`` or None."""
    kind = "part" if name in PARTS else None
    if not attributes or name in NEVER_PARTS:
        return kind
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if COMMENT.search(value):
                return "comments"
            if name not in MARKS and PART.search(value):
                kind = "part"
        elif name in MARKS:
            continue
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            kind = "part"
        elif key == "style" and HIDDEN.search(value):
            kind = "part"
    return kind


@dataclass
class Part:
    """Lines first to last - 1 of an element; above: index of the part around it; marked: an article or main begins in it."""

    kind: str
    first: int
    above: int
    depth: int  # of marks around it
    last: int = -1
    marked: bool = False


@dataclass
class Lines:
    """The lines of a page: text, characters in links, depth in marks, innermost part."""

    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    part: list[int] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)


def lines_of(page: str) -> Lines:
    """One pass over the page; each character is read a bounded number of times."""
    out = Lines()
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements and their part, -1 for none
    open_ = Counter()  # of the stack, by name
    dropped: list[str] = []  # open elements without text of an article, the outermost first
    dropped_open = Counter()
    link_chars = in_link = depth = 0
    inner = -1  # innermost open part
    at, n = 0, len(page)
    no_more: set[str] = set()  # raw elements that have no further end

    def end_line() -> None:
        nonlocal link_chars
        line = " ".join(html.unescape("".join(text)).split()) if text else ""
        text.clear()
        if line:
            out.text.append(line)
            out.linked.append(min(link_chars, len(line)))
            out.inside.append(depth)
            out.part.append(inner)
        link_chars = 0

    def pop() -> None:
        nonlocal inner, depth
        name, part = stack.pop()
        open_[name] -= 1
        if part >= 0:
            end_line()
            out.parts[part].last = len(out.text)
            inner = out.parts[part].above
        if name in MARKS:
            end_line()
            depth = max(0, depth - 1)

    def close(name: str) -> None:
        # an end tag closes all that is open inside its element; without a start it closes nothing
        if open_[name]:
            while stack[-1][0] != name:
                pop()
            pop()

    while at < n:
        lt = page.find("<", at)
        upto = n if lt < 0 else lt
        if upto > at and not dropped:
            piece = page[at:upto]
            text.append(piece)
            if in_link:
                link_chars += len(piece.strip())
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            if closing or page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # a sign, not a tag
                if not dropped:
                    text.append("<")
                at = lt + 1
            continue
        name = m[0].lower()
        stop, at = _tag_end(page, m.end())
        attributes = page[m.end() : stop]
        alone = attributes.rstrip().endswith("/")
        if dropped:
            if closing and dropped_open[name]:
                while dropped:
                    last = dropped.pop()
                    dropped_open[last] -= 1
                    if last == name:
                        break
                continue
            if closing and (name in ("body", "html", *MARKS) or dropped[0] == "head") or not closing and dropped[0] == "head" and name == "body":
                dropped.clear()  # never closed, or closed with its parent
                dropped_open.clear()
            elif not closing and (name in RAW or name in NO_TEXT) and not alone and name not in VOID:
                pass
            else:
                continue
        if name in RAW and not closing:
            end_line()
            if name not in no_more and not (alone and name not in ("script", "style", "title", "textarea")):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if end is None:
                    no_more.add(name)
                    at = n
                else:
                    gt = page.find(">", end.end())
                    at = n if gt < 0 else gt + 1
            continue
        if name in NO_TEXT and not closing:
            end_line()
            if not alone and name not in VOID:
                dropped.append(name)
                dropped_open[name] += 1
            continue
        if closing:
            if name == "a":
                in_link = 0
            elif name not in INLINE or open_[name]:
                end_line()
                close(name)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                end_line()
            continue
        if name == "a":
            in_link = 1
        kind = _kind(name, attributes) if attributes or name in PARTS else None
        if name in INLINE and not kind:
            continue
        end_line()
        while stack and name in IMPLIED.get(stack[-1][0], ()):
            pop()
        if alone:
            continue
        part = -1
        if kind:
            out.parts.append(Part(kind, len(out.text), inner, depth))
            part = inner = len(out.parts) - 1
        if name in MARKS:
            depth += 1
            above = inner
            if not (kind == "comments"):
                while above >= 0 and not out.parts[above].marked and out.parts[above].kind != "comments":
                    out.parts[above].marked = True
                    above = out.parts[above].above
        stack.append((name, part))
        open_[name] += 1
    end_line()
    while stack:
        pop()
    return out


def _left_out(lines: Lines, plain: np.ndarray) -> list[bool]:
    """For each part whether it goes: not if it holds a mark, or most of the unlinked text of its scope.

    The scope is what the nearest part around it that stays holds, or the marks, or
    the page. Comments go unless nothing else has text.
    """
    upto = np.concatenate([[0], np.cumsum(plain)])
    marked = np.concatenate([[0], np.cumsum(plain * (np.array(lines.inside, np.int64) > 0))])
    out: list[bool] = []
    for p in lines.parts:
        if p.above >= 0 and out[p.above]:
            out.append(True)
            continue
        own = upto[p.last] - upto[p.first]
        scope = marked[-1] if p.depth else upto[-1]
        if p.marked:
            out.append(False)
        elif p.kind == "comments":
            out.append(bool(own < scope))
        else:
            most = own > MOST_OF_SCOPE * scope and (p.last - p.first >= WINDOW or own > NEARLY_ALL * scope)
            out.append(not most)
    return out


def runs_of(sizes: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(runs, densest window of each): half-open runs of lines over which no window is empty."""
    if not len(sizes):
        return [], []
    sums = np.convolve(sizes, np.ones(WINDOW, np.int64))  # of the window that ends at each line
    full = np.concatenate([[False], sums > 0, [False]])
    first = np.flatnonzero(full[1:] & ~full[:-1])
    last = np.flatnonzero(~full[1:] & full[:-1])
    dense = [int(sums[a:b].max()) for a, b in zip(first, last, strict=True)]
    return [(int(a), int(b) - WINDOW + 1) for a, b in zip(first, last, strict=True)], dense


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, joined by one space; empty if there is none."""
    lines = lines_of(page or "")
    size = np.array([len(x) for x in lines.text], np.int64)
    links = np.array(lines.linked, np.int64)
    gone = _left_out(lines, size - links)
    # lines that stay, with a gap wherever a part begins or ends, or a mark does
    kept: list[int] = []
    at = None
    for k in range(len(size)):
        part = lines.part[k]
        if part >= 0 and gone[part]:
            at = None
            continue
        if at is None or lines.inside[k] != lines.inside[at]:
            kept += [-1] * WINDOW
        kept.append(k)
        at = k
    index = np.array(kept, np.int64)
    there = index >= 0
    if not there.any():
        return ""
    all_chars = np.where(there, size[index], 0)
    unlinked = np.where(there, (size - links)[index], 0)
    inside = there & (np.array(lines.inside, np.int64)[index] > 0)
    runs, _ = runs_of(all_chars)
    _, page_dense = runs_of(unlinked)
    most = max(page_dense, default=0)
    sums = np.convolve(unlinked, np.ones(WINDOW, np.int64))
    dense = [int(sums[a : b + WINDOW - 1].max()) for a, b in runs]
    surge = [most > 0 and d >= LEAST_SHARE * most for d in dense]
    marked = [bool(inside[a:b].any()) for a, b in runs]
    if any(s and m for s, m in zip(surge, marked, strict=True)) or most == 0 and any(marked):
        chosen = [r for r, m in zip(runs, marked, strict=True) if m]
    elif not any(surge):
        chosen = []
    else:
        plain = [int(unlinked[a:b].sum()) for a, b in runs]
        text = [p > 0 and p >= (1 - MOST_LINKED) * all_chars[a:b].sum() for (a, b), p in zip(runs, plain, strict=True)]
        dives = [k for k, (s, t) in enumerate(zip(surge, text, strict=True)) if s and t]
        chosen = [
            runs[k] for k, t in enumerate(text) if t and dives and (dives[0] <= k <= dives[-1] or SENTENCE.search(lines.text[max(int(x) for x in index[runs[k][0] : runs[k][1]])]))
        ]
    return " ".join(lines.text[k] for a, b in chosen for k in index[a:b].tolist() if k >= 0)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        sizes = [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    A null or empty html, and a page without text, give an empty text. Broken and
    very long pages are read in time linear in their length. Null ids and urls stay,
    repeated rows are treated alike, other columns are left out.
    """
    rows = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), pages[html_column].cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
