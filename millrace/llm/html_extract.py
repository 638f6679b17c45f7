"""Main text of web pages by differencing against the page of the nearest URL, with the page's structure as a prior.

1. Each page is cut into lines (visible blocks) in one pass. A line stands inside an article or main element, or in an element that is no
   content by its tag, role, class or id (menus, headers, footers, side bars, notices, adverts, forms, comments), or is open.
   An article element has exclusions too: one with the class of a comment, or inside a closed left-out element, is left out, unless
   nothing is left inside then and the articles hold more text than all that stays.
2. Of every page a light row is staged: host, path, and a 64-bit hash of each line that doesn't stand in an article. Rows are numbered by
   host and path over the whole table, so a host of any size is spread over tasks, and each page meets the pages before and after it by
   joins on the number; the nearer is the one with more leading path segments in common (the earlier page if equal).
3. The longest common subsequence of the two pages' lines outside articles is template text: open lines in it are deleted, the others
   stay, in page order with those inside articles. A page whose open lines are all shared is a copy if it has no article text or that of
   its neighbour, and is compared with its other neighbour before it keeps its lines.
4. What is deleted goes as line numbers to the pages, which are read again and stay where they are.

Lines of left-out elements take part in the alignment but go also if they aren't shared: neighbours by URL need not have the same
menus and adverts. Lines inside articles stay though they are shared, as neighbours may be copies.

In a block, white space becomes one space and ends are trimmed; blocks are joined by an empty line. Null or empty html gives an empty
text. Unclosed and unknown tags are tolerated; an article or main element ends a left-out element that is open and never closed. Rows that
repeat an id, url and html get the same text.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import numbered
from .common import met, stage

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("head nav footer aside form button dialog menu canvas object audio video map datalist".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist note".split())
#: Names that say so wherever they stand in a class or id.
STRONG = frozenset("nav navbar navigation submenu topbar colophon sidebar ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr popup modal breadcrumb breadcrumbs pagination pager share sharing newsletter subscribe signup login comment comments replies disqus".split())
#: Names that say so outside articles, or as a whole class or id.
WEAK = frozenset("menu header masthead footer aside rail banner sponsors promotion notice notices overlay alert disclaimer social related recommended subscription reply respond discussion widget toolbar skip".split())
#: What a class or id begins with that says content.
CONTENT = frozenset("article content entry main post story text title".split())

#: Where a line stands.
OPEN, INSIDE, OUT = 0, 1, 2


def says_no(name: str, inside: bool) -> bool:
    """Whether a class or id is that of an element without content; inside an article only where the name leaves no doubt."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts:
        return False
    if inside:
        return parts[0] in STRONG or len(parts) == 1 and parts[0] in WEAK - {"header", "masthead"}
    return any(p in STRONG for p in parts) or parts[0] not in CONTENT and any(p in WEAK for p in parts)


def left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the element is no content; inside: it stands in an article."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name not in ("class", "id") or tag in ("body", "html", "main"):
            continue
        if tag != "article" and any(says_no(x, inside) for x in value.split()):
            return True
        if tag == "article" and any(p[0].lower() in STRONG | WEAK for p in map(PARTS.findall, value.split()) if p):
            return True  # by the first part only: has-sidebar and category-social are said of articles that are content
    return False


def closed_tags(page: str) -> set[int]:
    """Places of the elements that are closed by a tag of their own."""
    found: set[int] = set()
    stack: list[tuple[str, int]] = []
    for m in TOKEN.finditer(page):
        tag = (m[3] or m[6] or "").lower()
        if not tag or tag in VOID or (m[4] or m[7] or "").endswith("/") and tag not in BLOCKS:
            continue
        if not (m[2] or m[5]):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
            stack.append((tag, m.start()))
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                found.add(stack[i][1])
                del stack[i:]
                break
    return found


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, where it stands) of the visible blocks, in page order."""
    found, dropped = _blocks(page or "", True)
    if not dropped or any(at == INSIDE for _, at in found):
        return found
    every, _ = _blocks(page or "", False)
    return every if sum(len(t) for t, at in every if at == INSIDE) > sum(len(t) for t, at in found if at == OPEN) else found


def _blocks(page: str, strict: bool) -> tuple[list[tuple[str, int]], bool]:
    """The blocks, and whether an article was left out by its class or id or by what it stands in (only if strict)."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, left out, in an article, place if left out for itself or -1
    words: tuple[list[str], list[str]] = ([], [])  # what stays, what is left out
    closed, dropped = None, False

    def flush() -> None:
        for own, at in zip(words, (INSIDE if stack and stack[-1][2] else OPEN, OUT), strict=True):
            if own:
                if text := " ".join(html.unescape("".join(own)).split()):
                    out.append((text, at))
                own.clear()

    for m in TOKEN.finditer(page):
        token = m[0]
        gone = bool(stack and stack[-1][1])
        if token[0] != "<" or token == "<":
            words[gone].append(token)
            continue
        tag = m[3] or m[6]
        if not tag:
            if m[1]:
                words[gone].append(" ")
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            words[gone].append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag == "body" or tag in ARTICLE:  # whatever is open and left out was never closed, or holds no article
            if strict and tag == "article" and stack and stack[-1][1]:
                closed = closed_tags(page) if closed is None else closed
            if not (strict and tag == "article" and any(x[3] in closed for x in stack if x[3] >= 0)):
                while stack and stack[-1][1]:
                    stack.pop()
        elif tag == "p" or tag == "li":  # closes its like
            if stack and stack[-1][0] == tag:
                stack.pop()
        _, gone, inside, _ = stack[-1] if stack else ("", False, False, -1)
        bare = left_out(tag, attributes, inside) if strict or tag != "article" else left_out("main", attributes, inside)
        dropped |= tag == "article" and (gone or bare)
        stack.append((tag, gone or bare, inside or tag in ARTICLE, m.start() if bare else -1))
    flush()
    return out, dropped


def common_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b (equal ends first, then Hunt and Szymanski's way)."""
    n, m, lo = len(a), len(b), 0
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    found = {*range(lo), *range(n - hi, n)}
    at: dict[object, list[int]] = {}
    for j in range(m - hi - 1, lo - 1, -1):
        at.setdefault(b[j], []).append(j)  # falling
    ends: list[int] = []  # least last place in b of a common subsequence of each length
    tails: list[tuple] = []
    for i in range(lo, n - hi):
        for j in at.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(link)
            else:
                ends[k], tails[k] = j, link
    link = tails[-1] if tails else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path, the path in segments joined by NUL (which sorts before anything else)."""
    try:
        u = urlsplit((url or "").strip())
        return (u.hostname or ""), "\0".join(unquote(u.path).strip("/").split("/"))
    except ValueError:
        return "", url or ""


def shared_segments(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("\0"), b.split("\0"), strict=False):
        if x != y:
            break
        n += 1
    return n


def line_hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def shared_lines(path: str, inner: int | None, lines: list, open_: list[bool], neighbours: list[tuple[str, int | None, list]]) -> list[int]:
    """Which of the lines outside articles the nearest of the neighbours shares, if these are template text.

    open_: which of the lines are open; inner: a hash of the lines inside articles, or None without any. A neighbour: path, inner and
    lines, in URL order.
    """
    for at, its, other in sorted(neighbours, key=lambda x: -shared_segments(path, x[0])):
        gone = common_lines(lines, other)
        if any(o and i not in gone for i, o in enumerate(open_)) or inner is not None and inner != its:
            return [i for i in sorted(gone) if open_[i]]
    return []


def main_text(found: list[tuple[str, int]], gone: list[int] | None = None) -> str:
    """The text of blocks less what is left out and the open ones whose numbers, among those outside articles, are in gone."""
    outside, kept, less = -1, [], set(gone or ())
    for text, at in found:
        outside += at != INSIDE
        if at == INSIDE or at == OPEN and outside not in less:
            kept.append(text)
    return "\n\n".join(kept)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            yield b.slice(k, 500)


def outlines(pages: DataFrame) -> DataFrame:
    """(id, tie, host, path, inner, lines, open) of each of pages (id, tie, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        for b in _sliced(batches):
            rows = []
            for u, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = blocks(h)
                inside = [t for t, at in found if at == INSIDE]
                outside = [(line_hash(t), at == OPEN) for t, at in found if at != INSIDE]
                rows.append((*url_key(u), line_hash("\n\n".join(inside)) if inside else None, [x for x, _ in outside], [o for _, o in outside]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["id", "tie", "host", "path", "inner", "lines", "open"])

    more = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("inner", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("open", T.ArrayType(T.BooleanType()))]
    return pages.mapInArrow(run, T.StructType([pages.schema["id"], pages.schema["tie"], *more]))


def template_lines(pages: DataFrame) -> DataFrame:
    """(id, tie, gone): of pages (id, tie, url, html), which open lines the page of the nearest URL shares, where there are any."""
    ordered = stage(numbered(stage(outlines(pages), "html-outlines"), ["host", "path", "id", "tie"], "pos"), "html-ordered")
    beside = ordered.select("pos", F.struct("host", "path", "inner", "lines").alias("page"))
    own = ordered.where(F.exists("open", lambda x: x))
    for side, step in (("before", 1), ("after", -1)):
        own = own.join(beside.select((F.col("pos") + step).alias("pos"), F.col("page").alias(side)), "pos", "left")
        own = own.withColumn(side, F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for r in b.select(["path", "inner", "lines", "open", "before", "after"]).to_pylist():
                near = [(x["path"], x["inner"], x["lines"]) for x in (r["before"], r["after"]) if x]
                gone.append(shared_lines(r["path"], r["inner"], r["lines"], r["open"], near))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(gone, pa.list_(pa.int32()))], ["id", "tie", "pos", "gone"])

    schema = T.StructType([ordered.schema["id"], ordered.schema["tie"], ordered.schema["pos"], T.StructField("gone", T.ArrayType(T.IntegerType()))])
    found = own.select("id", "tie", "pos", "path", "inner", "lines", "open", "before", "after").mapInArrow(run, schema)
    return found.groupBy("id", "tie").agg(F.min(F.struct("pos", "gone")).alias("first")).select("id", "tie", F.col("first.gone").alias("gone")).where(F.size("gone") > 0)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: <id_col>, <url_col>, text, n_chars."""
    own = pages.select(F.col(id_col).alias("id"), F.xxhash64(F.col(url_col).cast("string"), F.col(html_col)).alias("tie"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    gone = stage(template_lines(own).select(F.col("id").alias("gone_id"), F.col("tie").alias("gone_tie"), "gone"), "html-gone")
    both = met(own, gone, {"gone_id": F.col("id"), "gone_tie": F.col("tie")}, "left").select("id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            texts = [main_text(blocks(h), g) for h, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    done = both.mapInArrow(run, T.StructType([own.schema["id"], own.schema["url"], T.StructField("text", T.StringType())]))
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
