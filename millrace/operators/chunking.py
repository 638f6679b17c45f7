"""Pages to parents and children: section, paragraph and cluster chunks, recursive splitting, short-piece merging, block titles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: chars -> how long a piece is; the default counts code points.
Length = Callable[[str], int]


def section_chunks(text: Column | str, group_size: int = 10, least_chars: int = 256) -> Column:
    """Chunks of a page without clustering, or null where it would have to be clustered: a short page is one chunk, then heading
    sections, then paragraphs if they are few."""
    text = F.col(text) if isinstance(text, str) else text
    sections, paragraphs = X.heading_sections(text), X.paragraphs(text)
    return F.when(F.length(text) <= least_chars, F.array(text)).when(F.size(sections) > 1, sections).when(F.size(paragraphs) <= group_size, paragraphs)


def hashed_vectors(texts: Sequence[str], dim: int = 128) -> np.ndarray:
    """Word-hash counts of unit length: an embedder without a model."""
    import zlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def average_linkage(vectors: np.ndarray, clusters: int) -> list[int]:
    """Labels by repeatedly joining the two clusters of least mean cosine distance; numbered by first member."""
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    dist = unit @ unit.T
    np.subtract(1, dist, out=dist)
    np.fill_diagonal(dist, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - max(1, clusters)):
        i, j = sorted(np.unravel_index(np.argmin(dist), dist.shape))
        both = (dist[i] * size[i] + dist[j] * size[j]) / (size[i] + size[j])
        dist[i], dist[:, i] = both, both
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1].tolist()


def merge_short(chunks: Sequence[str], least: int = 50) -> list[str]:
    """Each chunk with the short ones that follow it."""
    out: list[str] = []
    for c in chunks:
        if out and len(c) < least:
            out[-1] += c
        else:
            out.append(c)
    return out


def cluster_chunks(text: str, group_size: int, embed: Callable = hashed_vectors, preserve_order: bool = False) -> list[str]:
    """Paragraphs of like content joined by a space; preserve_order: clusters by first paragraph (else by label, which here is the same)."""
    parts = text.split("\n\n")
    labels = average_linkage(embed(parts), -(-len(parts) // group_size))
    order = sorted(set(labels), key=labels.index if preserve_order else None)
    return merge_short([" ".join(p for p, y in zip(parts, labels, strict=True) if y == k) for k in order])


def semantic_chunks(pages: DataFrame, text_col: str = "page_content", group_size: int = 10, embed: Callable = hashed_vectors) -> DataFrame:
    """pages with column chunks: the ladder in Column form; only pages that need clustering meet Python, as Arrow batches."""
    if group_size < 1:
        raise ValueError("group_size must be positive")

    @F.pandas_udf("array<string>")
    def clustered(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            for part in X.pieces(s):
                yield part.map(lambda t: None if t is None else cluster_chunks(t, group_size, embed))

    easy = section_chunks(text_col, group_size)
    # a page that the ladder settles reaches the function as null and costs it nothing
    return pages.withColumn("chunks", F.coalesce(easy, clustered(F.when(easy.isNull(), F.col(text_col)))))


def split_recursively(text: str, size: int, overlap: int, separators: Sequence[str] = ("\n\n", "\n"), length: Length = len) -> list[str]:
    """Pieces of at most size, split at the first separator that occurs and merged again up to size with an overlap of whole pieces.

    A piece that no separator can split stays as it is, however long.
    """
    sep = next((s for s in separators if s in text), None)
    if sep is None:
        return [text.strip()] if text.strip() else []
    rest = separators[list(separators).index(sep) + 1 :]
    first, *more = text.split(sep)
    parts = [p for p in (first, *(sep + m for m in more)) if p]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for p in parts:
        if length(p) >= size and length(p.strip()) > size:
            flush()
            held.clear()
            out.extend(split_recursively(p, size, overlap, rest, length))
            continue
        if held and length("".join(held)) + length(p) > size:
            flush()
            while held and (length("".join(held)) > overlap or length("".join(held)) + length(p) > size):
                held.pop(0)
        held.append(p)
    flush()
    return out


def children(parents: DataFrame, size: int = 256, overlap: int = 50, length: Length = len, keep_whole: bool = True) -> DataFrame:
    """DOC rows: parents (unique_id, page_content, source, page, ordinal, images_info) and their children with parent_id.

    A child equal to its parent is not repeated. Parents shorter than 512 characters are marked indexed, and children always; keep_whole
    also marks a longer parent that no child represents (without it such a parent is in no index).
    """

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            for part in X.pieces(s):
                yield part.map(lambda t: split_recursively(t or "", size, overlap, length=length))

    cut = parents.withColumn("parts", F.filter(split("page_content"), lambda p: p != F.col("page_content")))
    alone = F.lit(keep_whole) & (F.size("parts") == 0)
    own = cut.select("unique_id", "page_content", "source", "page", "ordinal", F.lit(None).cast("string").alias("parent_id"), "images_info", ((F.length("page_content") < 512) | alone).alias("indexed"))
    kids = cut.select(F.col("unique_id").alias("parent_id"), "source", "page", "ordinal", "images_info", F.explode("parts").alias("page_content"))
    kids = kids.select(X.content_id("page_content").alias("unique_id"), "page_content", "source", "page", "ordinal", "parent_id", "images_info", F.lit(True).alias("indexed"))
    return own.unionByName(kids)


def parents_of(pages: DataFrame) -> DataFrame:
    """pages (source, page, chunks, images_info) to parents, one a non-blank chunk; ordinal is its place on the page."""
    rows = pages.select("source", "page", "images_info", F.posexplode("chunks").alias("ordinal", "page_content")).where(F.trim("page_content") != "")
    return rows.select(X.content_id("page_content").alias("unique_id"), "page_content", "source", "page", F.col("ordinal").cast("long").alias("ordinal"), "images_info")


def merged_short_rows(rows: DataFrame, group: str, order: str, text: str, least: int = 50) -> DataFrame:
    """(group, chunk_no, chunk): rows in order, each shorter than least joined to the one before (gaps and islands)."""
    w = Window.partitionBy(group).orderBy(order)
    starts = F.when((F.length(text) >= least) | (F.row_number().over(w) == 1), 1).otherwise(0)
    marked = rows.withColumn("__start", starts).withColumn("chunk_no", F.sum("__start").over(w))
    return grouped_text(marked, [group, "chunk_no"], order, text, "", "chunk")


def grouped_text(rows: DataFrame, keys: list[str], order: str, text: str, joiner: str = " ", name: str = "text") -> DataFrame:
    """The texts of each key in order, joined. A key's texts meet in one row, so keys are pages or clusters, not sources."""
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("l"))
    return lists.select(*keys, F.array_join(F.col("l.t"), joiner).alias(name))


def title_scores(blocks: DataFrame, typical_size: str = "typical_size") -> DataFrame:
    """blocks (text, size, bold, lines, above, typical_size) with score and is_title (3 or more; never a text that ends a sentence)."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    score = (
        F.when(F.col("size") > F.col(typical_size), 2.0).otherwise(0.0)
        + F.when(F.col("bold"), 1.0).otherwise(0.0)
        + F.when(F.col("lines") <= 2, 0.5).otherwise(0.0)
        + F.when(F.length(text) <= 30, 0.5).otherwise(0.0)
        + F.when(F.col("above"), 2.0).otherwise(-1.0)
    )
    ends = text.rlike("[.。!！]$")
    return blocks.withColumn("score", F.when(ends, 0.0).otherwise(score)).withColumn("is_title", ~ends & (F.col("score") >= 3))


def overlapping(blocks: DataFrame, rects: DataFrame, cell: float = 256.0) -> DataFrame:
    """Blocks and rectangles (page, x0, y0, x1, y1) that intersect on a page: joined on page and grid cell, then compared.

    rects' columns come back with prefix r_.
    """
    grid = lambda df: df.withColumn("__cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("__cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    a = grid(blocks)
    b = grid(rects).select(*[F.col(c).alias(f"r_{c}" if c not in ("page", "__cx", "__cy") else c) for c in [*rects.columns, "__cx", "__cy"]])
    hit = a.join(b, ["page", "__cx", "__cy"]).where("x0 < r_x1 and x1 > r_x0 and y0 < r_y1 and y1 > r_y0")
    return hit.drop("__cx", "__cy").distinct()


#: What makes a block a picture's title, and where it is looked for, in points.
TITLE_SIZE, TITLE_LINES, TITLE_CHARS, LEAST_SCORE = 10, 3, 30, 3.0
SEARCH_ABOVE, SEARCH_BELOW, FOOT = 200, 3, 50
LEAST_WIDTH = 34


def kept_pictures(pictures: DataFrame) -> DataFrame:
    """Pictures (ext, width, ...) that are no icons; a null width or ext counts as one."""
    return pictures.where((F.col("ext") != "png") & (F.col("width") > LEAST_WIDTH))


def search_areas(pictures: DataFrame, pages: DataFrame) -> DataFrame:
    """pictures (page, x0, y0, x1, y1, ...) with the area where titles may stand: over the picture, and under it in proportion to its height, but
    not at the page's foot or beyond its sides. pages: (page, page_width, page_height). The picture's own top comes back as top, its bottom as bottom."""
    own = pictures.join(pages.select("page", "page_width", "page_height"), "page").withColumns({"top": F.col("y0"), "bottom": F.col("y1")})
    grown = own.withColumns(
        {
            "y1": F.least(F.col("y1") + (F.col("y1") - F.col("y0")) * SEARCH_BELOW, F.col("page_height") - FOOT),
            "y0": F.greatest(F.col("y0") - SEARCH_ABOVE, F.lit(0.0)),
            "x0": F.greatest("x0", F.lit(0.0)),
            "x1": F.least("x1", "page_width"),
        }
    )
    return grown.where("x0 < x1 AND y0 < y1").drop("page_width", "page_height")


def picture_titles(pictures: DataFrame, blocks: DataFrame, pages: DataFrame, key: str = "picture", cell: float = 256.0) -> DataFrame:
    """(key, page, image_path, title, best_title) of each picture that is no icon.

    pictures: (key, page, number, ext, width, x0, y0, x1, y1), number being its place on the page from 0; blocks: (page, block, text, size, bold, x0, y0, x1, y1);
    pages: (page, page_width, page_height); page counts from 0 and image_path from 1. title joins the texts of all blocks that score as titles, in
    order; best_title is the one of greatest score, of equal ones the nearest to the picture, then the first. Without any both are empty. Blocks and
    areas meet on page and grid cell, so a page with very many blocks is spread over its cells.
    """
    own = kept_pictures(pictures)
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    titled = blocks.withColumns({"text": text}).where(F.length("text") > 0).where(~F.col("text").rlike("[.。!！]$")).withColumn("lines", lines)
    fixed = (
        F.when(F.col("size") >= TITLE_SIZE, 2.0).otherwise(0.0)
        + F.when(F.col("bold"), 1.0).otherwise(0.0)
        + F.when(F.col("lines") <= TITLE_LINES, 0.5).otherwise(0.0)
        + F.when(F.length("text") <= TITLE_CHARS, 0.5).otherwise(0.0)
    )
    # A block that cannot reach the score at any place need not be joined.
    able = titled.withColumn("fixed", fixed).where(F.col("fixed") + 2 >= LEAST_SCORE).select("page", "block", "text", "fixed", "x0", "y0", "x1", "y1")
    areas = search_areas(own.select(key, "page", "x0", "y0", "x1", "y1"), pages)
    met = overlapping(able, areas, cell)
    above = F.col("y1") < F.col("r_top")
    score = F.col("fixed") + F.when(above, 2.0).otherwise(-1.0)
    away = F.greatest(F.col("r_top") - F.col("y1"), F.col("y0") - F.col("r_bottom"), F.lit(0.0))
    hits = met.withColumns({"score": score, "away": away}).where(F.col("score") >= LEAST_SCORE)
    found = hits.groupBy(F.col(f"r_{key}").alias(key)).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "\n").alias("title"),
        F.max_by("text", F.struct("score", -F.col("away"), -F.col("block"))).alias("best_title"),
    )
    path = F.concat(F.lit("page"), (F.col("page") + 1).cast("string"), F.lit("_img"), (F.col("number") + 1).cast("string"), F.lit("."), F.col("ext"))
    return own.select(key, "page", path.alias("image_path")).join(found, key, "left").select(key, "page", "image_path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("best_title", F.lit("")).alias("best_title"))
