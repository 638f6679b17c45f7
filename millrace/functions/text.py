"""Scalar functions over text and model output, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that say there is no answer.
NO_ANSWER = "无答案"
REFUSALS = ("无答案", "没有答案", "无", "")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_id(text: Column | str) -> Column:
    """md5 of the UTF-8 text, in hex."""
    return F.md5(_c(text))


def hash_bucket(key: Column | str, buckets: Column | int) -> Column:
    """A number under buckets from the first 8 hex digits of md5; the same in any engine."""
    return F.conv(F.substring(F.md5(_c(key)), 1, 8), 16, 10).cast("bigint") % buckets


# tokens


def pieces(texts: pd.Series, chars: int = 1 << 18) -> Iterator[pd.Series]:
    """A batch's texts in parts of at most so many characters, so that what is made of them is held for a part only; a longer text is alone."""
    ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
        yield texts.iloc[at:end]
        at = end


def tokens(text: Column | str, min_chars: int = 1) -> Column:
    """Lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), "")
    return words if min_chars <= 1 else F.filter(words, lambda t: F.length(t) >= min_chars)


def cjk_bigrams(text: Column | str) -> Column:
    """Overlapping pairs of neighbouring characters, for scripts without spaces; a single character is itself."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"(\p{IsHan}+)"), 1)
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pairs))


def without(words: Column | str, stop: Column | Sequence[str]) -> Column:
    """words less those in stop, order and repeats kept."""
    stop = stop if isinstance(stop, Column) else F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(_c(words), lambda t: ~F.array_contains(stop, t))


# splitting


def sentences(text: Column | str) -> Column:
    """Pieces that end after a full stop (。), a line feed or a tab; trimmed, without empty ones."""
    return _kept(F.split(_c(text), "(?<=[。\n\t])"))


def trimmed_lines(text: Column | str) -> Column:
    return _kept(F.split(_c(text), "\n"))


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def paragraphs(text: Column | str) -> Column:
    return F.split(_c(text), "\n\n")


def heading_sections(text: Column | str, mark: str = "###") -> Column:
    """The text before the first mark, then each mark with what follows it; blank pieces go."""
    parts = F.split(_c(text), mark)
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.concat(F.lit(mark), x))
    lead = F.filter(F.slice(parts, 1, 1), lambda x: F.trim(x) != "")
    return F.concat(lead, rest)


# citations


def cite_numbers(response: Column | str) -> Column:
    """Sorted distinct numbers in 【】 marks."""
    marks = F.regexp_extract_all(_c(response), F.lit("[【](.*?)[】]"), 1)
    clean = F.transform(marks, lambda m: F.split(F.replace(F.regexp_replace(m, "[{} 【】]", ""), F.lit(","), F.lit("，")), "，"))
    numbers = F.filter(F.flatten(clean), lambda x: x.rlike("^[0-9]{1,9}$"))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda x: x.cast("int"))))


def without_cites(response: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(response), "[【](.*?)[】]", ""), "[{}【】]", "")


def is_refusal(answer: Column | str) -> Column:
    return F.trim(_c(answer)).isin(*REFUSALS)


def cited_answer(response: Column | str) -> Column:
    """The answer with its citations in one mark; without citations it is no answer."""
    cites = cite_numbers(response)
    return F.when(F.size(cites) > 0, F.concat(without_cites(response), F.lit("【"), F.array_join(cites.cast("array<string>"), ","), F.lit("】"))).otherwise(F.lit(NO_ANSWER))


# cleaning


def without_number_prefix(question: Column | str, loose: bool = False) -> Column:
    """Without a leading '1. ' or '2、'; loose: one digit with a dot or space only."""
    return F.trim(F.regexp_replace(_c(question), r"^\d[.. ]" if loose else r"^\s*\d+\s*[.．。、]\s*", ""))


def expand_abbreviations(text: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Each abbreviation that no ASCII letter touches by its full form, in the order of pairs."""
    return reduce(lambda c, p: F.regexp_replace(c, F.lit(rf"(?<![A-Za-z])\Q{p[0]}\E(?![A-Za-z])"), F.lit(p[1].replace("\\", "\\\\").replace("$", "\\$"))), pairs, _c(text))


def without_thought(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?s)<think>(.*?)</think>", ""), r"^\n+", "")


def with_empty_thought(text: Column | str) -> Column:
    text = _c(text)
    return F.when(text.contains("<think>"), text).otherwise(F.concat(F.lit("<think>\n\n</think>\n\n"), text))


def truncated(text: Column | str, chars: int) -> Column:
    return F.substring(_c(text), 1, chars)


def numbered_context(texts: Column | str, style: str = "【{}】") -> Column:
    """Texts with their place, one a line; style: '【{}】' for answering, '{}.' for training items."""
    head, _, tail = style.partition("{}")
    return F.array_join(F.transform(_c(texts), lambda x, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit(tail), x)), "\n")


# keywords


def keyword_list(raw: Column | str, answer: Column | str, banned: Sequence[str] = ("无", "SU7", "")) -> Column:
    """Comma-separated keywords that occur in the answer; '无' is none."""
    raw, answer = F.trim(_c(raw)), _c(answer)
    words = F.filter(F.transform(F.split(raw, ","), lambda k: F.trim(k)), lambda k: (k != "") & answer.contains(k) & ~k.isin(*banned))
    return F.when(raw == "无", F.array().cast("array<string>")).otherwise(words)


def characters(text: Column | str) -> Column:
    """Distinct characters, spaces left out."""
    return F.array_distinct(F.filter(F.split(_c(text), ""), lambda c: (c != "") & (c != " ")))


def fuzzy_match(keyword: Column, text: Column, share: float = 0.6) -> Column:
    """The keyword occurs in the text, or so many of its distinct characters do; an empty one only as a substring."""
    chars = characters(keyword)
    hit = F.size(F.filter(chars, lambda c: text.contains(c)))
    return text.contains(keyword) | ((F.size(chars) > 0) & (hit / F.greatest(F.size(chars), F.lit(1)) >= share))


def has_any(text: Column | str, words: Sequence[str]) -> Column:
    """Whether one of the words occurs in the text."""
    return _c(text).rlike("|".join(rf"\Q{w}\E" for w in words))


def filled(template: str, **slots: Column | str) -> Column:
    """The template with each {{name}} by its slot, all occurrences; one pass, so slots are not searched."""
    parts: list[Column] = []
    rest = template
    while rest:
        at, name = min(((rest.find("{{" + n + "}}"), n) for n in slots if "{{" + n + "}}" in rest), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(_c(slots[name]))
        rest = rest[at + len(name) + 4 :]
    return F.concat(*parts) if parts else F.lit("")


def media_counts_match(text: Column | str, placeholder: str, media: Column | str) -> Column:
    """As many placeholders in the text as media."""
    return F.regexp_count(_c(text), F.lit(rf"\Q{placeholder}\E")) == F.size(F.coalesce(_c(media), F.array()))


def date_text(when: Column | str) -> Column:
    """A date as prompts carry it: 05 Mar 2026."""
    return F.date_format(when, "dd MMM yyyy")
