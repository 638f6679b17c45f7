"""Fill-in-middle transformation of whole texts over ropes.

A text is cut into units: runs of ASCII letters, and every other code point by itself. Two hashed ranks cut the units into prefix, middle and
suffix, which change places behind sentinels; the model then learns to write the middle last.

A text is held as a rope: a balanced tree whose leaves are stretches of about LEAF code points, cut between units, and whose nodes know how many
units and code points lie under them. A cut at a unit rank walks down to one leaf and scans only that; the parts are rearranged by joining
subtrees, so no text is copied until it is written out. The inverse builds a rope from the output, splits it at its sentinels and joins the
parts in their first order.

Empty and null texts, texts that hold a sentinel and those beyond the rate stay plain: the output is the text itself and the lengths are null.
A null id hashes as an empty one. Every row is a row of the result; repeated rows give equal ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .toxicity import slices

#: Code points of a leaf, about; a longer run of letters is not cut.
LEAF = 4096
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
RUN = re.compile(r"[A-Za-z]+")


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int

    @property
    def chars(self) -> int:
        return len(self.text)


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    chars: int


Rope = Leaf | Node
EMPTY = Leaf("", 0)


def leaf(text: str) -> Leaf:
    return Leaf(text, len(RUN.sub("a", text)))


def join(a: Rope, b: Rope) -> Rope:
    """a before b. The seam must lie between units of the two."""
    if not a.chars:
        return b
    return Node(a, b, a.units + b.units, a.chars + b.chars) if b.chars else a


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of a text."""
    leaves, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text) and RUN.match(text, end - 1) and (m := RUN.match(text, end)):
            end = m.end()
        leaves.append(leaf(text[at:end]))
        at = end
    while len(leaves) > 1:
        leaves = [join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def split(r: Rope, at: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first at units (or chars) of a rope, and the rest; only one leaf is read."""
    after: list[Rope] = []
    before: list[Rope] = []
    while isinstance(r, Node):
        under = getattr(r.left, by)
        if at < under:
            after.append(r.right)
            r = r.left
        else:
            before.append(r.left)
            at -= under
            r = r.right
    if at <= 0:
        low, high = EMPTY, r
    elif at >= getattr(r, by):
        low, high = r, EMPTY
    elif by == "chars":
        low, high = leaf(r.text[:at]), leaf(r.text[at:])
    else:
        place = next(islice(UNIT.finditer(r.text), at, None)).start()
        low, high = Leaf(r.text[:place], at), Leaf(r.text[place:], r.units - at)
    for x in reversed(before):
        low = join(x, low)
    for x in reversed(after):
        high = join(high, x)
    return low, high


def leaves(r: Rope) -> Iterator[str]:
    rest = [r]
    while rest:
        r = rest.pop()
        if isinstance(r, Node):
            rest += (r.right, r.left)
        else:
            yield r.text


def text_of(r: Rope) -> str:
    return "".join(leaves(r))


def find(r: Rope, what: str, start: int = 0) -> int:
    """The place in code points of the first what at or after start, -1 without one; it may reach over leaves."""
    keep, tail, at = len(what) - 1, "", 0
    for t in leaves(r):
        seen = tail + t
        first = at - len(tail)
        if at + len(t) > start and (i := seen.find(what, max(0, start - first))) >= 0:
            return first + i
        at += len(t)
        tail = seen[-keep:] if keep else ""
    return -1


@dataclass(frozen=True)
class Forms:
    """How texts are transformed. rate, spm: of hundred texts, how many are transformed, and how many of those put the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    spm: int = 20
    salt: str = "1:"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def transformed(self, key: str, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, code points of the prefix and of the middle, output) of a text."""
        digest = hashlib.sha256((self.salt + key).encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        whole = rope(text)
        n = whole.units
        if not text or h3 % 100 >= self.rate or any(m in text for m in self.marks):
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        rest, suffix = split(whole, high)
        prefix, middle = split(rest, low)
        p, s, m = map(leaf, self.marks)
        form = "spm" if h4 % 100 < self.spm else "psm"
        out = EMPTY
        for part in (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle):
            out = join(out, part)
        return n, form, prefix.chars, middle.chars, text_of(out)

    def restored(self, form: str, output: str) -> str:
        """The text of an output, from it and its form alone."""
        if form == "plain":
            return output
        first, second = (self.suffix, self.prefix) if form == "spm" else (self.prefix, self.suffix)
        whole = rope(output)
        a = find(whole, second, len(first))
        b = find(whole, self.middle, a + len(second)) if a >= 0 else -1
        if b < 0 or find(whole, first) != 0:
            raise ValueError(f"no output of form {form}")
        rest, middle = split(whole, b, "chars")
        one, two = split(rest, a, "chars")
        _, one = split(one, len(first), "chars")
        _, two = split(two, len(second), "chars")
        _, middle = split(middle, len(self.middle), "chars")
        prefix, suffix = (two, one) if form == "spm" else (one, two)
        return text_of(join(join(prefix, middle), suffix))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forms: Forms | None = None) -> DataFrame:
    """A row for each row of docs: <id_col>, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output (the whole text)."""
    forms = forms or Forms()
    if len(set(forms.marks)) < 3 or any(not re.fullmatch(r"<[^<>]+>", m) for m in forms.marks):
        raise ValueError("sentinels must be three different names in angle brackets")  # so that none can begin inside a seam

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in slices(batches):
            done = [forms.transformed("" if key is None else str(key), text or "") for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            own = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *own], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType().add(id_col, docs.schema[id_col].dataType).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", forms: Forms | None = None) -> DataFrame:
    """df with the text rebuilt from output and form in column name, in place of a column of that name. A null output is an empty one."""
    forms = forms or Forms()
    kept = df.drop(name)
    at, form_at = kept.columns.index(output_col), kept.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts = [forms.restored(f, x or "") for f, x in zip(b.column(form_at).to_pylist(), b.column(at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))
