"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line's words are what white space (space, tab, line and form feeds, carriage return) separates, lower-cased. A line with words is
removed if an earlier one (by document id, then line number) has equal words, and one of at least ``min_words`` words also if an
earlier one is within one word of it: one word changed, added or left out. With five words that is a similarity of 0.8; the bound
stays one word at any length, so a longer line of n words is matched at (n - 1) / n only (0.98 at 50 words) and near copies with more
changes stay. Lines without a word always stay. The earliest of each group stays.

1. One pass over the texts: the hashes of every line and of its halves are staged, a light row a line. Texts are read again only for
   candidates and for the result.
2. Equal lines become one class by a map-side aggregate over a 128-bit hash; it keeps the earliest place. However often a line
   occurs, it is one row from here on.
3. A line and its neighbour agree on one half of their words. Classes that share no half with another class (four hashed keys a line)
   can have no neighbour and leave here; the words of the rest are staged.
4. Each line left emits its deletion variants, one for each word, as hashed keys: sums of word hashes at their places, so a variant costs
   a row and not a copy of the line. Lines equal but for the word at place i share the variant of place i; a line that is
   another's variant shares it with the line's own hash. A minimum over each key finds the earliest partner: no pairs within a key.
5. Partners' words are compared, which verifies the edit distance, before a line is dropped.
6. What goes is gathered by document as line numbers, which are sent to the documents where these stand, if few enough.

"Earlier" looks at all lines of the input, whether they stay or not. A null text has one empty line and stays null. Rows that repeat
an id and text are treated alike: none of them is earlier than the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .common import BLOCK_ROWS, fresh, met, stage

#: Word hashes are below this, so that sums over any line stay in a long.
_RANGE = 1 << 40
#: What separates words besides the space.
_OTHER_WHITE = "\t\x0b\x0c\r"


def _raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, line_no, line); tid tells rows apart that repeat an id."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.select("id", "tid", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _joined_words(line: Column) -> Column:
    """The words joined by a space; only a line with other white space than single spaces inside is taken apart for it."""
    low = F.lower(line)
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for c in _OTHER_WHITE:
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.array_join(F.array_remove(F.split(low, f"[ {_OTHER_WHITE}]+"), ""), " ")).otherwise(low)


def _half_keys() -> list[Column]:
    """Of a line of n words as one of class n and as the shorter one of class n + 1: hashes of its first and its last part."""
    keys = []
    for c in ("n", "n + 1"):
        keys.append(F.expr(f"xxhash64({c}, 'first', substring_index(joined, ' ', ({c}) div 2))"))
        keys.append(F.expr(f"xxhash64({c}, 'last', substring_index(joined, ' ', ({c}) div 2 - ({c})))"))
    return keys


def hashed_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tid, line_no, n, h1, h2, k0..k3) of each line with words, staged; the halves' keys are null below min_words."""
    raw = _raw_lines(docs, id_col, text_col).withColumn("joined", _joined_words(F.col("line"))).drop("line")
    spaces = F.octet_length("joined") - F.octet_length(F.replace("joined", F.lit(" "), F.lit("")))
    counted = raw.withColumn("n", F.when(F.col("joined") == "", 0).otherwise(spaces + 1))
    keys = [F.when(F.col("n") >= min_words, k).alias(f"k{i}") for i, k in enumerate(_half_keys())]
    hashed = counted.select("id", "tid", "line_no", "n", F.xxhash64("joined").alias("h1"), F.xxhash64(F.lit(1), "joined").alias("h2"), *keys)
    return stage(hashed, "lines-hashed").where("n > 0")


def _small(df: DataFrame, label: str) -> DataFrame:
    """df staged, to be broadcast if its rows are few enough."""
    staged = stage(df, label)
    return F.broadcast(staged) if staged.count() <= BLOCK_ROWS else staged


def near_lines(docs: DataFrame, lines: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal lines (h1, h2, n, first, copies), staged, and those with an earlier neighbour (h1, h2). lines: from hashed_lines()."""
    if min_words < 2:
        raise ValueError("lines of one word would all be neighbours")
    keyed = lines.withColumn("pos", F.struct("id", "tid", "line_no"))
    grouped = keyed.groupBy("h1", "h2", "n").agg(F.min("pos").alias("first"), F.count("*").alias("copies"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    classes = stage(grouped.withColumn("lid", F.monotonically_increasing_id()), "lines-classes")
    halves = classes.where(F.col("n") >= min_words).select("lid", F.explode(F.array(*[f"k{i}" for i in range(4)])).alias("key"))
    shared = _small(halves.groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a <> b").select("key"), "lines-keys")
    able = _small(halves.join(shared, "key").select("lid").distinct(), "lines-able")
    first = classes.join(able, "lid").select("h1", "h2", "first.*")
    places = stage(numbered(first, ["id", "tid", "line_no"], "ord"), "lines-places")  # ord: earlier lines have smaller numbers
    sought = F.broadcast(places) if places.count() <= BLOCK_ROWS else places
    own = _raw_lines(docs, id_col, text_col).alias("l").join(sought.alias("p"), F.expr("l.id <=> p.id and l.tid = p.tid and l.line_no = p.line_no"))
    texts = stage(own.select("ord", F.split(_joined_words(F.col("line")), " ").alias("words")).dropDuplicates(["ord"]).withColumn("n", F.size("words")), "lines-texts")

    # dealt out before it is exploded, a line's words are in one task already when the window wants them
    word = texts.repartition("ord").select("ord", "n", F.posexplode("words").alias("i", "w"))
    for s in (1, 2):
        word = word.withColumn(f"a{s}", F.pmod(F.xxhash64(F.lit(s), "w", "i"), F.lit(_RANGE))).withColumn(f"b{s}", F.pmod(F.xxhash64(F.lit(s), "w", F.col("i") - 1), F.lit(_RANGE)))
    line = Window.partitionBy("ord")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.sum(f"a{s}").over(upto) - F.col(f"a{s}") + F.sum(f"b{s}").over(line) - F.sum(f"b{s}").over(upto)).alias(f"v{s}") for s in (1, 2)]
    # same: lines equal but for the word at i; less: lines without that word
    variants = word.select("ord", "n", "i", *sums).select("ord", "i", F.xxhash64("v1", "v2", "n", "i").alias("same"), F.xxhash64("v1", "v2", F.col("n") - 1).alias("less"))
    whole = word.groupBy("ord", "n").agg(F.sum("a1").alias("v1"), F.sum("a2").alias("v2")).select("ord", F.xxhash64("v1", "v2", "n").alias("less"))

    changed = _small(variants.groupBy("same").agg(F.min("ord").alias("m"), F.max("ord").alias("x")).where("m <> x").select("same", "m"), "lines-changed")
    none = F.lit(None).cast("long")
    sides = variants.select("less", F.struct("ord", "i").alias("d"), none.alias("f")).union(whole.select("less", F.when(F.lit(False), F.struct("ord", F.lit(0).alias("i"))), "ord"))
    pairs = _small(sides.groupBy("less").agg(F.min("d").alias("d"), F.min("f").alias("f")).where("d is not null and f is not null"), "lines-longer")
    # 'mine' and 'its': 1 where that line lacks the word at place i, so its words after i stand one place earlier
    substituted = variants.join(changed, "same").where("m < ord").select("ord", "i", "m", F.lit(0).alias("mine"), F.lit(0).alias("its"))
    left_out = pairs.where("d.ord < f").select(F.col("f").alias("ord"), "d.i", F.col("d.ord").alias("m"), F.lit(1).alias("mine"), F.lit(0).alias("its"))
    added = variants.join(pairs, "less").where("f < ord").select("ord", "i", F.col("f").alias("m"), F.lit(0).alias("mine"), F.lit(1).alias("its"))

    found = substituted.union(left_out).union(added)
    mine = texts.select("ord", F.col("words").alias("x"))
    its = texts.select(F.col("ord").alias("m"), F.col("words").alias("y"))
    same = "slice(x, 1, i) = slice(y, 1, i) and slice(x, i + 2 - mine, size(x)) = slice(y, i + 2 - its, size(y))"
    near = found.join(mine, "ord").join(its, "m").where(same).select("ord").distinct()
    return classes, stage(places.join(near, "ord").select("h1", "h2"), "lines-near")


def drop_repeated_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less its removed lines, all columns kept."""
    return _less_lines(docs, [], min_words, id_col, text_col)


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """drop_repeated_lines() with n_lines and n_removed; columns of these names are replaced."""
    return _less_lines(docs.drop("n_lines", "n_removed"), ["n_lines", "n_removed"], min_words, id_col, text_col)


def _less_lines(docs: DataFrame, counts: list[str], min_words: int, id_col: str, text_col: str) -> DataFrame:
    lines = hashed_lines(docs, min_words, id_col, text_col)
    classes, near = near_lines(docs, lines, min_words, id_col, text_col)
    going = classes.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("copies > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    placed = lines.select("h1", "h2", F.struct("id", "tid", "line_no").alias("pos"))
    gone = placed.join(_small(going, "lines-going"), ["h1", "h2"]).where("near or pos <> first")
    at, tid, cut = fresh(docs, "id", "tid", "cut")
    lists = stage(gone.groupBy(F.col("pos.id").alias(at), F.col("pos.tid").alias(tid)).agg(F.collect_set("pos.line_no").alias(cut)), "lines-gone")
    both = met(docs, lists, {at: F.col(id_col), tid: F.xxhash64(text_col)}, "left")
    text = F.col(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(cut, i)), "\n")
    size = F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long")
    own = [F.when(F.col(cut).isNull(), text).otherwise(kept).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    numbers = [size, F.coalesce(F.size(cut), F.lit(0)).cast("long")]
    return both.select(*own, *(n.alias(c) for n, c in zip(numbers, counts, strict=False)))
