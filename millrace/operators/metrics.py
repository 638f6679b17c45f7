"""Scores and reports: answers, parsing and chunk quality, overlap metrics, accuracy, lengths, latency, perplexity."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import scratch

# Titles and list items. In document mode a pattern is looked for at the start of the text only.
TITLES = (
    r"^[一二三四五六七八九十]+[、.．]\s|"
    r"^\d+[.．)\\]]\s|"
    r"^【[^】]+】\s|"
    r"^[第][一二三四五六七八九十\d]+[章条款节项]\s|"
    r"^[A-Za-z][.．]\s|"
    r"^[（(]\d+[)）]\s"
)
LIST_ITEMS = (
    r"^[••●▪\-*+>→›»]\s|"
    r"^\d+[.．)\\]]\s|"
    r"^[（(]\d+[)）]\s|"
    r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\s|"
    r"^[ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ]\s"
)
#: U+FFFD and control characters other than tab and line ends.
ABNORMAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F�]"


def abnormal_chars(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(ABNORMAL))


def _matches(text: Column, pattern: str, mode: str) -> Column:
    if mode == "line":  # the class with a stray bracket is read as it was meant
        pattern = "(?m)" + pattern.replace(r"[.．)\\]]\s", r"[.．)\]]\s")
    elif mode != "document":
        raise ValueError(f"unknown mode {mode}")
    return F.regexp_count(text, F.lit(pattern))


def text_quality(df: DataFrame, raw: str = "raw_text", parsed: str = "parsed_text", mode: str = "document") -> DataFrame:
    """df with the text's retention, blank-line ratio, title and list retention, abnormal rate and their weighted score."""
    r, p = F.col(raw), F.col(parsed)
    strip = lambda c: F.length(F.regexp_replace(c, r"^\s+|\s+$", ""))
    lines = F.split(p, "\n")
    full = F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"\s", "") != ""))
    kept = lambda pat: F.when(_matches(r, pat, mode) == 0, 1.0).otherwise(_matches(p, pat, mode) / F.greatest(_matches(r, pat, mode), F.lit(1)))
    out = df.withColumns({
        "text_retention_rate": F.least(strip(p) / F.greatest(strip(r), F.lit(1)), F.lit(1.0)),
        "blank_line_ratio": 1 - full / F.size(lines),
        "title_retention": kept(TITLES),
        "list_retention": kept(LIST_ITEMS),
        "abnormal_char_rate": abnormal_chars(p) / F.greatest(F.length(p), F.lit(1)),
    })
    score = 0.55 * F.col("text_retention_rate") + 0.10 * (1 - F.col("blank_line_ratio")) + 0.10 * F.col("title_retention") + 0.10 * F.col("list_retention") + 0.15 * (1 - F.col("abnormal_char_rate"))
    return out.withColumn("overall_score", score)


def chunk_quality(chunks: DataFrame, keys: list[str], order: str, text: str, ideal_count: int = 1000) -> DataFrame:
    """By keys: count, mean and population deviation of lengths, mean character overlap of neighbours (first 200), weighted score."""
    w = Window.partitionBy(*keys).orderBy(order)
    head = F.array_distinct(F.filter(F.split(F.substring(text, 1, 200), ""), lambda c: c != ""))
    own = chunks.withColumn("__h", head).withColumn("__n", F.lead("__h").over(w)).withColumn("__len", F.length(text))
    both = (F.size("__h") > 0) & (F.size("__n") > 0)
    jaccard = F.when(both, F.size(F.array_intersect("__h", "__n")) / F.size(F.array_union("__h", "__n")))
    stats = own.groupBy(*keys).agg(F.count("*").alias("chunk_count"), F.avg("__len").alias("avg_chunk_length"), F.stddev_pop("__len").alias("length_std"), F.coalesce(F.avg(jaccard), F.lit(0.0)).alias("avg_context_similarity"))
    mean = F.col("avg_chunk_length")
    length = F.when(mean.between(150, 1200), 1.0).when(mean < 150, mean / 150).otherwise(F.greatest(F.lit(0.0), 1 - (mean - 1200) / 1200))
    uniform = 1 - F.least(F.col("length_std") / F.greatest(mean, F.lit(1.0)), F.lit(0.8))
    number = F.greatest(F.lit(0.0), 1 - F.abs(F.col("chunk_count") - ideal_count) / ideal_count)
    return stats.withColumn("quality_score", 0.50 * length + 0.35 * uniform + 0.03 * F.col("avg_context_similarity") + 0.12 * number)


def parse_accuracy(text_score: Column, chunk_score: Column) -> Column:
    return 0.85 * text_score + 0.15 * chunk_score


def answer_score(gold: Column, pred: Column, semantic: Column, keywords: Column) -> Column:
    """Similarity with keyword hits and floors for short answers; a refusal must be met by a refusal."""
    valid = F.filter(keywords, lambda k: X.fuzzy_match(k, gold))
    hits = F.size(F.filter(valid, lambda k: X.fuzzy_match(k, pred))) / F.greatest(F.size(valid), F.lit(1))
    keyword = F.when(hits > 0.3, 1.0).otherwise(hits)
    base = F.when(F.size(valid) > 0, F.greatest(semantic, 0.3 * keyword + 0.7 * semantic)).otherwise(semantic)
    g, p = F.trim(gold), F.trim(pred)
    overlap = F.size(F.array_intersect(X.characters(gold), X.characters(pred))) / F.greatest(F.size(X.characters(gold)), F.lit(1))
    floor = F.when((F.length(gold) <= 20) & pred.contains(g), 0.9).when(F.length(p).between(4, 30) & gold.contains(p), 0.9).when((F.length(gold) <= 50) & (overlap > 0.6), 0.8).otherwise(0.0)
    return F.when(gold == X.NO_ANSWER, F.when(pred == gold, 1.0).otherwise(0.0)).otherwise(F.greatest(base, floor))


def accuracy(df: DataFrame, category: str, correct: Column) -> DataFrame:
    """(category, n, accuracy) with a row 'Average' over all."""
    rolled = df.withColumn("__ok", correct.cast("int")).rollup(category).agg(F.grouping(category).alias("g"), F.count("*").alias("n"), F.avg("__ok").alias("accuracy"))
    return rolled.select(F.when(F.col("g") == 1, "Average").otherwise(F.col(category).cast("string")).alias("category"), "n", "accuracy")


def token_accuracy(preds: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of right tokens in a row: predictions are for the next label; ignored labels don't count (null if all are)."""
    pairs = F.filter(F.arrays_zip(F.slice(preds, F.lit(1), F.greatest(F.size(preds) - 1, F.lit(0))).alias("p"), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))).alias("y")), lambda x: x["y"] != ignore)
    return F.size(F.filter(pairs, lambda x: x["p"] == x["y"])) / F.nullif(F.size(pairs), F.lit(0))


def preference_accuracy(chosen: Column, rejected: Column) -> Column:
    return F.avg((chosen > rejected).cast("int"))


def length_cdf(df: DataFrame, length: Column, interval: int) -> DataFrame:
    """(bucket, n, cumulative, percent); as many rows as buckets."""
    counts = df.groupBy((F.floor(length / interval) * interval).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # over buckets, not rows
    total = Window.partitionBy()
    run = counts.withColumn("cumulative", F.sum("n").over(upto))
    return run.withColumn("percent", F.round(F.col("cumulative") / F.sum("n").over(total) * 100, 2))


def perplexity(logps: Column, mask: Column) -> Column:
    """exp of the mean negative log probability under the mask."""
    both = F.zip_with(logps, mask, lambda x, m: F.struct((-x * m).alias("l"), m.cast("double").alias("m")))
    add = lambda f: F.aggregate(both, F.lit(0.0), lambda s, x: s + x[f])
    return F.exp(add("l") / add("m"))


#: Rows up to which a group's percentiles are taken from all of its values at once.
EXACT_ROWS = 1_000_000
#: Bins that an interval is cut in.
BINS = 4096


def selected(df: DataFrame, key: str, value: str, ranks: DataFrame) -> DataFrame:
    """(key, rank, value): the value at each rank (from 0) of each key's values in order, exactly; ranks: (key, rank).

    Each round cuts the interval that holds a rank in BINS and goes on with the least and greatest value of the bin that has it, until they are the
    same. A task holds counts by bin, never values, so a key may have any number of rows; values that lie evenly take two or three rounds.
    """
    own = df.select(F.col(key).alias("g"), F.col(value).alias("v"))
    ends = own.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    open_ = ranks.select(F.col(key).alias("g"), F.col("rank").alias("k"), F.col("rank").alias("rest")).join(ends, "g")
    out = None
    while True:
        path = scratch(df.sparkSession, "ranks")
        open_.write.parquet(path)
        targets = df.sparkSession.read.schema(open_.schema).parquet(path)
        done = targets.where("lo >= hi").select(F.col("g").alias(key), F.col("k").alias("rank"), F.col("lo").alias("value"))
        out = done if out is None else out.union(done)
        targets = targets.where("lo < hi")
        if targets.isEmpty():
            return out
        at = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS))
        bins = own.join(targets, "g").where("v BETWEEN lo AND hi").groupBy("g", "k", "rest", at.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = bins.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "k").orderBy("bin")))  # BINS rows at most
        open_ = upto.where("upto > rest AND upto - c <= rest").select("g", "k", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest"), "lo", "hi")


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], exact_rows: int | None = None) -> DataFrame:
    """(keys, percentiles): exact, linear between neighbours, of every group's values; nulls, NaN and infinite values do not count.

    Groups of up to exact_rows rows hold their values in one task; larger ones are selected from by counts.
    """
    most = EXACT_ROWS if exact_rows is None else exact_rows
    own = df.select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    sizes = own.groupBy("g").agg(F.count("*").alias("n"))
    small, big = own, None
    if sizes.where(F.col("n") > most).limit(1).count():
        path = scratch(df.sparkSession, "sizes")
        sizes.write.parquet(path)
        sizes = df.sparkSession.read.schema(sizes.schema).parquet(path)
        small = own.join(sizes.where(F.col("n") <= most).select("g"), "g", "left_semi")
        big = sizes.where(F.col("n") > most)
    out = small.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("percentiles"))
    if big is not None:
        place = big.select("g", F.posexplode(F.array(*[F.lit(float(q)) * (F.col("n") - 1) for q in at])).alias("i", "place"))
        low, high = F.floor("place"), F.ceil("place")
        ranks = place.select("g", F.explode(F.array(low, high)).alias("rank")).distinct()
        found = selected(own.join(big.select("g"), "g", "left_semi"), "g", "v", ranks)
        near = lambda name, r: found.select("g", F.col("rank").alias(r), F.col("value").alias(name))
        both = place.withColumns({"a": low, "b": high}).join(near("x", "a"), ["g", "a"]).join(near("y", "b"), ["g", "b"])
        one = both.select("g", "i", (F.col("x") + (F.col("place") - F.col("a")) * (F.col("y") - F.col("x"))).alias("p"))
        out = out.union(one.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "p")))["p"].alias("percentiles")))  # one for each of at
    return out.select("g.*", "percentiles")


def latency(df: DataFrame, keys: list[str], ms: str, tokens: str | None = None) -> DataFrame:
    """Mean, median and 95th percentile (linear between neighbours), and tokens a second. A table that is no larger than a group may be is read once."""
    more = [(F.sum(tokens) / F.sum(F.col(ms) / 1000)).alias("tokens_per_second")] if tokens else []
    if df.count() <= EXACT_ROWS:
        number = F.col(ms).cast("double")
        value = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)
        return df.groupBy(*keys).agg(F.avg(ms).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), *more)
    means = df.groupBy(F.struct(*keys).alias("g")).agg(F.avg(ms).alias("mean"), *more)
    two = percentiles(df, keys, ms, [0.5, 0.95]).select(F.struct(*keys).alias("g"), F.col("percentiles")[0].alias("p50"), F.col("percentiles")[1].alias("p95"))
    return means.join(two, "g", "left").select("g.*", "mean", "p50", "p95", *(["tokens_per_second"] if tokens else []))


def valid_ratio(df: DataFrame, labels: str = "labels", ignore: int = -100) -> DataFrame:
    valid = F.sum(F.size(F.filter(labels, lambda y: y != ignore)))
    return df.agg(valid.alias("valid_tokens"), F.sum(F.size(labels)).alias("total_tokens"), (valid / F.sum(F.size(labels))).alias("valid_ratio"))


def _grams(words: list, n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _f1(hits: int, hyp: int, ref: int) -> float:
    if not hits or not hyp or not ref:
        return 0.0
    p, r = hits / hyp, hits / ref
    return 2 * p * r / (p + r)


def rouge_n(hyp: list[str], ref: list[str], n: int) -> float:
    """F over distinct n-grams."""
    a, b = set(_grams(hyp, n)), set(_grams(ref, n))
    return _f1(len(a & b), len(a), len(b))


def rouge_l(hyp: list[str], ref: list[str]) -> float:
    """By a longest common subsequence, a row of its table as the bits of one number: a zero is where the length grows."""
    at: dict[str, int] = {}
    for j, y in enumerate(ref):
        at[y] = at.get(y, 0) | 1 << j
    every = row = (1 << len(ref)) - 1
    for x in hyp:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & every
    return _f1(len(ref) - row.bit_count(), len(hyp), len(ref))


def bleu4(hyp: list[str], ref: list[str]) -> float:
    """One reference; a precision without a hit becomes 1 / (2**k * candidates), k counting such orders."""
    if not hyp or not any((_grams(hyp, 1) & _grams(ref, 1)).values()):
        return 0.0
    logs, k = 0.0, 0
    for n in range(1, 5):
        a, b = _grams(hyp, n), _grams(ref, n)
        total, hits = max(1, sum(a.values())), sum((a & b).values())
        if hits:
            logs += math.log(hits / total)
        else:
            k += 1
            logs -= math.log(2**k * total)
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(logs / 4)


def overlap_scores(df: DataFrame, pred: str, label: str) -> DataFrame:
    """df with rouge_1, rouge_2, rouge_l over words and bleu_4 over characters, in percent with 4 places. Arrow batches."""

    @F.pandas_udf("rouge_1 double, rouge_2 double, rouge_l double, bleu_4 double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, y in batches:
            rows = []
            for a, b in zip(p.fillna(""), y.fillna(""), strict=True):
                h, r = a.split(), b.split()
                three = (rouge_n(h, r, 1), rouge_n(h, r, 2), rouge_l(h, r)) if h and r else (0.0, 0.0, 0.0)
                rows.append([round(v * 100, 4) for v in (*three, bleu4(list(a), list(b)))])
            yield pd.DataFrame(rows, columns=["rouge_1", "rouge_2", "rouge_l", "bleu_4"])

    return df.withColumn("__s", score(pred, label)).select(*df.columns, "__s.*")


def rouge_1_counts(df: DataFrame, id_col: str, pred: Column, label: Column) -> DataFrame:
    """(id, hits, rouge_1): the word-set F without Python, from arrays of words."""
    a, b = F.array_distinct(pred), F.array_distinct(label)
    hits, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return df.select(id_col, hits.alias("hits"), F.when((hits == 0) | (n == 0) | (m == 0), 0.0).otherwise(2.0 * hits / (n + m)).alias("rouge_1"))


def with_previous(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with the value of the run before and the change in percent, null where the run before was zero."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    return df.withColumn("previous", before).withColumn("change_percent", F.when(F.col("previous") != 0, (F.col(value) - F.col("previous")) / F.col("previous") * 100))


def progress(df: DataFrame, steps: str, total: int, elapsed: str) -> DataFrame:
    """df with percentage and remaining seconds from steps done and seconds elapsed."""
    return df.withColumns({"percentage": F.round(F.col(steps) / total * 100, 2), "remaining": F.when(F.col(steps) > 0, (total - F.col(steps)) * F.col(elapsed) / F.col(steps))})


def preference_types(rows: DataFrame, wanted: Column) -> DataFrame:
    """One row: how many answers are wanted, how many unwanted; a null tag is neither."""
    return rows.agg(F.count_if(wanted).alias("wanted"), F.count_if(~wanted).alias("unwanted"))


def context_precision(verdicts: Column) -> Column:
    """Of an array of verdicts (1 relevant, 0 not) in rank order: the mean precision at the ranks of the relevant contexts; 0 without any."""
    upto = lambda k: F.aggregate(F.slice(verdicts, F.lit(1), k), F.lit(0), lambda a, v: a + v)
    hits = F.transform(verdicts, lambda v, i: v * upto(i + 1) / (i + 1))
    relevant = F.aggregate(verdicts, F.lit(0), lambda a, v: a + v)
    return F.when(relevant > 0, F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / relevant).otherwise(F.lit(0.0))


def context_recall(supported: Column) -> Column:
    """Of an array of verdicts (1 supported by the contexts, 0 not) of a reference answer's statements: the share supported; null without any."""
    return F.when(F.size(supported) > 0, F.aggregate(supported, F.lit(0), lambda a, v: a + v) / F.size(supported))
