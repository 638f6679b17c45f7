"""Splits, samples, mixes and draws that give the same rows on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def hash_split(df: DataFrame, key: Column | str, percent: int, seed: str = "", names: tuple[str, str] = ("test", "train")) -> DataFrame:
    """Column split: percent of the keys, by hash, to the first name. Equal keys go together, so no shuffle and no leak."""
    key = F.col(key) if isinstance(key, str) else key
    return df.withColumn("split", F.when(X.hash_bucket(F.concat(F.lit(seed), key.cast("string")), 100) < percent, names[0]).otherwise(names[1]))


#: Rows that a range's bounds are chosen from, for each range.
BOUND_ROWS = 20


def range_number(df: DataFrame, order: list[str]) -> Column:
    """A number for each row that rises with order, spreading df over about as many ranges as there are shuffle partitions.

    The bounds are taken once, from a sample of at most BOUND_ROWS rows a range (those of the least hash), and are constants of the
    expression: wherever, and however often, the number is computed, a row has the same one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    own = F.struct(*[F.col(c) for c in order])
    hashed = F.xxhash64(*[F.col(c).cast("string") for c in order])
    chosen = df.select(*order).withColumn("__h", hashed).orderBy("__h").limit(BOUND_ROWS * parts).orderBy(*order).collect()
    step = max(1, len(chosen) // parts)
    types = {c: df.schema[c].dataType for c in order}
    bounds = [F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order]) for r in chosen[step::step]]

    def place(lo: int, hi: int) -> Column:
        """How many of the bounds lo..hi - 1 a row reaches, plus lo, by bisection."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(own >= bounds[mid], place(mid + 1, hi)).otherwise(place(lo, mid))

    return place(0, len(bounds))


def running_total(df: DataFrame, order: list[str], value: Column | str, name: str) -> DataFrame:
    """df with the sum of value up to and with each row by order: summed in each range of rows and shifted by the ranges before.

    Equal rows by order come in any order, in one task.
    """
    value = F.col(value) if isinstance(value, str) else value
    ranged = df.withColumn("__v", value).withColumn("__part", range_number(df, order))
    sums = ranged.groupBy("__part").agg(F.sum("__v").alias("__n"))  # a row a range
    before = sums.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum("__v").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before", "__v")


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with positions from 0 by order."""
    return running_total(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """In the order of a seeded hash of the key."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)


def sampled(df: DataFrame, n: int, key: str, seed: str = "42") -> DataFrame:
    """n rows: a permutation's first n, and once the rows run out whole further rounds of it, so each row comes as often or once more."""
    total = df.count()
    if total == 0:
        return df.limit(0)
    whole, rest = divmod(n, total)
    part = shuffled(df, key, seed).limit(rest)
    if not whole:
        return part
    copies = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("__copy")
    return copies.unionByName(part) if rest else copies


def train_validation(df: DataFrame, size: float | int, key: str, seed: str = "42") -> dict[str, DataFrame]:
    """size under 1: that share by hash; an integer: so many rows."""
    if size == 0:
        return {"train": df}
    if isinstance(size, float) and size < 1:
        both = hash_split(df, key, round(size * 100), seed)
        return {"validation": both.where("split = 'test'").drop("split"), "train": both.where("split = 'train'").drop("split")}
    held = shuffled(df, key, seed).limit(int(size))
    return {"validation": held, "train": df.join(held.select(key), key, "left_anti")}


def leaked(df: DataFrame, key: str) -> DataFrame:
    """Keys that are on more than one side of column split."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key)


def concatenated(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def round_robin(parts: list[DataFrame], order: list[str], stop: str = "first_exhausted") -> DataFrame:
    """Rows in turn from each part: until the shortest ends, or (all_exhausted) until the longest does, shorter ones starting anew.

    Column mix_pos is the place of the row.
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(f"unknown strategy {stop}")
    sizes = [p.count() for p in parts]
    if min(sizes) == 0:
        return parts[0].limit(0).withColumn("mix_pos", F.lit(0).cast("long"))
    rounds = min(sizes) if stop == "first_exhausted" else max(sizes)
    out = None
    for i, (p, size) in enumerate(zip(parts, sizes, strict=True)):
        own = numbered(p, order, "__at")
        copies = -(-rounds // size)
        if copies > 1:
            own = own.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("__at", F.col("__at") + F.col("__c") * size).drop("__c")
        own = own.where(F.col("__at") < rounds).withColumn("mix_pos", (F.col("__at") * len(parts) + i).cast("long")).drop("__at")
        out = own if out is None else out.unionByName(own)
    return out


def probabilistic_mix(parts: list[DataFrame], probabilities: list[float], order: list[str], draws: int, seed: str = "42") -> DataFrame:
    """draws rows; draw number d takes part i by a hash of seed and d, and each part's rows go in order, starting anew at its end."""
    if abs(sum(probabilities) - 1) > 1e-9 or len(parts) != len(probabilities):
        raise ValueError("one probability a part, 1 together")
    spark = parts[0].sparkSession
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    edges = [sum(probabilities[: i + 1]) for i in range(len(probabilities) - 1)]
    which = F.coalesce(*[F.when(u < e, F.lit(i)) for i, e in enumerate(edges)], F.lit(len(parts) - 1))
    drawn = spark.range(draws).select("id", which.alias("part"))
    out = None
    for i, p in enumerate(parts):
        size = p.count()
        own = numbered(drawn.where(F.col("part") == i), ["id"], "__k").select(F.col("id").alias("mix_pos"), (F.col("__k") % max(size, 1)).alias("__at"))
        rows = numbered(p, order, "__at").join(own, "__at").drop("__at")
        out = rows if out is None else out.unionByName(rows)
    return out


def few_shot(targets: DataFrame, pool: DataFrame, n: int, target_key: str, pool_key: str, seed: str = "42") -> DataFrame:
    """n different pool rows for each target (all, if the pool has fewer), drawn by hash: (target_key, pool columns, shot).

    The pool is numbered by its key and cut in n equal stretches; shot i is the row at a hashed place of stretch i. So a target meets n
    rows of the pool, by an equi-join on the number.
    """
    total = pool.count()
    n = min(n, total)
    name = target_key if target_key not in pool.columns else f"target_{target_key}"
    drawn = targets.select(F.col(target_key).alias(name)).withColumn("shot", F.explode(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")))
    lo, hi = (F.expr(f"(cast(shot as bigint) - {k}) * {total} div {max(n, 1)}") for k in (1, 0))
    place = lo + X.hash_bucket(F.concat_ws("|", F.lit(seed), F.col(name).cast("string"), F.col("shot").cast("string")), hi - lo)
    return drawn.withColumn("__at", place.cast("long")).join(numbered(pool, [pool_key], "__at"), "__at").drop("__at")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: of each key the row of the greatest order; a map-side aggregate, not a window."""
    others = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *others)).alias("r")).select(key, "r.*")


def divided(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Column part: n parts of consecutive rows whose sizes differ by one at most."""
    total = df.count()
    return numbered(df, order, "__pos").withColumn("part", F.floor(F.col("__pos") * n / max(total, 1)).cast("int")).drop("__pos")
