"""Merkle manifest of a data set: a root for every source, one for all, and for each row the proof that it is part of them.

H is lower-case hex SHA-256 of its inputs put together, digests as hex text. A leaf is H of a row's fields, each ``-`` if null, else its number
of UTF-8 bytes, ``:`` and its value. The leaves of a source stand by id, every ``fanout`` neighbours become their H, level by level, until one
is left, the source's subroot; the subroots, by source with null first, become the root in the same way. A lone leaf is its source's subroot.

Up: rows are numbered (ranges of the order, row_number in each range, the ranges before added), a source's first number is taken off, and each
level groups nodes by source and index // fanout, sorts the children and stages their parents with them. Levels shrink by the fanout, and no key
has more than fanout rows, however many rows a source has.
Down: a parent's proof is joined with its children, level by level from the root, each child putting its own siblings in front. So a level
joins one row for each parent, and the rows of the table meet their parents' proofs once, at the end. Digests travel as bytes.

Rows of equal id stand by their leaf; equal rows are leaves of their own with equal digests. A null id comes first and is a ``-`` in the leaf; a null
source is a source. Without rows there is no root. Columns of the input come through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, met, stage

PATH = "array<struct<before: binary, after: binary>>"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """H of a row's fields."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def as_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def placed(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df with its place from 0 by order in column __at; order must have no equal rows. Staged once, with the numbers in each range."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    rows = stage(ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long")), label)
    sums = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return rows.join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part").withColumn("__at", F.col("__before") + F.col("__r") - 1).drop("__part", "__r", "__before")


def height(n: int, fanout: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def heights(n: Column, most: int, fanout: int) -> Column:
    """height() of a column of at most most."""
    out, size = F.lit(0), 1
    for h in range(1, height(most, fanout) + 1):
        out = F.when(n > size, h).otherwise(out)
        size *= fanout
    return out


def parents(nodes: DataFrame, fanout: int, label: str) -> DataFrame:
    """The next level of nodes (s, i, n, h): (s, i, n, h, kids), n being how many nodes the level of s has, kids the children's i and h in order."""
    up = nodes.where("n > 1").groupBy("s", F.expr(f"i div {fanout}").alias("i"))
    found = up.agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "h"))).alias("kids"))  # at most fanout children
    digest = F.unhex(F.sha2(F.array_join(F.transform("kids", lambda k: as_text(k["h"])), ""), 256))
    return stage(found.select("s", "i", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest.alias("h"), "kids"), label)


def step(i: Column, kids: Column) -> Column:
    """What a child's path begins with: the digests before and after its own."""
    side = lambda keep: F.aggregate(F.filter(kids, keep), F.lit(b""), lambda a, k: F.concat(a, k["h"]))
    return F.struct(side(lambda k: k["i"] < i).alias("before"), side(lambda k: k["i"] > i).alias("after"))


def lower(level: DataFrame, paths: DataFrame, keep: list[str]) -> DataFrame:
    """The paths (s, i, path, *keep) of the children of a level whose own paths are given."""
    joined = level.select("s", "i", "kids").join(paths, ["s", "i"]).withColumn("k", F.explode("kids"))
    return joined.select("s", F.col("k.i").alias("i"), F.concat(F.array(step(F.col("k.i"), F.col("kids"))), "path").alias("path"), *keep)


def proofs(leaves: DataFrame, source_col: str, order: list[str], leaf_col: str, fanout: int = 3) -> DataFrame:
    """The rows of leaves, all columns kept, with subroot, root (hex) and proof: for each level the digests before and after the row's own.

    leaf_col: the leaf digests as hex text, without nulls. Rows of a source stand by order, then by leaf.
    """
    names = leaves.columns
    plain = leaves.toDF(*[f"c{j}" for j in range(len(names))])  # no clash with the names used here
    c = {n: f"c{j}" for j, n in enumerate(names)}
    plain = stage(plain.withColumn(c[leaf_col], F.unhex(c[leaf_col])).withColumn("u", F.monotonically_increasing_id()), "merkle-leaves")
    rows = placed(plain, [c[source_col], *[c[o] for o in order if o != source_col], c[leaf_col], "u"], "merkle-rows").drop("u")
    groups = rows.groupBy(F.col(c[source_col]).alias("g")).agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    sources = placed(groups, ["first"], "merkle-sources").withColumnRenamed("__at", "s")
    sources = stage(sources, "merkle-sources")
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = met(rows, sources, {"g": F.col(c[source_col])}, "inner").withColumn("i", F.col("__at") - F.col("first"))

    levels = [nodes.select("s", "i", "n", F.col(c[leaf_col]).alias("h"))]
    for k in range(height(most, fanout)):
        levels.append(parents(levels[-1], fanout, f"merkle-{k}"))
    tops = [x.where("n = 1").select("s", "h") for x in levels]
    subroots = tops[0]
    for x in tops[1:]:
        subroots = subroots.union(x)
    subroots = stage(subroots.select(F.lit(0).cast("long").alias("s"), F.col("s").alias("i"), F.lit(n_sources).cast("long").alias("n"), "h"), "merkle-subroots")

    above = [subroots]
    for k in range(height(n_sources, fanout)):
        above.append(parents(above[-1], fanout, f"merkle-top-{k}"))
    root = above[-1].select(as_text(F.col("h")).alias("h")).first() if n_sources else None
    paths = above[-1].select("s", "i", F.array().cast(PATH).alias("path"))
    for level in reversed(above[1:]):
        paths = lower(level, paths, [])
    own = subroots.select("i", F.col("h").alias("subroot")).join(paths.select("i", "path"), "i")
    sized = sources.select(F.col("s").alias("i"), heights(F.col("n"), max(most, 1), fanout).alias("height"))
    starts = stage(own.join(sized, "i").select(F.col("i").alias("s"), "path", "subroot", "height"), "merkle-starts")

    begins = lambda k: starts.where(F.col("height") == k).select("s", F.lit(0).cast("long").alias("i"), "path", "subroot")
    tree = begins(len(levels) - 1) if len(levels) > 1 else None
    for k in range(len(levels) - 1, 1, -1):
        tree = lower(levels[k], tree, ["subroot"]).union(begins(k - 1))
    none = F.lit(None).cast("array<struct<i: bigint, h: binary>>").alias("kids")
    last = begins(0).select("s", "i", none, "path", "subroot")
    if tree is not None:
        last = last.union(levels[1].select("s", "i", "kids").join(tree, ["s", "i"]).select("s", "i", "kids", "path", "subroot"))
    named = fresh(leaves, "subroot", "root", "proof")
    met_last = nodes.withColumn("up", F.expr(f"i div {fanout}")).join(last.toDF("s", "up", "kids", "path", "subroot"), ["s", "up"])
    path = F.when(F.col("kids").isNull(), F.col("path")).otherwise(F.concat(F.array(step(F.col("i"), F.col("kids"))), "path"))
    found = [as_text(F.col(c[n])).alias(n) if n == leaf_col else F.col(c[n]).alias(n) for n in names]
    more = as_text(F.col("subroot")), F.lit(root["h"] if root else None).cast("string"), path
    return met_last.select(*found, *[v.alias(n) for v, n in zip(more, named, strict=True)])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest (hex) and a proof give."""
    return F.aggregate(proof, leaf, lambda own, p: F.sha2(F.concat(as_text(p["before"]), own, as_text(p["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings in a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(as_text(p["before"]), as_text(p["after"]))), ""), 256)


def manifest(docs: DataFrame, fields: list[str], source_col: str = "source", id_col: str = "doc_id", fanout: int = 3) -> DataFrame:
    """A row for each row of docs: <id_col>, <source_col>, leaf over the fields in their order, subroot, root, proof (see proofs)."""
    leaves = docs.select(id_col, source_col, leaf_digest(*[F.col(f) for f in fields]).alias("leaf"))
    return proofs(leaves, source_col, [id_col], "leaf", fanout)
