"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, fill_in_middle, html_extract, language_id, line_dedup, manifest, packing, quality, simhash, suffix_dedup, token_counts, toxicity
from .common import load

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(load(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    found = toxicity.toxicity_scores(load(spark, sf_dir, "documents"), known)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    return language_id.identify(docs, docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.restored(fill_in_middle.fill_in_middle(load(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.unhex(manifest.leaf_digest(*head, F.translate("text", "\n", ""))))
    leaves = docs.select("doc_id", "source", manifest.leaf_digest(*head, F.col("text")).alias("leaf"), cut.alias("tampered"))
    found = manifest.proofs(leaves, "source", ["doc_id"], "leaf", fanout=3)
    again = manifest.folded(F.coalesce(manifest.as_text(F.col("tampered")), "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP10_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
w AS (SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(lower(line), '[ \t\x0b\f\r]+'), lambda x: x <> '') AS words FROM l),
e AS (SELECT *, array_to_string(words, ' ') AS j, len(words) AS n, doc_id * 1000000 + line_no AS pos FROM w),
c AS (SELECT j, n, any_value(words) AS words, min(pos) AS first FROM e WHERE n >= 1 GROUP BY j, n),
v AS (SELECT j, n, first, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c WHERE n >= 5)),
s AS (SELECT v, n, i, min(first) AS m FROM v GROUP BY v, n, i),
d AS (SELECT v, min(first) AS m FROM v GROUP BY v),
near AS (
  SELECT v.j FROM v JOIN s USING (v, n, i) WHERE s.m < v.first
  UNION SELECT c.j FROM c JOIN d ON c.j = d.v WHERE c.n >= 5 AND d.m < c.first
  UNION SELECT v.j FROM v JOIN c ON v.v = c.j WHERE c.n >= 5 AND c.first < v.first),
k AS (SELECT e.*, coalesce(near.j IS NOT NULL OR e.pos > c.first, false) AS gone FROM e LEFT JOIN c ON e.j = c.j AND e.n = c.n LEFT JOIN near ON e.j = near.j)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4,
  regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

OP13_SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
  || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
  list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) AS state FROM documents),
e AS (SELECT rid, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  CASE WHEN xor(state, 4294967295) % 2 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) END AS tampered FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM e),
lower_nodes(k, s, i, n, h) AS (
  SELECT 0, s, i, n, leaf FROM leaves
  UNION ALL SELECT k + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lower_nodes WHERE n > 1 GROUP BY k, s, i // 3, n),
sub AS (SELECT s, k AS height, h FROM lower_nodes WHERE n = 1),
upper_nodes(k, i, n, h) AS (
  SELECT 0, s, count(*) OVER (), h FROM sub
  UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY k, i // 3, n),
top AS (SELECT k AS height, h FROM upper_nodes WHERE n = 1),
sib AS (
  SELECT rid, 0 AS t, x.k, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < l.i // CAST(power(3, x.k) AS BIGINT)), '') AS b, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > l.i // CAST(power(3, x.k) AS BIGINT)), '') AS a
  FROM leaves l JOIN lower_nodes x ON x.s = l.s AND x.n > 1 AND x.i // 3 = l.i // CAST(power(3, x.k + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT rid, 1, x.k, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < l.s // CAST(power(3, x.k) AS BIGINT)), ''), coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > l.s // CAST(power(3, x.k) AS BIGINT)), '')
  FROM leaves l JOIN upper_nodes x ON x.n > 1 AND x.i // 3 = l.s // CAST(power(3, x.k + 1) AS BIGINT) GROUP BY ALL),
steps AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY t, k) AS j FROM sib),
whole AS (SELECT rid, sha256(string_agg(b || a, '' ORDER BY j)) AS proof_sha256 FROM steps GROUP BY rid),
fold(rid, j, h) AS (
  SELECT rid, 0, coalesce(tampered, leaf) FROM leaves
  UNION ALL SELECT f.rid, s.j, sha256(s.b || f.h || s.a) FROM fold f JOIN steps s ON s.rid = f.rid AND s.j = f.j + 1),
ended AS (SELECT rid, arg_max(h, j) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM leaves JOIN sub USING (s) JOIN ended USING (rid) LEFT JOIN whole USING (rid) CROSS JOIN top
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_manifest": OP13_SQL}
