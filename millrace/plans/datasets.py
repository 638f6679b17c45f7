"""Queries of the dataset engine: alignment, rendering, mixing, splitting, encoding arithmetic, windows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.media import get_plugin
from ..functions.templates import choice_templates, get_template, reasoning_messages
from ..functions.tools import extracted_calls, function_texts
from ..operators import align, chunking, encode, fusion, metrics, qa, sampling
from ..sources import readers
from ..streaming import streams
from .catalogue import register
from .corpus import _QA, _STRIP, docs, labels, lines, pairs, table, talk
from .retrieval import _CHAIN, documents, questions, reranked
from .retrieval import bm25 as bm25_ranked

events, pages, embeddings = table("events"), table("pages"), table("embeddings")

# ---- alignment

_OPENAI = align.openai_columns()
_ALIGN = """m AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1),
o AS (SELECT conv_id, roles[1] = 'system' AS led, CASE WHEN roles[1] = 'system' THEN texts[1] ELSE '' END AS _system, CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END AS r, CASE WHEN roles[1] = 'system' THEN texts[2:] ELSE texts END AS t FROM m),
al AS (SELECT *, len(r) % 2 = 0 AND len(list_filter(list_zip(r, range(0, len(r))), lambda z: (z[2] % 2 = 0 AND z[1] <> 'user') OR (z[2] % 2 = 1 AND z[1] <> 'assistant'))) = 0 AS ok FROM o)"""


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    return align.dialogues(talk(spark, sf), "conv_id", "turn", "role", "text", "messages")


def aligned(spark: SparkSession, sf: str, **more: object) -> DataFrame:
    own = dialogues(spark, sf)
    out = align.align(own, align.openai_columns(**more))
    return out.withColumn("first", F.try_element_at("_prompt", F.lit(1))["content"])


def _said(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")


register(
    "p15_align_sharegpt",
    lambda s, d: aligned(s, d).select(_said("_prompt").alias("prompt"), _said("_response").alias("response"), F.col("_system").alias("system")),
    f"WITH {_ALIGN} SELECT CASE WHEN ok THEN array_to_string(list_transform(list_zip(r[:len(r) - 1], t[:len(t) - 1]), lambda z: z[1] || ':' || z[2]), chr(10)) ELSE '' END AS prompt, CASE WHEN ok AND len(r) > 0 THEN r[-1] || ':' || t[-1] ELSE '' END AS response, _system AS system FROM al",
)


def kto(spark: SparkSession, sf: str) -> DataFrame:
    own = dialogues(spark, sf).join(labels(spark, sf).select(F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("tag")), "conv_id")
    out = align.align(own, align.openai_columns(kto_tag="tag"))
    return out.select(_said("_prompt").alias("prompt"), F.array_join(F.transform("_response", lambda m: F.concat(F.lit("<"), m["content"], F.lit(">"))), "|").alias("response"))


register(
    "p15_align_kto",
    kto,
    f"""WITH {_ALIGN}, k AS (SELECT al.*, quality = 1 AS tag FROM al JOIN labels ON doc_id = conv_id)
SELECT CASE WHEN ok THEN array_to_string(list_transform(list_zip(r[:len(r) - 1], t[:len(t) - 1]), lambda z: z[1] || ':' || z[2]), chr(10)) ELSE '' END AS prompt,
  CASE WHEN NOT ok THEN '' WHEN tag THEN CASE WHEN len(t) > 0 THEN '<' || t[-1] || '>|' ELSE '' END || '<>' ELSE '<>' || CASE WHEN len(t) > 0 THEN '|<' || t[-1] || '>' ELSE '' END END AS response FROM k""",
)


def alpaca(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select(F.col("text").alias("instruction"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("input"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("output"), F.array(F.array(F.col("source"), F.col("lang"))).alias("history"), "doc_id")
    out = align.align(own, align.Columns(history="history"))
    return out.select(_said("_prompt").alias("prompt"), _said("_response").alias("response"), F.size("_prompt").cast("long").alias("n"))


register(
    "p14_align_alpaca",
    alpaca,
    "SELECT 'user:' || source || chr(10) || 'assistant:' || lang || chr(10) || 'user:' || CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || source ELSE text END AS prompt, CASE WHEN doc_id % 3 <> 0 THEN 'assistant:' || text ELSE '' END AS response, 3 AS n FROM documents",
)
register("p18_prompt_valid", lambda s, d: aligned(s, d).agg(F.count_if(align.encodable("sft")).alias("sft"), F.count_if(align.encodable("pt")).alias("pt"), F.count_if(align.encodable("dpo")).alias("dpo")), f"WITH {_ALIGN} SELECT count(*) FILTER (ok AND len(r) > 0 AND len(r) % 2 = 0) AS sft, count(*) FILTER (ok AND len(r) > 0) AS pt, 0 AS dpo FROM al")
register(
    "p21_chat_request",
    lambda s, d: align.normalise_request(dialogues(s, d)).select("conv_id", "error", F.size("_prompt").cast("long").alias("n"), F.col("_system").alias("system")),
    f"""WITH {_ALIGN}, e AS (SELECT *, CASE WHEN len(roles_) = 0 THEN 'Invalid length' WHEN len(r) % 2 = 0 THEN 'Only supports u/a/u/a/u...' WHEN len(list_filter(list_zip(r, range(0, len(r))), lambda z: (z[2] % 2 = 0 AND z[1] <> 'user') OR (z[2] % 2 = 1 AND z[1] <> 'assistant'))) > 0 THEN 'Invalid role' END AS error FROM (SELECT *, r AS roles_ FROM al))
SELECT conv_id, error, CASE WHEN error IS NULL THEN len(r) ELSE 0 END AS n, _system AS system FROM e""",
)
_CHATML = "CASE WHEN z[1] = 'user' THEN '<|im_start|>user' || chr(10) || z[2] || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE z[2] || '<|im_end|>' || chr(10) END"
register(
    "x20_chat_render",
    lambda s, d: aligned(s, d).where(align.encodable("sft")).select(get_template("chatml").rendered(F.concat("_prompt", "_response"), "_system").alias("text")),
    f"WITH {_ALIGN} SELECT CASE WHEN _system <> '' THEN '<|im_start|>system' || chr(10) || _system || '<|im_end|>' || chr(10) ELSE '' END || array_to_string(list_transform(list_zip(r, t), lambda z: {_CHATML}), '') AS text FROM al WHERE ok AND len(r) > 0",
)
_THOUGHT = "CASE WHEN doc_id % 2 = 0 THEN '<think>' || chr(10) || source || '</think>' || chr(10) || chr(10) ELSE '' END || text"
register("x15_think_strip", lambda s, d: docs(s, d).select("doc_id", X.without_thought(F.expr(_THOUGHT)).alias("text")), f"SELECT doc_id, regexp_replace(regexp_replace({_THOUGHT}, '(?s)<think>(.*?)</think>', '', 'g'), '^\\n+', '') AS text FROM documents")
register("x16_empty_thought", lambda s, d: docs(s, d).select("doc_id", X.with_empty_thought(F.expr(_THOUGHT)).alias("text")), f"SELECT doc_id, CASE WHEN contains({_THOUGHT}, '<think>') THEN {_THOUGHT} ELSE '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || {_THOUGHT} END AS text FROM documents")
register(
    "x17_slot_format",
    lambda s, d: docs(s, d).select("doc_id", get_template("default").rendered(F.array(align.message("user", F.col("text")), align.message("assistant", F.col("lang"))), F.lit("S"), eos="</s>").alias("text")).select("doc_id", F.md5("text").alias("text")),
    "SELECT doc_id, md5('System: S</s>' || chr(10) || 'Human: ' || text || '</s>' || chr(10) || 'Assistant:' || lang || '</s>' || chr(10)) AS text FROM documents",
)
register(
    "x21_template_registry",
    lambda s, d: docs(s, d).select("doc_id", *[F.md5(get_template(k).rendered(F.array(align.message("user", F.col("text")), align.message("assistant", F.col("lang"))), F.lit("S"), eos="</s>")).alias(k) for k in ("llama2", "mistral", "phi4", "zephyr", "glm4")]),
    """SELECT doc_id, md5('<s>[INST] <<SYS>>' || chr(10) || 'S' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text || ' [/INST]' || lang || '</s>') AS llama2,
  md5('<s>[INST] S' || chr(10) || chr(10) || text || '[/INST] ' || lang || '</s>') AS mistral,
  md5('<|im_start|>system<|im_sep|>S<|im_end|><|im_start|>user<|im_sep|>' || text || '<|im_end|><|im_start|>assistant<|im_sep|>' || lang || '<|im_end|>') AS phi4,
  md5('<|system|>' || chr(10) || 'S</s><|user|>' || chr(10) || text || '</s><|assistant|>' || chr(10) || lang || '</s>') AS zephyr,
  md5('[gMASK]<sop><|system|>' || chr(10) || 'S<|user|>' || chr(10) || text || '<|assistant|>' || chr(10) || lang) AS glm4 FROM documents""",
)
register("x23_prompt_build", lambda s, d: docs(s, d).select("doc_id", F.md5(X.filled("Q {{q}} C {{c}} Q {{q}}", q="text", c="lang")).alias("text")), "SELECT doc_id, md5('Q ' || text || ' C ' || lang || ' Q ' || text) AS text FROM documents")


def choices(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select("doc_id", F.col("text").alias("q"), *[F.concat(F.lit(c), F.col("source")).alias(c) for c in "ABCD"], "lang")
    prompt = choice_templates["en"].prompt(F.col("q"), {c: F.col(c) for c in "ABCD"})
    target = F.struct(prompt.alias("prompt"), F.lit("A").alias("answer"))
    text = choice_templates["en"].messages(F.array(target), target, F.col("lang"))
    return own.select("doc_id", F.array_join(F.transform(text, lambda m: m["content"]), "#").alias("text"))


_MC = "text || chr(10) || 'A. A' || source || chr(10) || 'B. B' || source || chr(10) || 'C. C' || source || chr(10) || 'D. D' || source || chr(10) || 'Answer:'"
register("x24_choice_prompt", choices, f"SELECT doc_id, 'The following are multiple choice questions (with answers) about ' || lang || '.' || chr(10) || chr(10) || {_MC} || '#A#' || {_MC} || '#A' AS text FROM documents")
_QWEN_CALL = """'<tool_call>' || chr(10) || '{"name": "f", "arguments": {"a": ' || doc_id || '}}' || chr(10) || '</tool_call>'"""
_PLAIN_CALL = """'Action: f' || chr(10) || 'Action Input: {"a": ' || doc_id || '}'"""


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The calls in an answer of each document's dialect; of every fifth the JSON is broken."""
    said = F.expr(f"if(doc_id % 5 = 0, replace(if(doc_id % 2 = 0, {_QWEN_CALL}, {_PLAIN_CALL}), ': ', ':, '), if(doc_id % 2 = 0, {_QWEN_CALL}, {_PLAIN_CALL}))")
    own = docs(spark, sf).select("doc_id", said.alias("said"))
    calls = F.when(F.col("doc_id") % 2 == 0, extracted_calls("said", "qwen")).otherwise(extracted_calls("said", "default"))
    return own.select("doc_id", calls.alias("calls")).select("doc_id", F.coalesce(F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit(" "), c["arguments"])), "|"), F.lit("none")).alias("calls"))


register("x18_tool_calls", tool_calls, """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE 'f {"a": ' || doc_id || '}' END AS calls FROM documents""")
register(
    "x19_function_text",
    lambda s, d: docs(s, d).select("doc_id", F.expr("""'{"name": "f", "arguments": {"a": ' || doc_id || '}}'""").alias("call")).select("doc_id", *[function_texts("call", k).alias(f"{k}_text") for k in ("default", "glm4", "qwen")]),
    f"""SELECT doc_id, {_PLAIN_CALL} AS default_text, 'f' || chr(10) || '{{"a": ' || doc_id || '}}' AS glm4_text, {_QWEN_CALL} AS qwen_text FROM documents""",
)
register(
    "x29_media_counts",
    lambda s, d: docs(s, d).select("doc_id", X.media_counts_match(F.concat(F.repeat(F.lit("<image>"), (F.col("doc_id") % 3).cast("int")), F.lit("x")), "<image>", F.array_repeat(F.lit("p"), (F.col("doc_id") % 2).cast("int"))).alias("ok")),
    "SELECT doc_id, doc_id % 3 = doc_id % 2 AS ok FROM documents",
)


def tile_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A picture of each text's measures (characters by lines, in tens of pixels), as two families cut it in tiles."""
    own = docs(spark, sf).select("doc_id", F.struct((F.length("text") % 2000 + 1).cast("int").alias("width"), (F.size(F.split("text", "\n")) * 40).cast("int").alias("height"), F.lit(None).cast("int").alias("frames"), F.lit(None).cast("double").alias("seconds")).alias("m"))
    made = {k: get_plugin(k).expanded(F.lit("<image>"), F.array("m")) for k in ("llama4", "minicpm_v")}
    many = lambda k, token: F.regexp_count(made[k], F.lit(token)).cast("long")
    return own.select("doc_id", many("llama4", "tile_y_separator").alias("tile_rows"), many("llama4", r"<\|patch\|>").alias("patches"), many("minicpm_v", "<slice>").alias("slices"), many("minicpm_v", "\n").alias("slice_breaks"))


register(
    "g6_tile_grids",
    tile_tokens,
    """WITH s AS (SELECT doc_id, (length(text) % 2000 + 1)::double AS w, (len(string_split(text, chr(10))) * 40)::double AS h FROM documents),
sides AS (SELECT unnest(range(1, 17)) AS i), g AS (SELECT a.i AS a, b.i AS b FROM sides a, sides b WHERE a.i * b.i <= 16),
t AS (SELECT doc_id, a, b, least(336 * a / h, 336 * b / w) AS scale FROM s, g),
k AS (SELECT doc_id, first(struct_pack(a := a, b := b) ORDER BY scale < 1, CASE WHEN scale >= 1 THEN scale ELSE -scale END, a * b, a) AS best FROM t GROUP BY 1),
c AS (SELECT doc_id, w, h, least(ceil(w * h / (448 * 448)), 9) AS cover FROM s),
n AS (SELECT doc_id, cover, first(struct_pack(a := a, b := b) ORDER BY round(abs(ln(w / h) - ln(a::double / b)), 12), a * b, a) AS cut FROM c, g WHERE a * b BETWEEN 2 AND 9 AND abs(a * b - cover) <= 1 GROUP BY ALL)
SELECT k.doc_id, CASE WHEN best.a * best.b > 1 THEN best.a ELSE 0 END AS tile_rows, 144 * (1 + CASE WHEN best.a * best.b > 1 THEN best.a * best.b ELSE 0 END) AS patches,
  CASE WHEN cover > 1 THEN cut.a * cut.b ELSE 0 END AS slices, CASE WHEN cover > 1 THEN cut.b - 1 ELSE 0 END AS slice_breaks FROM k JOIN n USING (doc_id)""",
)


def media_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with 0 to 2 images, of sizes made from the rows, as three model families want them; every seventh lacks an image."""
    size = lambda n: F.struct(((F.col("doc_id") * 37 + n * 101) % 2000 + 20).cast("int").alias("width"), ((F.col("doc_id") * 53 + n * 211) % 1500 + 20).cast("int").alias("height"), F.lit(None).cast("int").alias("frames"), F.lit(None).cast("double").alias("seconds"))
    n = (F.col("doc_id") % 3).cast("int")
    own = docs(spark, sf).select("doc_id", F.concat(F.lit("a "), F.repeat(F.lit("<image> b "), n + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))).alias("content"), F.slice(F.array(size(0), size(1)), F.lit(1), n).alias("images"))
    made = {k: get_plugin(k).expanded("content", F.col("images")) for k in ("gemma3", "pixtral", "qwen2_vl")}
    return own.select("doc_id", F.length(made["gemma3"]).cast("long").alias("gemma3"), F.md5(made["pixtral"]).alias("pixtral"), F.regexp_count(made["qwen2_vl"], F.lit(r"<\|image_pad\|>")).cast("long").alias("qwen2_vl"))


register(
    "g6_media_tokens",
    media_tokens,
    """WITH i AS (SELECT doc_id, unnest(range(0, doc_id % 3)) AS n FROM documents), s AS (SELECT doc_id, n, ((doc_id * 37 + n * 101) % 2000 + 20)::double AS w, ((doc_id * 53 + n * 211) % 1500 + 20)::double AS h FROM i),
g AS (SELECT *, greatest(28, round(h / 28) * 28) AS h0, greatest(28, round(w / 28) * 28) AS w0, sqrt(h * w / 589824) AS down, sqrt(3136 / (h * w)) AS up FROM s),
q AS (SELECT *, CASE WHEN h0 * w0 > 589824 THEN greatest(28, floor(h / down / 28) * 28) WHEN h0 * w0 < 3136 THEN greatest(28, ceil(h * up / 28) * 28) ELSE h0 END AS h1, CASE WHEN h0 * w0 > 589824 THEN greatest(28, floor(w / down / 28) * 28) WHEN h0 * w0 < 3136 THEN greatest(28, ceil(w * up / 28) * 28) ELSE w0 END AS w1 FROM g),
t AS (SELECT doc_id, sum(h1 / 28 * (w1 / 28))::bigint AS q, string_agg(rtrim(repeat(repeat('[IMG]', ceil(w / 16)::int) || '[IMG_BREAK]', ceil(h / 16)::int - 1)) || repeat('[IMG]', ceil(w / 16)::int) || '[IMG_END] b ', '' ORDER BY n) AS p, count(*) AS c FROM q GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 2 + coalesce(c, 0) * (length(' b ') + 256 * length('<image_soft_token>') + length('<start_of_image><end_of_image>') + 4) END AS gemma3, CASE WHEN doc_id % 7 <> 0 THEN md5('a ' || coalesce(p, '')) END AS pixtral, CASE WHEN doc_id % 7 <> 0 THEN coalesce(q, 0) END AS qwen2_vl FROM documents LEFT JOIN t USING (doc_id)""",
)

# ---- mixing, splitting, drawing

_BUCKET = "(('0x' || substr(md5({}), 1, 8))::bigint % {})"
register("tk6_hash_split", lambda s, d: sampling.hash_split(docs(s, d).select("doc_id"), "doc_id", 10, "42"), f"SELECT doc_id, CASE WHEN {_BUCKET.format(chr(39) + '42' + chr(39) + ' || doc_id', 100)} < 10 THEN 'test' ELSE 'train' END AS split FROM documents")
register(
    "q6_split_leakage",
    lambda s, d: sampling.leaked(sampling.hash_split(docs(s, d).select("doc_id", X.content_id("text").alias("unique_id")), "doc_id", 30, "42"), "unique_id"),
    f"WITH s AS (SELECT md5(text) AS unique_id, {_BUCKET.format(chr(39) + '42' + chr(39) + ' || doc_id', 100)} < 30 AS t FROM documents) SELECT unique_id FROM s GROUP BY 1 HAVING count(DISTINCT t) > 1",
)
register("tk6_group_split", lambda s, d: sampling.hash_split(docs(s, d).select("doc_id", X.content_id("text").alias("unique_id")), "unique_id", 30).select("doc_id", "split"), f"SELECT doc_id, CASE WHEN {_BUCKET.format('md5(text)', 100)} < 30 THEN 'test' ELSE 'train' END AS split FROM documents")
register("tk7_train_validation", lambda s, d: sampling.train_validation(docs(s, d).select("doc_id"), 50, "doc_id")["validation"], "SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 50")
register("tk5_take_first_n", lambda s, d: sampling.first_n(docs(s, d).select("doc_id", "lang"), 100, ["lang", "doc_id"]), "SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 100")
register(
    "tk4_sample_with_topup",
    lambda s, d: sampling.sampled(s.read.parquet(f"{d}/benchmark.parquet").select("item_id"), 90, "item_id").groupBy("item_id").agg(F.count("*").alias("n")),
    "WITH t AS (SELECT count(*) AS c FROM benchmark), o AS (SELECT item_id, row_number() OVER (ORDER BY md5('42' || item_id), item_id) AS r FROM benchmark) SELECT item_id, 90 // c + CASE WHEN r <= 90 % c THEN 1 ELSE 0 END AS n FROM o, t WHERE 90 // c + CASE WHEN r <= 90 % c THEN 1 ELSE 0 END > 0",
)
register("tk8_seeded_shuffle", lambda s, d: sampling.numbered(docs(s, d).select("doc_id").withColumn("h", F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string")))), ["h", "doc_id"]).select("doc_id", "pos"), "SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) - 1 AS pos FROM documents")
register("tk9_drawn_item", lambda s, d: docs(s, d).select("doc_id", qa.drawn(X.trimmed_lines("text"), F.col("doc_id").cast("string"), F.lit("42")).alias("line")), rf"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 0 THEN l[{_BUCKET.format('doc_id || ' + chr(39) + '|42' + chr(39), 'len(l)')} + 1] END AS line FROM l")


def shots(spark: SparkSession, sf: str) -> DataFrame:
    pool = docs(spark, sf).select("doc_id")
    return sampling.few_shot(questions(spark, sf), pool, 3, "query_id", "doc_id").select("query_id", "doc_id", F.col("shot").cast("long").alias("shot"))


register(
    "tk10_fewshot_draw",
    shots,
    f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), c AS (SELECT count(*) AS c FROM documents),
s AS (SELECT item_id, shot, (shot - 1) * c // 3 AS lo, shot * c // 3 AS hi FROM benchmark, c, (SELECT unnest([1, 2, 3]) AS shot)),
d AS (SELECT item_id, shot, lo + {_BUCKET.format("'42|' || item_id || '|' || shot", "(hi - lo)")} AS pos FROM s) SELECT item_id AS query_id, doc_id, shot FROM d JOIN p USING (pos)""",
)
register("tk13_sorted_distinct", lambda s, d: docs(s, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.array((F.col("doc_id") % 5).cast("int"), F.lit(3), (F.col("doc_id") % 3).cast("int")))).cast("array<string>"), ",").alias("v")), "SELECT doc_id, array_to_string(list_sort(list_distinct([(doc_id % 5)::int, 3, (doc_id % 3)::int])), ',') AS v FROM documents")
register("tk12_divide_parts", lambda s, d: sampling.divided(docs(s, d).select("doc_id"), 20, ["doc_id"]), "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) * 20 // (SELECT count(*) FROM documents))::int AS part FROM documents")


def by_lang(spark: SparkSession, sf: str) -> list[DataFrame]:
    own = docs(spark, sf).select("doc_id", "lang")
    return [own.where(F.col("lang") == x) for x in ("de", "en", "es", "fr")]


register("u1_mix_concat", lambda s, d: sampling.concatenated(*by_lang(s, d)), "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')")
_ROBIN = "WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM documents), b AS (SELECT min(c) AS lo, max(c) AS hi FROM n), l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS p FROM (SELECT DISTINCT lang FROM documents))"
register("u2_mix_round_robin", lambda s, d: sampling.round_robin(by_lang(s, d), ["doc_id"]), f"{_ROBIN} SELECT doc_id, n.lang, i * 4 + p AS mix_pos FROM n JOIN l USING (lang), b WHERE i < lo")
register("u2_mix_all_exhausted", lambda s, d: sampling.round_robin(by_lang(s, d), ["doc_id"], "all_exhausted"), f"{_ROBIN} SELECT doc_id, n.lang, (i + k * c) * 4 + p AS mix_pos FROM n JOIN l USING (lang), b, (SELECT unnest(range(0, 100)) AS k) WHERE i + k * c < hi")
register(
    "u2_mix_probabilities",
    lambda s, d: sampling.probabilistic_mix(by_lang(s, d), [0.1, 0.6, 0.1, 0.2], ["doc_id"], 800),
    """WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM documents),
u AS (SELECT x AS mix_pos, ('0x' || substr(md5('42' || x), 1, 8))::bigint / 4294967296.0::double AS u FROM range(0, 800) t(x)),
w AS (SELECT mix_pos, CASE WHEN u < 0.1 THEN 'de' WHEN u < 0.7 THEN 'en' WHEN u < 0.7999999999999999 THEN 'es' ELSE 'fr' END AS lang FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mix_pos) - 1 AS k FROM w) SELECT doc_id, n.lang, mix_pos FROM k JOIN n ON n.lang = k.lang AND n.i = k.k % n.c""",
)
register("u3_distinct", lambda s, d: docs(s, d).select("text").distinct().agg(F.count("*").alias("n")), "SELECT count(DISTINCT text) AS n FROM documents")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """(query, context, response, merged_docs) from reranked and BM25 documents."""
    best = reranked(spark, sf).select("query_id", "unique_id", "rank").join(questions(spark, sf), "query_id")
    top = best.join(documents(spark, sf), "unique_id").select("query_id", "query", "rank", F.col("page_content").alias("t"))
    context = top.groupBy("query_id", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("context"))
    merged = bm25_ranked(spark, sf).join(documents(spark, sf), "unique_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("page_content").alias("t")))), lambda x: x["t"]).alias("merged_docs"))
    response = F.when(F.col("query_id") % 4 == 0, F.lit("无答案")).otherwise(F.lit("答【2,1】。"))
    return context.join(merged, "query_id").select("query_id", "query", "context", response.alias("response"), "merged_docs")


_RECORDS = f"""{_CHAIN},
cx AS (SELECT item_id, list(text ORDER BY rank) AS context FROM rr JOIN documents USING (doc_id) GROUP BY 1),
md AS (SELECT item_id, list(text ORDER BY rank) AS merged FROM bm25 JOIN documents USING (doc_id) GROUP BY 1),
rec AS (SELECT item_id, {_STRIP.format('b.text')} AS query, context, merged, list_filter(merged, lambda x: NOT list_contains(context, x)) AS neg, item_id % 4 <> 0 AS cited FROM benchmark b JOIN cx USING (item_id) JOIN md USING (item_id))"""
_DRAW = "{l}[" + _BUCKET.format("query || '|42'", "len({l})") + " + 1]"
register("j5_neg_docs", lambda s, d: records(s, d).select("query_id", F.size(qa.negative_docs("merged_docs", "context")).cast("long").alias("n")), f"{_RECORDS} SELECT item_id AS query_id, len(neg) AS n FROM rec")
register(
    "q5_sft_items",
    lambda s, d: qa.sft_items(records(s, d), "资料：{context}\n问题：{query}").select("query", "instruction", "output"),
    f"{_RECORDS}, c AS (SELECT query, cited, array_to_string(list_transform(list_zip(context, range(1, len(context) + 1)), lambda z: z[2] || '.' || z[1]), chr(10))[1:4096] AS c FROM rec) SELECT query, '资料：' || c || chr(10) || '问题：' || query AS instruction, CASE WHEN cited THEN '答。【1,2】' ELSE '无答案' END AS output FROM c",
)
_LAST = "context[greatest(len(context) - 1, 1):len(context)]"
register(
    "u4_rerank_triples",
    lambda s, d: qa.rerank_triples(records(s, d)),
    f"""{_RECORDS}, l AS (SELECT *, {_LAST} AS lst FROM rec),
t AS (SELECT query, context[1] AS content, 2 AS label FROM l WHERE cited UNION ALL SELECT query, {_DRAW.format(l='lst')}, 1 FROM l WHERE cited UNION ALL SELECT query, {_DRAW.format(l='neg')}, 0 FROM l WHERE cited AND len(neg) > 0 UNION ALL SELECT query, {_DRAW.format(l='merged')}, 0 FROM l WHERE NOT cited)
SELECT * FROM t WHERE content <> '' AND query <> ''""",
)

# ---- encoding arithmetic

_SEQ = "CASE WHEN t * 2 < c THEN c WHEN s * 2 < c THEN c - s ELSE floor(c * (t / (s + t)))::int END"
register(
    "x25_infer_seqlen",
    lambda s, d: pairs(s, d).select("conv_id", "turn", *[x.cast("long").alias(n) for x, n in zip(N.inferred_lengths(F.length("question"), F.length("answer"), F.lit(500)), ("source", "target"), strict=True)]),
    f"WITH {_QA}, x AS (SELECT conv_id, turn, length(question) AS s, length(answer) AS t, 500 AS c FROM qa), y AS (SELECT *, least({_SEQ}, t) AS target FROM x) SELECT conv_id, turn, least(greatest(c - target, 0), s) AS source, target FROM y",
)


def _ids(column: str) -> F.Column:
    return F.transform(X.tokens(column), lambda w: F.length(w))


_IDS = r"list_transform(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda w: length(w))"


def masked(spark: SparkSession, sf: str) -> DataFrame:
    ids, labels_ = encode.masked_labels(_ids("question"), _ids("answer"), 100)
    return pairs(spark, sf).select("conv_id", "turn", ids.alias("input_ids"), labels_.alias("labels"))


_MASKED = f"""{_QA}, i AS (SELECT conv_id, turn, {_IDS.format('question')} AS q, {_IDS.format('answer')} AS a FROM qa), x AS (SELECT *, len(q) AS s, len(a) AS t, 100 AS c FROM i),
y AS (SELECT *, least({_SEQ}, t) AS nt FROM x), z AS (SELECT *, least(greatest(c - nt, 0), s) AS ns FROM y), ml AS (SELECT conv_id, turn, list_concat(q[:ns], a[:nt]) AS input_ids, list_concat(list_transform(range(0, ns), lambda x: -100), a[:nt]) AS labels FROM z)"""
register("x26_label_mask", lambda s, d: masked(s, d).select("conv_id", "turn", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels")), f"WITH {_MASKED} SELECT conv_id, turn, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM ml")
register("a16_valid_token_ratio", lambda s, d: metrics.valid_ratio(masked(s, d)).select("valid_tokens", "total_tokens", F.round("valid_ratio", 6).alias("valid_ratio"), F.round(N.suggested_lr(3e-4, 1 << 22, 100, F.lit(8), F.col("valid_ratio")) * 1e6, 3).alias("lr_millionths")), f"WITH {_MASKED}, r AS (SELECT sum(len(list_filter(labels, lambda x: x <> -100)))::bigint AS v, sum(len(labels))::bigint AS t FROM ml) SELECT v AS valid_tokens, t AS total_tokens, round(v::double / t, 6) AS valid_ratio, round(3e-4 * sqrt(100 * 8 * (v::double / t) / 4194304) * 1e6, 3) AS lr_millionths FROM r")
register(
    "g5_pad_labels",
    lambda s, d: encode.collate(masked(s, d).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).withColumn("b", F.col("conv_id") % 7), "b").select("conv_id", "turn", F.size("input_ids").cast("long").alias("n"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("ones"), F.size(F.filter("labels", lambda y: y == -100)).cast("long").alias("ignored")),
    f"WITH {_MASKED}, p AS (SELECT *, ceil(max(len(input_ids)) OVER (PARTITION BY conv_id % 7) / 8.0)::bigint * 8 AS n FROM ml) SELECT conv_id, turn, n, len(input_ids) AS ones, len(list_filter(labels, lambda x: x = -100)) + n - len(labels) AS ignored FROM p",
)
register(
    "g3_block_pack",
    lambda s, d: encode.block_pack(docs(s, d).select("doc_id", _ids("text").alias("ids")), "doc_id", "ids", 64, 100).select("batch", F.col("block_no").cast("long").alias("block_no"), F.aggregate("input_ids", F.lit(0), lambda a, x: a + x).cast("long").alias("total")),
    rf"""WITH i AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch, {_IDS.format('text')} AS ids FROM documents), f AS (SELECT batch, flatten(list(ids ORDER BY doc_id)) AS a FROM i GROUP BY 1),
b AS (SELECT batch, a, unnest(range(0, len(a) // 64)) AS block_no FROM f) SELECT batch, block_no, list_sum(a[block_no * 64 + 1:block_no * 64 + 64])::bigint AS total FROM b""",
)
register("w5_kl_shift", lambda s, d: encode.shifted_responses(docs(s, d).select("doc_id"), "doc_id", "doc_id", "other", 300), "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents), b AS (SELECT *, p // 300 AS b FROM n) SELECT doc_id, coalesce(lag(doc_id) OVER (PARTITION BY b ORDER BY p), max(doc_id) OVER (PARTITION BY b)) AS other FROM b")


def packed(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select("doc_id", _ids("text").alias("input_ids")).withColumn("labels", F.col("input_ids"))
    return encode.pack_supervised(own, "doc_id", encode.Settings(cutoff=512, neat_packing=True)).select(F.size("input_ids").alias("n"), F.size(encode.segment_lengths("attention_mask")).alias("segments"))


register("g2_greedy_pack", packed)
register("c3_semantic_cluster", lambda s, d: chunking.semantic_chunks(docs(s, d).select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("page_content")), group_size=4).select("doc_id", F.size("chunks").alias("n")))
register("c5_recursive_split", lambda s, d: chunking.children(docs(s, d).select(X.content_id("text").alias("unique_id"), F.col("text").alias("page_content"), "source", F.col("doc_id").cast("int").alias("page"), F.lit(0).cast("long").alias("ordinal"), F.array().cast("array<struct<page:int,image_path:string,title:string>>").alias("images_info"))).select("unique_id", "parent_id", "page", "indexed"))
register("g1_sft_encode", lambda s, d: encode.encode_supervised(aligned(s, d), get_template("qwen"), settings=encode.Settings(cutoff=256)).select("first", F.size("input_ids").alias("n")))

# ---- reports and windows

register("a14_length_cdf", lambda s, d: metrics.length_cdf(docs(s, d), F.length("text"), 500), "WITH b AS (SELECT length(text) // 500 * 500 AS bucket, count(*) AS n FROM documents GROUP BY 1) SELECT bucket, n, sum(n) OVER (ORDER BY bucket)::bigint AS cumulative, round(sum(n) OVER (ORDER BY bucket) * 100.0::double / sum(n) OVER (), 2) AS percent FROM b")
register("a17_latency_percentiles", lambda s, d: metrics.latency(events(s, d), ["event_type"], "value", "user_id").select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "tokens_per_second")]), "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(sum(user_id) / sum(value / 1000), 4) AS tokens_per_second FROM events GROUP BY 1")
register("a18_preference_types", lambda s, d: metrics.preference_types(labels(s, d), F.col("quality") == 1), "SELECT count(*) FILTER (quality = 1) AS wanted, count(*) FILTER (quality = 0) AS unwanted FROM labels")
register("a13_reward_accuracy", lambda s, d: docs(s, d).agg(F.round(metrics.preference_accuracy(F.length("text"), F.col("doc_id") * 3), 6).alias("accuracy")), "SELECT round(avg((length(text) > doc_id * 3)::int), 6) AS accuracy FROM documents")
register("a11_token_accuracy", lambda s, d: masked(s, d).select("conv_id", "turn", F.round(metrics.token_accuracy(F.transform("input_ids", lambda x: F.when(x % 2 == 0, x).otherwise(0)), F.col("labels")), 6).alias("acc")), f"WITH {_MASKED}, p AS (SELECT conv_id, turn, list_filter(list_zip(list_transform(input_ids[:len(input_ids) - 1], lambda x: CASE WHEN x % 2 = 0 THEN x ELSE 0 END), labels[2:]), lambda z: z[2] <> -100) AS z FROM ml) SELECT conv_id, turn, round(len(list_filter(z, lambda y: y[1] = y[2]))::double / nullif(len(z), 0), 6) AS acc FROM p")
register("a15_perplexity", lambda s, d: embeddings(s, d).select("vec_id", F.round(metrics.perplexity(F.transform("embedding", lambda x: -F.abs(x.cast("double"))), F.transform("embedding", lambda x: (x > 0).cast("int"))), 5).alias("ppl")), "SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN abs(x::double) ELSE 0.0 END)) / len(list_filter(embedding, lambda x: x > 0))), 5) AS ppl FROM embeddings")
register("a12_rouge_1", lambda s, d: metrics.rouge_1_counts(pairs(s, d), "conv_id", X.tokens("question"), X.tokens("answer")).select("conv_id", F.col("hits").cast("long").alias("hits"), F.round("rouge_1", 6).alias("rouge_1")), rf"WITH {_QA}, t AS (SELECT conv_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(answer), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS b FROM qa), h AS (SELECT *, len(list_intersect(a, b)) AS hits FROM t) SELECT conv_id, hits, round(CASE WHEN hits = 0 THEN 0.0 ELSE 2.0 * hits / (len(a) + len(b)) END::double, 6) AS rouge_1 FROM h")
register("a12_overlap_scores", lambda s, d: metrics.overlap_scores(pairs(s, d), "question", "answer").select("conv_id", "turn", "rouge_1", "rouge_2", "rouge_l", "bleu_4"))
register("a9_baseline_delta", lambda s, d: labels(s, d).agg(F.round(N.delta_percent(F.avg("quality"), F.avg("toxic")), 3).alias("delta")), "SELECT round((avg(quality) - avg(toxic)) / (avg(toxic) + 1e-9) * 100, 3) AS delta FROM labels")
register("a1_cluster_text", lambda s, d: chunking.grouped_text(lines(s, d).withColumn("k", F.col("pos") % 3), ["doc_id", "k"], "pos", "line", " ", "text"), "WITH l AS (SELECT doc_id, i - 1 AS pos, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) SELECT doc_id, pos % 3 AS k, string_agg(line, ' ' ORDER BY pos) AS text FROM l GROUP BY ALL")
register("w1_rank", lambda s, d: fusion.ranks_without_gaps(docs(s, d).select(F.col("source").alias("query_id"), "doc_id", "n_chars"), ["n_chars", "doc_id"]).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank")), "SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents")
register("w9_previous_run", lambda s, d: metrics.with_previous(events(s, d).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "event_id", "previous", F.round("change_percent", 4).alias("change")), "WITH e AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, event_id, p AS previous, round(CASE WHEN p <> 0 THEN (value - p) / p * 100 END, 4) AS change FROM e")
register("w8_progress", lambda s, d: metrics.progress(docs(s, d).select("doc_id", (F.col("doc_id") * 2.5).alias("t")), "doc_id", 1000, "t").select("doc_id", "percentage", F.round("remaining", 4).alias("remaining")), "SELECT doc_id, round(doc_id * 100.0::double / 1000, 2) AS percentage, CASE WHEN doc_id > 0 THEN round((1000 - doc_id) * (doc_id * 2.5::double) / doc_id, 4) END AS remaining FROM documents")
register("w6_smoothing", lambda s, d: embeddings(s, d).select("vec_id", F.round(F.element_at(N.smoothed(F.col("embedding")), -1), 6).alias("last")), "WITH RECURSIVE e AS (SELECT vec_id, embedding AS v, 1.8 * (1 / (1 + exp(-0.05 * len(embedding))) - 0.5) AS w FROM embeddings), r AS (SELECT vec_id, 1 AS i, v[1]::double AS s FROM e UNION ALL SELECT r.vec_id, i + 1, s * w + (1 - w) * v[i + 1]::double FROM r JOIN e USING (vec_id) WHERE i < len(v)) SELECT vec_id, round(s, 6) AS last FROM r JOIN e USING (vec_id) WHERE i = len(v)")
register("x27_sparse_weight", lambda s, d: embeddings(s, d).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + N.sparse_weight(x.cast("double"))), 6).alias("w")), "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: ln(1 + greatest(x::double, 0)))), 6) AS w FROM embeddings")
register("x28_image_resize", lambda s, d: docs(s, d).select("doc_id", *[x.cast("long").alias(n) for x, n in zip(N.resized(F.col("n_chars"), F.col("doc_id") + 7, 768 * 768, 32 * 32), ("w", "h"), strict=True)]), "WITH f AS (SELECT doc_id, n_chars AS w, doc_id + 7 AS h, (n_chars * (doc_id + 7))::double AS a FROM documents), g AS (SELECT *, CASE WHEN a > 589824 THEN sqrt(589824 / a) WHEN a < 1024 THEN sqrt(1024 / a) ELSE 1.0 END AS r FROM f) SELECT doc_id, floor(w * r)::bigint AS w, floor(h * r)::bigint AS h FROM g")
register("x28_frame_indices", lambda s, d: docs(s, d).select("doc_id", F.array_join(N.frame_indices(F.col("doc_id") * 10 + 5, F.col("doc_id") / 4, 2.0, 16).cast("array<string>"), ",").alias("frames")), "WITH f AS (SELECT doc_id, doc_id * 10 + 5 AS t, least(doc_id * 10 + 5, 16, greatest(1, floor(doc_id / 4 * 2.0)::int))::int AS n FROM documents) SELECT doc_id, array_to_string(list_transform(range(0, n), lambda i: floor(i * ((t - 1) / greatest(n - 1, 1)))::int), ',') AS frames FROM f")
register("x31_flops", lambda s, d: docs(s, d).select("doc_id", (N.model_flops(F.col("doc_id") + 1, F.lit(128), 4, 64, 1000, 256, 2, 4) / 1e6).alias("mflops")), "SELECT doc_id, (3 * ((doc_id + 1) * 128.0::double * 4 * (6.0 * 64 * 256 + 4.0 * 64 * 64 + 2.0 * ((2 * 64 * 64 * 2) // 4)) + (doc_id + 1) * 128 * 128 * (4.0 * 64 * 4)) + (doc_id + 1) * 128 * (64.0 * 1000 * 2) * 3) / 1e6 AS mflops FROM documents")
_C, _R = "-(doc_id % 7 + 1) / 10.0::double", "-(doc_id % 5 + 1) / 8.0::double"
_SIG = "(CASE WHEN ({x}) >= 0 THEN -ln(1 + exp(-({x}))) ELSE ({x}) - ln(1 + exp({x})) END)"
register(
    "x32_preference_losses",
    lambda s, d: docs(s, d).select("doc_id", ((F.col("doc_id") % 7 + 1) / -10.0).alias("c"), ((F.col("doc_id") % 5 + 1) / -8.0).alias("r")).select("doc_id", F.round(N.simpo_loss(F.col("c"), F.col("r"), 0.5, 0.3), 6).alias("simpo"), F.round(N.orpo_loss(F.col("c"), F.col("r"), 0.1), 6).alias("orpo"), F.round(N.reward_loss(F.col("c"), F.col("r")), 6).alias("reward")),
    f"WITH t AS (SELECT doc_id, {_C} AS c, {_R} AS r FROM documents) SELECT doc_id, round(-{_SIG.format(x='0.5 * (c - r - 0.6)')}, 6) AS simpo, round(-c - 0.1 * {_SIG.format(x='(c - r) - (ln(1 - exp(c)) - ln(1 - exp(r)))')}, 6) AS orpo, round(-{_SIG.format(x='c - r')}, 6) AS reward FROM t",
)
register("r15_yes_probability", lambda s, d: docs(s, d).select("doc_id", F.round(N.yes_probability((F.col("doc_id") % 9) / 2.0, F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 4).cast("double"))), 6).alias("p")), "SELECT doc_id, round(1 / (1 + exp(coalesce(CASE WHEN doc_id % 3 > 0 THEN (doc_id % 4)::double END, -10.0) - doc_id % 9 / 2.0::double)), 6) AS p FROM documents")
register("e4_choice_argmax", lambda s, d: embeddings(s, d).select("vec_id", N.argmax_letter(F.slice("embedding", 1, 4)).alias("choice")), "SELECT vec_id, chr((64 + list_position(embedding[1:4], list_max(embedding[1:4])))::int) AS choice FROM embeddings")
register("e2_semantic_similarity", lambda s, d: _similar(s, d), "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x)) * list_sum(list_transform(b.embedding, lambda x: x::double * x))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.retrieval import cosine

    e = embeddings(spark, sf)
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", "embedding").join(other, "vec_id").select("vec_id", F.round(cosine("embedding", "b"), 5).alias("cosine"))


# ---- blocks and rectangles made from documents

def blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return docs(spark, sf).select("doc_id", F.floor(d / 40).alias("page"), ((d * 37) % 900).cast("double").alias("x0"), ((d * 53) % 700).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 40 + F.col("doc_id") % 60, "y1": F.col("y0") + 12.0})


register(
    "j13_spatial_overlap",
    lambda s, d: chunking.overlapping(blocks(s, d), blocks(s, d).select(F.col("doc_id").alias("rect"), "page", (F.col("x0") - 50).alias("x0"), (F.col("y0") - 50).alias("y0"), (F.col("x1") + 90).alias("x1"), (F.col("y1") + 90).alias("y1"))).select("doc_id", F.col("r_rect").alias("rect")),
    """WITH b AS (SELECT doc_id, doc_id // 40 AS page, ((doc_id * 37) % 900)::double AS x0, ((doc_id * 53) % 700)::double AS y0 FROM documents), c AS (SELECT *, x0 + 40 + doc_id % 60 AS x1, y0 + 12 AS y1 FROM b)
SELECT a.doc_id, r.doc_id AS rect FROM c a JOIN c r ON a.page = r.page AND a.x0 < r.x1 + 90 AND a.x1 > r.x0 - 50 AND a.y0 < r.y1 + 90 AND a.y1 > r.y0 - 50""",
)
register(
    "s2_title_scores",
    lambda s, d: chunking.title_scores(docs(s, d).select("doc_id", "text", (F.col("doc_id") % 20).alias("size"), (F.col("doc_id") % 2 == 0).alias("bold"), (F.col("doc_id") % 4).alias("lines"), (F.col("doc_id") % 3 == 0).alias("above"), F.lit(10).alias("typical_size"))).select("doc_id", "score", "is_title"),
    rf"""WITH t AS (SELECT doc_id, {_STRIP.format('text')} AS t, regexp_matches({_STRIP.format('text')}, '[.。!！]$') AS e FROM documents), s AS (SELECT doc_id, CASE WHEN e THEN 0.0 ELSE CASE WHEN doc_id % 20 > 10 THEN 2 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 <= 2 THEN 0.5 ELSE 0 END + CASE WHEN length(t) <= 30 THEN 0.5 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE -1 END END::double AS score, e FROM t)
SELECT doc_id, score, NOT e AND score >= 3 AS is_title FROM s""",
)
register("s12_dialogue_script", lambda s, d: talk(s, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("role") == "assistant", "Assistant: ").otherwise("Human: "), F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("t")).select("conv_id", readers.peeled_dialogue("t").alias("said")).select("conv_id", F.size("said").cast("long").alias("n"), F.md5(F.array_join(F.transform("said", lambda x: x["value"]), "|")).alias("said")), rf"WITH r AS (SELECT conv_id, list(role ORDER BY turn) AS r, list({_STRIP.format('text')} ORDER BY turn) AS t FROM conversations GROUP BY 1), c AS (SELECT *, len(r) - CASE WHEN r[-1] = 'assistant' THEN 0 ELSE 1 END AS n FROM r) SELECT conv_id, n, md5(array_to_string(t[1:n], '|')) AS said FROM c")
register("s4_json_lines", lambda s, d: readers.parsed_lines(events(s, d).select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")).alias("props")), "props", "k long").select("event_id", "k"), "SELECT event_id, (props::json->>'k')::bigint AS k FROM events WHERE event_id % 10 <> 0")
register("s15_doc_lookup", lambda s, d: fusion.looked_up(labels(s, d).select("doc_id"), docs(s, d), "doc_id", ["source"]), "SELECT l.doc_id, source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
register("x30_date_text", lambda s, d: events(s, d).select("event_id", X.date_text("ts").alias("day")), "SELECT event_id, strftime(ts, '%d %b %Y') AS day FROM events")
register("st_tumbling_events", lambda s, d: streams.tumbling(streams.with_event_time(events(s, d)), "1 hour", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
register("reasoning_turns", lambda s, d: dialogues(s, d).select("conv_id", F.size(reasoning_messages("messages")).cast("long").alias("n")), "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
