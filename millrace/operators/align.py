"""Source rows to ALIGNED rows (_prompt, _response, _system, _tools, media), and the rules that aligned rows must meet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
USER, ASSISTANT, SYSTEM, FUNCTION, OBSERVATION = "user", "assistant", "system", "function", "observation"


@dataclass
class Columns:
    """Where a dataset keeps what; None: it has no such column."""

    formatting: str = "alpaca"
    ranking: bool = False
    prompt: str | None = "instruction"
    query: str | None = "input"
    response: str | None = "output"
    history: str | None = None
    messages: str | None = "conversations"
    system: str | None = None
    tools: str | None = None
    chosen: str | None = "chosen"
    rejected: str | None = "rejected"
    kto_tag: str | None = None
    images: str | None = None
    videos: str | None = None
    audios: str | None = None
    role_tag: str = "from"
    content_tag: str = "value"
    user_tag: str = "human"
    assistant_tag: str = "gpt"
    observation_tag: str = "observation"
    function_tag: str = "function_call"
    system_tag: str | None = "system"
    #: Of instruction rows: an empty instruction or input stays a line of its own, and a null one gives a null text; otherwise either is left out.
    keep_empty: bool = False


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _none() -> Column:
    return F.array().cast(MESSAGES)


def _rest(df: DataFrame, c: Columns, system: Column | None = None) -> list[Column]:
    media = lambda name: (F.col(name) if name else F.lit(None)).cast("array<string>")
    own = F.coalesce(F.col(c.system), F.lit("")) if c.system and c.system in df.columns else F.lit("")
    return [
        (own if system is None else F.coalesce(system, own)).alias("_system"),
        (F.coalesce(F.col(c.tools), F.lit("")) if c.tools and c.tools in df.columns else F.lit("")).alias("_tools"),
        media(c.images).alias("_images"),
        media(c.videos).alias("_videos"),
        media(c.audios).alias("_audios"),
    ]


def align_alpaca(df: DataFrame, c: Columns) -> DataFrame:
    """Instruction rows: history pairs, then instruction and input by a line feed; one answer, two for preference, none without."""
    has = lambda name: name and name in df.columns
    parts = [F.col(n) for n in (c.prompt, c.query) if has(n)]
    if c.keep_empty and parts:
        text = reduce(lambda a, b: F.concat(a, F.lit("\n"), b), parts)
    else:
        text = F.concat_ws("\n", *[F.when(x != "", x) for x in parts])
    asked = F.array(message(USER, text))
    if has(c.history):
        pairs = F.transform(c.history, lambda h: F.array(message(USER, h[0]), message(ASSISTANT, h[1])))
        asked = F.concat(F.coalesce(F.flatten(pairs), _none()), asked)
    response = F.when(F.col(c.response).isNotNull(), F.array(message(ASSISTANT, F.col(c.response)))).otherwise(_none()) if has(c.response) else _none()
    if c.ranking and has(c.chosen) and has(c.rejected):
        both = F.array(message(ASSISTANT, F.col(c.chosen)), message(ASSISTANT, F.col(c.rejected)))
        response = F.when(F.col(c.chosen).isNotNull() & F.col(c.rejected).isNotNull(), both).otherwise(response)
    if has(c.kto_tag):
        response = _kto(F.col(c.kto_tag), F.array(message(ASSISTANT, F.col(c.response))), response)
    return df.select(asked.cast(MESSAGES).alias("_prompt"), response.cast(MESSAGES).alias("_response"), *_rest(df, c))


def _kto(tag: Column, answer: Column, otherwise: Column) -> Column:
    """The answer before an empty one if it is wanted, behind it if not."""
    empty = F.array(message(ASSISTANT, F.lit("")))
    return F.when(tag, F.concat(answer, empty)).when(~tag, F.concat(empty, answer)).otherwise(otherwise)


def align_sharegpt(df: DataFrame, c: Columns) -> DataFrame:
    """Dialogue rows: a leading system message is taken out; users and assistants must alternate, and their number fit, or the row is emptied."""
    tags = {c.user_tag: USER, c.assistant_tag: ASSISTANT, c.observation_tag: OBSERVATION, c.function_tag: FUNCTION}
    role = lambda m: m[c.role_tag]
    turn = lambda m: message(F.coalesce(*[F.when(role(m) == t, r) for t, r in tags.items()], F.lit(None)), m[c.content_tag])
    raw = F.coalesce(F.col(c.messages), F.array().cast(df.schema[c.messages].dataType))
    first = F.try_element_at(raw, F.lit(1))
    led = F.coalesce(role(first) == c.system_tag, F.lit(False)) if c.system_tag else F.lit(False)
    own = F.when(led, F.slice(raw, 2, F.greatest(F.size(raw), F.lit(1)))).otherwise(raw)
    fits = F.forall(F.transform(own, lambda m, i: F.coalesce(F.when(i % 2 == 0, role(m).isin(c.user_tag, c.observation_tag)).otherwise(role(m).isin(c.assistant_tag, c.function_tag)), F.lit(False))), lambda x: x)
    sound = fits & (F.size(own) % 2 == (1 if c.ranking else 0))
    turns = F.transform(own, turn)
    n = F.greatest(F.size(turns) - 1, F.lit(0))
    prompt, response = F.slice(turns, F.lit(1), n), F.slice(turns, n + 1, F.lit(1))
    if c.kto_tag and c.kto_tag in df.columns:
        response = _kto(F.col(c.kto_tag), response, response)
    elif c.ranking:
        pair = F.array(*[message(F.coalesce(*[F.when(F.col(x)[c.role_tag] == t, r) for t, r in tags.items()]), F.col(x)[c.content_tag]) for x in (c.chosen, c.rejected)])
        known = F.col(c.chosen).isNotNull() & F.col(c.rejected).isNotNull()
        prompt, response = F.when(known, turns).otherwise(prompt), F.when(known, pair).otherwise(response)
    keep = lambda x: F.when(sound, x).otherwise(_none())
    return df.select(keep(prompt).cast(MESSAGES).alias("_prompt"), keep(response).cast(MESSAGES).alias("_response"), *_rest(df, c, F.when(led, first[c.content_tag])))


def dialogues(turns: DataFrame, key: str, order: str, role: str, content: str, name: str = "conversations") -> DataFrame:
    """(key, name): the turns of each dialogue in order, as structs (role, content). A dialogue meets in one row."""
    lists = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("l"))
    return lists.select(key, F.transform("l", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias(name))


Converter = Callable[[DataFrame, Columns], DataFrame]
_converters: dict[str, Converter] = {}


def has_converter(name: str) -> bool:
    return name in _converters


def register_converter(name: str, convert: Converter) -> None:
    if name in _converters:
        raise ValueError(f"converter {name} is registered already")
    _converters[name] = convert


def align(df: DataFrame, columns: Columns) -> DataFrame:
    """df by the converter of its formatting; its own columns are dropped, so a scan reads only what is needed."""
    if columns.formatting not in _converters:
        raise ValueError(f"unknown converter {columns.formatting}")
    return _converters[columns.formatting](df, columns)


register_converter("alpaca", align_alpaca)
register_converter("sharegpt", align_sharegpt)


def openai_columns(**more: object) -> Columns:
    """role/content messages with the roles user, assistant, tool, function and system."""
    return Columns(formatting="sharegpt", messages="messages", role_tag="role", content_tag="content", user_tag=USER, assistant_tag=ASSISTANT, observation_tag="tool", function_tag=FUNCTION, system_tag=SYSTEM, **more)


def encodable(stage: str) -> Column:
    """Rows that the encoder of a stage takes: an odd prompt, and one response (sft), two or more (rm, dpo, kto), any (ppo)."""
    odd, n = F.size("_prompt") % 2 == 1, F.size("_response")
    if stage == "sft":
        return odd & (n == 1)
    if stage in ("rm", "dpo", "kto"):
        return odd & (n >= 2)
    if stage == "pt":
        return odd
    if stage == "ppo":
        return odd
    raise ValueError(f"unknown stage {stage}")


def check_stage(stage: str, ranking: bool) -> None:
    if stage == "rm" and not ranking:
        raise ValueError("the reward stage needs ranking data")
    if stage != "rm" and ranking:
        raise ValueError("ranking data is for the reward stage")


def with_media_paths(df: DataFrame, column: str, files: DataFrame, media_dir: str) -> DataFrame:
    """column (array of paths) with media_dir put before those that files (path) has; others stay. One join on the path."""
    known = files.select(F.col("path").alias("__p")).distinct()
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    parts = rows.select("__id", F.posexplode(column).alias("__i", "__m")).withColumn("__full", F.concat(F.lit(media_dir.rstrip("/") + "/"), "__m"))
    found = parts.join(known, parts["__full"] == known["__p"], "left")
    lists = found.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("__i", F.when(F.col("__p").isNotNull(), F.col("__full")).otherwise(F.col("__m")).alias("m")))).alias("__l"))
    out = rows.join(lists, "__id", "left").withColumn(column, F.when(F.col("__l").isNotNull(), F.col("__l.m")).otherwise(F.col(column)))
    return out.select(df.columns)


def normalise_request(requests: DataFrame, messages: str = "messages") -> DataFrame:
    """Chat requests to aligned form: leading system taken out, alternation and an odd number of turns required (error says what is wrong)."""
    raw = F.col(messages)
    first = F.try_element_at(raw, F.lit(1))
    led = F.coalesce(first["role"] == SYSTEM, F.lit(False))
    turns = F.when(led, F.slice(raw, 2, F.greatest(F.size(raw), F.lit(1)))).otherwise(raw)
    fits = F.forall(F.transform(turns, lambda m, i: F.coalesce(F.when(i % 2 == 0, m["role"].isin(USER, "tool")).otherwise(m["role"].isin(ASSISTANT, FUNCTION)), F.lit(False))), lambda x: x)
    error = F.when(F.size(raw) == 0, "Invalid length").when(F.size(turns) % 2 == 0, "Only supports u/a/u/a/u...").when(~fits, "Invalid role")
    mapped = F.transform(turns, lambda m: message(F.when(m["role"] == "tool", OBSERVATION).otherwise(m["role"]), m["content"]))
    return requests.withColumns({"_prompt": F.when(error.isNull(), mapped).otherwise(_none()), "_system": F.when(led, first["content"]).otherwise(F.lit("")), "error": error})
