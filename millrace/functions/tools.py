"""Tool descriptions and calls in five dialects: format, and extract again. Python on purpose: JSON of any shape goes in and out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Call = tuple[str, str]


def _dump(x: object) -> str:
    return json.dumps(x, ensure_ascii=False)


def _json_calls(text: str, name: str = "name", arguments: str = "arguments") -> list[Call] | None:
    try:
        data = json.loads(text.strip())
        return [(t[name], _dump(t[arguments])) for t in (data if isinstance(data, list) else [data])]
    except (ValueError, KeyError, TypeError):
        return None


@dataclass(frozen=True)
class Dialect:
    """describe: tools to text; call: calls to text; extract: text to calls, or None where it holds none."""

    describe: Callable[[list[dict]], str]
    call: Callable[[list[Call]], str]
    extract: Callable[[str], list[Call] | None]


# The wording of descriptions and calls, here and in DIALECTS, is what models were trained on.
def _default_describe(tools: list[dict]) -> str:
    out, names = "", []
    for t in tools:
        t = t.get("function", t)
        need = t.get("parameters", {}).get("required", [])
        rows = ""
        for name, p in t.get("parameters", {}).get("properties", {}).items():
            enum = f", should be one of [{', '.join(p['enum'])}]" if p.get("enum") else ""
            items = f", where each item should be {p['items'].get('type', '')}" if p.get("items") else ""
            rows += f"  - {name} ({p.get('type', '')}{', required' if name in need else ''}): {p.get('description', '')}{enum}{items}\n"
        out += f"> Tool Name: {t['name']}\nTool Description: {t.get('description', '')}\nTool Args:\n{rows}\n"
        names.append(t["name"])
    return f"You have access to the following tools:\n{out}Use the following format if using a tool:\n```\nAction: tool name (one of [{', '.join(names)}])\nAction Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{{\"input\": \"hello world\", \"num_beams\": 5}}```)\n```\n"


# The marks of the dialects.
_OPEN, _CLOSE = "<tool_call>", "</tool_call>"


def _default_extract(text: str) -> list[Call] | None:
    """Each 'Action:' begins a call: a name of letters, digits and underscores, then 'Action Input:' and its arguments."""
    calls = []
    for part in text.split("Action:")[1:]:
        name, mark, arguments = part.partition("Action Input:")
        if not mark or not arguments.strip() or not name.strip().isascii() or not name.strip().replace("_", "a").isalnum():
            continue
        try:
            calls.append((name.strip(), _dump(json.loads(arguments.strip().strip('"').strip("`")))))
        except ValueError:
            return None
    return calls or None


def _glm4_extract(text: str) -> list[Call] | None:
    name, nl, rest = text.partition("\n")
    try:
        return [(name.strip(), _dump(json.loads(rest.strip())))] if nl else None
    except ValueError:
        return None


def _qwen_extract(text: str) -> list[Call] | None:
    """What stands between tool_call marks; a closing mark counts if the next call or the end of the text follows it."""
    calls: list[Call] = []
    at = text.find(_OPEN)
    while at >= 0:
        stop = text.find(_CLOSE, at + len(_OPEN) + 1)
        while stop >= 0 and (rest := text[stop + len(_CLOSE) :].lstrip()) and not rest.startswith(_OPEN):
            stop = text.find(_CLOSE, stop + 1)
        if stop < 0:
            break
        own = _json_calls(text[at + len(_OPEN) : stop])
        if own is None:
            return None
        calls += own
        at = text.find(_OPEN, stop)
    return calls or None


def _listed(calls: list[Call], key: str) -> list[dict]:
    return [{"name": n, key: json.loads(a)} for n, a in calls]


DIALECTS: dict[str, Dialect] = {
    "default": Dialect(_default_describe, lambda calls: "\n".join(f"Action: {n}\nAction Input: {a}" for n, a in calls), _default_extract),
    "glm4": Dialect(lambda tools: "".join(f"\n\n## {t['name']}\n\n{json.dumps(t, indent=4, ensure_ascii=False)}\n在调用上述函数时，请使用 Json 格式表示调用的参数。" for t in (x.get("function", x) for x in tools)), lambda calls: f"{calls[0][0]}\n{calls[0][1]}" if len(calls) == 1 else _raise("glm4 takes one call"), _glm4_extract),
    "llama3": Dialect(lambda tools: "\n\n".join(json.dumps({"type": "function", "function": t.get("function", t)}, indent=4, ensure_ascii=False) for t in tools), lambda calls: _dump(_listed(calls, "parameters")[0] if len(calls) == 1 else _listed(calls, "parameters")), lambda s: _json_calls(s, arguments="parameters")),
    "mistral": Dialect(lambda tools: f"[AVAILABLE_TOOLS] {_dump([{'type': 'function', 'function': t.get('function', t)} for t in tools])}[/AVAILABLE_TOOLS]", lambda calls: _dump(_listed(calls, "arguments")), _json_calls),
    "qwen": Dialect(lambda tools: "\n".join(_dump({"type": "function", "function": t.get("function", t)}) for t in tools), lambda calls: "\n".join(f"<tool_call>\n{_dump(x)}\n</tool_call>" for x in _listed(calls, "arguments")), _qwen_extract),
}


def _raise(what: str) -> str:
    raise ValueError(what)


def dialect(name: str) -> Dialect:
    if name not in DIALECTS:
        raise ValueError(f"unknown tool format {name}")
    return DIALECTS[name]


def function_text(content: str, name: str) -> str:
    """A function message (JSON of one call or a list, perhaps behind a thought) in the dialect; broken JSON raises."""
    thought = re.match(r"(?s)<think>.*?</think>\n*", content)
    head = thought[0] if thought else ""
    calls = _json_calls(content[len(head) :])
    if calls is None:
        raise ValueError(f"Invalid JSON format in function message: {content!r}.")
    return head + dialect(name).call(calls)


def function_texts(content: Column | str, name: str) -> Column:
    """function_text() of a column."""

    @F.pandas_udf("string")
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else function_text(t, name))

    return written(content)


def extracted_calls(text: Column | str, name: str) -> Column:
    """array<struct<name,arguments>> of the calls in the text; null where it holds none."""

    @F.pandas_udf("array<struct<name:string,arguments:string>>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = dialect(name).extract
        for s in batches:
            yield s.map(lambda t: None if t is None or (c := own(t)) is None else [{"name": n, "arguments": a} for n, a in c])

    return extract(text)
