"""Templates inferred from what tokenizers make of messages."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import templates
from millrace.functions.templates import BOS, CONTENT, EOS, INDEX, Template, inferred_template

END = "</s>"


def plainly(t, takes_system=True):
    """Template t as a tokenizer would apply it, in plain code."""
    at = [0]

    def rendered(messages, open_):
        fill = lambda slot, content: slot.replace(EOS, END).replace(BOS, "<s>").replace(INDEX, str(at[0]), 1).replace(CONTENT, content, 1)
        system, rest = t.default_system, messages
        if messages[0]["role"] == "system":
            if not takes_system:
                raise ValueError("no system message here")
            system, rest = messages[0]["content"], messages[1:]
        out, led = fill(t.prefix, ""), fill(t.system, system) if system else ""
        if not t.system_in_user:
            out += led
        for i, m in enumerate(rest):
            at[0] = i // 2
            out += fill(getattr(t, m["role"]), (led if t.system_in_user and i == 0 else "") + m["content"])
        return out

    return rendered


TURNS = [("user", "How?"), ("assistant", "So."), ("user", "And <this>?"), ("assistant", "x\ny")]


@pytest.mark.parametrize("name", sorted(templates.templates))
def test_round_trip(spark, name):
    """What the inferred template renders is what the tokenizer does, with and without a system message."""
    t = templates.get_template(name)
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in TURNS])
    assert spark.range(1).select(t.rendered(messages, F.lit("Be kind."), eos=END)).first()[0] == plainly(t)([{"role": "system", "content": "Be kind."}, *[{"role": r, "content": c} for r, c in TURNS]], False)
    if INDEX in t.user:
        return  # numbers of turns cannot be told from texts
    own = inferred_template(plainly(t), t.prefix.replace(BOS, "<s>").replace(EOS, END), eos=END)
    row = spark.range(1).select(own.rendered(messages, eos=END).alias("bare"), own.rendered(messages, F.lit("Be kind."), eos=END).alias("led")).first()
    plain = plainly(t)
    turns = [{"role": r, "content": c} for r, c in TURNS]
    assert row["bare"] == plain(turns, False)
    assert row["led"] == plain([{"role": "system", "content": "Be kind."}, *turns], False)


def test_thoughts_and_refused_systems():
    t = Template("x", user="<u>" + CONTENT + "<a>", assistant="<think>\n\n</think>\n\n" + CONTENT + "<e>", prefix="<b>")
    own = inferred_template(plainly(t, takes_system=False), "<b>")
    assert own.reasoning and own.user == "<u>" + CONTENT + "<a>" and own.assistant == CONTENT + "<e>" and own.default_system == ""


def test_default_system():
    t = templates.get_template("qwen")
    own = inferred_template(plainly(t), eos=END)
    assert (own.default_system, own.system, own.user, own.assistant) == (t.default_system, t.system, t.user, t.assistant) and t.default_system
