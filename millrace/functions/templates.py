"""Chat templates as data: slots of text per role, compiled to Column expressions; thoughts; tools; multiple-choice prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

CONTENT, INDEX, EOS, BOS = "{{content}}", "{{idx}}", "{{eos}}", "{{bos}}"


@dataclass(frozen=True)
class Template:
    """Each slot is a string with {{content}}, {{idx}} (number of the turn pair), {{bos}} and {{eos}} (texts that begin and end a sequence).

    system_in_user: the system text stands inside the first user's slot, before the content. thoughts: the marks of a thought.
    """

    name: str
    user: str = CONTENT
    assistant: str = ""
    system: str = CONTENT
    function: str = ""
    observation: str = ""
    prefix: str = ""
    default_system: str = ""
    tool_format: str | None = None
    efficient_eos: bool = False
    stop_words: tuple[str, ...] = field(default=())
    reasoning: bool = False
    system_in_user: bool = False
    thoughts: tuple[str, str] = ("<think>", "</think>")
    media: str = "base"

    def __post_init__(self) -> None:
        """Answers and calls end with the end-of-sequence text, unless that is put once at the end; observations read like users."""
        end = CONTENT if self.efficient_eos else CONTENT + EOS
        for field_, default in (("assistant", end), ("function", end), ("observation", self.user)):
            object.__setattr__(self, field_, getattr(self, field_) or default)

    def render(self, messages: Column | str, system: Column | str | None = None, tools: Column | str | None = None, eos: str = "", bos: str = "<s>") -> Column:
        """The messages as an array of texts; prefix, system and tools are in the first."""
        own = F.coalesce(F.nullif(F.col(system) if isinstance(system, str) else system, F.lit("")), F.lit(self.default_system)) if system is not None else F.lit(self.default_system)
        tool_text = F.lit("") if tools is None else F.coalesce(F.col(tools) if isinstance(tools, str) else tools, F.lit(""))
        led = F.when((own != "") | (tool_text != ""), self._slot(self.system, F.concat(own, tool_text), F.lit(0), eos, bos)).otherwise(F.lit(""))
        prefix = F.lit(self.prefix.replace(BOS, bos).replace(EOS, eos))

        def turn(m: Column, i: Column) -> Column:
            said = F.when((i == 0) & (m["role"] == "user"), F.concat(led, m["content"])).otherwise(m["content"]) if self.system_in_user else m["content"]
            body = F.coalesce(*[F.when(m["role"] == r, self._slot(getattr(self, r), said, (i / 2).cast("int"), eos, bos)) for r in ("user", "assistant", "function", "observation")])
            return F.concat(F.when(i == 0, prefix if self.system_in_user else F.concat(prefix, led)).otherwise(F.lit("")), body)

        return F.transform(messages, turn)

    def _slot(self, slot: str, content: Column, index: Column, eos: str, bos: str) -> Column:
        """Only the first {{content}} and {{idx}} are filled."""
        slot = slot.replace(EOS, eos).replace(BOS, bos)
        parts: list[Column] = []
        values = {CONTENT: content, INDEX: index.cast("string")}
        while slot:
            at, mark = min(((slot.find(m), m) for m in values if m in slot), default=(-1, ""))
            if at < 0:
                parts.append(F.lit(slot))
                break
            if at:
                parts.append(F.lit(slot[:at]))
            parts.append(values.pop(mark))
            slot = slot[at + len(mark) :]
        return F.concat(*parts) if parts else F.lit("")

    def rendered(self, messages: Column | str, system: Column | str | None = None, tools: Column | str | None = None, eos: str = "", bos: str = "<s>") -> Column:
        return F.array_join(self.render(messages, system, tools, eos, bos), "")

    def jinja(self, eos: str = "", bos: str = "<s>") -> str:
        """A jinja chat template that renders what render() does (without tools)."""
        q = lambda slot, what: " + ".join(json.dumps(p) if p != CONTENT else what for p in re.split(f"({re.escape(CONTENT)})", slot.replace(EOS, eos).replace(BOS, bos).replace(INDEX, "")) if p) or '""'
        default = "{% set system_message = " + json.dumps(self.default_system) + " %}" if self.default_system else ""
        led = q(self.system, "system_message")
        shown = "" if self.system_in_user else "{% if system_message is defined %}{{ " + led + " }}{% endif %}"
        inside = "{% if loop.index0 == 0 and system_message is defined %}{% set content = " + led + " + content %}{% endif %}" if self.system_in_user else ""
        prefix = self.prefix.replace(BOS, bos).replace(EOS, eos)
        return (
            default + "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% endif %}"
            + (f"{{{{ {json.dumps(prefix)} }}}}" if prefix else "") + shown + "{% for message in loop_messages %}{% set content = message['content'] %}" + inside
            + "{% if message['role'] == 'user' %}{{ " + q(self.user, "content") + " }}{% elif message['role'] == 'assistant' %}{{ " + q(self.assistant, "content") + " }}{% endif %}{% endfor %}"
        )

    def ollama(self, eos: str = "", bos: str = "<s>") -> str:
        """A model file's TEMPLATE and stop parameters."""
        fill = lambda slot, what: slot.replace(EOS, eos).replace(BOS, bos).replace(INDEX, "").replace(CONTENT, what)
        system = "{{ if .System }}" + fill(self.system, "{{ .System }}") + "{{ end }}"
        user = fill(self.user, ("{{ if eq $i 0 }}" + system.replace(".System", "$.System") + "{{ end }}{{ .Content }}") if self.system_in_user else "{{ .Content }}")
        each = "{{ range $i, $m := .Messages }}" if self.system_in_user else "{{ range .Messages }}"
        body = fill(self.prefix, "") + ("" if self.system_in_user else system) + each + '{{ if eq .Role "user" }}' + user + '{{ else if eq .Role "assistant" }}' + fill(self.assistant, "{{ .Content }}") + "{{ end }}{{ end }}"
        return f'TEMPLATE """{body}"""\n' + "".join(f'PARAMETER stop "{w}"\n' for w in self.stop_words)


templates: dict[str, Template] = {}


def register_template(template: Template) -> Template:
    if template.name in templates:
        raise ValueError(f"template {template.name} is registered already")
    templates[template.name] = template
    return template


def get_template(name: str) -> Template:
    if name not in templates:
        raise ValueError(f"template {name} does not exist")
    return templates[name]


#: From messages (dicts of role and content) and whether the model's turn is opened at the end, to the text a tokenizer's own template makes of them.
Rendered = Callable[[list[dict[str, str]], bool], str]
THOUGHTS = re.compile(r"<think>|</think>")


def _marked(n: int) -> str:
    return f"\u2060{n}\u2060"  # letters that no template holds


def inferred_template(rendered: Rendered, prefix: str = "", name: str = "inferred", eos: str = "") -> Template:
    """The template that a tokenizer applies, from what it makes of marked messages.

    rendered: the tokenizer's apply_chat_template(); prefix: what it puts before any text. Two whole rounds are rendered and cut at the marks: what
    stands between a user's mark and the answer's ends the user's slot, what stands between the answer's and the next user's ends the answer's and begins the
    user's, and a dialogue that ends at each place tells where the cut lies. A default system text is what is
    rendered without a system message and not with an empty one. A tokenizer whose template refuses system messages gets an empty system slot.
    """

    def made(messages: list[tuple[str, str]], open_: bool) -> str:
        text = rendered([{"role": r, "content": c} for r, c in messages], open_)
        return text[len(prefix) :] if text.startswith(prefix) else text

    ask, say, more, system = map(_marked, (1, 2, 3, 4))
    # An empty system message keeps a default from being put in, where there is one.
    try:
        led = made([("system", system), ("user", ask)], True)
        start = led.index(system)
        empty = made([("system", ""), ("user", ask)], True)
        takes_system = True
    except Exception:  # noqa: BLE001  templates raise what they like
        led, start, empty, takes_system = "", 0, made([("user", ask)], True), False
    bare = made([("user", ask)], True)
    both = made([("user", ask), ("assistant", say)], False)
    rounds = made([("user", ask), ("assistant", say), ("user", more)], True)
    close = bare[bare.index(ask) + len(ask) :]  # after a user's text
    between = rounds[rounds.index(say) + len(say) : rounds.index(more)]
    end = both[both.index(say) + len(say) :]  # after an answer
    head = between[len(end) :] if between.startswith(end) else ""  # before a user's text
    answer = both[both.index(ask) + len(ask) + len(close) : both.index(say)]
    reasoning = bool(THOUGHTS.search(answer))
    answer = THOUGHTS.sub("", answer).lstrip("\n") if reasoning else answer
    first = bare[: bare.index(ask)]
    again, head = head, first if not first.endswith(head) else head  # what stands before a later user's text, and before the first
    slot, default = "", ""
    if takes_system:
        # What follows the system text up to the user's own beginning closes its slot.
        tail = led[start + len(system) : led.index(ask)]
        if again and first.startswith(again) and led[:start].startswith(again) and not tail.endswith(again):
            lead = led[len(again) : start]  # the system text stands inside the user's slot
            inner, inside = lead + CONTENT + tail, first[len(again) :]
            default = inside[len(lead) : len(inside) - len(tail)] if inside else ""
            filled = lambda text: text.replace(eos, EOS) if eos else text
            user, assistant = filled(again + CONTENT + close), filled(answer + CONTENT + end)
            return Template(name, user=user, assistant=assistant, system=filled(inner), function=assistant, observation=user, prefix=prefix, default_system=default, reasoning=reasoning, system_in_user=True)
        own = tail.removesuffix(head) if tail.endswith(head) else tail
        slot = led[:start] + CONTENT + own
        lead, rest = slot.split(CONTENT)
        whole = first.removesuffix(head)
        if whole and whole.startswith(lead) and whole.endswith(rest) and len(whole) >= len(lead) + len(rest) and bare != empty:
            default = whole[len(lead) : len(whole) - len(rest)]
        elif whole:
            head = first  # no default text: what stands before the first user is the user's
            slot = slot.removesuffix(whole) if slot.endswith(whole) and slot != CONTENT else slot
    ended = lambda text: text.replace(eos, EOS) if eos else text
    user, assistant = ended(head + CONTENT + close), ended(answer + CONTENT + end)
    return Template(name, user=user, assistant=assistant, system=ended(slot) or CONTENT, function=assistant, observation=user, prefix=prefix, default_system=default, reasoning=reasoning)


# What the models of these names were trained on.
_chatml = Template(
    "chatml",
    user="<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n",
    assistant="{{content}}<|im_end|>\n",
    system="<|im_start|>system\n{{content}}<|im_end|>\n",
    observation="<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n",
    stop_words=("<|im_end|>", "<|im_start|>"),
)
register_template(Template("alpaca", user="### Instruction:\n{{content}}\n\n### Response:\n", assistant="{{content}}{{eos}}\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"))
register_template(_chatml)
register_template(Template("default", user="Human: {{content}}{{eos}}\nAssistant:", assistant="{{content}}{{eos}}\n", system="System: {{content}}{{eos}}\n"))
register_template(Template("empty", assistant="{{content}}"))
register_template(Template("fewshot", assistant="{{content}}\n\n", efficient_eos=True))
_gemma = register_template(Template("gemma", prefix="<bos>", system_in_user=True, user="<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n", assistant="{{content}}<end_of_turn>\n", system="{{content}}\n\n", observation="<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n"))
_llama3_turn = "<|start_header_id|>{}<|end_header_id|>\n\n{{{{content}}}}<|eot_id|>"
_llama3_open = "<|start_header_id|>assistant<|end_header_id|>\n\n"
register_template(Template("llama3", prefix="<|begin_of_text|>", user=_llama3_turn.format("user") + _llama3_open, assistant="{{content}}<|eot_id|>", system=_llama3_turn.format("system"), function="{{content}}<|eot_id|>", observation=_llama3_turn.format("ipython") + _llama3_open, tool_format="llama3", stop_words=("<|eot_id|>", "<|eom_id|>")))
_qwen = replace(_chatml, name="qwen", function="{{content}}<|im_end|>\n", observation="<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n", tool_format="qwen", stop_words=("<|im_end|>",), default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.")
register_template(_qwen)
register_template(replace(_qwen, name="qwen3", default_system="", reasoning=True))
register_template(replace(_chatml, name="yi"))
register_template(Template("baichuan2", user="<reserved_106>{{content}}<reserved_107>", efficient_eos=True))
register_template(Template("chatglm3", prefix="[gMASK]sop", user="<|user|>\n{{content}}<|assistant|>", assistant="\n{{content}}", system="<|system|>\n{{content}}", observation="<|observation|>\n{{content}}<|assistant|>", stop_words=("<|user|>", "<|observation|>"), efficient_eos=True))
register_template(Template("cohere", prefix="<BOS_TOKEN>", user="<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>"))
register_template(Template("deepseek3", prefix="<｜begin▁of▁sentence｜>", user="<｜User｜>{{content}}<｜Assistant｜>"))
register_template(Template("falcon", user="User: {{content}}\nFalcon:", assistant="{{content}}\n", efficient_eos=True))
register_template(Template("glm4", prefix="[gMASK]<sop>", user="<|user|>\n{{content}}<|assistant|>", assistant="\n{{content}}", function="{{content}}", system="<|system|>\n{{content}}", observation="<|observation|>\n{{content}}<|assistant|>", tool_format="glm4", stop_words=("<|user|>", "<|observation|>"), efficient_eos=True))
register_template(Template("granite3", user="<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", assistant="{{content}}<|end_of_text|>\n", system="<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n"))
register_template(Template("intern2", prefix="<s>", user="<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n", assistant="{{content}}<|im_end|>\n", system="<|im_start|>system\n{{content}}<|im_end|>\n", stop_words=("<|im_end|>",)))
_llama2 = register_template(Template("llama2", user="{{bos}}[INST] {{content}} [/INST]", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", system_in_user=True))
_mistral = register_template(Template("mistral", prefix="{{bos}}", system_in_user=True, user="[INST] {{content}}[/INST]", assistant=" {{content}}{{eos}}", system="{{content}}\n\n", function="[TOOL_CALLS] {{content}}{{eos}}", observation="[TOOL_RESULTS] {\"content\": {{content}}}[/TOOL_RESULTS]", tool_format="mistral"))
register_template(Template("openchat", prefix="<s>", user="GPT4 Correct User: {{content}}{{eos}}GPT4 Correct Assistant:"))
register_template(Template("phi3", user="<|user|>\n{{content}}<|end|>\n<|assistant|>\n", assistant="{{content}}<|end|>\n", system="<|system|>\n{{content}}<|end|>\n", stop_words=("<|end|>",)))
register_template(Template("phi4", user="<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>", assistant="{{content}}<|im_end|>", system="<|im_start|>system<|im_sep|>{{content}}<|im_end|>", stop_words=("<|im_end|>",)))
register_template(Template("solar", user="### User:\n{{content}}\n\n### Assistant:\n", system="### System:\n{{content}}\n\n", efficient_eos=True))
register_template(Template("vicuna", user="USER: {{content}} ASSISTANT:", default_system="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."))
register_template(Template("zephyr", user="<|user|>\n{{content}}{{eos}}<|assistant|>\n", assistant="{{content}}{{eos}}", system="<|system|>\n{{content}}{{eos}}"))


_vicuna, _llama3, _glm4, _zephyr_like = get_template("vicuna"), get_template("llama3"), get_template("glm4"), "<|user|>\n{{content}}<|end|>\n<|assistant|>\n"
_plain_chatml = replace(_chatml, observation=_chatml.user, stop_words=("<|im_end|>",))
_assistant = "You are a helpful assistant."
_tool_brackets = {"function": "[TOOL_CALLS]{{content}}{{eos}}", "observation": '[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]', "tool_format": "mistral"}
register_template(Template("aquila", user="Human: {{content}}###Assistant:", assistant="{{content}}###", system="System: {{content}}###", stop_words=("</s>",), default_system="A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."))
register_template(Template("atom", user="{{bos}}Human: {{content}}\n{{eos}}{{bos}}Assistant:", assistant="{{content}}\n{{eos}}"))
register_template(Template("baichuan", user="<reserved_102>{{content}}<reserved_103>", efficient_eos=True))
register_template(Template("bailing", user="<role>HUMAN</role>{{content}}<role>ASSISTANT</role>", system="<role>SYSTEM</role>{{content}}", observation="<role>OBSERVATION</role>{{content}}<role>ASSISTANT</role>", stop_words=("<|endoftext|>",), efficient_eos=True))
register_template(Template("belle", prefix="{{bos}}", user="Human: {{content}}\n\nBelle: ", assistant="{{content}}{{eos}}\n\n"))
register_template(Template("bluelm", user="[|Human|]:{{content}}[|AI|]:"))
register_template(Template("breeze", prefix="{{bos}}", user="[INST] {{content}} [/INST] ", efficient_eos=True))
register_template(Template("chatglm2", prefix="[gMASK]sop", user="[Round {{idx}}]\n\n问：{{content}}\n\n答：", efficient_eos=True))
register_template(replace(_chatml, name="chatml_de", default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent."))
register_template(Template("codegeex2", prefix="[gMASK]sop"))
register_template(replace(_glm4, name="codegeex4", user="<|user|>\n{{content}}<|assistant|>\n", assistant="{{content}}", observation="<|observation|>\n{{content}}<|assistant|>\n", default_system="你是一位智能编程助手，你叫CodeGeeX。你会为用户回答关于编程、代码、计算机方面的任何问题，并提供格式规范、可以执行、准确安全的代码，并在必要时提供详细的解释。"))
register_template(Template("cpm", prefix="{{bos}}", user="<用户>{{content}}<AI>", observation="<用户>{{content}}<AI>"))
register_template(replace(_plain_chatml, name="cpm3", prefix="{{bos}}", function="{{content}}{{eos}}"))
register_template(replace(_chatml, name="dbrx", stop_words=("<|im_end|>",), default_system="You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\nYOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\nYou assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\nThis is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. You should be responding appropriately and usually that means not mentioning this.\nYOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."))
register_template(Template("deepseek", prefix="{{bos}}", user="User: {{content}}\n\nAssistant:", observation="User: {{content}}\n\nAssistant:", system="{{content}}\n\n"))
register_template(replace(get_template("deepseek3"), name="deepseekr1", reasoning=True))
register_template(Template("deepseekcoder", prefix="{{bos}}", user="### Instruction:\n{{content}}\n### Response:", observation="### Instruction:\n{{content}}\n### Response:", assistant="\n{{content}}\n<|EOT|>\n", default_system="You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"))
register_template(Template("exaone", user="[|user|]{{content}}\n[|assistant|]", observation="[|user|]{{content}}\n[|assistant|]", assistant="{{content}}{{eos}}\n", system="[|system|]{{content}}[|endofturn|]\n"))
register_template(replace(_gemma, name="gemma3", media="gemma3"))
register_template(replace(_glm4, name="glmz1", reasoning=True))
register_template(Template("granite3_vision", user="<|user|>\n{{content}}\n<|assistant|>\n", observation="<|user|>\n{{content}}\n<|assistant|>\n", system="<|system|>\n{{content}}\n", default_system=_vicuna.default_system, media="llava_next"))
register_template(Template("index", user="reserved_0{{content}}reserved_1", observation="reserved_0{{content}}reserved_1", assistant="{{content}}", function="{{content}}", system="<unk>{{content}}", efficient_eos=True))
register_template(Template("hunyuan", prefix="<|bos|>", user="<|bos|>user\n{{content}}<|eos|>\n<|bos|>assistant\n", observation="<|bos|>user\n{{content}}<|eos|>\n<|bos|>assistant\n", assistant="{{content}}<|eos|>\n", system="<|bos|>system\n{{content}}<|eos|>\n", stop_words=("<|eos|>",)))
register_template(Template("intern", prefix="{{bos}}", user="<|User|>:{{content}}\n<|Bot|>:", observation="<|User|>:{{content}}\n<|Bot|>:", assistant="{{content}}<eoa>\n", system="<|System|>:{{content}}\n", stop_words=("<eoa>",), default_system="You are an AI assistant whose name is InternLM (书生·浦语).\n- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."))
register_template(replace(_plain_chatml, name="intern_vl", prefix="{{bos}}", default_system="你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。", media="intern_vl"))
_middle = Template("moonlight", user="<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>", observation="<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>", assistant="{{content}}<|im_end|>", system="<|im_system|>system<|im_middle|>{{content}}<|im_end|>", default_system="You are a helpful assistant provided by Moonshot-AI.", stop_words=("<|im_end|>",))
register_template(_middle)
register_template(replace(_middle, name="kimi_vl", default_system="You are a helpful assistant", thoughts=("◁think▷", "◁/think▷"), media="kimi_vl"))
register_template(replace(_llama2, name="llama2_zh", default_system="You are a helpful assistant. 你是一个乐于助人的助手。"))
_llama4_turn, _llama4_open = "<|header_start|>{}<|header_end|>\n\n{{{{content}}}}<|eot|>", "<|header_start|>assistant<|header_end|>\n\n"
register_template(Template("llama4", prefix="{{bos}}", user=_llama4_turn.format("user") + _llama4_open, assistant="{{content}}<|eot|>", system=_llama4_turn.format("system"), function="{{content}}<|eot|>", observation=_llama4_turn.format("ipython") + _llama4_open, tool_format="llama3", stop_words=("<|eot|>", "<|eom|>"), media="llama4"))
register_template(replace(_llama3, name="mllama", media="mllama"))
register_template(replace(_llama3, name="llava_next_llama3", media="llava_next"))
register_template(replace(_llama3, name="skywork_o1", default_system="You are Skywork-o1, a thinking model developed by Skywork AI, specializing in solving complex problems involving mathematics, coding, and logical reasoning through deep thought. When faced with a user's request, you first engage in a lengthy and in-depth thinking process to explore possible solutions to the problem. After completing your thoughts, you then provide a detailed explanation of the solution process in your response."))
for _name, _media in (("llava", "llava"), ("llava_next", "llava_next"), ("llava_next_video", "llava_next_video"), ("video_llava", "video_llava")):
    register_template(replace(_vicuna, name=_name, observation=_vicuna.user, media=_media))
for _name, _media in (("llava_next_mistral", "llava_next"), ("llava_next_video_mistral", "llava_next_video")):
    register_template(replace(_mistral, name=_name, media=_media))
for _name, _media in (("llava_next_yi", "llava_next"), ("llava_next_video_yi", "llava_next_video")):
    register_template(replace(_plain_chatml, name=_name, media=_media))
for _name, _media in (("llava_next_qwen", "llava_next"), ("qwen2_omni", "qwen2_omni"), ("qwen2_vl", "qwen2_vl")):
    register_template(replace(_qwen, name=_name, default_system=_assistant, media=_media))
register_template(replace(_qwen, name="mimo", default_system=_assistant, reasoning=True))
register_template(replace(_chatml, name="marco", stop_words=("<|im_end|>",), default_system="你是一个经过良好训练的AI助手，你的名字是Marco-o1.由阿里国际数字商业集团的AI Business创造.\n## 重要！！！！！\n当你回答问题时，你的思考应该在<Thought>内完成，<Output>内输出你的结果。\n<Thought>应该尽可能是英文，但是有2个特例，一个是对原文中的引用，另一个是是数学应该使用markdown格式，<Output>内的输出需要遵循用户输入的语言。\n"))
register_template(replace(_plain_chatml, name="minicpm_v", default_system=_assistant, media="minicpm_v"))
register_template(replace(_plain_chatml, name="minicpm_o", default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.", media="minicpm_v"))
register_template(replace(_plain_chatml, name="qwen2_audio", default_system=_assistant, media="qwen2_audio"))
register_template(replace(_plain_chatml, name="smollm"))
register_template(replace(_plain_chatml, name="sailor", user="<|im_start|>question\n{{content}}<|im_end|>\n<|im_start|>answer\n", observation="<|im_start|>question\n{{content}}<|im_end|>\n<|im_start|>answer\n", default_system="You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed."))
register_template(replace(_chatml, name="opencoder", stop_words=("<|im_end|>",), default_system="You are OpenCoder, created by OpenCoder Team."))
register_template(Template("ministral", prefix="{{bos}}", user="[INST]{{content}}[/INST]", system="{{content}}\n\n", system_in_user=True, **_tool_brackets))
register_template(Template("mistral_small", prefix="{{bos}}", user="[INST]{{content}}[/INST]", system="[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]", **_tool_brackets))
register_template(replace(get_template("ministral"), name="pixtral", media="pixtral"))
register_template(Template("olmo", prefix="{{eos}}", user="<|user|>\n{{content}}<|assistant|>\n", observation="<|user|>\n{{content}}<|assistant|>\n"))
_correct = "<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n"
register_template(Template("openchat-3.6", prefix="{{bos}}", user=_correct, observation=_correct, stop_words=("<|eot_id|>",)))
register_template(Template("orion", prefix="{{bos}}", user="Human: {{content}}\n\nAssistant: {{eos}}", observation="Human: {{content}}\n\nAssistant: {{eos}}"))
register_template(Template("paligemma", prefix="{{bos}}", user="{{content}}\n", observation="{{content}}\n", system_in_user=True, media="paligemma"))
register_template(replace(_gemma, name="paligemma_chat", prefix="{{bos}}", system="{{content}}", media="paligemma"))
register_template(Template("phi", user=_zephyr_like, observation=_zephyr_like, assistant="{{content}}<|end|>\n", system="<|system|>\n{{content}}<|end|>\n", stop_words=("<|end|>",)))
register_template(replace(get_template("phi"), name="phi_small", prefix="<|endoftext|>"))
register_template(replace(get_template("phi"), name="starchat", user="<|user|>\n{{content}}<|end|>\n<|assistant|>", observation="<|user|>\n{{content}}<|end|>\n<|assistant|>"))
register_template(Template("seed_coder", user="{{bos}}user\n{{content}}{{eos}}{{bos}}assistant\n", observation="{{bos}}user\n{{content}}{{eos}}{{bos}}assistant\n", system="{{bos}}system\n{{content}}{{eos}}", default_system="You are an AI programming assistant, utilizing the Seed-Coder model, developed by ByteDance Seed, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n\n"))
register_template(Template("telechat", user="<_user>{{content}}<_bot>", observation="<_user>{{content}}<_bot>", system="<_system>{{content}}<_end>"))
register_template(Template("telechat2", user="<_user>{{content}}<_bot>", observation="<_user>{{content}}<_bot>", system="<_system>{{content}}", default_system="你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"))
register_template(Template("xuanyuan", user="Human: {{content}} Assistant:", observation="Human: {{content}} Assistant:", default_system="以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"))
register_template(Template("xverse", user="Human: {{content}}\n\nAssistant: ", observation="Human: {{content}}\n\nAssistant: "))
register_template(Template("yayi", user="<|Human|>:\n{{content}}\n\n<|YaYi|>:", observation="<|Human|>:\n{{content}}\n\n<|YaYi|>:", assistant="{{content}}\n\n", system="<|System|>:\n{{content}}\n\n", stop_words=("<|End|>",), default_system="You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."))
register_template(Template("yi_vl", user="### Human: {{content}}\n### Assistant:", observation="### Human: {{content}}\n### Assistant:", assistant="{{content}}\n", function="{{content}}", stop_words=("###",), efficient_eos=True, media="llava", default_system="This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. Read all the images carefully, and respond to the human's questions with informative, helpful, detailed and polite answers. 这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"))
register_template(Template("yuan", user="{{content}}<sep>", observation="{{content}}<sep>", assistant="{{content}}<eod>\n", stop_words=("<eod>",)))
register_template(Template("ziya", user="<human>:{{content}}\n<bot>:", observation="<human>:{{content}}\n<bot>:", assistant="{{content}}\n"))


def reasoning_messages(messages: Column | str, keep_last: bool = True, empty_thought: bool = True) -> Column:
    """Assistant turns of a reasoning template: thoughts of earlier ones go, the last has one (an empty one if need be)."""
    messages = F.col(messages) if isinstance(messages, str) else messages

    def turn(m: Column, i: Column) -> Column:
        last = i == F.size(messages) - 1
        bare = X.without_thought(m["content"])
        whole = X.with_empty_thought(m["content"]) if empty_thought else m["content"]
        body = F.when(last, whole if keep_last else bare).otherwise(bare)
        return F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", body).otherwise(m["content"]).alias("content"))

    return F.transform(messages, turn)


@dataclass(frozen=True)
class ChoiceTemplate:
    system: str
    choice: str
    answer: str

    def prompt(self, question: Column, options: dict[str, Column]) -> Column:
        """The question with its options (a null one is left out) and the cue for the answer."""
        lines = [F.coalesce(X.filled(self.choice, choice=F.lit(k), content=v), F.lit("")) for k, v in options.items()]
        return F.concat(question, *lines, F.lit(self.answer))

    def messages(self, shots: Column, target: Column, subject: Column) -> Column:
        """Shots (array of struct prompt, answer) and the target (struct) as alternating messages; the subject heads the first."""
        pair = lambda s: F.array(F.struct(F.lit("user").alias("role"), s["prompt"].alias("content")), F.struct(F.lit("assistant").alias("role"), s["answer"].alias("content")))
        flat = F.flatten(F.transform(F.concat(shots, F.array(target)), pair))
        head = X.filled(self.system, subject=subject)
        return F.transform(flat, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(head, m["content"])).otherwise(m["content"]).alias("content")))


# Prompts of the multiple-choice evaluation.
choice_templates = {
    "en": ChoiceTemplate("The following are multiple choice questions (with answers) about {{subject}}.\n\n", "\n{{choice}}. {{content}}", "\nAnswer:"),
    "zh": ChoiceTemplate("以下是中国关于{{subject}}考试的单项选择题，请选出其中的正确答案。\n\n", "\n{{choice}}. {{content}}", "\n答案："),
}
