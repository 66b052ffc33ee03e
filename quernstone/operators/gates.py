"""Gates over samples, trajectories, translations and exports. Built-ins but for self-attribution, which needs the places of matches. The names of reasons,
signals and kinds are fixed values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from quernstone.functions.text import HAN, HANGUL, LATIN, first_reason, let, share

# Patterns that must match what the gates are defined by.
SPECIAL = r"<\|[A-Za-z_]+\|>|</?(?:tool_call|tool_response|think)>"
END_MARKS = r"<\|endoftext\|>|<\|im_end\|>|<\|im_start\|>"
VENDORS = "(Qwen|通义千问|GLM|Zhipu|智谱|Alibaba|알리바바|Google|구글|Gemini|제미나이|Gemma|OpenAI|오픈AI|ChatGPT|GPT-4|GPT-5|Anthropic|앤트로픽|Claude|클로드|DeepSeek|딥시크|Moonshot|Kimi|Mistral|Meta AI|Llama|PaLM|Bard|LaMDA)"
SELF = (
    r"\b(I am|I'm|I’m|I was|I have been|I've been|as an?|this is)\b[^.\n]{0,30}?" + VENDORS
    + r"|\b(developed|trained|created|made|built|designed)\s+by\s+" + VENDORS
    + r"|(저는|나는|제가)\s*[^.\n]{0,20}?" + VENDORS
    + "|" + VENDORS + r"\s*(이|가|에서|에 의해|팀이)\s*(개발|훈련|만든|만들|제작|학습)"
)
NEGATION = r"\b(not|no longer|neither|nor)\b|아니|않|아닙"
INSTRUCTION = "(사고를 생략하거나 서두르지|여러 각도로 검토하고, 대안과 예외|초안을 쓴 뒤 사실과 오류를 검증|다른 회사나 다른 모델의 이름으로)"
FORBIDDEN_GIT = r"\bgit\s+(push|pull|fetch|clone|cherry-pick|reflog|fsck|remote|ls-remote)\b"
TRIVIAL = r"^(cd(\s+\S+)?|ls(\s+-\w+)*(\s+\S+)?|pwd|clear)?$"
WRITES = r"""<<\s*['"]?\w+|>\s*/?\S+\.(py|txt|sh|json|c|cpp|md|csv|yaml|yml|ini|cfg)\b|\bsed\s+-i\b|\btee\b|open\([^)]*['"]w|\bcat\s*>|\bprintf\b[^\n]*>|\becho\b[^\n]*>"""
RUNS = r"python3?\s+(/app/)?solution\.py|<\s*/?app/?samples/|samples/\d\.in|answer\.txt"
DEBUG = r"""\bimport pdb\b|\bpdb\.set_trace\(|\bbreakpoint\(\)|print\(\s*["']DEBUG"""
PARSE_ERROR = r"(?i)Previous response had (parsing errors|warnings)"
TEACHER = r"(?i)gemma|gemini|구글이 (?:저를|나를) |google(?:이|에서) (?:저를|나를)"
META = r"번역할 .{0,10}(?:제공|입력)해 주|번역해 드리겠습니다|Please provide"


@F.pandas_udf(StringType())
def self_attribution(text: pd.Series) -> pd.Series:
    """The first vendor self-attribution (80 characters at most) with no negation from 60 characters before it to 40 after it; null if none.

    A word that the window's edge cuts is no negation ('nor' of 'minor')."""
    claim, negation = re.compile(SELF, re.I), re.compile(NEGATION, re.I)

    def negated(t: str, first: int, last: int) -> bool:
        m = negation.search(t, first, last + 1)  # word edges see the characters on both sides of the window
        return m is not None and m.end() <= last

    def one(t: str | None) -> str | None:
        for m in claim.finditer(t or ""):
            if not negated(t, max(0, m.start() - 60), min(len(t), m.end() + 40)):
                return m[0][:80]
        return None

    return text.map(one)


def most_repeated(values: Column) -> Column:
    """How often the most frequent element of an array occurs; 0 for an empty or null one."""
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    hashed = F.array_sort(F.transform(values, lambda v: F.xxhash64(v)))

    def step(a: Column, h: Column) -> Column:
        run = F.when((a["run"] > 0) & (a["last"] == h), a["run"] + 1).otherwise(1)
        return F.struct(h.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.coalesce(F.aggregate(hashed, start, step)["most"], F.lit(0))


def longest_run(values: Column) -> Column:
    """The longest run of equal consecutive elements; 0 for an empty array."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, v: Column) -> Column:
        run = F.when((a["run"] > 0) & (a["last"] == v), a["run"] + 1).otherwise(1)
        return F.struct(v.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(values, start, step)["most"]


def four_grams(words: Column) -> Column:
    def grams(w: Column) -> Column:
        at = F.when(F.size(w) >= 4, F.sequence(F.lit(0), F.size(w) - 4)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3)))

    return let(words, grams)


def degenerate(text: Column) -> Column:
    """Repetition instead of thought: a four-gram five times among 40 words or more with under 0.7 of the sentences unique, under 0.3 unique of 12 or
    more, or a line three times in a row."""
    kept = lambda x: F.filter(x, lambda s: s != "")
    words = kept(F.split(text, r"[\s]+"))
    sentences = F.filter(F.transform(F.split(text, r"[.!?。\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 3)
    lines = kept(F.transform(F.split(text, "\n"), lambda s: F.trim(s)))
    unique = F.coalesce(F.try_divide(F.size(F.array_distinct(sentences)).cast("double"), F.size(sentences).cast("double")), F.lit(1.0))
    repeated = F.when(F.size(words) >= 40, most_repeated(four_grams(words))).otherwise(0)
    return ((repeated >= 5) & (unique < 0.7)) | ((F.size(sentences) >= 12) & (unique < 0.3)) | (longest_run(lines) >= 3)


def han_share(text: Column) -> Column:
    """Han characters among Hangul, Latin and Han ones."""
    letters = f"{HANGUL[:-1]}{LATIN[1:-1]}{HAN[1:]}"
    return share(text, HAN, letters)


def sample_reason(reasoning: Column, content: Column, finish: Column) -> Column:
    """The first reason against a generated sample, or null."""
    blank = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) == ""
    either = lambda p: reasoning.rlike(p) | content.rlike(p)
    claimed = self_attribution(F.concat(reasoning, F.lit("\n"), content)).isNotNull()
    finished = F.when(finish != "stop", F.concat(F.lit("finish_"), finish))
    first = first_reason((blank(content), "empty_content"))
    last = first_reason(
        (blank(reasoning), "empty_reasoning"), (either(SPECIAL), "special_token"), (han_share(reasoning) > 0.02, "reasoning_chinese"), (han_share(content) > 0.01, "content_chinese"),
        (claimed, "vendor_self_attribution"), (degenerate(reasoning), "reasoning_degenerate"), (either(INSTRUCTION), "instruction_leak"),
    )
    return F.coalesce(first, finished, last)


def keystrokes(content: Column) -> Column:
    """array<string>: keystrokes of the commands in the JSON object from the first { to the last } of an assistant's turn; empty if that is none."""
    first, size = F.instr(content, "{"), F.length(content)
    last = size - F.instr(F.reverse(content), "}") + 1
    body = F.when((first > 0) & (last > first), F.substring(content, first, last - first + 1))
    commands = F.from_json(body, "commands array<struct<keystrokes:string>>")["commands"]
    return F.coalesce(F.transform(F.filter(commands, lambda c: c.isNotNull()), lambda c: F.coalesce(c["keystrokes"], F.lit(""))), F.array().cast("array<string>"))


HARD = ("forbidden_git", "repeat_loop", "no_edit", "parse_error_rate", "max_turns")
SOFT = ("debug_residue", "edit_no_test")


def trajectory_signals(messages: Column, task: Column, repeat: int = 4, errors: float = 0.34, turns: int = 30) -> dict[str, Column]:
    """Quality signals (booleans) of a trajectory: messages array<struct<role, text>>, with commands as JSON in the assistant's turns."""
    said = lambda role: F.filter(messages, lambda m: m["role"] == role)
    commands = F.transform(said("assistant"), lambda m: keystrokes(m["text"]))
    flat = F.flatten(commands)
    whole, n = F.array_join(flat, "\n"), F.size(said("assistant"))
    serious = F.filter(F.transform(flat, lambda k: F.trim(k)), lambda k: ~k.rlike(TRIVIAL))
    failed = F.size(F.filter(said("user"), lambda m: m["text"].rlike(PARSE_ERROR)))
    places = lambda hit: F.filter(F.transform(commands, lambda t, i: F.when(F.exists(t, hit), i)), lambda i: i.isNotNull())
    wrote, ran = places(lambda k: F.contains(k, F.lit("solution.py")) & k.rlike(WRITES)), places(lambda k: k.rlike(RUNS))
    return {
        "forbidden_git": whole.rlike(FORBIDDEN_GIT),
        "repeat_loop": longest_run(serious) >= repeat,
        "no_edit": (task.startswith("oc-") | task.startswith("sc-")) & ~whole.rlike(WRITES),
        "parse_error_rate": failed / F.greatest(n, F.lit(1)) > errors,
        "debug_residue": whole.rlike(DEBUG),
        "edit_no_test": task.startswith("oc-") & (F.size(wrote) > 0) & (F.coalesce(F.array_max(ran), F.lit(-1)) < F.get(wrote, F.lit(0))),
        "max_turns": n > turns,
    }


def translation_failure(source: Column, out: Column, least: float = 0.4) -> Column:
    """struct(kind, reason, idx) of the first failed check of a translated conversation, or null. source, out: array<struct<role, text>> of one length."""
    final = F.element_at(out, -1)["text"]
    users = F.array_join(F.transform(F.filter(out, lambda m: m["role"] == "user"), lambda m: m["text"]), " ")
    fences = lambda t: F.size(F.split(t, "```"))

    def failure(kind: str, reason, idx=None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.lit(None) if idx is None else idx).cast("int").alias("idx"))

    def turn(s: Column, o: Column, i: Column) -> Column:
        collapsed = F.concat(F.lit("translation_collapse:"), F.length(o).cast("string"), F.lit("/"), F.length(s).cast("string"))
        return (
            F.when(s == "", None).when(fences(s) != fences(o), failure("codefence", "codefence_mismatch", i))
            .when((F.length(s) > 200) & (F.length(o) < 0.25 * F.length(s)), failure("hard", collapsed)).when(o.rlike(META) & ~s.rlike(META), failure("hard", "meta_translation_leak"))
        )

    turns = F.transform(F.arrays_zip(source.alias("s"), out.alias("o")), lambda z, i: turn(F.coalesce(z["s"]["text"], F.lit("")), F.coalesce(z["o"]["text"], F.lit("")), i))
    body = F.regexp_replace(F.regexp_replace(final, r"(?s)```.*?```", ""), r"`[^`\n]+`", "")
    hangul = F.when(F.regexp_count(body, F.lit("[A-Za-z가-힣]")) == 0, 1.0).otherwise(share(body, HANGUL, "[A-Za-z가-힣]"))
    low = F.concat(F.lit("low_hangul_ratio:"), F.format_string("%.2f", hangul))
    return F.coalesce(
        F.when(F.trim(F.coalesce(final, F.lit(""))) == "", failure("hard", "empty_final")),
        F.when(F.exists(out, lambda m: m["text"].rlike(SPECIAL)), failure("hard", "special_token_literal")),
        F.when(final.rlike(TEACHER) & ~users.rlike(TEACHER), failure("hard", "teacher_leak")),
        F.get(F.filter(turns, lambda t: t.isNotNull()), F.lit(0)),
        F.when(hangul < least, failure("low_hangul", low)),
    )


def export_reason(messages: Column) -> Column:
    """The first reason against exporting a conversation (array<struct<role, text, reasoning>>), or null."""
    last = F.element_at(messages, -1)
    content, reasoning = F.coalesce(last["text"], F.lit("")), F.coalesce(last["reasoning"], F.lit(""))
    marked = F.exists(messages, lambda m: F.concat(F.coalesce(m["text"], F.lit("")), F.coalesce(m["reasoning"], F.lit(""))).rlike(f"{SPECIAL}|{END_MARKS}"))
    claimed = self_attribution(F.concat(content, F.lit("\n"), reasoning)).isNotNull()
    return first_reason((F.trim(content) == "", "empty_content"), (marked, "special_token"), ((han_share(reasoning) > 0.02) | (han_share(content) > 0.01), "hanja"), (claimed, "self_attribution"))


def swapped(key: Column) -> Column:
    """Whether a pair of answers is shown in reverse order: a bit of the key's hash, so that it can be restored."""
    return F.conv(F.right(F.md5(key.cast("string")), F.lit(1)), 16, 10).cast("int") % 2 == 1


def restored(verdict: Column, swap: Column) -> Column:
    """A verdict about what was shown, as one about the original order; anything but A or B counts as no verdict."""
    flipped = F.when(verdict == "A", "B").when(verdict == "B", "A")
    return F.when(verdict.isin("A", "B"), F.when(swap, flipped).otherwise(verdict))
