"""Text functions as column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACES = r"[ \t\n\r\f\x0B]+"
#: What the corpus cleaner deletes, in its order: addresses, runs of spaces, characters outside the kept set.
URL = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
NOT_KEPT = "[^0-9a-zA-Z一-龥.， ,\\-。%《*》/•、&＆(—)（+）：？!！“”·]+"
#: Ranges of scripts.
HANGUL, HAN, KANA, LATIN = "[가-힣]", "[一-鿿]", "[぀-ヿ]", "[A-Za-z]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside lambdas an expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held(value: Column) -> Column:
    """value, made by a generator of one row, which the optimizer doesn't copy into what refers to it (filters would compute it for every element)."""
    return F.explode(F.array(value))


def norm_space_lower(text: Column) -> Column:
    """Lower case, runs of ASCII white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def norm_answer(text: Column) -> Column:
    """Without parentheticals, spaces and ASCII punctuation."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"[ \t\n\r.,;:!?'\"()\-]", ""))


def norm_articles(text: Column) -> Column:
    """Lower case, punctuation as spaces, words a, an, the dropped, single spaces."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", "a", "an", "the")), " ")


def clean_text(text: Column) -> Column:
    """Addresses deleted, runs of spaces as one, characters outside the kept set deleted, ends trimmed, in this order."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, URL, ""), " +", " "), NOT_KEPT, ""))


def share(text: Column, pattern: str, of: str | None = None) -> Column:
    """Matches of a character class over those of another (or over all characters); 0 where there are none."""
    whole = F.regexp_count(text, F.lit(of)) if of else F.length(text)
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), whole.cast("double")), F.lit(0.0))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """Name of the first condition that holds, or null."""
    out = F.when(*_pair(cases[0]))
    for c in cases[1:]:
        out = out.when(*_pair(c))
    return out


def _pair(case: tuple[Column, str]) -> tuple[Column, Column]:
    return case[0], F.lit(case[1])


def all_reasons(*cases: tuple[Column, str]) -> Column:
    """Names of all conditions that hold, in order, once each, joined by ';'."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))), ";")


def split_think(text: Column) -> tuple[Column, Column]:
    """What follows the last closing think mark (or all), and whether there is one."""
    return F.trim(F.substring_index(text, "</think>", -1)), F.contains(text, F.lit("</think>"))


def suffixed_int(text: Column) -> Column:
    """12, 3K, 2M, 1B, 4T as integers; null otherwise."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMBTkmbt]?)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMBTkmbt]?)\s*$", 2))
    factor = F.when(unit == "K", 10**3).when(unit == "M", 10**6).when(unit == "B", 10**9).when(unit == "T", 10**12).otherwise(F.lit(1).cast("long"))
    return F.when(number != "", (number.cast("double") * factor).cast("long"))


def hash_mod(text: Column, modulus: int) -> Column:
    """SHA-1 of the text as a 160-bit number, modulo `modulus`, by folding its hex digits."""
    digits = F.transform(F.filter(F.split(F.sha1(text), ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % modulus)


def ramp(i: Column, start: int, full: int, low: float, high: float) -> Column:
    """low up to start, high from full on, linear between."""
    return F.when(i <= start, F.lit(low)).when(i >= full, F.lit(high)).otherwise(low + (high - low) * (i - start) / F.lit(float(max(1, full - start))))


def round_up(n: Column, multiple: int) -> Column:
    return F.ceil(n / multiple) * multiple


#: What stands for leaked terms of a prompt's scaffold, by language.
IDENTITY = {
    "ko": "제 정체성 정보", "en": "my identity information", "zh": "我的身份信息", "ja": "私のアイデンティティ情報", "es": "mi información de identidad", "de": "meine Identitätsinformationen",
    "fr": "mes informations d'identité", "it": "le mie informazioni di identità", "pt": "minhas informações de identidade",
}
SECTIONS = {
    "en": {"SCALE": "scale", "ARCHITECTURE": "architecture", "ORIGIN": "origin", "DEVELOPED BY": "developer", "NOT DISCLOSED": "not-disclosed", "UNDISCLOSED": "undisclosed", "NAME": "name"},
    "ko": {"SCALE": "규모", "ARCHITECTURE": "아키텍처", "ORIGIN": "출처", "DEVELOPED BY": "개발 주체", "NOT DISCLOSED": "비공개", "UNDISCLOSED": "비공개", "NAME": "명칭"},
    "ja": {"SCALE": "規模", "ARCHITECTURE": "アーキテクチャ", "ORIGIN": "出自", "DEVELOPED BY": "開発主体", "NOT DISCLOSED": "非公開", "UNDISCLOSED": "非公開", "NAME": "名称"},
    "zh": {"SCALE": "规模", "ARCHITECTURE": "架构", "ORIGIN": "来源", "DEVELOPED BY": "开发主体", "NOT DISCLOSED": "未公开", "UNDISCLOSED": "未公开", "NAME": "名称"},
}
MEMBERS = {"en": {"lead_only": "lead-only", "all_members": "all-members"}, "ko": {"lead_only": "리드만 명시하는", "all_members": "전원을 명시하는"}}


def _scrubbed(text: Column, language: str) -> Column:
    own = IDENTITY.get(language, IDENTITY["en"]).replace("$", r"\$")
    for p in (r"[Tt]he\s+identity[- _]facts", r"제공된\s+<?identity[- _]facts>?", r"(?i)<?/?identity[- _]facts>?"):
        text = F.regexp_replace(text, p, own)
    for name, word in SECTIONS.get(language, SECTIONS["en"]).items():
        if language == "ko":
            text = F.regexp_replace(text, rf"'?{name}'?(?:\s*(항목|섹션|정보|section|entry|field))", f"{word} $1")
            text = F.regexp_replace(text, rf"'?{name}'?\s*", word)
        else:
            text = F.regexp_replace(text, rf"'?(?<![A-Za-z]){name}(?![A-Za-z])'?", word)
    for name, word in MEMBERS["ko" if language == "ko" else "en"].items():
        text = F.regexp_replace(text, rf"{name}\s*(?:형식|form|format)?", word + (" 형식" if language == "ko" else " form"))
    return F.regexp_replace(text, "  +", " ")


def scrub_scaffold(text: Column, language: Column) -> Column:
    """text with leaked scaffold terms replaced by words of its language (English for others)."""
    out = None
    for code in IDENTITY:
        if code != "en":
            out = F.when(language == code, _scrubbed(text, code)) if out is None else out.when(language == code, _scrubbed(text, code))
    return out.otherwise(_scrubbed(text, "en"))
