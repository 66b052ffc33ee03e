"""Extraction and normalisation of model answers, mark-up and identifiers. Built-ins where they can say it, Arrow-batched functions where not."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def multiple_choice(text: Column, letters: str = "ABCD") -> Column:
    """Last letter by the first pattern that has a valid one: 'answer is X', '(X)', 'X' alone on a line."""
    return F.coalesce(stated_choice(text, letters), *[_last_letter(text, p) for p in (rf"\(([{letters}])\)", rf"(?m)^\s*([{letters}])\.?\s*$")])


def stated_choice(text: Column, letters: str = "ABCD") -> Column:
    """Last letter that the text calls its answer ('answer is X'), the first pattern of multiple_choice alone; null if none is valid."""
    return _last_letter(text, rf"(?i)answer(?: is)?:?\s*\(?([{letters}])\b")


def _last_letter(text: Column, pattern: str) -> Column:
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)))


def judge_score(text: Column) -> Column:
    """[[x]], else x/10, clamped to 0..10; null if neither."""
    marked = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\[\[([0-9]+(?:\.[0-9]+)?)\]\]"), F.lit(1)), F.lit(-1))
    ratio = F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*/\s*10", 1), F.lit(""))
    score = F.coalesce(marked, ratio).cast("double")
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


@F.pandas_udf(StringType())
def boxed(s: pd.Series) -> pd.Series:
    r"""Content of the last \boxed{...} with balanced braces, or null."""

    def one(t: str | None) -> str | None:
        at = (t or "").rfind("\\boxed{")
        if at < 0:
            return None
        depth = 0
        for i in range(at + 6, len(t)):
            depth += (t[i] == "{") - (t[i] == "}")
            if not depth:
                return t[at + 7 : i]
        return None

    return s.map(one)


@F.pandas_udf(StringType())
def latex_normal(s: pd.Series) -> pd.Series:
    """A LaTeX answer in one spelling: spacing and sizing commands dropped, fractions and roots braced, units and percent signs dropped."""
    drop = re.compile(r"\\(?:left|right|!|,|;|quad|displaystyle)|\\text\{[^}]*\}|\\%|%|\$|\s|\^\{?\\circ\}?|\.$")

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = drop.sub("", t.replace("tfrac", "frac").replace("dfrac", "frac"))
        t = re.sub(r"\\frac([0-9])([0-9])", r"\\frac{\1}{\2}", t)
        t = re.sub(r"\\sqrt([0-9a-z])", r"\\sqrt{\1}", t)
        t = re.sub(r"^(-?[0-9]+)/([0-9]+)$", r"\\frac{\1}{\2}", t)
        return re.sub(r"^\.", "0.", t)

    return s.map(one)


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; other text as it is."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return t

    return s.map(one)


@F.pandas_udf(StringType())
def without_templates(s: pd.Series) -> pd.Series:
    """Text without {{ ... }}, nested ones too."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        out, depth, last = [], 0, 0
        for m in re.finditer(r"\{\{|\}\}", t):
            if not depth:
                out.append(t[last : m.start()])
            depth = max(0, depth + (1 if m[0] == "{{" else -1))
            last = m.end()
        return "".join(out) + ("" if depth else t[last:])

    return s.map(one)


def json_kind(text: Column) -> Column:
    """Name of the JSON value's type."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def repair_escapes(text: Column) -> Column:
    """Backslashes that begin no JSON escape are doubled."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")


def loose_variants(text: Column) -> Column:
    """Eight readings of a response: with and without first line, last line and asterisks."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    cut = [text, F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0))), "\n"), F.array_join(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), "\n"), F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n")]
    return F.array(*cut, *[F.replace(c, F.lit("*"), F.lit("")) for c in cut])


def tool_calls(text: Column) -> Column:
    """Array of (name, arguments) of <function=name><parameter=key>value</parameter></function> calls."""
    calls = F.regexp_extract_all(text, F.lit(r"(?s)<function=[^>]+>.*?</function>"), F.lit(0))
    return F.transform(calls, lambda c: F.struct(
        F.regexp_extract(c, "<function=([^>]+)>", 1).alias("name"),
        F.map_from_arrays(F.regexp_extract_all(c, F.lit("(?s)<parameter=([^>]+)>(.*?)</parameter>"), F.lit(1)), F.regexp_extract_all(c, F.lit("(?s)<parameter=([^>]+)>(.*?)</parameter>"), F.lit(2))).alias("arguments"),
    ))


def log_pairs(line: Column) -> Column:
    """key: value pairs between bars as a map."""
    parts = F.filter(F.split(line, r"\|"), lambda p: F.contains(p, F.lit(":")))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.substr(p, F.instr(p, ":") + 1)))))
