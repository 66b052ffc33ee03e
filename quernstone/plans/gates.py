"""Queries of the gates over samples, trajectories, translations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions.plugins import model_call
from quernstone.operators import chat, gates as G
from quernstone.plans.registry import query
from quernstone.sources.tables import table


def turns(spark, sf):
    return table(spark, sf, "conversations")


#: Added to texts by number, so that every branch of a gate is met.
PHRASES = ("", " I was trained by Google.", " I am not developed by OpenAI.", " Claude Makelele plays.", " It was built by Meta AI, they say.", " 저는 구글에서 만든 모델입니다.", " this is no longer a Gemini product")
PHRASE_SQL = "CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END"


def phrased(spark, sf):
    phrase = F.get(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    return turns(spark, sf).select("conv_id", "turn", "role", F.concat("text", phrase).alias("text"))


@query("f18_self_attribution", "SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 1 THEN 'I was trained by Google' WHEN 4 THEN 'built by Meta AI' WHEN 5 THEN '저는 구글' END AS claim FROM conversations WHERE role = 'assistant'")
def f18(spark, sf):
    """Claims in whole turns; a negation near a claim clears it, and other mentions of a vendor are none."""
    return phrased(spark, sf).filter("role = 'assistant'").select("conv_id", "turn", G.self_attribution(F.col("text")).alias("claim"))


SAMPLES = """p AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') || CASE conv_id % 11 WHEN 1 THEN repeat(' 生成', 400) WHEN 2 THEN '<|im_end|>' WHEN 3 THEN repeat(chr(10) || 'again', 3) WHEN 4 THEN ' 여러 각도로 검토하고, 대안과 예외' ELSE '' END AS r,
    CASE conv_id % 11 WHEN 5 THEN ' ' WHEN 6 THEN repeat('한자 漢字 ', 300) ELSE coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') END AS c, CASE conv_id % 11 WHEN 7 THEN 'length' ELSE 'stop' END AS f FROM conversations GROUP BY conv_id)"""


def samples(spark, sf):
    said = lambda role: F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["text"]), "\n")
    k = F.col("conv_id") % 11
    r = F.when(k == 1, F.repeat(F.lit(" 生成"), 400)).when(k == 2, F.lit("<|im_end|>")).when(k == 3, F.repeat(F.lit("\nagain"), 3)).when(k == 4, F.lit(" 여러 각도로 검토하고, 대안과 예외")).otherwise("")
    c = F.when(k == 5, F.lit(" ")).when(k == 6, F.repeat(F.lit("한자 漢字 "), 300)).otherwise(said("assistant"))
    return chat.conversations(turns(spark, sf)).select("conv_id", F.concat(said("user"), r).alias("reasoning"), c.alias("content"), F.when(k == 7, "length").otherwise("stop").alias("finish"))


def _han(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '[一-鿿]')) / nullif(len(regexp_extract_all({c}, '[가-힣A-Za-z一-鿿]')), 0), 0)"


GATE_SQL = f"""WITH {SAMPLES}, d AS (SELECT *, list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '') AS w, list_filter(list_transform(string_split_regex(r, '[.!?。\\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 3) AS s,
    list_filter(list_transform(string_split(r, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM p),
    g AS (SELECT conv_id, unnest(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) AS g FROM d WHERE len(w) >= 40),
    t AS (SELECT conv_id, max(n) AS top FROM (SELECT conv_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY conv_id),
    u AS (SELECT d.*, coalesce(top, 0) AS top, CASE WHEN len(s) = 0 THEN 1 ELSE len(list_distinct(s)) / len(s) END AS uniq FROM d LEFT JOIN t USING (conv_id)),
    x AS (SELECT conv_id, CASE WHEN trim(regexp_replace(c, '\\s+', ' ', 'g'), ' ') = '' THEN 'empty_content' WHEN f <> 'stop' THEN 'finish_' || f WHEN trim(regexp_replace(r, '\\s+', ' ', 'g'), ' ') = '' THEN 'empty_reasoning'
    WHEN regexp_matches(r, '<\\|[A-Za-z_]+\\|>|</?(?:tool_call|tool_response|think)>') OR regexp_matches(c, '<\\|[A-Za-z_]+\\|>|</?(?:tool_call|tool_response|think)>') THEN 'special_token'
    WHEN {_han('r')} > 0.02 THEN 'reasoning_chinese' WHEN {_han('c')} > 0.01 THEN 'content_chinese'
    WHEN (top >= 5 AND uniq < 0.7) OR (len(s) >= 12 AND uniq < 0.3) OR len(list_filter(generate_series(1, len(l) - 2), lambda i: l[i] = l[i+1] AND l[i] = l[i+2])) > 0 THEN 'reasoning_degenerate'
    WHEN contains(r, '여러 각도로 검토하고, 대안과 예외') THEN 'instruction_leak' END AS reason FROM u)"""


@query("f13_sample_gate", GATE_SQL + " SELECT conv_id, reason FROM x")
def f13(spark, sf):
    """No sample of these tables claims a vendor; f18 covers that branch."""
    return samples(spark, sf).select("conv_id", G.sample_reason(F.col("reasoning"), F.col("content"), F.col("finish")).alias("reason"))


@query("l46_revalidated_rejects", GATE_SQL + ", b AS (SELECT conv_id // 3 AS seed, count(*) FILTER (reason IS NULL) AS n, min(conv_id) FILTER (reason IS NULL) AS first FROM x GROUP BY 1) SELECT seed, n AS passed, CASE WHEN n = 0 THEN 'still_rejected' WHEN n = 1 THEN 'rescued' ELSE 'judged' END AS outcome, first FROM b")
def l46(spark, sf):
    """Rejected samples (three to a seed) under the present gate: none, one or more survive; with more a judge is asked, else the first is taken."""
    s = samples(spark, sf).select(F.floor(F.col("conv_id") / 3).alias("seed"), "conv_id", G.sample_reason(F.col("reasoning"), F.col("content"), F.col("finish")).alias("reason"))
    b = s.groupBy("seed").agg(F.count_if(F.col("reason").isNull()).alias("passed"), F.min(F.when(F.col("reason").isNull(), F.col("conv_id"))).alias("first"))
    return b.select("seed", "passed", F.when(F.col("passed") == 0, "still_rejected").when(F.col("passed") == 1, "rescued").otherwise("judged").alias("outcome"), "first")


@query("l47_pairwise_verdict", "WITH p AS (SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'user'), '') AS a, coalesce(min_by(text, turn) FILTER (role = 'assistant'), '') AS b FROM conversations GROUP BY conv_id) SELECT conv_id, ('0x' || right(md5(CAST(conv_id AS VARCHAR)), 1))::BIGINT % 2 = 1 AS swap, CASE WHEN length(a) > length(b) THEN 'A' WHEN length(b) > length(a) THEN 'B' END AS verdict FROM p")
def l47(spark, sf):
    """A judge that prefers the longer answer sees pairs in an order drawn by hash; its verdict is restored to the original order. Equal lengths: none."""
    first = lambda role: F.coalesce(F.get(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["text"]), F.lit(0)), F.lit(""))
    p = chat.conversations(turns(spark, sf)).select("conv_id", first("user").alias("a"), first("assistant").alias("b")).withColumn("swap", G.swapped(F.col("conv_id")))
    shown = F.when(F.col("swap"), F.concat_ws("\x00", "b", "a")).otherwise(F.concat_ws("\x00", "a", "b"))

    def longer(prompts: list[str]) -> list[str]:
        pairs = [p.split("\x00") for p in prompts]
        return ["A" if len(x) > len(y) else "B" if len(y) > len(x) else "?" for x, y in pairs]

    return p.withColumn("told", model_call(longer)(shown)).select("conv_id", "swap", G.restored(F.col("told"), F.col("swap")).alias("verdict"))


#: A command that is added to the assistant's turns of a conversation, by its number.
COMMANDS = ("git push origin", "echo x > solution.py", "python3 solution.py", "import pdb", "ls -la", "make")


def trajectories(spark, sf):
    """Conversations in which every assistant turn is a JSON object of commands: the words of its text, and one by the conversation's number."""
    extra = F.get(F.array(*map(F.lit, COMMANDS)), (F.col("conv_id") % 6).cast("int"))
    commands = F.concat(F.transform(F.split("text", " "), lambda w: F.struct(w.alias("keystrokes"))), F.array(F.struct(extra.alias("keystrokes"))))
    said = F.concat(F.lit("next: "), F.to_json(F.struct(commands.alias("commands"))), F.lit(" ok"))
    failed = F.when((F.col("conv_id") % 4 == 1), F.lit("Previous response had parsing errors. ")).otherwise("")
    rows = turns(spark, sf).select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", said).otherwise(F.concat(failed, "text")).alias("text"))
    task = F.concat(F.get(F.array(F.lit("oc-"), F.lit("sc-"), F.lit("qa-")), (F.col("conv_id") % 3).cast("int")), "conv_id")
    return chat.conversations(rows).withColumn("task", task)


@query("x45_keystrokes", "SELECT conv_id, turn, len(string_split(text, ' ')) + 1 AS n, md5(array_to_string(list_append(string_split(text, ' '), CASE conv_id % 6 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(COMMANDS)) + " END), chr(10))) AS digest FROM conversations WHERE role = 'assistant'")
def x45(spark, sf):
    rows = trajectories(spark, sf).select("conv_id", F.explode("messages").alias("m")).filter("m.role = 'assistant'").select("conv_id", "m.turn", G.keystrokes(F.col("m.text")).alias("k"))
    return rows.select("conv_id", "turn", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "\n")).alias("digest"))


@query("f19_trajectory_signals", """WITH k AS (SELECT conv_id, turn, unnest(list_append(string_split(text, ' '), CASE conv_id % 6 """ + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(COMMANDS)) + """ END)) AS k, generate_subscripts(list_append(string_split(text, ' '), ''), 1) AS i FROM conversations WHERE role = 'assistant'),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - row_number() OVER (PARTITION BY conv_id, trim(k, ' ') ORDER BY turn, i) AS g FROM k WHERE NOT regexp_full_match(trim(k, ' '), '(cd(\\s+\\S+)?|ls(\\s+-\\w+)*(\\s+\\S+)?|pwd|clear)?')),
    r AS (SELECT conv_id, max(n) AS run FROM (SELECT conv_id, trim(k, ' '), g, count(*) AS n FROM s GROUP BY ALL) GROUP BY conv_id),
    c AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, array_to_string(list_filter([CASE WHEN conv_id % 6 = 0 AND n > 0 THEN 'forbidden_git' END, CASE WHEN coalesce(run, 0) >= 4 THEN 'repeat_loop' END, CASE WHEN conv_id % 3 < 2 AND NOT (conv_id % 6 = 1 AND n > 0) THEN 'no_edit' END,
    CASE WHEN conv_id % 4 = 1 AND u / greatest(n, 1) > 0.34 THEN 'parse_error_rate' END, CASE WHEN conv_id % 6 = 3 AND n > 0 THEN 'debug_residue' END, CASE WHEN n > 5 THEN 'max_turns' END], lambda x: x IS NOT NULL), ',') AS flags FROM c LEFT JOIN r USING (conv_id)""")
def f19(spark, sf):
    """All signals that hold, hard and soft; a row is dropped by the hard ones."""
    t = trajectories(spark, sf)
    signals = G.trajectory_signals(F.col("messages"), F.col("task"), turns=5)
    return t.select("conv_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in signals.items()])), ",").alias("flags"))


@query("f22_translation_checks", """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text AS s, CASE WHEN conv_id % 8 = 1 AND turn = 1 THEN text || '```' WHEN conv_id % 8 = 2 THEN left(text, length(text) // 5) WHEN conv_id % 8 = 3 AND role = 'assistant' THEN 'gemma ' || text
    WHEN conv_id % 8 = 4 THEN text || '</think>' WHEN conv_id % 8 = 5 THEN repeat('한글 ', length(text)) WHEN conv_id % 8 = 6 THEN 'Please provide ' || text ELSE text END AS o FROM conversations),
    z AS (SELECT conv_id, i, CASE WHEN s = '' THEN NULL WHEN len(string_split(s, '```')) <> len(string_split(o, '```')) THEN 'codefence_mismatch' WHEN length(s) > 200 AND length(o) < 0.25 * length(s) THEN 'translation_collapse:' || length(o) || '/' || length(s) WHEN contains(o, 'Please provide') THEN 'meta_translation_leak' END AS r FROM t),
    f AS (SELECT conv_id, min_by(r, i) FILTER (r IS NOT NULL) AS r, min(i) FILTER (r IS NOT NULL) AS i FROM z GROUP BY conv_id),
    c AS (SELECT conv_id, max_by(o, i) AS fin, bool_or(regexp_matches(o, '</think>')) AS special, coalesce(bool_or(regexp_matches(o, '(?i)gemma|gemini')) FILTER (role = 'user'), false) AS asked FROM t GROUP BY conv_id),
    h AS (SELECT *, CASE WHEN len(regexp_extract_all(fin, '[A-Za-z가-힣]')) = 0 THEN 1 ELSE len(regexp_extract_all(fin, '[가-힣]')) / len(regexp_extract_all(fin, '[A-Za-z가-힣]')) END AS ratio FROM c)
    SELECT conv_id, CASE WHEN trim(fin, ' ') = '' THEN 'empty_final' WHEN special THEN 'special_token_literal' WHEN regexp_matches(fin, '(?i)gemma|gemini') AND NOT asked THEN 'teacher_leak' WHEN r IS NOT NULL THEN r WHEN ratio < 0.4 THEN 'low_hangul_ratio:' || printf('%.2f', ratio) END AS reason,
    CASE WHEN trim(fin, ' ') = '' OR special OR (regexp_matches(fin, '(?i)gemma|gemini') AND NOT asked) THEN NULL WHEN r = 'codefence_mismatch' THEN CAST(i AS INT) END AS idx FROM h JOIN f USING (conv_id)""")
def f22(spark, sf):
    k, text = F.col("conv_id") % 8, F.col("text")
    out = (
        F.when((k == 1) & (F.col("turn") == 1), F.concat(text, F.lit("```"))).when(k == 2, F.left(text, F.floor(F.length(text) / 5).cast("int"))).when((k == 3) & (F.col("role") == "assistant"), F.concat(F.lit("gemma "), text))
        .when(k == 4, F.concat(text, F.lit("</think>"))).when(k == 5, F.repeat(F.lit("한글 "), F.length(text))).when(k == 6, F.concat(F.lit("Please provide "), text)).otherwise(text)
    )
    c = turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", out.alias("out")))).alias("m"))
    one = lambda name: F.transform("m", lambda x: F.struct(x["role"].alias("role"), x[name].alias("text")))
    c = c.select("conv_id", one("text").alias("source"), one("out").alias("made"))
    return c.select("conv_id", G.translation_failure(F.col("source"), F.col("made")).alias("f")).select("conv_id", "f.reason", "f.idx")


@query("f25_export_gate", f"""WITH c AS (SELECT conv_id, coalesce(max_by(text, turn), '') || CASE conv_id % 5 WHEN 1 THEN repeat(' 漢字', 200) ELSE '' END AS fin, bool_or(regexp_matches(text || CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN '<|endoftext|>' ELSE '' END, '<\\|[A-Za-z_]+\\|>|</?think>')) AS marked FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 5 = 3 THEN 'empty_content' WHEN marked THEN 'special_token' WHEN {_han('fin')} > 0.01 THEN 'hanja' WHEN conv_id % 5 = 4 THEN 'self_attribution' END AS reason FROM c""")
def f25(spark, sf):
    k = F.col("conv_id") % 5
    text = F.concat("text", F.when((k == 2) & (F.col("turn") == 1), "<|endoftext|>").otherwise(""))
    c = chat.conversations(turns(spark, sf).withColumn("text", text))
    last = F.element_at("messages", -1)["text"]
    end = F.when(k == 1, F.concat(last, F.repeat(F.lit(" 漢字"), 200))).when(k == 3, F.lit("  ")).when(k == 4, F.concat(last, F.lit(" I was created by OpenAI."))).otherwise(last)
    role = lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"), F.lit(None).cast("string").alias("reasoning"))
    before = F.transform(F.slice("messages", F.lit(1), F.size("messages") - 1), role)
    final = F.array(F.struct(F.element_at("messages", -1)["role"].alias("role"), end.alias("text"), F.lit("").alias("reasoning")))
    return c.select("conv_id", G.export_reason(F.concat(before, final)).alias("reason"))


@query("f33_aliased_columns", "SELECT item_id, md5(text) AS instruction, length(text) AS response FROM benchmark")
def f33(spark, sf):
    """Whichever of the known names a table has; none is an error."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"), F.length("text").cast("long").alias("content"))
    return b.select("item_id", F.md5(first_of(b, "instruction", "query")).alias("instruction"), first_of(b, "output", "content", "response").alias("response"))


def first_of(df, *names):
    found = [n for n in names if n in df.columns]
    if not found:
        raise ValueError(f"none of {', '.join(names)}")
    return F.col(found[0])


@query("f34_text_key_guard", "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL")
def f34(spark, sf):
    """The text column is checked in the schema before anything is read."""
    d = table(spark, sf, "documents")
    return d.select(first_of(d, "text").alias("t")).filter("t is not null").agg(F.count("*").alias("n"))
