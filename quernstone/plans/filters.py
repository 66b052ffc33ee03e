"""Queries of projections, filters and gates (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions import text as X
from quernstone.operators import chat, gates
from quernstone.plans.registry import query
from quernstone.sources.tables import table

MESSAGES = """m AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"""
SPECIAL_SQL = "(" + " OR ".join(f"contains(text, '{s}')" for s in chat.SPECIAL) + ")"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def convs(spark: SparkSession, sf: str) -> DataFrame:
    return chat.conversations(table(spark, sf, "conversations"))


@query("f01_drop_empty", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 0")
def f01(spark, sf):
    return docs(spark, sf).filter(F.length("text") > 0).select("doc_id", "n_chars")


CLEAN_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '{X.URL}', '', 'g'), ' +', ' ', 'g'), '{X.NOT_KEPT}', '', 'g'), ' ')"


@query("f02_clean_text", f"SELECT doc_id, md5({CLEAN_SQL}) AS digest, length({CLEAN_SQL}) AS n FROM documents")
def f02(spark, sf):
    c = docs(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("c"))
    return c.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n"))


@query("f03_language_or_source", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') OR source = 'src3'")
def f03(spark, sf):
    return docs(spark, sf).filter(F.col("lang").isin("en", "de") | (F.col("source") == "src3")).select("doc_id", "lang")


@query("f04_floor_on_source_family", "SELECT doc_id, source, n_chars FROM documents WHERE NOT (source LIKE '%7' AND length(text) < 1000)")
def f04(spark, sf):
    return docs(spark, sf).filter(~(F.col("source").endswith("7") & (F.length("text") < 1000))).select("doc_id", "source", "n_chars")


@query("f05_hash_sample_of_band")
def f05(spark, sf):
    keep = F.crc32(F.col("doc_id").cast("string").cast("binary")) / F.lit(4294967296.0) < 0.1
    return docs(spark, sf).filter((F.length("text") >= 2000) | keep).select("doc_id", "n_chars")


@query("f06_length_partition", "SELECT CASE WHEN n_chars < 2000 THEN 'lt' ELSE 'ge' END AS part, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE n_chars > 0 GROUP BY 1")
def f06(spark, sf):
    part = F.when(F.col("n_chars") < 2000, "lt").otherwise("ge").alias("part")
    return docs(spark, sf).filter("n_chars > 0").groupBy(part).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "f07_first_failing_reason",
    f"""SELECT conv_id, CASE WHEN count(*) > 6 THEN 'too_many_turns' WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'bad_role' WHEN bool_or(text IS NULL) THEN 'null_content'
    WHEN bool_or(length(text) > 2000) THEN 'long_message' WHEN bool_or({SPECIAL_SQL}) THEN 'special_token' WHEN sum(length(text)) > 3000 THEN 'long_total'
    WHEN max_by(role, turn) <> 'assistant' THEN 'last_not_assistant' END AS reason FROM conversations GROUP BY conv_id""",
)
def f07(spark, sf):
    return convs(spark, sf).select("conv_id", chat.row_reason(F.col("messages"), 6, 2000, 3000).alias("reason"))


@query(
    "f08_seed_gate",
    f"""SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) > 6000 THEN 'long' WHEN {SPECIAL_SQL} THEN 'special'
    WHEN len(regexp_extract_all(text, '[#$%&*|]')) > 0.01 * length(text) THEN 'signs' WHEN len(regexp_extract_all(text, '[A-Za-z]')) < 0.5 * length(text) THEN 'script' END AS reason FROM documents""",
)
def f08(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", X.first_reason((F.length(t) < 200, "short"), (F.length(t) > 6000, "long"), (chat.has_special(t), "special"), (F.regexp_count(t, F.lit("[#$%&*|]")) > 0.01 * F.length(t), "signs"), (F.regexp_count(t, F.lit(X.LATIN)) < 0.5 * F.length(t), "script")).alias("reason"))


@query("f09_any_assistant_turn_matches", "SELECT conv_id, bool_or(role = 'assistant' AND regexp_matches(text, '(idiot|clown|tion)')) AS hit FROM conversations GROUP BY conv_id")
def f09(spark, sf):
    return convs(spark, sf).select("conv_id", F.exists("messages", lambda m: (m["role"] == "assistant") & m["text"].rlike("(idiot|clown|tion)")).alias("hit"))


PAIR = """WITH p AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS a, min_by(text, turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)"""


def pairs(spark, sf):
    t = table(spark, sf, "conversations")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return t.groupBy("conv_id").agg(first("user").alias("a"), first("assistant").alias("b"))


@query(
    "f10_pair_gate",
    PAIR + """ SELECT conv_id, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN len(string_split(a, '```')) <> len(string_split(b, '```')) THEN 'fences'
    WHEN length(b) < 0.25 * length(a) OR length(b) > 4 * length(a) THEN 'ratio' WHEN contains(b, substr(a, 1, 80)) THEN 'leak' END AS reason FROM p""",
)
def f10(spark, sf):
    a, b = F.col("a"), F.col("b")
    fences = lambda c: F.size(F.split(c, "```"))
    return pairs(spark, sf).select("conv_id", X.first_reason((a.isNull() | b.isNull(), "missing"), (fences(a) != fences(b), "fences"), ((F.length(b) < 0.25 * F.length(a)) | (F.length(b) > 4 * F.length(a)), "ratio"), (F.contains(b, F.substring(a, 1, 80)), "leak")).alias("reason"))


@query("f11_body_copied", "SELECT d.doc_id, contains(e.text, substr(d.text, 1, 80)) AS copied FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1")
def f11(spark, sf):
    d = docs(spark, sf).select("doc_id", F.substring("text", 1, 80).alias("head"))
    e = docs(spark, sf).select((F.col("doc_id") - 1).alias("doc_id"), "text")
    return d.join(e, "doc_id").select("doc_id", F.contains("text", "head").alias("copied"))


@query("f12_prompt_gate", "SELECT conv_id, turn, CASE WHEN length(trim(text, ' ')) < 20 THEN 'short' WHEN length(text) > 1500 THEN 'long' WHEN contains(text, chr(10)) THEN 'lines' END AS reason FROM conversations WHERE role = 'user'")
def f12(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", X.first_reason((F.length(F.trim(t)) < 20, "short"), (F.length(t) > 1500, "long"), (F.contains(t, F.lit("\n")), "lines")).alias("reason"))


@query(
    "f14_degenerate_repetition",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) AS g FROM w WHERE len(w) >= 4),
    c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g) GROUP BY doc_id)
    SELECT w.doc_id, coalesce(top, 0) AS top4, (coalesce(top, 0) >= 5 AND len(list_distinct(s)) < 0.7 * len(s)) OR (len(s) >= 12 AND len(list_distinct(s)) < 0.3 * len(s)) AS degenerate FROM w LEFT JOIN c USING (doc_id)""",
)
def f14(spark, sf):
    words = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    d = docs(spark, sf).select("doc_id", words.alias("w"), F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x)), lambda x: x != "").alias("s"))
    unique, n, t = F.size(F.array_distinct("s")), F.size("s"), F.col("top4")
    d = d.withColumn("top4", gates.most_repeated(gates.four_grams(F.col("w"))).cast("long"))
    return d.select("doc_id", "top4", (((t >= 5) & (unique < 0.7 * n)) | ((n >= 12) & (unique < 0.3 * n))).alias("degenerate"))


@query("f15_structural_injection", f"SELECT conv_id, bool_or({SPECIAL_SQL}) AS injected FROM conversations GROUP BY conv_id")
def f15(spark, sf):
    return convs(spark, sf).select("conv_id", F.exists("messages", lambda m: chat.has_special(m["text"])).alias("injected"))


@query("f16_count_literals_by_role", "SELECT role, sum(len(string_split(text, 'tion')) - 1) AS n, sum(CASE WHEN contains(text, 'tion') THEN 1 ELSE 0 END) AS turns FROM conversations GROUP BY role")
def f16(spark, sf):
    n = F.size(F.split("text", "tion")) - 1
    return table(spark, sf, "conversations").groupBy("role").agg(F.sum(n).alias("n"), F.sum((n > 0).cast("int")).alias("turns"))


@query("f17_canary", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(apache license|all rights reserved)')")
def f17(spark, sf):
    return docs(spark, sf).filter(F.col("text").rlike("(?i)(apache license|all rights reserved)")).select("doc_id")


@query(
    "f20_all_reasons",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 300 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN contains(text, '!!') THEN 'shouting' END,
    CASE WHEN length(text) < 100 THEN 'short' ELSE NULL END], lambda x, i: x IS NOT NULL AND i < 4), ';') AS reasons FROM documents""",
)
def f20(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", X.all_reasons((F.length(t) < 300, "short"), (F.col("lang") != "en", "language"), (F.contains(t, F.lit("!!")), "shouting"), (F.length(t) < 100, "short")).alias("reasons"))


@query("f21_ratio_gate", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) / length(text) AS letters, len(regexp_extract_all(text, '[A-Za-z]')) / length(text) >= 0.6 AS ok FROM documents WHERE length(text) > 0")
def f21(spark, sf):
    d = docs(spark, sf).filter(F.length("text") > 0).select("doc_id", X.share(F.col("text"), X.LATIN).alias("letters"))
    return d.select("doc_id", "letters", (F.col("letters") >= 0.6).alias("ok"))


@query("f23_judge_threshold_null_passes", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality >= 1")
def f23(spark, sf):
    return docs(spark, sf).select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").filter("quality is null or quality >= 1")


@query("f24_tranche_gate", "SELECT conv_id, bool_and(CASE WHEN role = 'assistant' THEN length(text) > 0 AND length(text) < 3000 ELSE true END) AS ok FROM conversations GROUP BY conv_id")
def f24(spark, sf):
    return convs(spark, sf).select("conv_id", F.forall("messages", lambda m: (m["role"] != "assistant") | ((F.length(m["text"]) > 0) & (F.length(m["text"]) < 3000))).alias("ok"))


@query("f26_exclude_origin_prefix", "SELECT doc_id, source FROM documents WHERE NOT (lower(source) LIKE 'src1%' OR lower(source) LIKE 'src9%')")
def f26(spark, sf):
    return docs(spark, sf).filter(~F.exists(F.array(F.lit("src1"), F.lit("src9")), lambda p: F.startswith(F.lower("source"), p))).select("doc_id", "source")


@query("f27_problem_predicate", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 200 AND 4000 AND lang NOT IN ('es') AND NOT contains(text, 'http') AND contains(text, 'tion')")
def f27(spark, sf):
    return docs(spark, sf).filter(F.col("n_chars").between(200, 4000) & ~F.col("lang").isin("es") & ~F.contains("text", F.lit("http")) & F.contains("text", F.lit("tion"))).select("doc_id")


@query("f28_numeric_answer", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]+(\\.[0-9]+)?') AND NOT regexp_matches(text, '(?i)proof|prove')")
def f28(spark, sf):
    return docs(spark, sf).filter(F.col("text").rlike(r"[0-9]+(\.[0-9]+)?") & ~F.col("text").rlike("(?i)proof|prove")).select("doc_id")


@query("f29_stride_and_floor", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND n_chars >= 500 ORDER BY doc_id LIMIT 50")
def f29(spark, sf):
    """The stride and the limit are the feature."""
    return docs(spark, sf).filter("doc_id % 7 = 0 and n_chars >= 500").orderBy("doc_id").limit(50).select("doc_id")


@query("f30_script_consistency", "SELECT doc_id, lang, CASE WHEN lang = 'es' THEN len(regexp_extract_all(text, '[ñáéíóú]')) > 0 WHEN lang = 'de' THEN len(regexp_extract_all(text, '[äöüß]')) > 0 ELSE len(regexp_extract_all(text, '[A-Za-z]')) > 0 END AS ok FROM documents")
def f30(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p)) > 0
    return docs(spark, sf).select("doc_id", "lang", F.when(F.col("lang") == "es", n("[ñáéíóú]")).when(F.col("lang") == "de", n("[äöüß]")).otherwise(n("[A-Za-z]")).alias("ok"))


@query("f31_question_template", PAIR + " SELECT conv_id, md5(CASE WHEN a IS NULL THEN b ELSE 'doc' || chr(10) || chr(10) || 'Question: ' || a || chr(10) || chr(10) || 'Answer: ' || b END) AS digest FROM p WHERE b IS NOT NULL")
def f31(spark, sf):
    made = F.when(F.col("a").isNull(), F.col("b")).otherwise(F.concat(F.lit("doc\n\nQuestion: "), "a", F.lit("\n\nAnswer: "), "b"))
    return pairs(spark, sf).filter("b is not null").select("conv_id", F.md5(made).alias("digest"))


@query("f32_section_concat", "SELECT doc_id, array_to_string(list_filter([lang, source, CASE WHEN n_chars > 1000 THEN 'long' END], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) AS text FROM documents")
def f32(spark, sf):
    sections = F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long"))
    return docs(spark, sf).select("doc_id", F.array_join(F.filter(sections, lambda s: s.isNotNull() & (s != "")), "\n\n").alias("text"))


@query("f35_measurement_validity", "SELECT source, array_to_string(list_filter([CASE WHEN avg(CAST(n_chars < 500 AS INT)) > 0.1 THEN 'short' END, CASE WHEN avg(CAST(lang = 'en' AS INT)) < 0.5 THEN 'language' END, CASE WHEN avg(CAST(contains(text, '!!') AS INT)) > 0.05 THEN 'shouting' END], lambda x: x IS NOT NULL), ';') AS reasons FROM documents GROUP BY source")
def f35(spark, sf):
    rate = lambda c: F.avg(c.cast("int"))
    return docs(spark, sf).groupBy("source").agg(X.all_reasons((rate(F.col("n_chars") < 500) > 0.1, "short"), (rate(F.col("lang") == "en") < 0.5, "language"), (rate(F.contains("text", F.lit("!!"))) > 0.05, "shouting")).alias("reasons"))


@query("f37_blend_invariants", "SELECT count(*) AS members, abs(sum(w) - 1) < 1e-6 AS sums_to_one, min(n) > 0 AS nonempty FROM (SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS w FROM documents GROUP BY source)")
def f37(spark, sf):
    n = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).agg(F.count("*").alias("members"), (F.abs(F.sum(F.col("n") / F.col("t")) - 1) < 1e-6).alias("sums_to_one"), (F.min("n") > 0).alias("nonempty"))
