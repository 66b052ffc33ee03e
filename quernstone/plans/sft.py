"""Queries of tool declarations and SFT rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions.text import held, let, scrub_scaffold
from quernstone.operators import chat, intervals, media, statistics, tools as T
from quernstone.plans.registry import query
from quernstone.sources.scratch import folder
from quernstone.sources.tables import table


def turns(spark, sf):
    return table(spark, sf, "conversations")


@query("l12_tool_schemas", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 5 < 2 THEN p_type END AS description, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 3 THEN 'object' ELSE p_brand END AS kind FROM part")
def l12(spark, sf):
    """Declarations in the function, MCP, Anthropic, schema-less and nameless forms; kind is what their parameters say."""
    k, q = F.col("p_partkey") % 5, lambda c: let(F.to_json(F.struct(F.col(c).alias("v"))), lambda j: j.substr(F.lit(6), F.length(j) - 6))
    schema = F.concat(F.lit('{"type":'), q("p_brand"), F.lit(',"properties":{}}'))
    form = (
        F.when(k == 0, F.concat(F.lit('{"type":"function","function":{"name":'), q("p_name"), F.lit(',"description":'), q("p_type"), F.lit(',"parameters":'), schema, F.lit("}}")))
        .when(k == 1, F.concat(F.lit('{"id":'), q("p_name"), F.lit(',"description":'), q("p_type"), F.lit(',"inputSchema":{"jsonSchema":'), schema, F.lit("}}")))
        .when(k == 2, F.concat(F.lit('{"name":'), q("p_name"), F.lit(',"input_schema":'), schema, F.lit("}"))).when(k == 3, F.concat(F.lit('{"name":'), q("p_name"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"parameters":'), schema, F.lit("}")))
    )
    t = table(spark, sf, "part").select("p_partkey", held(T.normal_tool(form)).alias("t"))
    return t.select("p_partkey", "t.name", "t.description", F.try_variant_get(F.try_parse_json("t.parameters"), "$.type", "string").alias("kind"))


CALLS = "c AS (SELECT user_id AS row, user_id % 7 AS family, event_type AS tool, event_id % 3 AS a FROM events)"


def calls(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("row"), (F.col("user_id") % 7).alias("family"), F.col("event_type").alias("tool"), F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("argument"), F.when(F.col("event_id") % 3 == 0, "string").otherwise("integer").alias("kind"))


FAMILIES = f"{CALLS}, r AS (SELECT family, row, string_agg(DISTINCT tool, ',' ORDER BY tool) AS s FROM c GROUP BY family, row), s AS (SELECT family, s, count(*) AS n FROM r GROUP BY family, s), f AS (SELECT family, max(n) AS top, CAST(sum(n) AS BIGINT) AS rows FROM s GROUP BY family), u AS (SELECT family, count(DISTINCT tool) AS tools FROM c GROUP BY family)"


@query("l14_tool_families", f"WITH {FAMILIES} SELECT family, rows, tools, CASE WHEN tools <= 10 AND top >= 0.2 * rows THEN 'union' ELSE 'called' END AS declare FROM f JOIN u USING (family)")
def l14(spark, sf):
    return T.families(calls(spark, sf)).select("family", "rows", F.size("tools").cast("long").alias("tools"), "declare")


@query("l13_tool_injection", f"WITH {CALLS}, k AS (SELECT DISTINCT row, family, tool, dense_rank() OVER (ORDER BY tool) AS t FROM c), all_ AS (SELECT DISTINCT family, tool FROM c WHERE family = 0), n AS (SELECT row, tool, CASE WHEN family < 3 AND t % 2 = 0 THEN 'family_called' WHEN t % 3 = 0 THEN 'by_name' ELSE 'synthesised' END AS origin FROM k WHERE family <> 0) SELECT DISTINCT row, all_.tool, 'family_union' AS origin FROM k JOIN all_ ON k.family = 0 UNION ALL SELECT row, tool, origin FROM n")
def l13(spark, sf):
    """Family 0 declares its union, 1 and 2 what is called of every second tool, others nothing; every third tool is known by name."""
    from pyspark.sql import Window

    c = calls(spark, sf)
    names = c.select("tool").distinct().withColumn("t", F.dense_rank().over(Window.orderBy("tool")))  # a row for each tool
    schema = F.lit(T.EMPTY)
    union = c.filter("family = 0").select("family", "tool").distinct().withColumns({"declare": F.lit("union"), "parameters": schema})
    own = spark.createDataFrame([(1,), (2,)], "family long").crossJoin(F.broadcast(names.filter("t % 2 = 0").select("tool"))).withColumns({"declare": F.lit("called"), "parameters": schema})
    got = T.injected(c, union.unionByName(own.select("family", "tool", "declare", "parameters")), names.filter("t % 3 = 0").select("tool", schema.alias("parameters")))
    return got.filter(F.try_parse_json("parameters").isNotNull()).select("row", "tool", "origin")


@query("x37_type_names", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'array' WHEN 2 THEN 'object' WHEN 3 THEN NULL WHEN 4 THEN 'array' ELSE 'number' END AS type, CASE event_id % 6 WHEN 1 THEN 'integer' WHEN 4 THEN 'array' END AS items FROM events")
def x37(spark, sf):
    written = F.get(F.array(*map(F.lit, ("str, optional", "List[int]", "Dict", "any", "list[List[str]]", " FLOAT"))), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf, "events").select("event_id", T.normal_type(written).alias("t")).select("event_id", "t.type", "t.items")


@query("x39_scaffold_terms", "SELECT doc_id, md5(text || CASE lang WHEN 'de' THEN ' meine Identitätsinformationen scale' WHEN 'fr' THEN ' mes informations d''identité scale' WHEN 'es' THEN ' mi información de identidad scale' ELSE ' my identity information scale' END || ' lead-only form') AS digest FROM documents WHERE NOT contains(text, '  ')")
def x39(spark, sf):
    """Terms of a prompt's scaffold that leaked into texts are replaced by the language's own words."""
    d = table(spark, sf, "documents").filter(~F.contains("text", F.lit("  ")))
    leaked = F.concat("text", F.lit(" the identity-facts 'SCALE' lead_only form"))
    return d.select("doc_id", F.md5(scrub_scaffold(leaked, F.col("lang"))).alias("digest"))


def reasoned(spark, sf):
    """Conversations whose assistant turns come with reasoning: the turn's own text, and none in every fourth."""
    reasoning = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 4 != 0), F.col("text"))
    return turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", reasoning.alias("reasoning")))).alias("messages"))


CUT = """t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM conversations),
    u AS (SELECT *, coalesce(max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id), -1) AS last FROM t),
    b AS (SELECT conv_id, turn, w, len(w) AS n, CASE WHEN role <> 'assistant' OR i < last THEN 'other' WHEN conv_id % 4 = 0 OR len(w) = 0 THEN 'none' WHEN len(w) < 20 THEN 'short' ELSE 'cut' END AS status, greatest(1, CAST(floor(len(w) * (0.3 + 0.4 * (('0x' || md5('7|' || conv_id || '|' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE))) AS INT)) AS budget FROM u)"""


@query("l19_reasoning_budget", f"WITH {CUT} SELECT conv_id, turn, status, CASE WHEN status = 'cut' THEN budget END AS budget, CASE WHEN status = 'cut' THEN md5(array_to_string(w[1:budget], ' ')) END AS digest FROM b")
def l19(spark, sf):
    rows = chat.truncated_reasoning(reasoned(spark, sf), 0.3, 0.7, 20, 7)
    m = rows.select("conv_id", F.inline("messages"))
    return m.select("conv_id", "turn", "status", "budget", F.when(F.col("status") == "cut", F.md5("reasoning")).alias("digest"))


@query("a39_truncation_counters", f"WITH {CUT} SELECT count(DISTINCT conv_id) AS rows, count(*) FILTER (status = 'cut') AS turns_cut, count(*) FILTER (status = 'short') AS too_short, count(*) FILTER (status = 'none') AS without, CAST(sum(n) FILTER (status = 'cut') AS BIGINT) AS words, CAST(sum(budget) FILTER (status = 'cut') AS BIGINT) AS kept, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS sub_rows FROM b")
def a39(spark, sf):
    """What truncation and fan-out did, summed where the rows are: turns cut, too short, without reasoning; words before and after; rows after fan-out."""
    before = reasoned(spark, sf)
    m = chat.truncated_reasoning(before, 0.3, 0.7, 20, 7)
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != ""))
    own = m.select("conv_id", F.col("messages").alias("new")).join(before, "conv_id").select("conv_id", F.explode(F.arrays_zip("new", "messages")).alias("z"))
    is_ = lambda s: F.col("z.new.status") == s
    when = lambda s, c: F.sum(F.when(is_(s), c)).cast("long")
    return own.agg(
        F.countDistinct("conv_id").alias("rows"), F.count_if(is_("cut")).alias("turns_cut"), F.count_if(is_("short")).alias("too_short"), F.count_if(is_("none")).alias("without"),
        when("cut", words(F.col("z.messages.reasoning"))).alias("words"), when("cut", words(F.col("z.new.reasoning"))).alias("kept"), F.count_if(F.col("z.new.role") == "assistant").alias("sub_rows"),
    )


@query("l21_next_fit_bins", """WITH RECURSIVE s AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, least(len(string_split(text, ' ')), 1024) AS n FROM documents),
    r AS (SELECT lang, doc_id, k, n AS fill, 0::BIGINT AS bin FROM s WHERE k = 1 UNION ALL SELECT s.lang, s.doc_id, s.k, CASE WHEN r.fill + s.n > 1024 THEN s.n ELSE r.fill + s.n END, CASE WHEN r.fill + s.n > 1024 THEN r.bin + 1 ELSE r.bin END FROM r JOIN s ON s.lang = r.lang AND s.k = r.k + 1)
    SELECT lang, doc_id, bin FROM r""")
def l21(spark, sf):
    """In order, no sorting, long rows cut; a group (here a language, in production an input file) is one sequence of bins."""
    d = table(spark, sf, "documents").select("lang", "doc_id", F.size(F.split("text", " ")).alias("n"))
    return chat.next_fit(d, "lang", "doc_id", "n", 1024).select("lang", "doc_id", "bin")


PAIR = "p AS (SELECT conv_id, list_filter(string_split(coalesce(min_by(text, turn) FILTER (role = 'user'), ''), ' '), lambda w: w <> '') AS a, list_filter(string_split(coalesce(min_by(text, turn) FILTER (role = 'assistant'), ''), ' '), lambda w: w <> '') AS b FROM conversations GROUP BY conv_id)"


@query("l22_prefix_masked", f"WITH {PAIR}, f AS (SELECT conv_id, len(a) AS s, list_transform(a || b, lambda w: length(w)) AS t FROM p WHERE len(a) < 128 AND len(a || b) > 0) SELECT conv_id, 129 AS size, least(len(t), 128) AS n, CASE WHEN len(t) <= 128 THEN -1 - t[-1] ELSE t[128] END AS last, greatest(least(len(t), 128) - s, 0) AS labels FROM f")
def l22(spark, sf):
    """Words stand for tokens, their lengths for ids."""
    ids = lambda role: F.transform(F.filter(F.split(F.coalesce(F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit("")), " "), lambda w: w != ""), lambda w: F.length(w))
    p = turns(spark, sf).groupBy("conv_id").agg(ids("user").alias("source"), ids("assistant").alias("answer")).withColumn("whole", F.concat("source", "answer")).filter(F.size("whole") > 0)
    made, labels = chat.prefix_masked(F.col("source"), F.col("whole"), 128)
    p = p.select("conv_id", made.alias("made"), labels.alias("labels")).filter("made is not null").withColumn("n", F.size(F.filter("made", lambda t: t != -100)))
    return p.select("conv_id", F.size("made").alias("size"), F.col("n").cast("long").alias("n"), F.get("made", F.col("n") - 1).cast("long").alias("last"), F.size(F.filter("labels", lambda t: t != -100)).cast("long").alias("labels"))


@query("l39_iteration_samples", "WITH o AS (SELECT doc_id, text, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS beg, sum(n_chars) OVER (ORDER BY doc_id) AS fin FROM documents), q AS (SELECT i, i * 4096 AS a, (i + 1) * 4096 AS b FROM (SELECT unnest(generate_series(16, 31)) AS i)) SELECT i // 8 AS iteration, i AS sample, count(*) AS documents, CAST(sum(least(b, fin) - greatest(a, beg)) AS BIGINT) AS chars, bool_or(regexp_matches(text, '([#$%&*])\\1\\1') OR contains(text, '$$$') OR contains(text, '###') OR contains(text, '%%%') OR contains(text, '&&&') OR contains(text, '***')) AS odd FROM q JOIN o ON beg < b AND fin > a GROUP BY i".replace("regexp_matches(text, '([#$%&*])\\1\\1') OR ", ""))
def l39(spark, sf):
    """The samples that iterations 2 and 3 saw (8 samples of 4,096 characters each), rebuilt from the corpus offsets, and whether they hold odd runs of signs."""
    d = table(spark, sf, "documents")
    o = statistics.running(d.select("doc_id", "n_chars"), "doc_id", "b_stop", F.col("n_chars")).select("doc_id", (F.col("b_stop") - F.coalesce("n_chars", F.lit(0))).alias("b_start"), "b_stop")
    q = spark.range(16, 32).select(F.col("id").alias("sample"), (F.col("id") * 4096).alias("a_start"), ((F.col("id") + 1) * 4096).alias("a_stop"))
    met = intervals.overlaps(q, o, 4096).join(d.select("doc_id", F.col("text").rlike(r"[$]{3}|[#]{3}|[%]{3}|[&]{3}|[*]{3}").alias("odd")), "doc_id")
    g = met.groupBy("sample").agg(F.count("*").alias("documents"), F.sum(F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")).cast("long").alias("chars"), F.max("odd").alias("odd"))
    return g.select(F.floor(F.col("sample") / 8).alias("iteration"), "sample", "documents", "chars", "odd")


@query("l43_tranche_export", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN lang = 'en' THEN 'regen' ELSE 'translate' END AS method, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def l43(spark, sf):
    """A folder of files for each method, read again."""
    at = folder(spark)
    method = F.when(F.col("n_chars") < 500, "short").when(F.col("lang") == "en", "regen").otherwise("translate")
    table(spark, sf, "documents").select("doc_id", "n_chars", method.alias("method")).write.partitionBy("method").json(at)
    return spark.read.schema("doc_id long, n_chars long, method string").json(at).groupBy("method").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))




@query("l40_media_batches", """WITH p AS (SELECT doc_id, n_chars, doc_id // 16 AS batch, 14 + n_chars % 3000 AS h, 28 + doc_id * 37 % 2000 AS w FROM documents), r AS (SELECT *, round_even(h / 28, 0) * 28 AS a, round_even(w / 28, 0) * 28 AS b, h >= 28 AND w >= 28 AND greatest(h, w) <= 200 * least(h, w) AS ok FROM p)
    SELECT doc_id, max(n_chars) OVER (PARTITION BY batch) - n_chars AS padding,
    CASE WHEN NOT ok THEN NULL WHEN a * b > 1003520 THEN CAST(floor(h / sqrt(h * w / 1003520.0::DOUBLE) / 28) * 28 AS BIGINT) WHEN a * b < 3136 THEN CAST(ceil(h * sqrt(3136.0::DOUBLE / (h * w)) / 28) * 28 AS BIGINT) ELSE CAST(a AS BIGINT) END AS height,
    CASE WHEN NOT ok THEN NULL WHEN a * b > 1003520 THEN CAST(floor(w / sqrt(h * w / 1003520.0::DOUBLE) / 28) * 28 AS BIGINT) WHEN a * b < 3136 THEN CAST(ceil(w * sqrt(3136.0::DOUBLE / (h * w)) / 28) * 28 AS BIGINT) ELSE CAST(b AS BIGINT) END AS width FROM r""")
def l40(spark, sf):
    """Pictures with sides made from a document's numbers, resized to patches; texts padded to the longest of a batch of 16."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 16).alias("batch"), (14 + F.col("n_chars") % 3000).alias("h"), (28 + F.col("doc_id") * 37 % 2000).alias("w"))
    size = media.resized(F.col("h"), F.col("w"))
    return media.padded(d, "batch", "n_chars").select("doc_id", "padding", size["height"].alias("height"), size["width"].alias("width"))
