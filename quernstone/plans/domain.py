"""Queries of domain operators (L): tokens, packing, chat rows, blends."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quernstone.operators import blend as B, chat, statistics, tokens as T
from quernstone.plans.registry import query
from quernstone.sources.scratch import folder
from quernstone.sources.tables import table

CAP = 4096


def docs(spark, sf):
    return table(spark, sf, "documents")


def lengths(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("n_chars").alias("n"))


@query("l01_tokenize", "SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) + 1 AS n FROM documents WHERE len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) > 0")
def l01(spark, sf):
    return T.tokenize(docs(spark, sf)).select("doc_id", F.size("tokens").cast("long").alias("n"))


@query("l02_tokens_per_sentence", "WITH s AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda s: trim(s, ' ' || chr(10)) <> '') AS s FROM documents), p AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM s) SELECT doc_id, i, len(list_filter(string_split_regex(s, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS n FROM p")
def l02(spark, sf):
    """A row for each sentence with its number of tokens."""
    s = F.filter(F.split("text", r"\."), lambda s: F.trim(F.translate(s, "\n", " ")) != "")
    per = docs(spark, sf).select("doc_id", F.posexplode(F.transform(s, lambda x: F.size(T.word_ids(x)))).alias("i", "n"))
    return per.select("doc_id", F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"))


@query("l03_blocks_before_splitting", "SELECT doc_id, b AS block, md5(substr(text, 1 + b * 1000000, 1000000)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, (n_chars - 1) // 1000000)) AS b FROM documents WHERE n_chars > 0)")
def l03(spark, sf):
    blocks = F.transform(F.expr("sequence(0, int((n_chars - 1) div 1000000))"), lambda i: F.md5(F.substr("text", i * 1000000 + 1, F.lit(1000000))))
    return docs(spark, sf).filter("n_chars > 0").select("doc_id", F.posexplode(blocks).alias("block", "digest")).withColumn("block", F.col("block").cast("long"))


@query("l04_truncated_tokens", "SELECT doc_id, least(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')), 500) AS n FROM documents")
def l04(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(F.slice(T.word_ids(F.col("text")), 1, 500)).cast("long").alias("n"))


@query("l05_concat_and_chunk", f"WITH s AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source) SELECT source, CAST(unnest(generate_series(0, greatest(0, total // {CAP} - 1))) AS BIGINT) AS chunk, least(total, {CAP}) AS n FROM s")
def l05(spark, sf):
    return T.concat_chunks(docs(spark, sf).select("doc_id", "source", F.col("n_chars").alias("n")), "source", CAP)


@query("l06_best_fit_bins")
def l06(spark, sf):
    made = T.pieces(lengths(spark, sf), CAP).filter("pool")
    return T.pack(made, CAP).groupBy("bin").agg(F.count("*").alias("items"), F.sum("len").alias("fill"))


PIECES = f"p AS (SELECT doc_id, n_chars AS n, unnest(generate_series(0, (n_chars - 1) // {CAP})) AS piece FROM documents WHERE n_chars > 0)"


@query("l07_pieces", f"WITH {PIECES} SELECT doc_id, CAST(piece AS BIGINT) AS piece, piece * {CAP} AS off, least({CAP}, n - piece * {CAP}) AS len, least({CAP}, n - piece * {CAP}) < {CAP} AS pool FROM p")
def l07(spark, sf):
    return T.pieces(lengths(spark, sf), CAP)


WORDS = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"


@query("l08_padded_bins", f"SELECT 1024 AS size, CAST(sum({WORDS}) AS BIGINT) AS tokens, count(*) FILTER ({WORDS} > 0) AS documents FROM documents")
def l08(spark, sf):
    """Every bin has the capacity's length; what is in the bins and isn't padding are all tokens, and the documents' ends are all there is of ends but padding."""
    at = folder(spark)
    T.tokenize(docs(spark, sf)).write.parquet(at)
    t = spark.read.parquet(at)
    packed = T.pack(T.pieces(t.select("doc_id", F.size("tokens").alias("n")), 1024), 1024)
    kept = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, x: n + (x != 0).cast("int"))
    bins = T.emit_bins(t, packed, 1024).groupBy(F.size("tokens").alias("size")).agg(F.sum(kept).alias("tokens"))
    ids = t.agg(F.countDistinct("doc_id").alias("documents"))
    return bins.crossJoin(F.broadcast(ids)).select("size", "tokens", "documents")  # a row


@query("l09_baseline_truncations", f"WITH c AS (SELECT sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS b, source FROM documents) SELECT source, CAST(max(b) // {CAP} - count(*) FILTER (b % {CAP} = 0) AS BIGINT) AS cut FROM c GROUP BY source")
def l09(spark, sf):
    c = statistics.running(docs(spark, sf).select("source", "doc_id", "n_chars"), "doc_id", "b", F.col("n_chars"), within=("source",))
    return c.groupBy("source").agg((F.floor(F.max("b") / CAP) - F.count_if(F.col("b") % CAP == 0)).cast("long").alias("cut"))


@query("l10_post_verification", f"SELECT sum(n_chars)::BIGINT AS tokens, CAST(sum((n_chars + {CAP} - 1) // {CAP}) AS BIGINT) AS pieces, CAST(sum(n_chars // {CAP}) AS BIGINT) AS full_pieces, true AS within, true AS near_bound FROM documents")
def l10(spark, sf):
    made = T.pieces(lengths(spark, sf), CAP)
    bins = T.pack(made, CAP).groupBy("bin").agg(F.sum("len").alias("fill"), F.count("*").alias("n"), F.count_if(F.col("len") == CAP).alias("full"))
    whole = bins.agg(F.sum("fill").alias("tokens"), F.sum("n").alias("pieces"), F.sum("full").alias("full_pieces"), F.max("fill").alias("most"), F.count("*").alias("bins"))
    return whole.select("tokens", "pieces", "full_pieces", (F.col("most") <= CAP).alias("within"), (F.col("bins") <= 1.05 * F.col("tokens") / CAP + 2).alias("near_bound"))


def convs(spark, sf):
    return chat.conversations(table(spark, sf, "conversations"))


@query("l11_normalised_rows", "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id")
def l11(spark, sf):
    m = convs(spark, sf).select("conv_id", F.transform("messages", lambda m: m.withField("role", chat.normal_role(m["role"])).withField("text", F.when((m["role"] == "system") & m["text"].isNull(), "").otherwise(m["text"]))).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda x: x["role"] == "system")).cast("long").alias("system"))


@query("l15_train_turn_fan_out", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sub, n AS n_messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE role = 'assistant'")
def l15(spark, sf):
    return chat.fan_out(convs(spark, sf)).select("conv_id", F.col("sub").cast("long").alias("sub"), F.col("n_messages").cast("long").alias("n_messages"))


@query("l16_implicit_fan_out", "SELECT conv_id, count(*) FILTER (role = 'user') > 1 AND count(*) FILTER (role = 'assistant') > 1 AS fans_out FROM conversations GROUP BY conv_id")
def l16(spark, sf):
    n = lambda role: F.size(F.filter("messages", lambda m: m["role"] == role))
    return convs(spark, sf).select("conv_id", ((n("user") > 1) & (n("assistant") > 1)).alias("fans_out"))


@query("l17_rendered", "SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def l17(spark, sf):
    return convs(spark, sf).select("conv_id", F.md5(chat.render(F.col("messages"))).alias("digest"))


@query("l18_loss_spans", "WITH n AS (SELECT *, len(list_filter(string_split(text, ' '), lambda w: w <> '')) + 2 AS n FROM conversations), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT conv_id, turn, CAST(b + 1 AS BIGINT) AS start, n - 1 AS n_trained FROM b WHERE role = 'assistant'")
def l18(spark, sf):
    s = chat.loss_spans(table(spark, sf, "conversations"))
    return s.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("n_trained").cast("long").alias("n_trained"))


def sft(spark, sf):
    t = table(spark, sf, "conversations").filter("role <> 'system'").select("conv_id", "turn", T.word_ids(F.col("text"), 1000).alias("ids"), (F.col("role") == "assistant").alias("on"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ids", "on"))).alias("m"))
    flat = c.select("conv_id", F.flatten(F.transform("m", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("m", lambda x: F.array_repeat(x["on"], F.size(x["ids"])))).alias("on"))
    size = 4096  # the results take names of their own: an alias "ids" would stand for the column inside the lambdas
    ids, labels = T.sft_bin(F.col("ids"), F.col("on"), size)
    return flat.filter(F.size("ids").between(1, size)).select("conv_id", F.size("ids").alias("n"), F.aggregate("on", F.lit(0).cast("long"), lambda a, x: a + x.cast("int")).alias("trained"), F.get("on", F.lit(0)).alias("first_on"), ids.alias("input_ids"), labels.alias("labels"))


@query("l20_sft_documents", """WITH t AS (SELECT conv_id, turn, role, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS n FROM conversations WHERE role <> 'system'),
    c AS (SELECT conv_id, sum(n)::BIGINT AS n, sum(n) FILTER (role = 'assistant') AS trained, min_by(role, turn) FILTER (n > 0) AS first FROM t GROUP BY conv_id) SELECT conv_id, n, 4096 AS size, CAST(coalesce(trained, 0) - (first = 'assistant')::INT AS BIGINT) AS labels FROM c WHERE n BETWEEN 1 AND 4096""")
def l20(spark, sf):
    return sft(spark, sf).select("conv_id", F.col("n").cast("long").alias("n"), F.size("input_ids").alias("size"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("labels"))


@query("l23_contract_check", """WITH n AS (SELECT conv_id, sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id)
    SELECT conv_id, CASE conv_id % 6 WHEN 1 THEN 'ids_length' WHEN 2 THEN 'labels_length' WHEN 3 THEN 'vocab;shift' WHEN 4 THEN 'tail_label' WHEN 5 THEN 'no_marker' ELSE '' END AS reasons FROM n WHERE n BETWEEN 1 AND 4096""")
def l23(spark, sf):
    """Bins that keep the contract and bins that are broken in one way each, by number."""
    s, k = sft(spark, sf), F.col("conv_id") % 6
    real = F.transform("input_ids", lambda t: F.when(t < 0, -1 - t).otherwise(t))
    ids = F.when(k == 1, F.slice("input_ids", F.lit(1), F.lit(4095))).when(k == 3, F.concat(F.array(F.lit(5), F.lit(1000)), F.slice("input_ids", F.lit(3), F.lit(4094)))).when(k == 5, real).otherwise(F.col("input_ids"))
    ids = F.when(k == 3, F.transform(ids, lambda t, i: F.when(i == 4095, -1).otherwise(t))).otherwise(ids)
    labels = F.when(k == 2, F.slice("labels", F.lit(1), F.lit(4095))).when(k == 3, F.concat(F.array(F.lit(7)), F.array_repeat(F.lit(-100), F.lit(4095)))).when(k == 4, F.concat(F.slice("labels", F.lit(1), F.lit(4095)), F.array(F.lit(3)))).otherwise(F.col("labels"))
    return s.select("conv_id", ids.alias("a"), labels.alias("b")).select("conv_id", T.contract_reasons(F.col("a"), F.col("b"), 4096, 1000).alias("reasons"))


@query("l24_render_check", "SELECT conv_id, count(*) AS opens, count(*) AS closes FROM conversations GROUP BY conv_id")
def l24(spark, sf):
    r = convs(spark, sf).select("conv_id", chat.render(F.col("messages")).alias("r"))
    return r.select("conv_id", F.regexp_count("r", F.lit(r"<\|im_start\|>")).cast("long").alias("opens"), F.regexp_count("r", F.lit(r"<\|im_end\|>")).cast("long").alias("closes"))


@query("l25_end_remap", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 0 END AS last, {WORDS} AS before, true AS same FROM documents WHERE {WORDS} > 0")
def l25(spark, sf):
    """The end of every second document is remapped; for the others the old id is another one, and they stay. What stands before the end is unchanged."""
    t = T.tokenize(docs(spark, sf)).select("doc_id", "tokens", F.when(F.col("doc_id") % 2 == 0, T.remap_end(F.col("tokens"), 0, 7)).otherwise(T.remap_end(F.col("tokens"), 5, 7)).alias("new"))
    head = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    return t.select("doc_id", F.element_at("new", -1).alias("last"), (F.size("new") - 1).cast("long").alias("before"), (head("new") == head("tokens")).alias("same"))


@query("l26_internal_end_scan", "WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) % 7) AS tokens FROM documents), p AS (SELECT doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM t), e AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p), c AS (SELECT doc_id, count(*) FILTER (t = 0 AND nxt <> 0) AS ends, count(*) FILTER (t = 0 AND nxt <> 0 AND i % 16 <> 0) AS off FROM e GROUP BY doc_id) SELECT count(*) AS docs, count(*) FILTER (ends > 0) AS contaminated, CAST(sum(ends) AS BIGINT) AS ends, CAST(sum(off) AS BIGINT) AS off_grid FROM c")
def l26(spark, sf):
    """Ends inside documents (words whose length is a multiple of seven stand for them), and how many are off the grid."""
    n, off = T.internal_eod(F.col("tokens"), 16)
    t = docs(spark, sf).select(F.transform(F.split("text", " "), lambda w: F.length(w) % 7).alias("tokens")).select(F.when(F.size("tokens") > 0, n).alias("n"), off.alias("off"))
    return t.agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 0).alias("contaminated"), F.sum("n").alias("ends"), F.sum("off").alias("off_grid"))


@query("l27_batch_masks", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CAST(role = 'assistant' AS INT) AS mask FROM conversations")
def l27(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("role") == "assistant").cast("int").alias("mask"))


@query("l28_segment_normalised_loss", "SELECT conv_id AS bin, turn AS pos, coalesce(CAST(role = 'assistant' AS INT) / nullif(sum(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id), 0), 0) AS weight FROM conversations")
def l28(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("bin"), F.lit(0).alias("segment"), F.col("turn").alias("pos"), (F.col("role") == "assistant").cast("int").alias("mask"))
    return T.segment_weights(rows).select("bin", "pos", "weight")


SIZES = "m AS (SELECT source AS member, CASE WHEN source LIKE 'src1%' THEN 'web' WHEN source LIKE 'src2%' THEN 'code' ELSE 'rest' END AS category, sum(n_chars)::DOUBLE AS size, count(*) AS bins FROM documents GROUP BY source)"


def members(spark, sf):
    m = docs(spark, sf).groupBy(F.col("source").alias("member")).agg(F.sum("n_chars").cast("double").alias("size"), F.count("*").alias("bins"))
    return m.withColumn("category", F.when(F.col("member").startswith("src1"), "web").when(F.col("member").startswith("src2"), "code").otherwise("rest"))


@query("l29_capped_weights", f"WITH {SIZES}, c AS (SELECT *, least(0.3, sum(size) FILTER (category = 'web') OVER () / sum(size) OVER ()) AS lim FROM m) SELECT member, size / sum(size) OVER (PARTITION BY category = 'web') * CASE WHEN category = 'web' THEN lim ELSE 1 - lim END AS weight FROM c")
def l29(spark, sf):
    return B.capped_weights(members(spark, sf), "size", "category", "web", 0.3).select("member", "weight")


PLAN = "p AS (SELECT * FROM (VALUES ('web', 0.6::DOUBLE), ('rest', 0.4::DOUBLE), ('code', 0.0::DOUBLE)) t(category, share))"


def plan(spark):
    return spark.createDataFrame([("web", 0.6), ("rest", 0.4), ("code", 0.0)], "category string, share double")


@query("l30_planned_weights", f"WITH {SIZES}, {PLAN} SELECT member, share * size / sum(size) OVER (PARTITION BY category) AS weight FROM m JOIN p USING (category) WHERE share > 0")
def l30(spark, sf):
    return B.planned_weights(members(spark, sf), plan(spark), "size", "category").select("member", "weight")


@query("l31_two_level_target", f"WITH {SIZES}, f AS (SELECT *, CASE WHEN member = 'src1' THEN 0.05 END AS fixed FROM m), r AS (SELECT *, 0.5 - coalesce(sum(fixed) OVER (PARTITION BY category), 0) AS rest, sum(CASE WHEN fixed IS NULL THEN size END) OVER (PARTITION BY category) AS free FROM f) SELECT member, coalesce(fixed, rest * size / free)::DOUBLE AS weight FROM r")
def l31(spark, sf):
    fixed = F.when(F.col("member") == "src1", F.lit(0.05))
    return B.two_level(members(spark, sf), "category", F.lit(0.5), "size", fixed).select("member", "weight")


@query("l32_category_target", f"WITH {SIZES}, t AS (SELECT *, sum(size) OVER (PARTITION BY category) AS total FROM m) SELECT member, size * (0.25 / total) AS weight FROM t")
def l32(spark, sf):
    return members(spark, sf).select("member", (F.col("size") * (F.lit(0.25) / F.sum("size").over(Window.partitionBy("category")))).alias("weight"))


@query("l33_replay_blend", f"WITH {SIZES}, k AS (SELECT member, CASE category WHEN 'web' THEN 2.0 * bins WHEN 'code' THEN 0.1 * sum(bins) OVER () ELSE 0.5 * bins END AS samples FROM m) SELECT member, CAST(samples AS DOUBLE) AS samples, CAST(samples / sum(samples) OVER () AS DOUBLE) AS weight FROM k")
def l33(spark, sf):
    """Members given by epochs (web), by share of all (code) or scaled (rest)."""
    all_ = Window.partitionBy(F.lit(0))
    s = F.when(F.col("category") == "web", 2.0 * F.col("bins")).when(F.col("category") == "code", 0.1 * F.sum("bins").over(all_)).otherwise(0.5 * F.col("bins"))
    return members(spark, sf).select("member", s.alias("samples")).withColumn("weight", F.col("samples") / F.sum("samples").over(all_))


@query("l34_epoch_preserving", f"WITH {SIZES}, b AS (SELECT member, size AS weight, bins, bins * 2 + 5 AS other FROM m) SELECT member, (weight / bins * other) / sum(weight / bins * other) OVER () AS weight FROM b")
def l34(spark, sf):
    m = members(spark, sf)
    return B.rederived(m.select("member", F.col("size").alias("weight"), "bins"), m.select("member", (F.col("bins") * 2 + 5).alias("bins")))


@query("l35_epoch_audit", f"WITH {SIZES} SELECT member, size / sum(size) OVER () * 10000 AS samples, size / sum(size) OVER () * 10000 / (bins * 0.9::DOUBLE) AS epoch FROM m")
def l35(spark, sf):
    return B.epochs(members(spark, sf).select("member", F.col("size").alias("weight"), "bins"), 10000, 0.9).select("member", "samples", "epoch")


@query("l36_progressive_mix", "WITH s AS (SELECT i AS sample, ('0x' || md5('9|' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u, CASE WHEN i <= 100 THEN 0.0 WHEN i >= 300 THEN 0.5 ELSE 0.5 * (i - 100) / 200 END AS a FROM (SELECT unnest(generate_series(0, 999)) AS i)) SELECT sample, CASE WHEN u < a THEN 1 WHEN u < a + 0.2 THEN 2 ELSE 0 END AS source FROM s")
def l36(spark, sf):
    return B.mixed(1000, spark, 9, [(100, 300, 0.0, 0.5), (-2, -1, 0.0, 0.2)])


@query("l37_schedule_validation", "SELECT max(CASE WHEN i <= 100 THEN 0.0 WHEN i >= 300 THEN 0.5 ELSE 0.5 * (i - 100) / 200 END + 0.2)::DOUBLE <= 1 AS ok FROM (SELECT unnest(generate_series(0, 1000, 5)) AS i)")
def l37(spark, sf):
    from quernstone.functions.text import ramp

    return spark.range(0, 1001, 5).agg((F.max(ramp(F.col("id"), 100, 300, 0.0, 0.5) + 0.2) <= 1).alias("ok"))


@query("l38_rank_sharding", "SELECT i, r, 4 * i + r AS parity, 4 * 8 * (i // 8) + r * 8 + i % 8 AS cyclic FROM (SELECT unnest(generate_series(0, 63)) AS i), (SELECT unnest(generate_series(0, 3)) AS r)")
def l38(spark, sf):
    rows = spark.range(64).select(F.col("id").alias("i"), F.explode(F.expr("sequence(0L, 3L)")).alias("r"))
    return rows.select("i", "r", B.parity_shard(F.col("i"), 4, F.col("r")).alias("parity"), B.block_shard(F.col("i"), 8, 4, F.col("r")).alias("cyclic"))


@query("l41_prefix_extraction", "SELECT conv_id, row_number() OVER w AS cut, md5(string_agg(role || ': ' || text, chr(10)) OVER w) AS digest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def l41(spark, sf):
    c = convs(spark, sf).select("conv_id", F.explode(F.expr("sequence(1, size(messages))")).alias("cut"), "messages")
    prefix = F.array_join(F.transform(F.slice("messages", F.lit(1), F.col("cut")), lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return c.select("conv_id", F.col("cut").cast("long").alias("cut"), F.md5(prefix).alias("digest"))


@query("l42_frame_sampling", "SELECT doc_id, f AS frame, unicode(substr(text, f + 1, 1)) AS seen FROM (SELECT doc_id, text, unnest(generate_series(0, n_chars - 1, 60)) AS f FROM documents WHERE n_chars > 0)")
def l42(spark, sf):
    """Every sixtieth character stands for a sampled frame."""
    frames = docs(spark, sf).filter("n_chars > 0").select("doc_id", F.explode(F.transform(F.expr("sequence(0L, n_chars - 1, 60L)"), lambda f: F.struct(f.alias("frame"), F.substr("text", (f + 1).cast("int"), F.lit(1)).alias("c")))).alias("f"))
    return frames.select("doc_id", "f.frame", F.conv(F.hex(F.encode("f.c", "UTF-32")), 16, 10).cast("int").alias("seen"))


@query("l44_record_assembly", "SELECT doc_id, CAST(('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 1))::BIGINT % 4 AS BIGINT) AS variant, CASE WHEN n_chars > 1000 THEN 3 ELSE 2 END AS n, md5(CASE WHEN n_chars > 1000 THEN 'system=long;' ELSE '' END || 'user=' || doc_id || ';assistant=' || text) AS digest FROM documents")
def l44(spark, sf):
    d = F.col("doc_id").cast("string")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    m = F.array_compact(F.array(F.when(F.col("n_chars") > 1000, turn("system", F.lit("long"))), turn("user", d), turn("assistant", F.col("text"))))
    rows = docs(spark, sf).select("doc_id", (F.conv(F.right(F.sha2(d, 256), F.lit(1)), 16, 10).cast("long") % 4).alias("variant"), m.alias("m"))
    return rows.select("doc_id", "variant", F.size("m").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("="), x["text"])), ";")).alias("digest"))


@query("l45_deferred_verdict", "WITH p AS (SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'user'), '') AS a, coalesce(min_by(text, turn) FILTER (role = 'assistant'), '') AS b FROM conversations GROUP BY conv_id) SELECT conv_id, md5(CASE WHEN length(b) > length(a) THEN b ELSE a END) AS winner, md5(CASE WHEN length(b) > length(a) THEN a ELSE b END) AS loser, CASE WHEN length(b) > length(a) THEN 'B' ELSE 'A' END AS verdict FROM p")
def l45(spark, sf):
    """Pairs kept in the order of generation; a later verdict of B (here: the longer answer) swaps winner and loser."""
    first = lambda role: F.coalesce(F.get(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["text"]), F.lit(0)), F.lit(""))
    p = convs(spark, sf).select("conv_id", first("user").alias("a"), first("assistant").alias("b"))
    p = p.withColumn("verdict", F.when(F.length("b") > F.length("a"), "B").otherwise("A"))
    winner, loser = F.when(F.col("verdict") == "B", F.col("b")).otherwise(F.col("a")), F.when(F.col("verdict") == "B", F.col("a")).otherwise(F.col("b"))
    return p.select("conv_id", F.md5(winner).alias("winner"), F.md5(loser).alias("loser"), "verdict")


@query("f36_token_range", "SELECT doc_id, len(list_filter(list_transform(string_split(text, ' '), lambda w: length(w) - 1), lambda t: t < 0 OR t >= 12)) AS bad FROM documents")
def f36(spark, sf):
    """Ids outside a vocabulary of twelve; a word's length less one stands for its id."""
    return docs(spark, sf).select("doc_id", T.out_of_range(F.transform(F.split("text", " "), lambda w: F.length(w) - 1), 12).cast("long").alias("bad"))
