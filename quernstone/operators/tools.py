"""Tool declarations of chat rows, as JSON text read through variants: one dialect, injection into rows that call undeclared tools, mining of families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions.text import let

#: JSON Schema names of the types that other dialects write.
TYPES = {
    "dict": "object", "str": "string", "string": "string", "int": "integer", "integer": "integer", "float": "number", "number": "number",
    "bool": "boolean", "boolean": "boolean", "list": "array", "array": "array", "tuple": "array", "object": "object",
}
EMPTY = '{"type":"object","properties":{}}'


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _object(v: Column, path: str) -> Column:
    """The object at a path as a variant, or null."""
    return let(_get(v, path, "variant"), lambda found: F.when(F.schema_of_variant(found).startswith("OBJECT"), found))


def normal_tool(json: Column) -> Column:
    """struct(name, description, parameters (JSON)) of a declaration in any of three dialects: {function: {name, parameters}} or bare, {id, inputSchema:
    {jsonSchema}}, {name, input_schema}. Null where no name is found or it is no object. The text is parsed once."""
    return let(F.try_parse_json(json), _normal)


def _normal(v: Column) -> Column:
    each = lambda *paths: F.coalesce(*[F.nullif(_get(v, p), F.lit("")) for p in paths])
    name = each("$.function.name", "$.function.id", "$.name", "$.id")
    places = [f"{at}.{k}{inner}" for at in ("$.function", "$") for k in ("inputSchema", "input_schema", "parameters_schema") for inner in (".jsonSchema", "")]
    parameters = F.coalesce(*[F.to_json(_object(v, p)) for p in ("$.function.parameters", "$.parameters", *places)], F.lit(EMPTY))
    described = F.coalesce(_get(v, "$.function.description"), _get(v, "$.description"))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), described.alias("description"), parameters.alias("parameters")))


def normal_type(text: Column) -> Column:
    """struct(type, items) in JSON Schema names: 'str, optional' is string, 'List[int]' an array of integers; null for unknown ones."""
    head = F.trim(F.regexp_extract(text, r"^([^,]*)", 1))
    inner = F.regexp_extract(head, r"^(?:List|list|Tuple|tuple)\[(.+)\]$", 1)
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    known = lambda c: F.coalesce(F.try_element_at(names, c), F.try_element_at(names, F.lower(c)))
    nested = F.when(inner.rlike(r"^(?:List|list|Tuple|tuple)\["), "array").otherwise(known(F.trim(F.regexp_extract(inner, r"^([^,]*)", 1))))
    return F.when(inner != "", F.struct(F.lit("array").alias("type"), nested.alias("items"))).otherwise(F.struct(known(head).alias("type"), F.lit(None).cast("string").alias("items")))


def families(calls: DataFrame, most_tools: int = 10, top_share: float = 0.2) -> DataFrame:
    """family, rows, tools (array), declare of each family: calls has row, family and tool, a row for each call.

    declare is 'union' where a family has `most_tools` tools at most and its commonest set of tools is in `top_share` of its rows or more (each session declares
    the same set), else 'called'."""
    rows = calls.groupBy("family", "row").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("set"))
    sets = rows.groupBy("family", "set").agg(F.count("*").alias("n")).groupBy("family").agg(F.max("n").alias("top"), F.sum("n").alias("rows"))
    tools = calls.groupBy("family").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    union = (F.size("tools") <= most_tools) & (F.col("top") >= top_share * F.col("rows"))
    return sets.join(tools, "family").select("family", "rows", "tools", F.when(union, "union").otherwise("called").alias("declare"))


def injected(calls: DataFrame, sidecar: DataFrame, by_name: DataFrame) -> DataFrame:
    """row, tool, origin ('family_union', 'family_called', 'by_name', 'synthesised'), parameters: the declarations of each row's tools.

    calls: row, family, tool, argument, kind (a row for each argument of a call). sidecar: family, declare, tool, parameters. by_name: tool, parameters.
    A family that declares its union gives all its tools; one that declares what is called gives those; other called tools come from by_name, or get a
    schema of the arguments seen."""
    called = calls.groupBy("row", "family", "tool").agg(F.sort_array(F.collect_set(F.struct("argument", "kind"))).alias("arguments"))
    union = called.select("row", "family").distinct().join(sidecar.filter("declare = 'union'"), "family").select("row", "tool", F.lit("family_union").alias("origin"), "parameters")
    rest = called.join(union.select("row", "tool"), ["row", "tool"], "left_anti")
    own = sidecar.filter("declare = 'called'").select("family", "tool", F.col("parameters").alias("own"))
    rest = rest.join(own, ["family", "tool"], "left").join(by_name.withColumnRenamed("parameters", "named"), "tool", "left")
    properties = F.array_join(F.transform("arguments", lambda a: F.concat(F.lit('"'), a["argument"], F.lit('":{"type":"'), a["kind"], F.lit('"}'))), ",")
    required = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("arguments", lambda a: a["argument"]))), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), ",")
    made = F.concat(F.lit('{"type":"object","properties":{'), properties, F.lit('},"required":['), required, F.lit("]}"))
    origin = F.when(F.col("own").isNotNull(), "family_called").when(F.col("named").isNotNull(), "by_name").otherwise("synthesised")
    return union.unionByName(rest.select("row", "tool", origin.alias("origin"), F.coalesce("own", "named", made).alias("parameters")))
