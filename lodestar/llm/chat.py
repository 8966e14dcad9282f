"""Chat formatting: tool calls are linked with their results and every message is serialised, all in native functions.

A turn's text may be JSON: `{"tool_calls": [{"id", "name", "arguments"}, ..]}` of an assistant, `{"tool_call_id",
"content"}` of a tool. Calls and results are joined by conversation and identifier. A result never stands before its call:
its place is the later of its own turn and its call's, after all calls of that turn. Content beside calls is a message of its own before
them, at step -1. Arguments must have every required field of the tool's schema with a value of its JSON type. One row per
message, so that no conversation meets in one task; `place` and `step` order them.

Arguments may be an object or a string that holds one. Values keep their JSON types; of a repeated key the last value counts.
What is no such object, or repeats a key within a nested one, is written as a string of its text and fits no schema. Numbers
with a fraction are read as doubles.

Anything else is plain text. Null texts have null content; null conversations are kept and never linked; an identifier used
by several calls links to the first. Repeated turns give repeated messages; other columns are ignored; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import let

# Required arguments of each known tool, by JSON type.
SCHEMAS = {"search": {"query": "string"}, "calculator": {"expression": "string"}, "weather": {"city": "string", "days": "number"}}
# What schema_of_variant says of a value of each JSON type.
_SHAPES = {"string": "^STRING$", "number": "^(BIGINT|DECIMAL|FLOAT|DOUBLE)", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}
# A string field takes the text of an object as it stands, so `arguments` is JSON text whether it came as a string or not.
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"


def typed_arguments(calls: DataFrame) -> DataFrame:
    """Adds `typed`: the JSON text in `arguments` as map<string,variant>, sorted by key, without repeated keys; null for no object."""
    df = let(calls, _read=F.from_json("arguments", "map<string,variant>"))
    df = let(df, _places=F.array_sort(F.transform(F.map_keys("_read"), lambda k, i: F.struct(k.alias("k"), i.alias("i")))), _values=F.map_values("_read"))
    last = F.filter("_places", lambda p, i: F.coalesce(F.get("_places", i + 1)["k"] != p["k"], F.lit(True)))
    return df.withColumn("typed", F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.get("_values", p["i"]))))).drop("_read", "_places", "_values")


def valid_arguments(name, arguments, schemas=SCHEMAS):
    """Null for a tool without a schema."""
    out = F.lit(None).cast("boolean")
    for tool, fields in schemas.items():
        fits = F.lit(True)
        for field, kind in fields.items():
            value = F.try_element_at(arguments, F.lit(field))
            fits = fits & value.isNotNull() & F.schema_of_variant(value).rlike(_SHAPES[kind])
        out = F.when(name == tool, F.coalesce(fits, F.lit(False))).otherwise(out)
    return out


def format_chat(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, place, step, role, call_id, linked, valid, message (canonical JSON: fixed key order, sorted arguments)."""
    df = turns.select("conv_id", "turn", "role", "text")
    shaped = F.col("text").rlike(r"^\s*\{")
    df = df.withColumn("j", F.when(shaped, F.from_json("text", _CALLS)))
    is_calls = F.coalesce((F.col("role") == "assistant") & (F.size("j.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), F.lit(False))
    calls = df.where(is_calls).select("conv_id", "turn", "role", F.size("j.tool_calls").alias("n_calls"), F.posexplode("j.tool_calls").alias("i", "c"))
    calls = calls.select("conv_id", "turn", "role", "n_calls", "i", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "i", "n_calls")).alias("at")).select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"), F.col("at.turn").alias("k_turn"), (F.col("at.i") + F.col("at.n_calls")).alias("k_step"))
    results = df.where(is_result).select("conv_id", "turn", "role", F.col("j.tool_call_id").alias("call_id"), "j.content")
    results = results.join(first, (F.col("conv_id") == F.col("k_conv")) & (F.col("call_id") == F.col("k_id")), "left")
    answered = df.where(is_result).select(F.col("conv_id").alias("r_conv"), F.col("j.tool_call_id").alias("r_id")).distinct()
    calls = calls.join(answered, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left")
    calls = typed_arguments(calls).withColumn("valid", valid_arguments(F.col("name"), F.col("typed"), schemas))
    keep = {"ignoreNullFields": "false"}
    none = F.lit(None)
    plain = df.where(~is_calls & ~is_result).select("conv_id", "turn", F.col("turn").alias("place"), F.lit(0).alias("step"), "role", none.cast("string").alias("call_id"), none.cast("boolean").alias("linked"), none.cast("boolean").alias("valid"), F.to_json(F.struct("role", F.col("text").alias("content")), keep).alias("message"))
    beside = df.where(is_calls & F.col("j.content").isNotNull()).select("conv_id", "turn", F.col("turn").alias("place"), F.lit(-1).alias("step"), "role", none.cast("string").alias("call_id"), none.cast("boolean").alias("linked"), none.cast("boolean").alias("valid"), F.to_json(F.struct("role", F.col("j.content").alias("content")), keep).alias("message"))
    written = lambda arguments: F.to_json(F.struct("role", F.col("call_id").alias("id"), "name", F.col(arguments).alias("arguments")), keep)
    called = calls.select("conv_id", "turn", F.col("turn").alias("place"), F.col("i").alias("step"), "role", "call_id", F.col("r_id").isNotNull().alias("linked"), "valid", F.when(F.col("typed").isNotNull(), written("typed")).otherwise(written("arguments")).alias("message"))
    place = F.greatest("turn", "k_turn")
    returned = results.select("conv_id", "turn", place.alias("place"), F.when(F.col("k_turn") >= F.col("turn"), F.col("k_step")).otherwise(0).alias("step"), "role", "call_id", F.col("k_id").isNotNull().alias("linked"), none.cast("boolean").alias("valid"), F.to_json(F.struct("role", F.col("call_id").alias("tool_call_id"), "content"), keep).alias("message"))
    return plain.unionByName(beside).unionByName(called).unionByName(returned)
