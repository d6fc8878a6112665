"""Chat formatting with linked tool calls."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
PARSED = "conv_id long, turn long, role string, call_id string, calls array<struct<id:string,valid:boolean>>, json string"
LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 can't hold, as JSON escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def number_of(digits: str) -> int | float:
    """A JSON number with a fraction or exponent: an integer where it is one that a double holds exactly. None may be infinite."""
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError(digits)
    return int(value) if value.is_integer() and abs(value) < 2**53 else value


def refused(name: str):
    raise ValueError(name)


def loads(text: str):
    """JSON's value; ValueError for NaN and infinities, and where nesting is too deep to be read."""
    try:
        return json.loads(text, parse_float=number_of, parse_constant=refused)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def plain_number(value: float) -> str:
    """As ECMAScript writes it: the fewest digits, an exponent from 1e21 on and under 1e-6."""
    digits, _, exponent = f"{value!r}".partition("e")
    whole, _, fraction = digits.lstrip("-").partition(".")
    fraction = "" if fraction == "0" else fraction
    point, figures = len(whole) + int(exponent or 0), whole + fraction
    stripped = figures.lstrip("0")
    point, figures = point - (len(figures) - len(stripped)), stripped.rstrip("0")
    sign, n = "-" if value < 0 else "", len(figures)
    if not figures:
        return "0"
    if -6 < point <= 21:
        body = figures + "0" * (point - n) if point >= n else figures[:point] + "." + figures[point:] if point > 0 else "0." + "0" * -point + figures
    else:
        body = figures[0] + ("." + figures[1:] if n > 1 else "") + f"e{point - 1:+d}"
    return sign + body


def canonical(value) -> str:
    """JSON with keys sorted by UTF-16 units, no blanks, letters as they are (lone surrogates escaped), and one form of
    each number: 1.0 is 1, 1e2 is 100; integers keep all their digits."""
    if isinstance(value, str):
        return escaped(json.dumps(value, ensure_ascii=False))
    if isinstance(value, float):
        return plain_number(value)
    if isinstance(value, Mapping):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value)


def fits(value, schema: Mapping) -> bool:
    """Whether value satisfies the schema: type, enum, required, properties, additionalProperties, items, minimum and
    maximum. No value has an unknown type; members of an enum are compared in their canonical form."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(isinstance(value, KINDS.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
            return False
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list):
        return all(fits(v, schema.get("items", {})) for v in value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value >= schema.get("minimum", value) and value <= schema.get("maximum", value)
    return True


def as_object(text: str) -> dict:
    if text.lstrip()[:1] != "{":
        return {}
    try:
        found = loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def identifier(value) -> str | None:
    """Of a call or result: a string, or another value in its canonical form."""
    return None if value is None else escaped(value) if isinstance(value, str) else canonical(value)


def parsed_call(call, schemas: Mapping) -> tuple[dict, bool]:
    """A call {id, name, arguments} from either usual layout, and whether its arguments satisfy the tool's schema."""
    call = call if isinstance(call, dict) else {}
    function = call.get("function") if isinstance(call.get("function"), dict) else call
    name, arguments = function.get("name"), function.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = loads(arguments)
        except ValueError:
            pass
    ok = isinstance(name, str) and name in schemas and isinstance(arguments, dict) and fits(arguments, schemas[name])
    ident = identifier(call.get("id"))
    return {"id": ident, "name": name, "arguments": arguments}, ok and ident is not None


def message(role: str | None, text: str | None, schemas: Mapping) -> tuple[str | None, list[dict], str]:
    """(identifier that a result answers, calls with id and valid, canonical JSON) of a message."""
    found = as_object(text or "")
    try:
        if role == "assistant" and isinstance(found.get("tool_calls"), list):
            got = [parsed_call(c, schemas) for c in found["tool_calls"]]
            out = {"role": role, "content": found.get("content"), "tool_calls": [c for c, _ in got]}
            return None, [{"id": c["id"], "valid": ok} for c, ok in got], canonical(out)
        if role == "tool" and found.get("tool_call_id") is not None:
            ident = identifier(found["tool_call_id"])
            return ident, [], canonical({"role": role, "content": found.get("content"), "tool_call_id": ident})
    except RecursionError:  # could be read, but not written
        pass
    return None, [], canonical({"role": role, "content": text})


def parsed(messages: DataFrame, schemas: Mapping) -> DataFrame:
    def parse(batches):
        for batch in batches:
            rows = [(conv_id, turn, role, *message(role, text, schemas)) for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("id", pa.string()), ("valid", pa.bool_())])), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "role", "call_id", "calls", "json"])

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(parse, PARSED)


def format_chat(messages: DataFrame, schemas: Mapping | None = None) -> DataFrame:
    """A row for each message: (conv_id, turn, at_turn, at_call, at_result, role, n_calls, n_valid, linked, json).

    Results find their calls by a hash join on conversation and identifier; other messages take no part in it. Ordered
    by conv_id, at_turn, at_call, at_result, every message is in its turn's place and every result right after the
    message with its call, also where it was stored before it: a topological order that needs no conversation in one
    task. json is canonical. n_valid counts calls with an identifier whose arguments satisfy their tool's schema. linked
    is null but for tool messages.

    Where several calls of a conversation share an identifier, the first has the results; several results of one call
    stay in turn order. Results without a call stay in their turn's place, not linked. Null or empty texts, text that
    isn't JSON (NaN and numbers beyond doubles are none) or is nested too deep to be read, and unknown roles are plain
    messages; null ids link with nothing; repeated rows stay; very long texts are kept whole; an empty table gives no
    rows; other columns aren't read.
    """
    # Only what looks like a JSON object can hold calls or an identifier.
    like = F.coalesce(F.rlike(F.col("text").cast("string"), F.lit(r"^[ \t\n\r]*\{")), F.lit(False))
    of = lambda role: F.coalesce(F.col("role") == role, F.lit(False)) & like
    read = lambda ok: parsed(messages.where(ok), schemas or {})
    calls = read(of("assistant")).where("size(calls) > 0").select("conv_id", "turn", F.posexplode("calls").alias("call", "own"))
    first = calls.where("own.id is not null").groupBy("conv_id", F.col("own.id").alias("call_id")).agg(F.min(F.struct("turn", "call")).alias("first"))
    results = read(of("tool"))
    linked = results.where("call_id is not null").join(first, ["conv_id", "call_id"], "left")
    rest = read(~of("tool")).unionByName(results.where("call_id is null")).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    count = lambda c: F.size(c).cast("long")
    return linked.unionByName(rest).select(
        "conv_id",
        "turn",
        F.coalesce("first.turn", "turn").alias("at_turn"),
        F.coalesce(F.col("first.call") + 1, F.lit(0)).cast("long").alias("at_call"),
        F.when(F.col("first").isNotNull(), F.col("turn")).otherwise(0).cast("long").alias("at_result"),
        "role",
        count("calls").alias("n_calls"),
        count(F.filter("calls", lambda c: c.valid)).alias("n_valid"),
        F.when(F.col("role") == "tool", F.col("first").isNotNull()).alias("linked"),
        "json",
    )


def in_order(formatted: DataFrame) -> DataFrame:
    """Formatted messages as sorted JSON lines, a range of conversations and places to a partition; a conversation may
    go on in the next one."""
    place = ["conv_id", "at_turn", "at_call", "at_result"]
    return formatted.repartitionByRange(*place).sortWithinPartitions(*place, "json")


#: The registered query's tool: it measures a text of at most 200 letters.
SCHEMAS = {
    "measure": {
        "type": "object",
        "required": ["letters", "turn"],
        "properties": {"letters": {"type": "integer", "maximum": 200}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}


def with_tools(conversations: DataFrame) -> DataFrame:
    """conversations, and tool messages made from them, as the tables have none: each answer of the assistant is
    preceded by a call that measures it (its arguments in a string, keys out of order), and by that call's result, which is stored a turn
    too early. Each user's message has a result that no call asked for."""
    at = F.concat(F.lit("c"), F.col("turn").cast("string"))
    answers, asked = conversations.where("role = 'assistant'"), conversations.where("role = 'user'")
    arguments = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "letters": '), F.length("text").cast("string"), F.lit(".0}"))
    call = F.struct(at.alias("id"), F.struct(F.lit("measure").alias("name"), arguments.alias("arguments")).alias("function"))
    calls = answers.where("text is not null").select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    reply = lambda ident: F.to_json(F.struct(ident.alias("tool_call_id"), F.coalesce(F.substring("text", 1, 20), F.lit("")).alias("content")))
    results = answers.where("text is not null").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("tool").alias("role"), reply(at).alias("text"))
    stray = asked.select("conv_id", "turn", F.lit("tool").alias("role"), reply(F.concat(F.lit("u"), F.col("turn").cast("string"))).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text")
    for more in (calls, results, stray):
        rows = rows.unionByName(more)
    return rows


#: format_chat(with_tools(conversations), SCHEMAS) in DuckDB's SQL, for tables whose messages hold no tool calls of
#: their own and whose conversations have a turn once.
TOOLS_SQL = """
with plain as (select conv_id, turn, turn as at_turn, 0 as at_call, 0 as at_result, role, 0 as n_calls, 0 as n_valid, case when role = 'tool' then false end as linked,
    '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' as json from conversations),
calls as (select conv_id, turn, turn, 0, 0, 'assistant', 1, case when length(text) <= 200 and turn >= 0 then 1 else 0 end, null::boolean,
    '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"letters":' || length(text) || ',"turn":' || turn || '},"id":"c' || turn || '","name":"measure"}]}'
    from conversations where role = 'assistant' and text is not null),
results as (select conv_id, turn - 1, turn, 1, turn - 1, 'tool', 0, 0, true,
    '{"content":' || to_json(substr(text, 1, 20))::varchar || ',"role":"tool","tool_call_id":"c' || turn || '"}' from conversations where role = 'assistant' and text is not null),
stray as (select conv_id, turn, turn, 0, 0, 'tool', 0, 0, false,
    '{"content":' || to_json(substr(coalesce(text, ''), 1, 20))::varchar || ',"role":"tool","tool_call_id":"u' || turn || '"}' from conversations where role = 'user'),
every as (select * from plain union all select * from calls union all select * from results union all select * from stray)
select conv_id, turn, at_turn, at_call::bigint as at_call, at_result::bigint as at_result, role, n_calls::bigint as n_calls, n_valid::bigint as n_valid, linked, json from every"""
