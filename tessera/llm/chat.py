"""Chat formatting with tool-call linking, as canonical JSON. DataFrame functions only.

An assistant message that calls tools has a JSON object as its text:
{"content": ..., "tool_calls": [{"id", "name", "arguments", "depends_on"}]},
where a call may also be {"id", "function": {"name", "arguments"}} and arguments
may be an object or its JSON text; a tool's message has {"tool_call_id",
"content"}. Every other text is content as it stands. Calls and results are
hash-joined by conversation and call id; a result comes after its call, and a
call after the results it depends on, whatever their turns say; arguments are
validated against the tools' schemas; objects are written with sorted keys and
without spaces, other fields of messages and calls included.

Only conversations in which a message stands before one it waits for need to be
put in order. Each of them is one array of its linked messages, from which
Kahn's algorithm peels what waits for nothing more; those of over MOST_EDGES
edges are peeled the same way by joins, a job for each level.

Conversations are written in parts of PART turns, and parts in pieces of PIECE
messages, numbered over range partitions, so that no conversation, however long,
becomes one group or one value.

Defined results: equal rows of a conversation count once; a message without a
conversation id is a conversation of its own (conv_id null), as often as it
stands; null texts and roles are empty strings; messages without a turn form a
part of their own, numbered -1; messages of one turn are ordered by role and
text; of calls with one id the earliest is linked; a call without an id is
written with the error "missing id"; a text that is not such a JSON object, or
that repeats a key, is plain content; messages that wait for each other in a
circle (or for one in it) keep the order of their turns and are marked; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

PART = 512
PIECE = 512
#: Edges of a conversation that is put in order as one array.
MOST_EDGES = 4096
#: Tool name -> JSON schema of its arguments: type, enum, const, properties, required, additionalProperties, items, at any depth.
Schemas = dict[str, dict]
#: JSON schema type -> pattern of the variant types that satisfy it.
_TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID",
}
_LAST = (1 << 63) - 1


def _none() -> Column:
    return F.array().cast("array<string>")


def _fields(value: Column) -> Column:
    """A variant object as a map; null if it is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _says(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _errors(value: Column, schema: dict, path: str) -> Column:
    """Array of what is wrong with a variant, by its schema."""
    at = lambda key: f"{path}.{key}" if path else key
    named = path or "arguments"
    found = []
    if "enum" in schema or "const" in schema:
        allowed = [_says(x) for x in schema.get("enum", [schema.get("const")])]
        found.append(F.when(F.coalesce(F.to_json(value).isin(allowed), F.lit(False)), _none()).otherwise(F.array(F.lit(f"value of {named}"))))
    properties, fields = schema.get("properties", {}), F.coalesce(_fields(value), F.create_map().cast("map<string,variant>"))
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    keys = F.map_keys(fields)
    inside = [F.when(~F.array_contains(keys, key), F.array(F.lit(f"missing {at(key)}"))).otherwise(_none()) for key in sorted(schema.get("required", []))]
    inside += [F.when(F.array_contains(keys, key), _errors(F.try_element_at(fields, F.lit(key)), rule, at(key))).otherwise(_none()) for key, rule in sorted(properties.items())]
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(keys, F.array(*(F.lit(k) for k in sorted(properties))).cast("array<string>")))
        inside.append(F.transform(extra, lambda k: F.concat(F.lit(f"unexpected {at('')}"), k)))
    if inside:
        found.append(F.when(F.coalesce(is_object, F.lit(False)), F.concat(*inside)).otherwise(_none()))
    if "items" in schema:
        members = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.array_distinct(F.flatten(F.transform(F.coalesce(members, F.array().cast("array<variant>")), lambda x: _errors(x, schema["items"], f"{path}[]")))))
    deeper = F.concat(*found) if found else _none()
    if "type" not in schema:
        return deeper
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    pattern = "^(" + "|".join(_TYPES[kind] for kind in kinds) + ")$"
    return F.when(F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False)), deeper).otherwise(F.array(F.lit(f"type of {named}")))


def _argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with a call's arguments (JSON text)."""
    parsed = F.try_parse_json(arguments)
    errors = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        errors = F.when(name == tool, _errors(parsed, schema, "")).otherwise(errors)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, errors).otherwise(F.array(F.lit("arguments are not an object")))


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no spaces; null where it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _quoted(value: Column) -> Column:
    """A string as JSON."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def _rest(value: Column, known: tuple[str, ...]) -> Column:
    """The other fields of a variant object as (key, JSON text)."""
    fields = F.coalesce(_fields(value), F.create_map().cast("map<string,variant>"))
    keys = F.array_except(F.map_keys(fields), F.array(*(F.lit(k) for k in known)))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.to_json(F.try_element_at(fields, k)), F.lit("null")).alias("text")))


def _object(rest: Column, **own: Column) -> Column:
    """A JSON object of the given fields (JSON texts; null ones are left out) and the rest, keys sorted."""
    given = F.array(*(F.struct(F.lit(key).alias("key"), text.alias("text")) for key, text in own.items()))
    fields = F.array_sort(F.concat(F.filter(given, lambda x: x["text"].isNotNull()), rest))
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["text"])), ","), F.lit("}"))


def _call(v: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    given = F.coalesce(get("$.arguments", "variant"), get("$.function.arguments", "variant"))
    as_text = F.when(F.schema_of_variant(given) == "STRING", F.to_json(_object_or_null(F.coalesce(get("$.arguments", "string"), get("$.function.arguments", "string")))))
    return F.struct(
        get("$.id", "string").alias("id"),
        F.coalesce(get("$.name", "string"), get("$.function.name", "string")).alias("name"),
        F.coalesce(as_text, F.to_json(given), F.lit("null")).alias("arguments"),
        F.coalesce(get("$.depends_on", "array<string>"), _none()).alias("depends_on"),
        _rest(v, ("id", "name", "arguments", "depends_on", "function", "errors", "linked")).alias("rest"),
    )


def _object_or_null(text: Column) -> Column:
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with conversation key c, message id m, times, content, tool_calls, tool_call_id and the rest of their fields."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    rows = rows.withColumn("m", F.xxhash64("turn", "role", "text")).withColumn("times", F.when(F.col("conv_id").isNull(), F.col("times")).otherwise(1))
    rows = rows.withColumn("c", F.when(F.col("conv_id").isNull(), F.concat(F.lit("m"), F.col("m").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"))))
    special = F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{")
    rows = rows.withColumn("v", F.when(special, F.try_parse_json("text")))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    calls = F.transform(F.when(F.col("role") == "assistant", get("$.tool_calls", "array<variant>")), _call)
    call_id = F.when(F.col("role") == "tool", get("$.tool_call_id", "string"))
    parsed = rows.withColumns({"tool_calls": calls, "tool_call_id": call_id})
    structured = F.coalesce(F.size("tool_calls") > 0, F.lit(False)) | F.col("tool_call_id").isNotNull()
    rest = F.when(structured, _rest(F.col("v"), ("content", "role", "tool_calls", "tool_call_id", "circular", "linked")))
    # content that is not a string stays as JSON
    content = F.coalesce(F.when(F.schema_of_variant(get("$.content", "variant")) == "STRING", get("$.content", "string")), F.to_json(get("$.content", "variant")), F.lit(""))
    return parsed.withColumns({"structured": structured, "rest": rest, "content": F.when(structured, content).otherwise(F.col("text"))}).drop("v", "text")


def _turn() -> Column:
    return F.coalesce("turn", F.lit(_LAST))


def linked_ids(tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, id, caller, answer): the earliest call and result of each linked id; (c, before, after): who waits for whom)."""
    calls = cut(tools.select("c", "m", _turn().alias("turn"), F.explode("tool_calls").alias("call")).select("c", "m", "turn", F.col("call.id").alias("id"), F.col("call.depends_on").alias("depends_on")))
    results = tools.where(F.col("tool_call_id").isNotNull()).select("c", "m", _turn().alias("turn"), F.col("tool_call_id").alias("id"))
    first = lambda df, name: df.where(F.col("id").isNotNull()).groupBy("c", "id").agg(F.min_by("m", F.struct("turn", "m")).alias(name))
    first_call = first(calls, "caller")
    linked = cut(first_call.join(first(results, "answer").hint("shuffle_hash"), ["c", "id"]))
    answers = results.join(first_call, ["c", "id"]).select("c", F.col("caller").alias("before"), F.col("m").alias("after"))
    needs = calls.select("c", F.col("m").alias("after"), F.explode("depends_on").alias("id")).join(linked, ["c", "id"]).select("c", F.col("answer").alias("before"), "after")
    return linked, cut(answers.unionByName(needs).where("before <> after").distinct())


def _place(pos: Column, depth: Column) -> Column:
    return F.struct(pos.cast("bigint").alias("pos"), depth.cast("int").alias("depth"))


def _peeled(nodes: Column) -> Column:
    """Places of an array of (m, turn, waits: numbers of the nodes waited for), null where a circle holds them up."""
    empty = F.lit(None).cast("struct<pos:bigint,depth:int>")

    def step(acc: Column, _: Column) -> Column:
        def settled(v: Column, i: Column) -> Column:
            before = F.transform(v["waits"], lambda p: F.get(acc["places"], p))
            bumped = F.array_max(F.transform(before, lambda x: _place(x["pos"], x["depth"] + 1)))
            now = F.when(F.forall(before, lambda x: x.isNotNull()), F.greatest(_place(v["turn"], F.lit(0)), bumped))
            return F.coalesce(F.get(acc["places"], i), now)

        places = F.transform(nodes, settled)
        left = lambda x: F.size(F.filter(x, lambda p: p.isNull()))
        fresh = F.get(F.transform(F.array(places), lambda p: F.struct(p.alias("places"), left(p).alias("left"), (left(p) == acc["left"]).alias("done"))), F.lit(0))
        return F.when(acc["done"], acc).otherwise(fresh)

    start = F.struct(F.transform(nodes, lambda v: F.when(F.size(v["waits"]) == 0, _place(v["turn"], F.lit(0))).otherwise(empty)).alias("places"), F.lit(-1).alias("left"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.size(nodes)), start, step, lambda acc: acc["places"])


def _placed(tools: DataFrame, edges: DataFrame, most_edges: int) -> DataFrame:
    """(c, m, place, circular) of the messages of conversations in which one stands before another that it waits for."""
    turns = tools.select("c", "m", _turn().alias("turn"))
    ends = edges.join(turns.withColumnsRenamed({"m": "before", "turn": "before_turn"}), ["c", "before"]).join(turns.withColumnsRenamed({"m": "after", "turn": "after_turn"}), ["c", "after"])
    tangled = cut(ends.groupBy("c").agg(F.count("*").alias("n"), F.max(F.col("before_turn") >= F.col("after_turn")).alias("late")).where("late").select("c", "n"))
    small, large = tangled.where(F.col("n") <= most_edges).select("c"), tangled.where(F.col("n") > most_edges).select("c")
    own = edges.join(small, "c", "left_semi")
    touched = own.select("c", F.col("before").alias("m")).unionByName(own.select("c", F.col("after").alias("m"))).distinct().join(turns, ["c", "m"])
    numbered = cut(touched.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("turn", "m")) - 1))
    number = lambda name: numbered.select("c", F.col("m").alias(name), F.col("i").alias(f"{name}_i"))
    waits = own.join(number("before"), ["c", "before"]).join(number("after"), ["c", "after"]).groupBy("c", F.col("after_i").alias("i")).agg(F.collect_list("before_i").alias("waits"))
    nodes = numbered.join(waits, ["c", "i"], "left").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "m", "turn", F.coalesce("waits", F.array().cast("array<int>")).alias("waits")))).alias("nodes"))
    peeled = nodes.select("c", F.explode(F.arrays_zip("nodes", _peeled(F.col("nodes")).alias("place"))).alias("x"))
    peeled = peeled.select("c", "x.nodes.m", F.coalesce("x.place", _place(F.col("x.nodes.turn"), F.lit(0))).alias("place"), F.col("x.place").isNull().alias("circular"))
    if large.isEmpty():
        return peeled
    return peeled.unionByName(_placed_by_joins(turns, cut(edges.join(large, "c", "left_semi"))))


def _placed_by_joins(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by joins: each level carries the places of what it settled to what waits for that, and nothing else."""
    touched = edges.select("c", F.col("before").alias("m")).unionByName(edges.select("c", F.col("after").alias("m"))).distinct()
    waits = edges.groupBy("c", F.col("after").alias("m")).agg(F.count("*").alias("waits"))
    nodes = touched.join(turns, ["c", "m"]).join(waits, ["c", "m"], "left")
    pending = cut(nodes.select("c", "m", _place(F.col("turn"), F.lit(0)).alias("own"), _place(F.col("turn"), F.lit(0)).alias("place"), F.coalesce("waits", F.lit(0)).cast("bigint").alias("waits")))
    settled = []
    while True:
        ready = cut(pending.where("waits = 0").select("c", "m", "place"))
        if ready.isEmpty():
            break
        settled.append(ready)
        news = edges.join(ready.withColumnRenamed("m", "before"), ["c", "before"]).groupBy("c", F.col("after").alias("m"))
        news = news.agg(F.count("*").alias("done"), F.max(_place(F.col("place.pos"), F.col("place.depth") + 1)).alias("least"))
        pending = pending.where("waits > 0").join(news, ["c", "m"], "left")
        pending = cut(pending.select("c", "m", "own", F.greatest("place", "least").alias("place"), (F.col("waits") - F.coalesce("done", F.lit(0))).alias("waits")))
    circular = pending.select("c", "m", F.col("own").alias("place"), F.lit(True).alias("circular"))
    for ready in settled:
        circular = circular.unionByName(ready.withColumn("circular", F.lit(False)))
    return circular


def _tool_lines(tools: DataFrame, schemas: Schemas, most_edges: int) -> DataFrame:
    """conv_id, c, times, turn, role, place, line and counts of the messages that call tools or answer."""
    linked, edges = linked_ids(tools)
    calls = tools.select("c", "m", F.posexplode("tool_calls").alias("k", "call")).withColumn("id", F.col("call.id")).join(linked.select("c", "id", "caller"), ["c", "id"], "left")
    calls = calls.withColumns({"linked": F.coalesce(F.col("caller") == F.col("m"), F.lit(False)), "unnamed": F.when(F.col("id").isNull(), F.array(F.lit("missing id"))).otherwise(_none())})
    calls = calls.withColumn("errors", F.concat("unnamed", _argument_errors(F.col("call.name"), F.col("call.arguments"), schemas)))
    text = _object(
        F.col("call.rest"), arguments=F.coalesce(canonical(F.col("call.arguments")), F.lit("null")), depends_on=F.when(F.size("call.depends_on") > 0, F.to_json("call.depends_on")),
        errors=F.to_json("errors"), id=F.coalesce(_quoted(F.col("id")), F.lit("null")), linked=F.col("linked").cast("string"), name=_quoted(F.coalesce("call.name", F.lit(""))),
    )
    calls = calls.select("c", "m", "k", text.alias("text"), "linked", (F.size("errors") > 0).alias("invalid"))
    called = calls.groupBy("c", "m").agg(
        F.array_sort(F.collect_list(F.struct("k", "text"))).alias("calls"), F.count("*").alias("n_calls"), F.sum(F.col("linked").cast("bigint")).alias("n_linked"), F.sum(F.col("invalid").cast("bigint")).alias("n_invalid")
    )
    answered = linked.select("c", F.col("id").alias("tool_call_id"), F.lit(True).alias("answered"))
    rows = tools.drop("tool_calls").join(answered, ["c", "tool_call_id"], "left").join(called, ["c", "m"], "left").join(_placed(tools, edges, most_edges), ["c", "m"], "left")
    answer = F.col("tool_call_id").isNotNull()
    line = _object(
        F.col("rest"), circular=F.when(F.col("circular"), F.lit("true")), content=_quoted(F.col("content")), linked=F.when(answer, F.coalesce("answered", F.lit(False)).cast("string")),
        role=_quoted(F.col("role")), tool_call_id=F.when(answer, _quoted(F.col("tool_call_id"))),
        tool_calls=F.when(F.col("calls").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("calls", lambda x: x["text"]), ","), F.lit("]"))),
    )
    n = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return rows.select("conv_id", "c", "times", "turn", "role", F.coalesce("place", _place(_turn(), F.lit(0))).alias("place"), line.alias("line"), n("n_calls"), n("n_linked"), n("n_invalid"))


def _in_pieces(lines: DataFrame) -> DataFrame:
    """The lines with part and piece: each part's lines, in order, are numbered over range partitions, so a large part is never one group."""
    part = F.when(F.col("place.pos") == _LAST, -1).otherwise(F.floor(F.col("place.pos") / PART)).cast("bigint")
    order = ("place", "turn", "role", "line")
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(lines.withColumn("part", part).repartitionByRange(n, "c", "part", *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("c", "part", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("c", "part", "range", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = ranged.withColumn("i", F.row_number().over(Window.partitionBy("c", "part", "range").orderBy(*order)) - 1).join(offsets, ["c", "part", "range"])
    return numbered.withColumn("piece", F.floor((F.col("before") + F.col("i")) / PIECE).cast("bigint"))


def formatted(conversations: DataFrame, schemas: Schemas | None = None, most_edges: int = MOST_EDGES) -> DataFrame:
    """conv_id, part, piece, n_messages, n_calls, n_linked, n_invalid, json: one row per conversation, part and piece."""
    rows = messages(conversations)
    tools = cut(rows.where("structured"))
    plain = rows.where(~F.col("structured"))
    zero = F.lit(0).cast("bigint")
    line = F.concat(F.lit('{"content":'), _quoted(F.col("content")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}"))
    lines = plain.select("conv_id", "c", "times", "turn", "role", _place(_turn(), F.lit(0)).alias("place"), line.alias("line"), zero.alias("n_calls"), zero.alias("n_linked"), zero.alias("n_invalid"))
    if not tools.isEmpty():
        lines = lines.unionByName(_tool_lines(tools, schemas or {}, most_edges))
    ordered = F.array_sort(F.collect_list(F.struct("place", "turn", "role", "line")))
    sums = (F.sum(n).alias(n) for n in ("n_calls", "n_linked", "n_invalid"))
    whole = _in_pieces(lines).groupBy("conv_id", "c", "part", "piece").agg(ordered.alias("x"), F.max("times").alias("times"), *sums)
    id_ = F.to_json(F.struct("conv_id"))  # {"conv_id":...}; without the field where it is null
    head = F.when(F.col("conv_id").isNull(), '{"conv_id":null').otherwise(F.substring(id_, F.lit(1), F.length(id_) - 1))
    text = F.concat(head, F.lit(',"messages":['), F.array_join(F.transform("x", lambda r: r["line"]), ","), F.lit("]}"))
    whole = whole.select("conv_id", "part", "piece", F.size("x").cast("bigint").alias("n_messages"), "n_calls", "n_linked", "n_invalid", text.alias("json"), "times")
    return whole.withColumn("times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).drop("times")
