"""Chat formatting with tool-call linking (operator 5).

Calls and results are joined by conversation and identifier, messages are put in an order in
which every result follows its call and every call the results it refers to, arguments are
validated against the schemas of the tools, and each message becomes one line of canonical
JSON.  All of it is SQL functions; a conversation is never gathered into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.sources.staging import stage

CALLS = "array<struct<id:string,name:string,arguments:string>>"
#: An argument refers to the result of an earlier call as {{identifier}}.
REFERENCE = r"\{\{([^{}]+)\}\}"
#: A JSON number: sign, digits before and behind the point, power of ten.
NUMBER = r"\A(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?\z"
#: Digits that a decimal number holds exactly.
MOST_DIGITS = 38


def messages_of(rows: DataFrame) -> DataFrame:
    """The columns conv_id, turn, role, text, calls and result_of, and ``msg``, which names
    the message; identical rows are one message said several times."""
    named = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text",
        F.coalesce(F.col("calls"), F.array().cast(CALLS)).cast(CALLS).alias("calls"), F.col("result_of").cast("string").alias("result_of"),
    )
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text", "calls", "result_of"), {"ignoreNullFields": "false"})
    return named.withColumn("msg", F.md5(whole))


def first_calls(messages: DataFrame) -> DataFrame:
    """``(conv_id, id)`` with the message of the first call that has this id, and its ``turn``."""
    calls = messages.select("conv_id", "turn", "msg", F.explode("calls.id").alias("id")).filter("id is not null")
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "msg")).alias("first"))
    return first.select("conv_id", "id", F.col("first.msg").alias("call_msg"), F.col("first.turn").alias("call_turn"))


def first_results(messages: DataFrame) -> DataFrame:
    """``(conv_id, id)`` with the first message that gives a result for this call."""
    given = messages.filter("result_of is not null").groupBy("conv_id", F.col("result_of").alias("id"))
    first = given.agg(F.min(F.struct("turn", "msg")).alias("first"))
    return first.select("conv_id", "id", F.col("first.msg").alias("result_msg"), F.col("first.turn").alias("result_turn"))


def order_edges(messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """``(conv_id, a, turn_a, b, turn_b)``: message a comes before message b."""
    answers = messages.filter("result_of is not null").select("conv_id", F.col("result_of").alias("id"), F.col("msg").alias("b"), F.col("turn").alias("turn_b"))
    linked = answers.join(calls.hint("shuffle_hash"), ["conv_id", "id"])
    linked = linked.select("conv_id", F.col("call_msg").alias("a"), F.col("call_turn").alias("turn_a"), "b", "turn_b")
    wanted = messages.select(
        "conv_id", F.col("msg").alias("b"), F.col("turn").alias("turn_b"), F.explode("calls.arguments").alias("arguments")
    )
    wanted = wanted.select("conv_id", "b", "turn_b", F.explode(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1))).alias("id"))
    needed = wanted.join(results.hint("shuffle_hash"), ["conv_id", "id"])
    needed = needed.select("conv_id", F.col("result_msg").alias("a"), F.col("result_turn").alias("turn_a"), "b", "turn_b")
    return linked.unionByName(needed).distinct()


def topological_order(edges: DataFrame) -> DataFrame:
    """``(msg, slot, depth, cyclic)`` for messages that have to move or stand in a circle.

    The order of turns is kept wherever it serves: only conversations with an edge that runs
    against it are sorted, by taking away messages that wait for nothing, round by round.  A
    message goes to the first turn, ``slot``, at which all it waits for is there, and behind
    those, ``depth``.  What is left when a round takes nothing away waits for a circle.
    """
    against = edges.filter((F.col("turn_a") >= F.col("turn_b")) | F.col("turn_a").isNull() | F.col("turn_b").isNull())
    broken = stage(against.select("conv_id").distinct(), "unordered-conversations")
    waiting = stage(edges.join(broken, edges["conv_id"].eqNullSafe(broken["conv_id"]), "left_semi"), "order-edges")
    place = lambda turn: F.struct(F.col(turn).alias("slot"), F.lit(0).alias("depth")).alias("place")
    nodes = waiting.select(F.col("a").alias("msg"), place("turn_a")).union(waiting.select("b", place("turn_b"))).distinct()
    nodes, waiting = stage(nodes, "order-nodes"), waiting.select("a", "b")
    settled = nodes.limit(0)
    while not nodes.isEmpty():
        blocked = waiting.select(F.col("b").alias("msg")).distinct()
        ready = stage(nodes.join(blocked, "msg", "left_anti"), "order-ready")
        if ready.isEmpty():
            break
        after = waiting.join(ready.select(F.col("msg").alias("a"), F.col("place").alias("before")), "a")
        behind = F.struct(F.col("before.slot").alias("slot"), (F.col("before.depth") + 1).alias("depth"))
        pushed = after.groupBy(F.col("b").alias("msg")).agg(F.max(behind).alias("least"))
        rest = nodes.join(ready, "msg", "left_anti").join(pushed, "msg", "left")
        nodes = stage(rest.select("msg", F.coalesce(F.greatest("place", "least"), "place").alias("place")), "order-nodes")
        waiting = stage(waiting.join(ready.select(F.col("msg").alias("a")), "a", "left_anti"), "order-edges")
        settled = settled.unionByName(ready)
    ordered = settled.withColumn("cyclic", F.lit(False)).unionByName(nodes.withColumn("cyclic", F.lit(True)))
    return ordered.select("msg", "place.slot", "place.depth", "cyclic")


def kind_of(value: Column) -> Column:
    """The JSON kind of a variant, with whole numbers apart from others."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .when(name.rlike(r"INT$|DECIMAL\(\d+,0\)"), "integer")
        .otherwise("number")
    )


def plain_number(literal: Column) -> Column:
    """A JSON number written out without exponent or needless zeros, so that equal numbers are
    equal texts; NULL beyond MOST_DIGITS digits before or behind the point, other text as it is."""
    part = lambda n: F.regexp_extract(literal, NUMBER, n)
    digits = F.concat(part(2), part(3))
    power = F.coalesce(part(4).try_cast("int"), F.when(part(4) == "", F.lit(0)))
    short = F.rtrim(digits, F.lit("0"))
    least = F.length(digits) - F.length(short) - F.length(part(3)) + power  # the power of ten of the last digit
    number = F.ltrim(short, F.lit("0"))
    point = F.greatest(-least, F.lit(0))
    padded = F.lpad(number, F.greatest(F.length(number), point + 1), F.lit("0"))
    split = F.length(padded) - point
    written = F.when(least >= 0, F.concat(number, F.repeat(F.lit("0"), least))).otherwise(
        F.concat(F.substring(padded, F.lit(1), split), F.lit("."), F.substring(padded, split + 1, point))
    )
    inside = power.isNotNull() & (F.length(number) + F.greatest(least, F.lit(0)) <= MOST_DIGITS) & (point <= MOST_DIGITS)
    exact = F.when(number == "", F.lit("0")).when(inside, F.concat(part(1), written))
    return F.when(literal.rlike(NUMBER), exact).otherwise(literal)


def plain_numbers(json: str, beyond: str | None = None) -> Column:
    """JSON text with each number outside of strings as ``plain_number`` writes it, and ``beyond``
    for those out of its range; without one the whole is NULL then.  Backslashes and quotes inside strings are set aside while the text is
    cut at its quotes, so time grows with the length only."""
    held = F.replace(F.replace(F.col(json), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    numbers = lambda text: F.transform(F.regexp_extract_all(text, F.lit("[-+.0-9eE]+|[^-+.0-9eE]+"), F.lit(0)), lambda x: F.coalesce(plain_number(x), F.lit(beyond)))
    joined = lambda pieces: F.when(~F.exists(pieces, lambda x: x.isNull()), F.array_join(pieces, ""))
    parts = F.transform(F.split(held, '"', -1), lambda text, i: F.when(i % 2 == 0, joined(numbers(text))).otherwise(text))
    whole = F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, '"'))
    back = F.replace(F.replace(whole, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    unusual = F.col(json).rlike("[0-9][.eE]|-0|[0-9]{19}") & ~F.col(json).rlike("[\x01\x02]")
    return F.when(unusual, back).otherwise(F.col(json))


def checked_calls(messages: DataFrame, schemas: DataFrame, results: DataFrame, calls: DataFrame) -> DataFrame:
    """``(msg, at)`` of every call with canonical ``arguments`` and its ``errors``.

    ``schemas(tool, parameter, kind, required)``: the rows of one tool are its parameters.
    """
    each = messages.select("conv_id", "msg", F.posexplode("calls").alias("at", "call")).distinct()
    each = each.select("conv_id", "msg", "at", "call.*").withColumn("exact", plain_numbers("arguments"))
    too_wide = F.when(F.col("exact").isNull(), F.try_parse_json(plain_numbers("arguments", "0")).isNotNull()).otherwise(False)
    each = each.withColumn("too_wide", too_wide).withColumn("value", F.try_parse_json("exact")).drop("exact")
    parameters = F.sort_array(F.collect_set(F.struct("parameter", "kind", "required"))).alias("parameters")
    tools = stage(schemas.filter("tool is not null and parameter is not null").groupBy("tool").agg(parameters), "tool-schemas")
    each = each.join(tools, F.col("name") == F.col("tool"), "left").drop("tool")
    each = each.join(results.select("conv_id", "id", "result_msg").hint("shuffle_hash"), ["conv_id", "id"], "left")
    first = calls.select("conv_id", "id", "call_msg")
    each = each.join(first.hint("shuffle_hash"), ["conv_id", "id"], "left")
    is_object = F.coalesce(kind_of(F.col("value")) == "object", F.lit(False))
    each = each.withColumn("given", F.when(is_object, F.try_variant_get("value", "$", "map<string,variant>")))
    said = lambda problem, name: F.concat(F.lit(problem), name)

    def problem(p: Column) -> Column:
        kind = kind_of(F.element_at("given", p.parameter))
        fits = (kind == p.kind) | ((p.kind == "number") & (kind == "integer"))
        there = F.map_contains_key("given", p.parameter)
        return F.when(there & ~fits, said("wrong kind: ", p.parameter)).when(~there & p.required, said("missing: ", p.parameter))

    none = F.array().cast("array<string>")
    known = F.transform("parameters", lambda p: p.parameter)
    by_schema = F.concat(
        F.filter(F.transform("parameters", problem), lambda x: x.isNotNull()),
        F.transform(F.array_sort(F.array_except(F.map_keys("given"), known)), lambda name: said("unknown parameter: ", name)),
    )
    of_arguments = F.when(F.col("parameters").isNull(), F.array(F.lit("unknown tool"))).when(
        F.col("too_wide"), F.array(F.lit("number out of range"))
    ).when(
        ~is_object, F.array(F.lit("arguments are not an object"))
    ).otherwise(by_schema)
    repeated = F.col("call_msg").isNotNull() & (F.col("call_msg") != F.col("msg"))
    of_link = (
        F.when(F.col("id").isNull(), F.array(F.lit("no identifier")))
        .when(repeated, F.array(F.lit("repeated identifier")))
        .when(F.col("result_msg").isNull(), F.array(F.lit("no result")))
        .otherwise(none)
    )
    return each.select("msg", "at", "id", "name", "arguments", "value", F.concat(of_arguments, of_link).alias("errors"))


def format_chats(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, slot, depth, json, n_calls, errors.

    ``rows`` have conv_id, turn, role, text, calls (id, name, arguments as JSON text) and
    result_of (the id that a tool's message answers); other columns are left out.  Sorted by
    (slot, depth, turn, json) a conversation is in topological order.  The JSON has its keys
    in order and no white space, and numbers are written out (``1e2`` and ``100.0`` as ``100``);
    missing fields are left out, and arguments that cannot be read, or with a number of more
    than 38 digits, stay text.  Very long texts are taken whole.  Of calls with one id in a conversation the first is the call, and of its
    results the first counts.  ``errors`` is empty for a sound message.  A missing
    conversation, turn or identifier is never linked, and identical rows give identical rows.
    """
    messages = stage(messages_of(rows), "chat-messages")
    calls, results = stage(first_calls(messages), "first-calls"), stage(first_results(messages), "first-results")
    order = stage(topological_order(order_edges(messages, calls, results)), "message-order")
    checked = checked_calls(messages, schemas, results, calls)
    quoted = lambda name: F.regexp_replace(F.to_json(F.struct(F.col(name).alias("x"))), r'^\{"x":|\}$', "")
    one = F.struct(F.coalesce(F.col("value"), F.try_parse_json(quoted("arguments"))).alias("arguments"), "id", "name")
    # A message's calls stand in one array already; they come back together as they were.
    formatted = checked.withColumn("one", F.to_json(one)).groupBy("msg").agg(
        F.sort_array(F.collect_list(F.struct("at", "one", "errors"))).alias("done")
    )
    orphans = calls.select("conv_id", F.col("id").alias("result_of"), F.lit(True).alias("has_call"))
    out = messages.join(order, "msg", "left").join(formatted, "msg", "left")
    out = out.join(orphans.hint("shuffle_hash"), ["conv_id", "result_of"], "left")
    field = lambda key, value, there: F.when(there, F.concat(F.lit(f'"{key}":'), value))
    parts = F.concat_ws(
        ",",
        field("content", quoted("text"), F.col("text").isNotNull()),
        field("conv_id", quoted("conv_id"), F.col("conv_id").isNotNull()),
        field("role", quoted("role"), F.col("role").isNotNull()),
        field("tool_call_id", quoted("result_of"), F.col("result_of").isNotNull()),
        field("tool_calls", F.concat(F.lit("["), F.array_join("done.one", ","), F.lit("]")), F.size("calls") > 0),
    )
    errors = F.concat(
        F.coalesce(F.flatten("done.errors"), F.array().cast("array<string>")),
        F.when(F.col("result_of").isNotNull() & F.col("has_call").isNull(), F.array(F.lit("result without call"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("cyclic"), F.array(F.lit("circular reference"))).otherwise(F.array().cast("array<string>")),
    )
    return out.select(
        "conv_id", "turn", "role", F.coalesce("slot", "turn").alias("slot"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit("{"), parts, F.lit("}")).alias("json"), F.size("calls").alias("n_calls"), F.array_join(errors, "; ").alias("errors"),
    )
