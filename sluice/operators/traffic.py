"""LLM traffic as rows: chat messages and their tool carriers, screened responses, conversations of several body shapes,
streamed responses put together, segment trees.

JSON of unknown shape is a VARIANT, so a wrong type reads as null and no row fails. Objects written back as text have
their keys in the variant's order, with ", " and ": " between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import rules as R
from sluice.functions import text as X
from sluice.operators import detect, masking

NO_TEXTS = "array<string>"
NOTICE = "【应答含敏感内容已屏蔽（{}）】"
#: A JSON string literal, for patterns that must look only outside of strings.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


# --- JSON -------------------------------------------------------------------------------------------------------------
def field(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def items(v: Column) -> Column:
    """The elements of a JSON array; none of anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def kind(v: Column) -> Column:
    """text, tree (an object or array), other; null of null."""
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", "text").when(s.startswith("OBJECT") | s.startswith("ARRAY"), "tree").otherwise(F.when(s.isNotNull() & (s != "VOID"), "other"))


def string(v: Column) -> Column:
    """The string that v is; null of any other kind."""
    return F.when(kind(v) == "text", v.cast("string"))


def dumped(v: Column) -> Column:
    """A string as it is, an object or array as JSON; null of numbers, flags and nulls."""
    spaced = F.regexp_replace(F.to_json(v), rf"\G((?:{_LITERAL}|[^\",:]++)*+)([,:])", "$1$2 ")
    return F.when(kind(v) == "text", v.cast("string")).when(kind(v) == "tree", spaced)


def one_or_none(c: Column) -> Column:
    return F.array_compact(F.array(c))


# --- message texts ----------------------------------------------------------------------------------------------------
def content_texts(message: Column) -> Column:
    """The content of a message, or the texts of its parts; pictures and other parts hold none."""
    parts = F.array_compact(F.transform(items(field(message, "content")), lambda p: string(field(p, "text"))))
    return F.concat(one_or_none(string(field(message, "content"))), parts)


def carrier_texts(message: Column) -> Column:
    """What a message passes to and from tools: arguments of calls, inputs and results."""
    arguments = F.transform(items(field(message, "tool_calls")), lambda c: dumped(field(c, "function.arguments")))
    block = lambda p: (
        F.when(field(p, "type", "string") == "tool_use", F.array(dumped(field(p, "input"))))
        .when(field(p, "type", "string") == "tool_result", F.concat(F.array(string(field(p, "content"))), F.transform(items(field(p, "content")), lambda b: string(field(b, "text")))))
        .otherwise(F.array().cast(NO_TEXTS))
    )
    return F.array_compact(F.concat(arguments, F.flatten(F.transform(items(field(message, "content")), block))))


def chat_text(messages: Column) -> Column:
    """The texts and tool carriers of a JSON array of messages, a line each; text that isn't JSON is taken as it is."""
    v = F.try_parse_json(messages)
    every = F.flatten(F.transform(items(v), lambda m: F.concat(content_texts(m), carrier_texts(m))))
    return F.when(v.isNull(), messages).otherwise(F.array_join(every, "\n"))


def carrier_secrets(df: DataFrame, key: str, messages: str, rules: list[R.FormatRule] = R.FORMAT_RULES) -> DataFrame:
    """(key, codes): sorted codes of secrets in tool carriers alone, for keys that have any."""
    every = F.flatten(F.transform(items(F.try_parse_json(messages)), carrier_texts))
    rows = X.with_hard_normalized(df.select(key, F.explode(every).alias("text")).where("text <> ''"), "text", "norm")
    found = rows.select(key, F.explode(detect.secret_codes(F.col("text"), F.col("norm"), rules)).alias("code"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))


# --- responses --------------------------------------------------------------------------------------------------------
def response_fields(body: Column) -> Column:
    """Texts of a response's choices: (choice, place, call, text), whole messages and stream parts alike."""
    entry = lambda i, place, call, text: F.struct(i.alias("choice"), F.lit(place).alias("place"), call.alias("call"), text.alias("text"))

    def of_choice(choice: Column, i: Column) -> Column:
        out = []
        for container in ("message", "delta"):
            c = field(choice, container)
            out += [F.array(entry(i, f"{container}.{name}", F.lit(None).cast("int"), string(field(c, name)))) for name in ("content", "reasoning_content")]
            out.append(F.transform(items(field(c, "tool_calls")), lambda t, n: entry(i, f"{container}.tool_calls", n, string(field(t, "function.arguments")))))  # noqa: B023
        return F.concat(*out)

    every = F.flatten(F.transform(items(field(F.try_parse_json(body), "choices")), of_choice))
    return F.filter(every, lambda f: F.length(f["text"]) > 0)


def screened_responses(df: DataFrame, key: str, body: str, rules: list[R.FormatRule] = R.FORMAT_RULES, terms: list[R.Term] = (), notice: str = NOTICE) -> DataFrame:
    """(key, choice, place, call, text, codes): fields of responses; one in which a secret, personal data or a term is
    found holds only a notice of the sorted codes."""
    rows = df.select(key, F.inline(response_fields(F.col(body))))
    rows = masking.masked(X.with_hard_normalized(rows, "text", "norm"), "text", rules)
    by_value = F.create_map(*[F.lit(x) for t in terms for x in (t.value, t.rule_id)]) if terms else None
    hit = F.transform(detect.term_hits(F.lower("norm"), F.lit(""), list(terms)), lambda t: F.element_at(by_value, t)) if terms else F.array().cast(NO_TEXTS)
    codes = F.array_sort(F.array_distinct(F.concat(detect.secret_codes(F.col("text"), F.col("norm"), rules), F.col("entities"), hit)))
    before, after = notice.split("{}")
    out = rows.withColumn("codes", codes)
    return out.withColumn("text", F.when(F.size("codes") > 0, F.concat(F.lit(before), F.array_join("codes", ", "), F.lit(after))).otherwise(F.col("text"))).select(key, "choice", "place", "call", "text", "codes")


# --- conversations ----------------------------------------------------------------------------------------------------
def body_shape(v: Column) -> Column:
    """gemini, anthropic, ai_sdk, responses, openai, or null: told by where a body keeps its messages and by block types."""
    blocks = F.flatten(F.transform(items(field(v, "messages")), lambda m: items(field(m, "content"))))
    typed = F.exists(blocks, lambda b: field(b, "type", "string").isin("thinking", "redacted_thinking", "tool_use", "tool_result"))
    parts = F.exists(items(field(v, "messages")), lambda m: F.exists(items(field(m, "parts")), lambda p: kind(field(p, "type")) == "text"))
    return (
        F.when(F.size(items(field(v, "contents"))) > 0, "gemini").when(field(v, "system").isNotNull() | F.coalesce(typed, F.lit(False)), "anthropic")
        .when(F.coalesce(parts, F.lit(False)), "ai_sdk").when(field(v, "input").isNotNull(), "responses").when(field(v, "messages").isNotNull(), "openai")
    )


# Part types of all shapes, which don't clash: where each keeps its text, call and result.
_SAID = {"text": "text", "input_text": "text", "output_text": "text"}
_THOUGHT = {"thinking": "thinking", "redacted_thinking": "data", "reasoning": "text", "reasoning-summary": "text"}
_CALLS = {"tool_use": ("id", "name", "input"), "tool-call": ("toolCallId", "toolName", "args")}
_RESULTS = {"tool_result": ("tool_use_id", "content"), "tool-result": ("toolCallId", "result")}


def _by_type(p: Column, table: dict[str, str]) -> Column:
    t = field(p, "type", "string")
    return F.coalesce(*[F.when(t == name, string(field(p, at))) for name, at in table.items()])


def _call(v: Column, i: str, name: str, arguments: str) -> Column:
    return F.when(field(v, name).isNotNull(), F.struct(field(v, i, "string").alias("id"), field(v, name, "string").alias("name"), dumped(field(v, arguments)).alias("arguments")))


def _result(v: Column, i: str, content: str) -> Column:
    return F.when(field(v, content).isNotNull(), F.struct(field(v, i, "string").alias("id"), dumped(field(v, content)).alias("content")))


def conversations(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, shape, index, role, content, reasoning, calls, results): the messages of request bodies of any known shape.

    A system text leads. Bodies that aren't JSON objects of a known shape have no rows."""
    v, part = F.col("_v"), F.lit(None).cast("variant")
    rows = df.select(key, F.try_parse_json(body).alias("_v")).withColumn("shape", body_shape(v)).where("shape is not null")
    instruction = F.coalesce(field(v, "system"), field(v, "systemInstruction.parts"), field(v, "instructions"))
    system = F.concat(one_or_none(string(instruction)), F.array_compact(F.transform(items(instruction), lambda p: F.coalesce(string(field(p, "text")), string(p)))))
    said = F.struct(F.lit("system").alias("role"), F.array_join(system, "").alias("text"), part.alias("m"))
    message = lambda m: F.struct(F.coalesce(field(m, "role", "string"), F.lit("user")).alias("role"), F.lit(None).cast("string").alias("text"), m.alias("m"))
    listed = F.when(F.col("shape") == "gemini", items(field(v, "contents"))).when(F.col("shape") == "responses", items(field(v, "input"))).otherwise(items(field(v, "messages")))
    plain = F.when((F.col("shape") == "responses") & (kind(field(v, "input")) == "text"), F.array(F.struct(F.lit("user").alias("role"), field(v, "input", "string").alias("text"), part.alias("m"))))
    lead = F.when(F.array_join(system, "") != "", F.array(said))
    none = F.array().cast("array<struct<role:string,text:string,m:variant>>")
    every = F.concat(F.coalesce(lead, none), F.coalesce(plain, none), F.transform(listed, message))
    rows = rows.select(key, "shape", F.posexplode(every).alias("index", "_x")).select(key, "shape", "index", "_x.*")
    m = F.col("m")
    rows = rows.withColumn("parts", F.concat(items(field(m, "parts")), items(field(m, "content"))))
    joined = lambda f: F.array_join(F.transform("parts", f), "")
    thought = lambda p: F.coalesce(field(p, "thought", "boolean"), F.lit(False))
    untyped = lambda p: F.when(field(p, "type").isNull(), string(field(p, "text")))
    content = F.concat(F.coalesce("text", string(field(m, "content")), F.lit("")), joined(lambda p: F.coalesce(string(p), _by_type(p, _SAID), F.when(~thought(p), untyped(p)))))
    reasoning = F.concat(F.coalesce(string(field(m, "reasoning_content")), F.lit("")), joined(lambda p: F.coalesce(_by_type(p, _THOUGHT), F.when(thought(p), untyped(p)))))
    typed = lambda p, name: field(p, "type", "string") == name
    calls = F.concat(
        F.transform(items(field(m, "tool_calls")), lambda c: _call(c, "id", "function.name", "function.arguments")),
        F.transform("parts", lambda p: F.coalesce(*[F.when(typed(p, t), _call(p, *at)) for t, at in _CALLS.items()], _call(p, "functionCall.id", "functionCall.name", "functionCall.args"))),
    )
    results = F.concat(
        F.array(F.when(F.col("role") == "tool", _result(m, "tool_call_id", "content"))),
        F.transform("parts", lambda p: F.coalesce(*[F.when(typed(p, t), _result(p, *at)) for t, at in _RESULTS.items()], _result(p, "functionResponse.name", "functionResponse.response"))),
    )
    return rows.select(key, "shape", "index", F.when(F.col("role") == "model", "assistant").otherwise(F.col("role")).alias("role"), content.alias("content"), reasoning.alias("reasoning"), F.array_compact(calls).alias("calls"), F.array_compact(results).alias("results"))


# --- streamed responses -----------------------------------------------------------------------------------------------
_PIECE = "struct<kind:string,rank:int,slot:string,starts:boolean,id:string,name:string,text:string>"


def _piece(what: Column | str, rank: int, text: Column, slot: Column | None = None, starts: bool = False, i: Column | None = None, name: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        (F.lit(what) if isinstance(what, str) else what).alias("kind"), F.lit(rank).alias("rank"), F.coalesce(null if slot is None else slot, F.lit("")).alias("slot"), F.lit(starts).alias("starts"),
        (null if i is None else i).alias("id"), (null if name is None else name).alias("name"), F.coalesce(text, F.lit("")).alias("text"),
    ).cast(_PIECE)


def pieces(event: Column) -> Column:
    """What one stream event adds: pieces of content, reasoning, blocks or tool calls, of five stream formats. An event that is
    parsed here is parsed once, though many of its fields are looked at."""
    return X.let(event, lambda e: X.let(field(e, "type", "string"), lambda t: _pieces(e, t)))


def _pieces(e: Column, t: Column) -> Column:
    s = lambda path: field(e, path, "string")
    padded = lambda path: F.lpad(F.coalesce(s(path), F.lit("0")), 9, "0")
    none = F.array().cast(f"array<{_PIECE}>")
    added = F.when(s("item.type") == "function_call", F.array(_piece("tool", 1, s("item.arguments"), F.coalesce(s("item.id"), s("item.call_id")), True, F.coalesce(s("item.call_id"), s("item.id")), F.coalesce(s("item.name"), F.lit("unknown"))))).otherwise(none)
    answer = F.when(t == "response.output_text.delta", F.array(_piece("content", 0, s("delta")))).when(t == "response.reasoning_summary_text.delta", F.array(_piece("reasoning", 0, s("delta")))).when(
        t == "response.function_call_arguments.delta", F.array(_piece("tool", 1, s("delta"), s("item_id")))).when(t == "response.output_item.added", added).otherwise(none)
    opened = F.coalesce(s("content_block.type"), F.lit("text"))
    guess = F.when(s("delta.type") == "thinking_delta", "thinking").when(s("delta.type") == "input_json_delta", "tool_use").otherwise("text")
    block_start = F.array(_piece("block", 3, F.lit(""), padded("index"), True, s("content_block.id"), F.concat_ws("\n", opened, s("content_block.name"))))
    block_delta = F.array(_piece("block", 3, F.coalesce(s("delta.thinking"), s("delta.text"), s("delta.partial_json")), padded("index"), False, None, guess))
    d = field(e, "choices[0].delta")
    call = lambda c: _piece("tool", 4, field(c, "function.arguments", "string"), F.lpad(F.coalesce(field(c, "index", "string"), F.lit("0")), 9, "0"), False, field(c, "id", "string"), field(c, "function.name", "string"))
    chat = F.concat(F.array(_piece("content", 0, field(d, "content", "string")), _piece("reasoning", 0, field(d, "reasoning_content", "string"))), F.transform(items(field(d, "tool_calls")), call))
    fn = lambda p, n: _piece("tool", 2, dumped(field(p, "functionCall.args")), F.concat_ws("_", field(p, "functionCall.name", "string"), n.cast("string")), True, F.concat_ws("_", field(p, "functionCall.name", "string"), n.cast("string")), field(p, "functionCall.name", "string"))
    gem = F.transform(items(field(e, "candidates[0].content.parts")), lambda p, n: F.when(field(p, "functionCall").isNotNull(), fn(p, n)).otherwise(_piece(F.when(field(p, "thought", "boolean"), "reasoning").otherwise("content"), 0, field(p, "text", "string"))))
    return (
        F.when(t.startswith("response."), answer).when(t == "content_block_start", block_start).when(t == "content_block_delta", block_delta).when(t == "text-delta", F.array(_piece("content", 0, s("delta"))))
        .when(t == "reasoning-delta", F.array(_piece("reasoning", 0, s("delta")))).when(d.isNotNull(), chat).when(s("choices[0].text").isNotNull(), F.array(_piece("content", 0, s("choices[0].text")))).when(field(e, "candidates").isNotNull(), gem).otherwise(none)
    )


def assembled(events: DataFrame, key: str, seq: str, data: str) -> DataFrame:
    """(key, content, reasoning, calls): responses from their stream events, in order of seq; a key of which no event adds
    anything has empty texts. Events are rows, so only one response's pieces ever meet in a task."""
    rows = events.select(key, F.col(seq).alias("_s"), F.posexplode_outer(pieces(F.try_parse_json(data))).alias("_n", "_p")).select(key, "_s", "_n", "_p.*")
    at = F.struct(F.coalesce("_s", F.lit(0)).alias("s"), F.coalesce("_n", F.lit(0)).alias("n"))
    slots = rows.groupBy(key, "kind", "rank", "slot").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_n").alias("n"), F.col("text").alias("text")))).alias("all"), F.min(at).alias("first"),
        F.max(F.when(F.col("starts"), F.col("_s"))).alias("start"), F.max_by("id", F.when(F.col("id").isNotNull(), at)).alias("id"), F.max_by("name", F.when(F.col("starts"), at)).alias("opened"),
        F.min_by("name", F.when(F.col("name").isNotNull(), at)).alias("guess"), F.max_by("name", F.when(F.col("name").isNotNull(), at)).alias("last"),
    )
    whole = F.array_join(F.transform(F.filter("all", lambda x: F.col("start").isNull() | (x["s"] >= F.col("start"))), lambda x: x["text"]), "")
    slots = slots.where("kind is null or rank <> 1 or start is not null").withColumn("text", whole)
    named = F.coalesce("opened", "guess")
    block = F.when(F.col("kind") == "block", F.substring_index(named, "\n", 1))
    what = F.when(block == "text", "content").when(block == "thinking", "reasoning").when(block.endswith("tool_use"), "tool").when(F.col("kind") == "block", "other").otherwise(F.col("kind"))
    name = F.when(F.col("kind") == "block", F.coalesce(F.get(F.split(named, "\n"), 1), F.lit("unknown"))).otherwise(F.col("last"))
    place = F.when(F.col("rank").isin(3, 4), F.struct(F.col("rank").alias("r"), F.lit(0).cast("long").alias("s"), F.col("slot").alias("o"))).otherwise(F.struct(F.col("rank").alias("r"), F.col("first")["s"].cast("long").alias("s"), F.col("slot").alias("o")))
    rows = slots.select(key, what.alias("what"), F.struct(place.alias("place"), F.col("id"), name.alias("name"), F.col("text")).alias("x"))
    sorted_of = lambda k: F.array_sort(F.collect_list(F.when(F.col("what") == k, F.col("x"))))
    out = rows.groupBy(key).agg(sorted_of("content").alias("c"), sorted_of("reasoning").alias("r"), sorted_of("tool").alias("t"))
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    ahead = F.filter("t", lambda x: x["place"]["r"] < 4)
    calls = F.transform(F.when(F.size(ahead) > 0, ahead).otherwise(F.col("t")), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["text"].alias("arguments")))
    return out.select(key, texts("c").alias("content"), texts("r").alias("reasoning"), calls.alias("calls"))


# --- final responses --------------------------------------------------------------------------------------------------
def _listed(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def final_responses(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, content, reasoning, calls) of whole response bodies: parts, a message, candidates, output items, completions or
    a bare content. A form is only read where those before it gave nothing of what it holds. Calls without a name are
    "unknown"; bodies that aren't JSON objects have empty texts."""
    v, none = F.col("_v"), F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    text = lambda parts, of: F.array_join(F.transform(parts, of), "")
    typed = lambda p, *names: field(p, "type", "string").isin(*names)
    named = lambda p, at: F.coalesce(F.nullif(field(p, at, "string"), F.lit("")), F.lit("unknown"))
    call = lambda i, name, arguments: F.struct(i.alias("id"), name.alias("name"), F.coalesce(F.nullif(arguments, F.lit("")), F.lit("{}")).alias("arguments"))
    rows = df.select(key, F.try_parse_json(body).alias("_v"))
    inner, bare = field(v, "choices[0].message"), (field(v, "role", "string") != "") & field(v, "content").isNotNull()
    rows = rows.withColumn("m", F.when(kind(inner) == "tree", inner).when(bare, v))
    rows = rows.select("*", items(field(F.col("m"), "content")).alias("blocks"), items(field(v, "parts")).alias("parts"), items(field(v, "candidates[0].content.parts")).alias("gemini"), F.concat(items(field(v, "output")), F.when(~_listed(field(v, "output")), items(field(v, "response.output"))).otherwise(F.array().cast("array<variant>"))).alias("output"))
    said = F.concat(text("parts", lambda p: F.when(typed(p, "text"), string(field(p, "text")))), text("blocks", lambda p: F.when(typed(p, "text"), string(field(p, "text")))))
    thought = F.concat(
        text("parts", lambda p: F.when(typed(p, "reasoning"), string(field(p, "text")))),
        text("blocks", lambda p: F.when(typed(p, "thinking"), string(field(p, "thinking"))).when(typed(p, "reasoning"), F.coalesce(F.nullif(string(field(p, "text")), F.lit("")), string(field(p, "reasoning"))))),
    )
    used = F.filter("blocks", lambda p: field(p, "type", "string").rlike("(^|_)tool_use$"))
    own = F.transform(items(field(F.col("m"), "tool_calls")), lambda c: call(field(c, "id", "string"), named(c, "function.name"), dumped(field(c, "function.arguments"))))
    rows = rows.withColumn("calls", F.when(_listed(field(F.col("m"), "tool_calls")), own).otherwise(F.transform(used, lambda p: call(field(p, "id", "string"), named(p, "name"), dumped(field(p, "input"))))))
    first = lambda *texts: F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))
    rows = rows.select("*", first(said, string(field(F.col("m"), "content"))).alias("c"), first(thought, string(field(F.col("m"), "reasoning_content"))).alias("r"))
    silent = (F.col("c") == "") & (F.col("r") == "")
    deep = lambda p: F.coalesce(field(p, "thought", "boolean"), F.lit(False))
    rows = rows.select(key, "_v", "output", "calls", F.when(silent, text("gemini", lambda p: F.when(~deep(p), string(field(p, "text"))))).otherwise(F.col("c")).alias("c"), F.when(silent, text("gemini", lambda p: F.when(deep(p), string(field(p, "text"))))).otherwise(F.col("r")).alias("r"))
    silent = silent & (F.size("calls") == 0)
    of = lambda i, name, at, t: F.when(typed(i, name), text(items(field(i, at)), lambda x: F.when(typed(x, t), string(field(x, "text")))))
    asked = F.transform(F.filter("output", lambda i: typed(i, "function_call")), lambda i: call(F.coalesce(F.nullif(field(i, "call_id", "string"), F.lit("")), field(i, "id", "string")), named(i, "name"), dumped(field(i, "arguments"))))
    answer = F.when(silent, text("output", lambda i: of(i, "message", "content", "output_text"))).otherwise(F.col("c"))
    why = F.when(silent, text("output", lambda i: of(i, "reasoning", "summary", "summary_text"))).otherwise(F.col("r"))
    return rows.select(key, first(answer, field(v, "choices[0].text", "string"), string(field(v, "content"))).alias("content"), why.alias("reasoning"), F.coalesce(F.when(silent, asked).otherwise(F.col("calls")), none).alias("calls"))


# --- traces -----------------------------------------------------------------------------------------------------------
def segments(df: DataFrame, key: str, root: str) -> DataFrame:
    """(key, depth, id, parent_id): a segment tree, given as JSON, level by level until no segment has children. Text that
    isn't a JSON object has no rows."""
    v = F.try_parse_json(root)
    level = df.select(key, F.lit(0).alias("depth"), v.alias("v"), F.lit(None).cast("string").alias("parent_id")).where(F.schema_of_variant(v).startswith("OBJECT"))
    levels = []
    while not level.isEmpty():
        levels.append(level.select(key, "depth", field(F.col("v"), "id", "string").alias("id"), "parent_id"))
        level = level.select(key, (F.col("depth") + 1).alias("depth"), F.explode(items(field(F.col("v"), "children"))).alias("c"), field(F.col("v"), "id", "string").alias("parent_id")).select(key, "depth", F.col("c").alias("v"), "parent_id")
    return reduce(DataFrame.unionByName, levels) if levels else level.select(key, "depth", F.lit(None).cast("string").alias("id"), "parent_id")


# Names of span types.
SPAN_TYPES = (
    "userQuery", "userImageUrl", "userVideoUrl", "userInputAudio", "text", "thinking", "imageUrl", "videoUrl", "audio", "functionCall", "functionResult", "toolUse", "toolResult",
    "message", "retrieve", "embedding", "synthesize", "chunking", "templating", "llm", "systemInstruction", "compaction", "compactionSummary",
)


def span_type(t: Column) -> Column:
    """Trimmed, in lower case, with _ for hyphens and white space; "default" of null and empty."""
    return F.when(F.coalesce(t, F.lit("")) == "", "default").otherwise(F.regexp_replace(F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), r"(?U)[-\s]+", "_"))


def span_type_name(t: Column) -> Column:
    """The known type that t writes, in any of its spellings; else "default"."""
    known = F.create_map(*[F.lit(x) for name in SPAN_TYPES for x in (name.lower(), name)])
    return F.coalesce(F.try_element_at(known, F.replace(span_type(t), F.lit("_"), F.lit(""))), F.lit("default"))


def span_labels(t: Column, value: Column, labels: dict[str, str] | None = None) -> Column:
    """(primary, secondary) of a span, its value given as JSON: a tool's name or a result's id leads, with the type second;
    else the type leads, with a compaction's summary second. ``labels`` holds texts by type name; a type without one is
    written in words."""
    words = F.filter(F.split(t, "[_-]+"), lambda w: w != "")
    spelled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    spelled = F.when(F.coalesce(t, F.lit("")) == "", "Span").otherwise(spelled)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), span_type_name(t)), spelled) if labels else spelled
    v = F.try_parse_json(value)
    some = lambda path: F.nullif(field(v, path, "string"), F.lit(""))
    custom = F.when(span_type(field(v, "toolUse.type", "string")) == "responses_custom_tool", F.concat(label, F.lit(" · responses_custom_tool"))).otherwise(label)
    lead = F.when((span_type(t) == "tool_use"), some("toolUse.name")).when(span_type(t) == "tool_result", some("toolResult.toolCallID"))
    second = F.when(lead.isNull(), some("compaction.summary")).when(span_type(t) == "tool_use", custom).otherwise(label)
    return F.struct(F.coalesce(lead, label).alias("primary"), second.alias("secondary"))
