"""Exports of other tools as turns and tool calls: which format a file has, its turns in order, the calls, and its tokens.

A document of one JSON value is one row; formats of JSON lines are read by line, so a large file is many tasks' work. Values
are taken by paths over text, so what isn't there, or has another shape, gives nulls or no row.

Defined results: files of no known format, or that aren't JSON, have the format null and no turns; blank texts and texts that
no person wrote are passed over; an empty folder gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transcripts import numbered_lines

from ..operators.sequence import latest_before, numbered

#: Formats of whole documents in the order in which they are tried, and of lines.
DOCUMENTS, LINES = ("chatgpt", "copilot", "gemini", "cursor", "grok"), ("codex", "gemini")
#: How texts begin that no person wrote.
SYNTHETIC = ("<environment_context>", "<permissions instructions>", "<collaboration_mode>", "<user_instructions>", "<system-reminder>")
TURNS = ("file", "session", "ord", "role", "ts", "text", "model")
ACTIONS = ("file", "session", "ord", "tool", "path", "command", "model")


def at(value: Column | str, path: str) -> Column:
    return F.get_json_object(value, path)


def truthy(value: Column) -> Column:
    return F.coalesce(~value.isin("", "false", "0", "null"), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(value.startswith("["), F.lit(False))


def items(value: Column) -> Column:
    """A JSON list's items as texts; none for anything else."""
    return F.coalesce(F.when(is_list(value), F.from_json(value, "array<string>")), F.array().cast("array<string>"))


def flat(content: Column) -> Column:
    """The text of a string, of a list of parts or of one part."""
    part = lambda p: F.when(p.startswith("{"), at(p, "$.text")).otherwise(p)
    parts = F.array_join(F.array_compact(F.transform(F.from_json(content, "array<string>"), part)), "\n")
    return F.coalesce(F.when(is_list(content), parts).when(content.startswith("{"), F.coalesce(at(content, "$.text"), F.lit(""))), content, F.lit(""))


def written(text: Column) -> Column:
    """Whether a person wrote a text."""
    own = F.ltrim(text)
    out = own != ""
    for mark in SYNTHETIC:
        out = out & ~own.startswith(mark)
    return out


def moment(value: Column) -> Column:
    """Milliseconds as a time in the form of the others; other times as they are."""
    return F.when(value.rlike("^[0-9]{10,}$"), F.date_format(F.timestamp_millis(value.try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(value)


def _exported(value: Column) -> Column:
    return F.exists(items(at(value, "$.messages")), lambda m: at(m, "$.role").isNotNull() & at(m, "$.content").isNotNull())


def _bubbles(value: Column) -> Column:
    tabs = F.flatten(F.transform(items(at(value, "$.tabs")), lambda t: F.when(is_list(at(t, "$.bubbles")), items(at(t, "$.bubbles"))).otherwise(items(at(t, "$.messages")))))
    out = F.when(is_list(value), items(value)).when(is_list(at(value, "$.bubbles")), items(at(value, "$.bubbles"))).when(is_list(at(value, "$.tabs")), tabs)
    return out.when(is_list(at(value, "$.conversation")), items(at(value, "$.conversation"))).otherwise(items(at(value, "$.messages")))


def _prompt_list(value: Column) -> Column:
    return F.when(is_list(at(value, "$.prompts")), at(value, "$.prompts")).otherwise(at(value, "$['aiService.prompts']"))


def _messages(value: Column) -> Column:
    return F.when(is_list(at(value, "$.conversation")), items(at(value, "$.conversation"))).otherwise(items(at(value, "$.messages")))


def document_format(value: Column) -> Column:
    """Which tool exported a JSON document, by its shape; the first that fits."""
    mapping = F.when(is_list(value), at(value, "$[0].mapping")).otherwise(F.coalesce(at(value, "$.conversations[0].mapping"), at(value, "$.mapping")))
    copilot = is_list(at(value, "$.requests")) & (truthy(at(value, "$.responderUsername")) | truthy(at(value, "$.requesterUsername")) | at(value, "$.version").isNotNull())
    gemini = F.exists(items(at(value, "$.messages")), lambda m: at(m, "$.type").isin("gemini", "user") & at(m, "$.content").isNotNull())
    branch = at(value, "$.workspaceId").isNotNull() | at(value, "$.index").isNotNull() | at(value, "$.activeBranchBubbleIds").isNotNull()
    bubble = F.exists(_bubbles(value), lambda b: at(b, "$.bubbleId").isNotNull() | at(b, "$.type").isin("1", "2", "ai"))
    cursor = truthy(at(value, "$.cursorExport")) | (F.coalesce(at(value, "$._tool"), F.lit("")) == "cursor") | (_exported(value) & branch) | is_list(at(value, "$.tabs")) | is_list(_prompt_list(value)) | bubble
    every = F.forall(_messages(value), lambda m: at(m, "$.role").isNotNull() & at(m, "$.content").isNotNull()) & (F.size(_messages(value)) > 0)
    signal = F.coalesce(at(value, "$.model").rlike("(?i)^grok"), F.lit(False)) | F.coalesce(at(value, "$.tool").rlike("(?i)grok"), F.lit(False)) | at(value, "$.grok").isNotNull() | at(value, "$.xai").isNotNull()
    holds = (("chatgpt", F.coalesce(mapping.startswith("{"), F.lit(False))), ("copilot", copilot), ("gemini", gemini), ("cursor", cursor), ("grok", ~is_list(value) & every & signal))
    out = F.lit(None).cast("string")
    for name, yes in reversed(holds):
        out = F.when(F.coalesce(yes, F.lit(False)), name).otherwise(out)
    return out


def line_format(first: Column) -> Column:
    """Which tool wrote a file of JSON lines, by its first line."""
    kind = at(first, "$.type")
    return F.when(((kind == "session_meta") & truthy(at(first, "$.payload.originator"))) | kind.isin("response_item", "turn_context"), "codex").when(kind.isin("user", "gemini") & at(first, "$.content").isNotNull(), "gemini")


def read_documents(spark: SparkSession, path: str, forced: str | None = None) -> DataFrame:
    """file, format and value of each JSON document; a forced format goes before what its shape says."""
    if forced is not None and forced not in DOCUMENTS:
        raise ValueError(f"no such format: {forced}; known: {', '.join(DOCUMENTS)}")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    own = raw.filter((F.col("value").startswith("{") | F.col("value").startswith("[")) & F.expr("try_parse_json(value)").isNotNull())
    return own.select("file", (F.lit(forced) if forced else document_format(F.col("value"))).alias("format"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, line and format of every JSON line."""
    own = numbered_lines(spark, path, lambda line: F.trim(line).startswith("{") & F.expr("try_parse_json(line)").isNotNull()).withColumn("line", F.trim("line"))
    first = own.filter("ord = 1").select("file", line_format(F.col("line")).alias("format"))
    return own.select("file", "ord", "line").join(first, "file")


def _each(documents: DataFrame, name: str, found: Column) -> DataFrame:
    """file, session, ord, whole and m, an item, of the documents of a format."""
    own = documents.filter(F.col("format") == name)
    session = F.coalesce(*(at("value", f"$.{k}") for k in ("composerId", "sessionId", "id")), F.col("file"))
    return own.select("file", session.alias("session"), F.col("value").alias("whole"), F.posexplode(found).alias("ord", "m"))


def messages(documents: DataFrame) -> DataFrame:
    """TURNS, with the item m, of all documents but those that are trees of nodes."""
    value = F.col("value")
    m = F.col("m")
    none = F.lit(None).cast("string")
    user = lambda found: F.coalesce(flat(at(found, "$.message")), F.lit(""))
    parts = F.array_join(F.transform(items(at(m, "$.message.parts")), flat), "\n")
    copilot_text = F.when(is_list(at(m, "$.message.parts")) & at(m, "$.message.text").isNull(), parts).otherwise(user(m))
    copilot = _each(documents, "copilot", items(at(value, "$.requests"))).select("file", "session", "ord", F.lit("user").alias("role"), moment(at(m, "$.timestamp")).alias("ts"), copilot_text.alias("text"), at(m, "$.result.metadata.modelId").alias("model"), "m")
    kind = F.coalesce(at(m, "$.type"), at(m, "$.role"))
    gemini_role = F.when(kind == "user", "user").when(kind.isin("gemini", "model", "assistant"), "assistant")
    gemini = _each(documents, "gemini", items(at(value, "$.messages"))).select("file", "session", "ord", gemini_role.alias("role"), at(m, "$.timestamp").alias("ts"), flat(at(m, "$.content")).alias("text"), F.coalesce(at(m, "$.model"), at("whole", "$.model")).alias("model"), "m")
    shape = F.when(_exported(value), items(at(value, "$.messages"))).when(is_list(_prompt_list(value)), F.transform(items(_prompt_list(value)), lambda p: F.to_json(F.struct(F.lit("user").alias("role"), flat(p).alias("text"))))).otherwise(_bubbles(value))
    cursor_role = F.when(at(m, "$.type").isin("1", "user"), "user").when(at(m, "$.type").isin("2", "ai", "assistant"), "assistant").when(at(m, "$.role") == "user", "user").otherwise("assistant")
    cursor_text = F.coalesce(at(m, "$.text"), at(m, "$.content"), at(m, "$.richText"), F.lit(""))
    cursor = _each(documents, "cursor", shape).select("file", "session", "ord", cursor_role.alias("role"), moment(F.coalesce(at(m, "$.timestamp"), at(m, "$.createdAt"))).alias("ts"), cursor_text.alias("text"), at(m, "$.model").alias("model"), "m")
    grok = _each(documents, "grok", _messages(value)).select("file", "session", "ord", at(m, "$.role").alias("role"), moment(at(m, "$.timestamp")).alias("ts"), flat(at(m, "$.content")).alias("text"), F.coalesce(at(m, "$.model"), at("whole", "$.model"), none).alias("model"), "m")
    return copilot.unionByName(gemini).unionByName(cursor).unionByName(grok).filter("role is not null")


def turns(found: DataFrame) -> DataFrame:
    """TURNS that a person or a model wrote; of messages(), tree_turns(), codex_messages() or gemini_lines()."""
    return found.filter(F.col("role").isin("user", "assistant") & ((F.col("role") != "user") | written(F.col("text")))).select(*TURNS)


def actions(found: DataFrame) -> DataFrame:
    """ACTIONS of messages() and gemini_lines(): calls listed with a message, tool data of a message, invocations in a response."""
    calls = F.transform(items(at("m", "$.toolCalls")), lambda c: F.struct(at(c, "$.name").alias("tool"), F.coalesce(*(at(c, f"$.{k}") for k in ("filePath", "args.file_path", "args.path", "args.absolute_path"))).alias("path"), at(c, "$.args.command").alias("command")))
    data = at("m", "$.toolFormerData")
    params = F.coalesce(at(data, "$.params"), at(data, "$.rawArgs"))
    single = F.when(data.isNotNull(), F.array(F.struct(at(data, "$.name").alias("tool"), F.coalesce(*(at(params, f"$.{k}") for k in ("file_path", "path", "target_file", "relativePath"))).alias("path"), at(params, "$.command").alias("command"))))
    invoked = F.filter(items(at("m", "$.response")), lambda r: at(r, "$.kind").isin("toolInvocation", "toolInvocationSerialized"))
    uri = lambda r: F.coalesce(at(r, "$.toolSpecificData.uri.path"), at(r, "$.toolSpecificData.uri.fsPath"), F.when(~at(r, "$.toolSpecificData.uri").startswith("{"), at(r, "$.toolSpecificData.uri")))
    responses = F.transform(invoked, lambda r: F.struct(F.coalesce(at(r, "$.toolId"), at(r, "$.prepareToolInvocation.toolName")).alias("tool"), uri(r).alias("path"), F.coalesce(at(r, "$.toolSpecificData.command"), at(r, "$.toolSpecificData.commandLine")).alias("command")))
    each = F.concat(calls, F.coalesce(single, F.filter(calls, lambda c: F.lit(False))), responses)
    return found.select("file", "session", "ord", "model", F.explode(each).alias("a")).select("file", "session", "ord", "a.tool", "a.path", "a.command", "model")


def tokens(found: DataFrame) -> DataFrame:
    """file, input_tokens and output_tokens: sums over the messages that state them."""
    state = lambda *keys: F.coalesce(*(at("m", f"$.tokens.{k}").try_cast("long") for k in keys), F.lit(0))
    return found.groupBy("file").agg(F.sum(state("prompt", "input")).alias("input_tokens"), F.sum(state("candidate", "output")).alias("output_tokens"))


def gemini_lines(lines: DataFrame) -> DataFrame:
    """TURNS, with the item m, of files of message lines."""
    kind = F.coalesce(at("line", "$.type"), at("line", "$.role"))
    role = F.when(kind == "user", "user").when(kind.isin("gemini", "model", "assistant"), "assistant")
    own = lines.filter("format = 'gemini'").select("file", F.col("file").alias("session"), "ord", role.alias("role"), at("line", "$.timestamp").alias("ts"), flat(at("line", "$.content")).alias("text"), at("line", "$.model").alias("model"), F.col("line").alias("m"))
    return own.filter("role is not null")


def codex(lines: DataFrame) -> DataFrame:
    """Lines of rollouts: file, session, ord, ts, kind, payload, and the model that the last context before stated."""
    own = lines.filter("format = 'codex'").select("file", "ord", at("line", "$.timestamp").alias("ts"), at("line", "$.type").alias("type"), at("line", "$.payload").alias("payload"))
    own = own.withColumn("kind", F.when(F.col("type").isin("response_item", "event_msg"), at("payload", "$.type")).otherwise(F.col("type")))
    model = latest_before(F.when(F.col("kind") == "turn_context", at("payload", "$.model")), ["file"], ["ord"])
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    session = F.first(F.when(F.col("kind") == "session_meta", at("payload", "$.id")), ignorenulls=True).over(w)
    return own.select("file", F.coalesce(session, F.col("file")).alias("session"), "ord", "ts", "kind", "payload", model.alias("model"))


def codex_messages(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'message'").select("file", "session", "ord", at("payload", "$.role").alias("role"), "ts", flat(at("payload", "$.content")).alias("text"), "model")


def codex_actions(found: DataFrame) -> DataFrame:
    """ACTIONS; a call's arguments may be an object or its text."""
    args, name = at("payload", "$.arguments"), at("payload", "$.name")
    listed = F.array_join(items(F.coalesce(at(args, "$.command"), at(args, "$.cmd"))), " ")
    said = F.coalesce(at(args, "$.command"), at(args, "$.cmd"))
    command = F.when(name.rlike("(?i)exec|shell|bash|run|terminal|command"), F.when(is_list(said), listed).otherwise(said))
    path = F.coalesce(*(at(args, f"$.{k}") for k in ("path", "file_path", "filePath")))
    return found.filter("kind = 'function_call'").select("file", "session", "ord", name.alias("tool"), path.alias("path"), command.alias("command"), "model")


def codex_tokens(found: DataFrame) -> DataFrame:
    """file, input_tokens and output_tokens: totals are running ones, so the last that isn't zero counts."""
    total = found.filter("kind = 'token_count'")
    last = lambda k: F.max_by(at("payload", f"$.info.total_token_usage.{k}").try_cast("long"), F.when(at("payload", f"$.info.total_token_usage.{k}").try_cast("long") > 0, F.col("ord")))
    return total.groupBy("file").agg(last("input_tokens").alias("input_tokens"), last("output_tokens").alias("output_tokens"))


def tree_turns(documents: DataFrame) -> DataFrame:
    """TURNS of documents whose conversations are maps of nodes: by time where all nodes with a message have one, else from the root by each node's last child."""
    value = F.col("value")
    node = "struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,create_time:string,content:string,metadata:struct<model_slug:string>>>"
    listed = F.when(is_list(value), items(value)).when(is_list(at(value, "$.conversations")), items(at(value, "$.conversations"))).otherwise(F.array(value))
    each = documents.filter("format = 'chatgpt'").select("file", F.posexplode(listed).alias("n", "c"))
    each = each.select("file", F.concat_ws("#", "file", "n").alias("session"), F.from_json(at("c", "$.mapping"), f"map<string,{node}>").alias("map")).filter("map is not null")
    ids = F.map_keys("map")
    root = F.filter(ids, lambda i: F.col("map")[i]["parent"].isNull())[0]
    # one step of the walk a node, while there is a next one that isn't seen
    step = lambda a, _: F.struct(F.when(a["at"].isNotNull() & ~F.array_contains(a["path"], a["at"]), F.array_append(a["path"], a["at"])).otherwise(a["path"]).alias("path"), F.when(a["at"].isNotNull() & ~F.array_contains(a["path"], a["at"]), F.try_element_at(F.col("map")[a["at"]]["children"], F.lit(-1))).alias("at"))
    walked = F.aggregate(ids, F.struct(F.array().cast("array<string>").alias("path"), root.alias("at")), step, lambda a: a["path"])
    said = F.filter(ids, lambda i: F.col("map")[i]["message"].isNotNull())
    time = lambda i: F.col("map")[i]["message"]["create_time"].try_cast("double")
    timed = (F.size(said) > 0) & F.forall(said, lambda i: time(i).isNotNull())
    by_time = F.transform(F.array_sort(F.transform(said, lambda i, k: F.struct(time(i).alias("t"), k.alias("k"), i.alias("i")))), lambda s: s["i"])
    ordered = each.select("file", "session", "map", F.posexplode(F.when(timed, by_time).otherwise(walked)).alias("ord", "i"))
    own = ordered.select("file", "session", "ord", F.col("map")[F.col("i")]["message"].alias("m")).filter("m is not null")
    text = F.array_join(F.transform(items(at("m.content", "$.parts")), flat), "\n")
    ts = moment(F.round(F.col("m.create_time").try_cast("double") * 1000).cast("long").cast("string"))
    return own.select("file", "session", "ord", F.col("m.author.role").alias("role"), ts.alias("ts"), text.alias("text"), F.col("m.metadata.model_slug").alias("model"))


def linear(found: DataFrame) -> DataFrame:
    """A person's turns as nodes of a chain: file, session, turn (from 1), node, parent (the turn before), ts and text."""
    own = numbered(turns(found).filter("role = 'user'"), ["file", "session"], ["ord"], "turn")
    node = F.concat(F.col("session"), F.lit("-u"), F.col("turn"))
    return own.select("file", "session", "turn", node.alias("node"), F.when(F.col("turn") > 1, F.concat(F.col("session"), F.lit("-u"), F.col("turn") - 1)).alias("parent"), "ts", "text")
