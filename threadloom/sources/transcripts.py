"""Session transcripts as flat tables: native JSON lines, and exports of chat tools as turns.

A line is parsed by paths over its text, so a malformed line or an unknown record gives nulls or no row, not an error, and
Spark's text reader splits large files among tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import redirects as R
from ..functions import text as T
from ..shared import cut

# How user texts begin that no person wrote as they stand, and what stands for a prompt of images alone.
CONTINUATION = r"^this session is being continued from a previous conversation"
COMMAND = ("<command-name>", "<command-message>", "<local-command-stdout>", "<bash-input>", "<bash-stdout>", "<bash-stderr>")
META = ("<system-reminder>", "<task-notification>", "<local-command-caveat>", "Caveat: The messages below")
IMAGE_ONLY = "[image-only prompt: screenshot/annotated feedback]"
INTERRUPTED = r"^\[Request interrupted by user"


def _at(path: str, line: str = "line") -> Column:
    return F.get_json_object(line, "$." + path)


def _flag(path: str) -> Column:
    return F.coalesce(_at(path) == "true", F.lit(False))


def _begins(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | text.startswith(mark)
    return out


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def numbered_lines(spark: SparkSession, path: str, wanted=None) -> DataFrame:
    """file, ord (from 1, of the wanted lines of a file) and line.

    A split numbers its own lines as it reads them; one row for each split says what precedes it in its file, so a large file is
    many tasks' work, and no window holds a file. The lines are written out first: the splits may be others when they are read again.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"))
    own = cut((raw if wanted is None else raw.filter(wanted(F.col("line")))).withColumn("_row", F.monotonically_increasing_id()))
    splits = own.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = own.join(splits, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.select("file", (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias("ord"), "line")


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON line: file, ord (of the line in its file), type and the fields that later steps use, and the line."""
    lines = numbered_lines(spark, path, lambda line: line.startswith("{") & F.expr("try_parse_json(line)").isNotNull())
    return lines.select(
        "file", "ord", _at("type").alias("type"), _at("uuid").alias("uuid"), F.when(_at("subtype") == "compact_boundary", _at("logicalParentUuid")).otherwise(_at("parentUuid")).alias("parent_uuid"),
        _at("sessionId").alias("session_id"), _at("timestamp").alias("ts"), _at("cwd").alias("cwd"), _flag("isSidechain").alias("sidechain"), _flag("isMeta").alias("meta"),
        _at("message.id").alias("message_id"), _at("message.model").alias("model"), _at("message.stop_reason").alias("stop_reason"), _at("message.usage.input_tokens").cast("long").alias("input_tokens"),
        _at("message.usage.output_tokens").cast("long").alias("output_tokens"), _at("message.content").alias("content"), (_at("toolUseResult").isNotNull() | _at("sourceToolAssistantUUID").isNotNull()).alias("is_tool_result"),
        (F.coalesce(_at("agentId"), F.lit("")) != "").alias("by_agent"), (F.coalesce(_at("promptSource").isin("system", "sdk"), F.lit(False)) | F.coalesce(_at("origin.kind") == "task-notification", F.lit(False))).alias("by_system"),
        _flag("isCompactSummary").alias("compact"), _at("summary").alias("summary"), F.coalesce(_at("aiTitle"), _at("title")).alias("ai_title"), _at("customTitle").alias("custom_title"), "line",
    )


def titles(found: DataFrame) -> DataFrame:
    """file and title: the last custom title, else the last title a model gave, else the first summary; files without any have no row."""
    summary = F.when((F.col("type") == "summary") & (F.col("summary") != ""), F.col("summary"))
    given = F.when((F.col("type") == "ai-title") & (F.col("ai_title") != ""), F.col("ai_title"))
    custom = F.when((F.col("type") == "custom-title") & (F.col("custom_title") != ""), F.col("custom_title"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("ord")))
    first = F.min_by(summary, F.when(summary.isNotNull(), F.col("ord")))
    return found.groupBy("file").agg(F.coalesce(last(custom), last(given), first).alias("title")).filter("title is not null")


def _blocks(content: Column) -> Column:
    """The content's blocks; a plain string is one block of text, also one that begins like a list."""
    kind = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
    text = F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("name", "string"), ("input", "string"), ("tool_use_id", "string"), ("is_error", "boolean"), ("content", "string"))))
    listed = F.filter(F.array(F.when(content.startswith("["), F.from_json(content, kind))), lambda b: F.forall(b, lambda x: x["type"].isNotNull()))
    return F.coalesce(F.try_element_at(listed, F.lit(1)), F.array(text).cast(kind))


def user_text(text: Column, has_image: Column) -> Column:
    """What a person wrote in a user record's text, else null: reminders taken out, a command with arguments as its name and them, a fixed text for images alone."""
    own = _stripped(F.coalesce(text, F.lit("")))
    plain = own
    for tag in ("system-reminder", "task-notification"):
        plain = F.regexp_replace(plain, rf"(?i)<{tag}>[\s\S]*?</{tag}>", "")
    for tag in ("system-reminder", "task-notification"):
        plain = F.regexp_replace(plain, rf"(?i)<{tag}>[\s\S]*\z", "")
    plain = _stripped(plain)
    name = _stripped(F.regexp_extract(own, r"<command-name>([^<]*)</command-name>", 1))
    args = _stripped(F.regexp_extract(own, r"<command-args>([\s\S]*?)</command-args>", 1))
    command = F.when(args != "", F.concat(F.when(name != "", name).otherwise("(command)"), F.lit(" "), args))
    said = F.when(T.matches(own, CONTINUATION), None).when(_begins(own, COMMAND), command).when(_begins(own, META), F.when((plain != own) & (plain != ""), plain))
    return said.when(own != "", own).when(has_image, IMAGE_ONLY)


def _user_records(found: DataFrame) -> DataFrame:
    own = found.filter("type = 'user' and not sidechain and not by_agent and not meta and not is_tool_result and not by_system").withColumn("_b", _blocks(F.col("content")))
    text = F.array_join(F.transform(F.filter("_b", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    image = F.exists("_b", lambda b: b["type"] == "image")
    own = own.withColumn("_text", text)
    return own.withColumns({"text": user_text(F.col("_text"), F.coalesce(image, F.lit(False))), "interrupt": T.matches(_stripped(F.col("_text")), INTERRUPTED)})


def prompts(found: DataFrame) -> DataFrame:
    """Turns that a person wrote: file, ord, session_id, ts, uuid, parent_uuid and text."""
    return _user_records(found).filter("text is not null and not interrupt and not compact").select("file", "ord", "session_id", "ts", "uuid", "parent_uuid", "text")


def _assistant(found: DataFrame) -> DataFrame:
    """The agent's messages with narration (texts joined by a space), files of its tool calls and whether it made any."""
    own = found.filter("type = 'assistant' and not sidechain").withColumn("_b", F.when(F.col("content").startswith("["), _blocks(F.col("content"))))
    own = own.withColumn("_b", F.coalesce("_b", F.filter(_blocks(F.lit("")), lambda b: F.lit(False))))
    said = F.filter(F.transform(F.filter("_b", lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull())
    calls = F.filter("_b", lambda b: b["type"] == "tool_use")
    named = F.array_compact(F.transform(calls, lambda b: F.coalesce(F.get_json_object(b["input"], "$.file_path"), F.get_json_object(b["input"], "$.notebook_path"))))
    shell = F.flatten(F.transform(F.filter(calls, lambda b: b["name"] == "Bash"), lambda b: F.coalesce(T.shell_paths(F.get_json_object(b["input"], "$.command")), F.array().cast("array<string>"))))
    return own.withColumns({"said": said, "narration": F.array_join(F.filter(said, lambda t: t != ""), " "), "files": F.array_distinct(F.concat(named, shell)), "calls": F.size(calls)})


def with_context(found: DataFrame) -> DataFrame:
    """Prompts with prior_tokens (of the agent's last message before that touched files or said something) and goal_tokens (of the file's first prompt; none if the file goes on from another conversation).

    An as-of lookup in one pass over each file's messages in order; null where there is no such message.
    """
    own = prompts(found).withColumn("_tokens", F.lit(None).cast("array<string>"))
    acted = _assistant(found).filter((F.size("files") > 0) | (F.col("narration") != ""))
    acted = acted.select("file", "ord", R.action_tokens(F.col("files"), F.col("narration")).alias("_tokens"))
    goes_on = _user_records(found).filter(F.col("compact") | T.matches(_stripped(F.col("_text")), CONTINUATION)).select("file", "ord", F.lit(True).alias("_goes_on"))
    rows = own.withColumn("_prompt", F.lit(True)).unionByName(acted, allowMissingColumns=True).unionByName(goes_on, allowMissingColumns=True)
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("_prompt") & ~F.coalesce(F.max("_goes_on").over(upto), F.lit(False))
    rows = rows.withColumn("prior_tokens", F.last("_tokens", ignorenulls=True).over(before)).withColumn("_fresh", fresh)
    rows = rows.withColumn("_first", F.first(F.when(F.col("_fresh"), F.col("text")), ignorenulls=True).over(upto))
    kept = rows.filter("_prompt").withColumn("goal_tokens", F.when(F.col("_first").isNotNull(), R.goal_tokens(F.col("_first"))))
    return kept.drop("_tokens", "_prompt", "_goes_on", "_fresh", "_first")


def actions(found: DataFrame) -> DataFrame:
    """Tool calls: file, ord, seq, tool, path, command and the narration of their message."""
    own = _assistant(found).select("file", "ord", "model", "narration", F.posexplode("_b").alias("seq", "b")).filter("b.type = 'tool_use'")
    return own.select("file", "ord", "seq", "model", "narration", F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("tool"), F.coalesce(_at("file_path", "b.input"), _at("notebook_path", "b.input")).alias("path"), _at("command", "b.input").alias("command"))


def rejections(found: DataFrame) -> DataFrame:
    """Failed tool results, interrupts, declining texts and refusals: file, ord, ts, kind and confidence.

    A text declines by its own words or by what it says of the agent's action just before. A refusal in words counts only for
    a message without tool calls that the provider didn't mark as a refusal itself.
    """
    blocks = found.filter("not sidechain").select("file", "ord", "ts", "type", F.explode(_blocks(F.col("content"))).alias("b"))
    failed = blocks.filter("type = 'user' and b.type = 'tool_result' and b.is_error").select("file", "ord", "ts", T.tool_rejection(F.col("b.content")).alias("r")).select("file", "ord", "ts", "r.*")
    stopped = _user_records(found).filter("interrupt").select("file", "ord", "ts", F.lit("user_interrupt").alias("kind"), F.lit(1.0).alias("confidence"))
    routed = R.routed(F.col("text"), F.col("prior_tokens"), F.col("goal_tokens"))
    declined = with_context(found).filter(routed["declined"]).select("file", "ord", "ts", F.lit("user_text_decline").alias("kind"), F.lit(0.8).alias("confidence"))
    said = F.exists("said", R.is_structural_refusal)
    refused = _assistant(found).withColumn("confidence", F.when(F.col("stop_reason") == "refusal", 0.95).when((F.col("calls") == 0) & said, 0.7))
    refused = refused.filter("confidence is not null").select("file", "ord", "ts", F.lit("model_refusal").alias("kind"), "confidence")
    return failed.unionByName(stopped).unionByName(declined).unionByName(refused)


def usage(found: DataFrame) -> DataFrame:
    """Records of token usage, for stats.token_usage."""
    return found.filter("type = 'assistant' and message_id is not null and coalesce(model, '') <> '<synthetic>'").select("file", "ord", "message_id", F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"))


def tree_exports(spark: SparkSession, path: str) -> DataFrame:
    """Exports whose conversations are maps of nodes: file, session, node, parent, ts (seconds), role, text and model."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    node = "struct<id:string,parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>,metadata:struct<model_slug:string>>>"
    one = f"struct<title:string,create_time:double,mapping:map<string,{node}>>"
    many = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{one}>")).otherwise(F.coalesce(F.from_json(F.get_json_object("value", "$.conversations"), f"array<{one}>"), F.array(F.from_json("value", one))))
    each = raw.select("file", F.posexplode(many).alias("session", "c")).select("file", "session", F.explode("c.mapping").alias("node", "n")).filter("n.message.author.role in ('user', 'assistant')")
    return each.select("file", "session", "node", F.col("n.parent").alias("parent"), F.col("n.message.create_time").alias("ts"), F.col("n.message.author.role").alias("role"), F.array_join("n.message.content.parts", "\n").alias("text"), F.col("n.message.metadata.model_slug").alias("model"))


def message_lists(spark: SparkSession, path: str) -> DataFrame:
    """Exports with one list of messages (messages, conversation, requests or history): file, ord, role, text and model."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    found = F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in ("messages", "conversation", "requests", "history")))
    each = raw.select("file", F.posexplode(F.from_json(found, "array<string>")).alias("ord", "m"))
    text = F.coalesce(*(F.get_json_object("m", f"$.{k}") for k in ("content", "message.text", "text", "message")))
    kind = F.lower(F.coalesce(F.get_json_object("m", "$.role"), F.get_json_object("m", "$.type"), F.lit("user")))
    return each.select("file", "ord", F.when(kind.isin("user", "human"), "user").otherwise("assistant").alias("role"), text.alias("text"), F.coalesce(F.get_json_object("m", "$.model"), F.get_json_object("m", "$.modelId")).alias("model"))


def marked_turns(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Turns of a plain transcript: a line with a speaker's mark opens one, lines after it belong to it; lines before the first don't.

    lines has line; out come the keys, turn (from 1), role and text.
    """
    from ..operators.sequence import islands

    mark = r"^\s*(?:#{1,4}\s*)?(?:\*\*)?(User|Human|Assistant|AI|Model)(?:\*\*)?\s*:(?:\*\*)?\s*"
    who = F.lower(F.regexp_extract("line", f"(?i){mark}", 1))
    marked = islands(lines.withColumn("_who", who), F.col("_who") != "", keys, order, "turn").filter("turn > 0")
    own = marked.withColumn("_text", F.regexp_replace("line", f"(?i){mark}", ""))
    whole = own.groupBy(*keys, "turn").agg(F.max("_who").alias("_who"), F.sort_array(F.collect_list(F.struct(*order, "_text"))).alias("_l"))
    return whole.select(*keys, "turn", F.when(F.col("_who").isin("user", "human"), "user").otherwise("assistant").alias("role"), F.trim(F.array_join(F.transform("_l", lambda x: x["_text"]), "\n")).alias("text"))
