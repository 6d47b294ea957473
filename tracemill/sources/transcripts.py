"""Readers: transcripts, captures, run ledgers, secret scans, decision tables; and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>"
KNOWN_TYPES = ("user", "assistant", "system", "attachment", "summary", "file-history-snapshot", "queue-operation")


def files(spark: SparkSession, root: str) -> DataFrame:
    """source_path, mtime, project, file_session, kind, agent_id, workflow_id, line_no and line of the transcripts below root.

    <project>/<session>.jsonl is a main transcript, <project>/<session>/subagents/**/agent-<id>.jsonl one of a subagent; other
    files are none. A file comes as one value, so the longest transcript has to fit into a task.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    p = F.col("_metadata.file_path")
    sub = r"/([^/]+)/([^/]+)/subagents/(?:.*/)?agent-([^/]+)\.jsonl$"
    is_sub, part = F.contains(p, F.lit("/subagents/")), lambda i: F.regexp_extract(p, sub, i)
    base = raw.where(~is_sub | p.rlike(sub)).select(
        p.alias("source_path"), F.col("_metadata.file_modification_time").alias("mtime"), F.when(is_sub, part(1)).otherwise(F.regexp_extract(p, r"([^/]+)/[^/]+\.jsonl$", 1)).alias("project"),
        F.when(is_sub, part(2)).otherwise(F.regexp_extract(p, r"([^/]+)\.jsonl$", 1)).alias("file_session"), F.when(is_sub, "subagent").otherwise("main").alias("kind"),
        F.when(is_sub, part(3)).alias("agent_id"), F.nullif(F.regexp_extract(p, r"/(wf_[^/]+)/", 1), F.lit("")).alias("workflow_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return base.where(F.trim("line") != "")


#: What is read of a record, in one pass over its VARIANT; what has another type than here is null.
RECORD = (
    "struct<type:string,uuid:string,parentUuid:string,sessionId:string,promptId:string,timestamp:string,version:string,gitBranch:string,subtype:string,durationMs:double,messageCount:double,toolUseResult:string,"
    "isMeta:boolean,isSidechain:boolean,isCompactSummary:boolean,origin:struct<kind:string>,message:struct<id:string,model:string,stop_reason:string,"
    "usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>,content:variant>>"
)
READ_BLOCK = BLOCK.replace("input:string", "input:variant").replace("content:string", "content:variant")


BLOCK_FIELDS = ("type", "text", "id", "name", "input", "tool_use_id", "is_error", "content")


def _blocks(content: Column, unread: tuple[str, ...] = ()) -> Column:
    """Content as an array of blocks; a string is one text block; what is not an object is dropped. Unread fields are null."""
    kinds = dict(x.split(":") for x in READ_BLOCK[len("struct<"):-1].split(","))
    null = {k: F.lit(None).cast(t) for k, t in (x.split(":") for x in BLOCK[len("struct<"):-1].split(","))}
    as_text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    value = lambda b, k: null[k] if k in unread else as_text(b[k]) if k in ("input", "content") else b[k]
    read = F.try_variant_get(content, "$", "array<struct<" + ",".join(f"{k}:{t}" for k, t in kinds.items() if k not in unread) + ">>")
    many = F.transform(F.filter(read, lambda b: b["type"].isNotNull()), lambda b: F.struct(*[value(b, k).alias(k) for k in BLOCK_FIELDS]))
    said = F.try_variant_get(content, "$", "string")
    single = F.array(F.struct(F.lit("text").alias("type"), said.alias("text"), *[null[k].alias(k) for k in BLOCK_FIELDS[2:]]))
    return F.coalesce(many, F.when(said.isNotNull(), single), F.array().cast(f"array<{BLOCK}>"))


def parse(lines: DataFrame, unread: tuple[str, ...] = ()) -> DataFrame:
    """lines with the record's columns, and status: ok, bad (no JSON) or not_object. Fields of blocks that go unread are null."""
    # the VARIANT of a line is as long as the line, so it goes no further than to the step that reads it
    df = lines.withColumn("v", F.try_parse_json("line")).select(*lines.columns, F.col("v").isNull().alias("bad"), F.try_variant_get("v", "$", RECORD).alias("r"))
    status = F.when(F.col("bad"), "bad").when(F.col("r").isNull(), "not_object").otherwise("ok")
    get = lambda k: F.col(f"r.{k}")
    return df.select(
        *lines.columns, status.alias("status"), F.coalesce(get("type"), F.lit("<missing>")).alias("type"), get("uuid").alias("uuid"), get("parentUuid").alias("parent_uuid"),
        F.coalesce(get("sessionId"), "file_session").alias("session_id"), get("promptId").alias("prompt_id"), get("timestamp").alias("ts"), get("version").alias("version"), get("gitBranch").alias("git_branch"), get("subtype").alias("subtype"),
        get("durationMs").alias("duration_ms"), get("messageCount").alias("message_count"), get("toolUseResult").alias("tool_use_result"), get("isMeta").alias("is_meta"), get("isSidechain").alias("is_sidechain"), get("isCompactSummary").alias("is_compact_summary"),
        get("origin.kind").alias("origin_kind"), get("message.id").alias("message_id"), get("message.model").alias("model"), get("message.stop_reason").alias("stop_reason"),
        get("message.usage.input_tokens").alias("input_tokens"), get("message.usage.output_tokens").alias("output_tokens"), get("message.usage.cache_read_input_tokens").alias("cache_read_tokens"),
        get("message.usage.cache_creation_input_tokens").alias("cache_creation_tokens"), _blocks(get("message.content"), unread).alias("blocks"))


def parse_stats(parsed: DataFrame) -> DataFrame:
    """type, records, unknown; bad lines and lines that are no object under <bad> and <not_object>."""
    kind = F.when(F.col("status") == "ok", F.col("type")).otherwise(F.concat(F.lit("<"), "status", F.lit(">")))
    return parsed.groupBy(kind.alias("type")).agg(F.count("*").alias("records")).withColumn("unknown", ~F.col("type").isin(*KNOWN_TYPES, "<bad>", "<not_object>"))


def captures(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """One capture per JSON file: its columns as a VARIANT, and body, the request's JSON or null; unreadable ones are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path_"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    if last is not None:
        raw = raw.orderBy(F.desc("path_")).limit(last)
    get = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    body = F.coalesce(get("request_body"), F.to_json(get("request_body", "variant")))
    return raw.select(F.col("path_").alias("file"), get("method").alias("method"), get("path").alias("path"), get("status", "int").alias("status"), get("latency_ms", "long").alias("latency_ms"), F.when(F.try_parse_json(body).isNotNull(), body).alias("body"), get("routed_to_local").alias("routed_to_local"), get("local_fallback").alias("local_fallback"))


def run_sessions(lines: DataFrame) -> DataFrame:
    """Distinct session ids of a run ledger, in its three places: the run, its list, its turns."""
    v = F.try_parse_json("line")
    ids = F.array_union(F.array_union(F.array(F.try_variant_get(v, "$.session_id", "string")), F.coalesce(F.try_variant_get(v, "$.session_ids", "array<string>"), F.array().cast("array<string>"))), F.coalesce(F.transform(F.try_variant_get(v, "$.turns", "array<variant>"), lambda t: F.try_variant_get(t, "$.session_id", "string")), F.array().cast("array<string>")))
    return lines.select(F.explode(ids).alias("session_id")).where("session_id IS NOT NULL").distinct()


def run_turns(lines: DataFrame) -> DataFrame:
    """One row per turn of a run ledger: its own turns, or the run itself; the prompt under the first key that has one."""
    def prompt(v: Column) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("prompt", "instruction_text", "instruction", "text", "message")])

    v = F.try_parse_json("line")
    turns = F.coalesce(F.try_variant_get(v, "$.turns", "array<variant>"), F.array(v))
    rows = lines.select(v.alias("v"), F.posexplode(turns).alias("idx", "t"))
    return rows.select(F.coalesce(F.try_variant_get("t", "$.session_id", "string"), F.try_variant_get("v", "$.session_id", "string")).alias("session_id"), "idx", prompt(F.col("t")).alias("text")).where("text IS NOT NULL")


def secret_sessions(text: DataFrame) -> DataFrame:
    """session_id and first_hit (null where unknown) of a secret scan; entries are pairs or bare strings."""
    entries = F.try_variant_get(F.try_parse_json("value"), "$.would_have_pinned", "array<variant>")
    e = text.select(F.explode(entries).alias("e"))
    return e.select(F.coalesce(F.try_variant_get("e", "$[0]", "string"), F.try_variant_get("e", "$", "string")).alias("session_id"), F.try_variant_get("e", "$[1].first_hit_turn_index", "int").alias("first_hit")).where("session_id IS NOT NULL")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any line that is no object of the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def decision_table(lines: DataFrame) -> DataFrame:
    """Rows of five cells of a Markdown table, with the number of their id."""
    cells = F.transform(F.slice(F.split("value", r"\|"), 2, 5), lambda c: F.trim(c))
    return lines.where(F.trim("value").startswith("|") & (F.size(F.split("value", r"\|")) == 7)).select(cells.alias("cells")).withColumn("number", F.regexp_extract(F.col("cells")[0], r"(\d+)", 1).try_cast("int")).where("number IS NOT NULL")


def write_turns(turns: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, or CSV with nested columns as JSON text."""
    if not csv:
        turns.write.mode("overwrite").parquet(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in turns.dtypes]
    turns.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def traces(records: DataFrame, matches: DataFrame, most: int = 5) -> DataFrame:
    """Records of the matched prompts, of at most ``most`` prompts per scenario; a record without a prompt has the last one before it."""
    w = Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = records.withColumn("prompt", F.last("prompt_id", ignorenulls=True).over(w))
    few = matches.withColumn("_n", F.row_number().over(Window.partitionBy("scenario").orderBy("ts", "prompt"))).where(F.col("_n") <= most)
    return filled.join(few.select("scenario", "prompt"), "prompt")
