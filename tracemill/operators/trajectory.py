"""Effort of agent trajectories: tool events, commands, paths, times and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of shell commands; a command may be of several.
COMMANDS = {
    "search": r"(?:^|[\s|;&])(rg|grep|find|fd|ls)(?:\s|$)",
    "execution": r"(?:^|[\s|;&])(python(?:3)?|pytest|bash|sh)(?:\s|$)",
    "test": r"pytest|unittest|qa_pipeline|testcase\.py|::test[_A-Za-z]",
    "inspection": r"(?:^|[\s|;&])(cat|sed|head|tail|awk|jq)(?:\s|$)",
    "mutation": r"(?:^|[\s|;&])(rm|mv|cp|mkdir|touch|chmod)(?:\s|$)",
    "install": r"(?:^|[\s|;&])(pip|pip3|apt|apt-get|npm|yarn|pnpm)(?:\s|$)",
    "instrumentation": r"(?i)instrument|sys\.settrace|trace[_-]|coverage|pdb",
}
# The weights of the effort components.
EFFORT_WEIGHTS = {"exploration": 0.25, "execution": 0.25, "deliberation": 0.25, "friction": 0.10, "resources": 0.15}
EVENT = """type string, timestamp string, message struct<content:array<struct<type:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string,text:string>>>,
 duration_ms long, num_turns long, modelUsage map<string,struct<inputTokens:long,outputTokens:long,cacheCreationInputTokens:long,cacheReadInputTokens:long,costUSD:double>>"""


def content_blocks(trajectories: DataFrame) -> DataFrame:
    """(rollout_id, doc) -> one row for each content block in order; broken documents give none."""
    events = trajectories.select("rollout_id", F.posexplode(F.from_json("doc", f"events array<struct<{EVENT.replace(' string', ':string').replace(' long', ':long').replace('message struct', 'message:struct').replace('modelUsage map', 'modelUsage:map')}>>")["events"]).alias("pos", "e"))
    return events.select("rollout_id", "pos", F.to_timestamp("e.timestamp").alias("ts"), F.col("e.type").alias("event"), F.posexplode_outer("e.message.content").alias("block", "b")).select(
        "rollout_id", "pos", "block", "ts", "event", F.col("b.type").alias("kind"), F.col("b.id").alias("tool_id"), F.col("b.name").alias("tool"),
        F.col("b.input").alias("input"), F.col("b.tool_use_id").alias("result_of"), F.coalesce("b.content", "b.text").alias("text"))


def tool_calls(blocks: DataFrame) -> DataFrame:
    """Tool uses with the text of their result, if any came."""
    uses = blocks.where("kind = 'tool_use'").drop("text", "result_of", "kind")
    results = blocks.where("kind = 'tool_result'").groupBy("rollout_id", F.col("result_of").alias("tool_id")).agg(F.min_by("text", F.struct("pos", "block")).alias("result"))
    return uses.join(results, ["rollout_id", "tool_id"], "left")


def path_class(path: Column, root: str = "/testbed") -> Column:
    """By the folder: answer, validation_workspace, question, test_bundle, qa_bundle, workspace_helper, repository or external."""
    p = F.regexp_replace(path, r"\\\\", "/")
    answers, questions, own = p.contains("/validation_answers/"), p.contains("/qa_instances_eval/"), p.startswith(f"{root}/")
    return (
        F.when(path.isNull(), None)
        .when(answers, F.when(p.rlike(r"/answer\.json[/ ]*$"), "answer").otherwise("validation_workspace"))
        .when(questions, F.when(p.endswith("question.json"), "question").when(p.contains("/files/"), "test_bundle").otherwise("qa_bundle"))
        .when(own, F.when(F.substring(p, len(root) + 2, 1 << 30).contains("/"), "repository").otherwise("workspace_helper"))
        .otherwise("external"))


# Suffixes of source files.
SOURCE_SUFFIXES = ["py", "pyi", "js", "jsx", "ts", "tsx", "java", "go", "rs", "rb", "php", "c", "cc", "cpp", "h", "hpp", "cs", "kt", "kts", "scala", "sh", "sql", "toml", "yaml", "yml"]


def is_source(path: Column) -> Column:
    """The last component has a name and a suffix of source files."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)/*$", 1)).isin(SOURCE_SUFFIXES)


# Paths that a redirection or tee names, what else writes a file, and the path that stands for such an answer.
REDIRECTED = r"(?:>>?|\btee(?:\s+-a)?\s+)[ \t]*[\"']?(/testbed/[^\s\"'|;&]+)"
SHELL_WRITE = r"write_text|json\.dump|\bopen\s*\([^)]*,\s*['\"][wax+]|\bcp\s|\bmv\s"
INFERRED_ANSWER = "/testbed/validation_answers/<shell-write>/answer.json"


def written_paths(command: Column) -> Column:
    """Paths that a command writes: those of redirections and tee, and an answer that something else in it writes."""
    named = F.coalesce(F.regexp_extract_all(command, F.lit(REDIRECTED), F.lit(1)), F.array().cast("array<string>"))
    inferred = command.contains("/validation_answers/") & command.rlike(SHELL_WRITE) & ~F.exists(named, lambda p: path_class(p) == "answer")
    return F.when(F.coalesce(inferred, F.lit(False)), F.concat(named, F.array(F.lit(INFERRED_ANSWER)))).otherwise(named)


def command_effort(commands: DataFrame) -> DataFrame:
    """Per rollout: commands, repeated ones, and how many are of each class."""
    return commands.groupBy("rollout_id").agg(
        F.count("*").alias("commands"), (F.count("command") - F.count_distinct("command")).alias("repeated"),
        *[F.count_if(F.col("command").rlike(p)).alias(f"{n}_commands") for n, p in COMMANDS.items()])


def first_times(events: DataFrame, first_tool: Column, first_run: Column, first_answer: Column) -> DataFrame:
    """Seconds from a rollout's start to its first tool, run and answer; never below zero."""
    start = F.min(F.col("ts").cast("timestamp"))
    since = lambda cond: F.greatest((F.unix_micros(F.min(F.when(cond, F.col("ts").cast("timestamp")))) - F.unix_micros(start)) / 1e6, F.lit(0.0))
    seen = lambda cond: F.when(F.count_if(cond) > 0, since(cond))
    return events.groupBy("rollout_id").agg(seen(first_tool).alias("to_tool"), seen(first_run).alias("to_run"), seen(first_answer).alias("to_answer"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Per rollout over its models: context, output and all tokens, and cost; null counters are zero."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    context = zero("input_tokens") + zero("cache_creation") + zero("cache_read")
    return usage.groupBy("rollout_id").agg(
        F.sum(context).alias("context_tokens"), F.sum(zero("output_tokens")).alias("output_tokens"),
        F.sum(context + zero("output_tokens")).alias("total_tokens"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


_USAGE = """modelUsage map<string,struct<inputTokens:double,outputTokens:double,cacheCreationInputTokens:double,cacheReadInputTokens:double,costUSD:double>>,
 usage struct<input_tokens:double,output_tokens:double,cache_creation_input_tokens:double,cache_read_input_tokens:double>, total_cost_usd double"""


def result_usage(results: DataFrame, doc: str = "doc") -> DataFrame:
    """The rows with input_tokens, output_tokens, cache_creation, cache_read and cost of a result document.

    The sums over its models, or, where it names none, its flat usage and total cost; missing numbers are zero.
    """
    rest = [c for c in results.columns if c != doc]
    read = results.select(*rest, F.from_json(doc, _USAGE).alias("_u"))
    models = F.map_values("_u.modelUsage")
    many = F.coalesce(F.size(models) > 0, F.lit(False))

    def total(model: str, flat: str, whole: bool = True) -> Column:
        one = (lambda c: F.floor(F.coalesce(c, F.lit(0.0)))) if whole else (lambda c: F.coalesce(c, F.lit(0.0)))
        zero = F.lit(0).cast("bigint") if whole else F.lit(0.0)
        return F.when(many, F.aggregate(models, zero, lambda a, m: a + one(m[model]))).otherwise(one(F.col(f"_u.{flat}")))

    return read.select(
        *rest, total("inputTokens", "usage.input_tokens").alias("input_tokens"), total("outputTokens", "usage.output_tokens").alias("output_tokens"),
        total("cacheCreationInputTokens", "usage.cache_creation_input_tokens").alias("cache_creation"),
        total("cacheReadInputTokens", "usage.cache_read_input_tokens").alias("cache_read"), total("costUSD", "total_cost_usd", False).alias("cost"))


def raw_effort(rows: DataFrame) -> DataFrame:
    """The five raw effort scores of rollouts, rounded to six digits.

    Columns: tool_calls, files_read and source_files_read (distinct, of the
    repository), read_characters, commands, search_commands, execution_commands,
    test_commands, helper_files (distinct ones written), write_calls, edit_calls,
    messages, thinking_tokens, output_tokens, tool_errors, answer_writes, repeated,
    denials, duration_ms, context_tokens.
    """
    n = F.col
    parts = {
        "exploration": n("tool_calls") + 2 * n("files_read") + 3 * n("source_files_read") + 2 * n("search_commands") + n("read_characters") / 20_000,
        "execution": n("commands") + 2 * n("execution_commands") + 3 * n("test_commands") + 3 * n("helper_files") + n("write_calls") + n("edit_calls"),
        "deliberation": n("messages") + n("thinking_tokens") / 500 + n("output_tokens") / 1000,
        "friction": 3 * n("tool_errors") + 2 * F.greatest(n("answer_writes") - 1, F.lit(0)) + n("repeated") + n("denials"),
        "resources": n("duration_ms") / 60_000 + n("context_tokens") / 100_000,
    }
    return rows.withColumns({k: F.round(v.cast("double"), 6) for k, v in parts.items()})


def solver_reads(log: DataFrame) -> DataFrame:
    """(run_id, text) solver log lines -> run_id, path, first, last of successful file reads."""
    pattern = r"^\[tool\] result read_file ok=True path=(\S+) lines=(\d+)-(\d+)"
    found = lambda k: F.regexp_extract("text", pattern, k)
    return log.where(F.col("text").rlike(pattern)).select("run_id", found(1).alias("path"), found(2).cast("int").alias("first"), found(3).cast("int").alias("last"))
