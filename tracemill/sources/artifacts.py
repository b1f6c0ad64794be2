"""Run artifacts as tables: JSON documents, answers keyed by their path, trace logs, verdict reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import row_numbers
from ..operators.trace import join_continuations, parse_records, split_tail

# Layouts of answer files below a run, the rollout only in the last.
LAYOUTS = [
    ("llm", r"/evaluation/llm/([^/]+/[^/]+)/([^/]+)/answer\.json$", None),
    ("agent", r"/evaluation/([^/]+-noexec/[^/]+)/([^/]+)/answer\.json$", None),
    ("validation", r"/validation/solver_agent/([^/]+/[^/]+)/([^/]+)/rollout_(\d+)/answer\.json$", 3),
]
VERDICTS = "runs array<struct<validator:string,scope:string,verdicts:array<struct<instance_id:string,passed:boolean,details:struct<pass_count:int,rollouts:array<struct<rollout:int,passed:boolean,reason:string>>>>>>>"


def json_or_default(text: Column, default: str) -> Column:
    """The text where it is JSON, else the default."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.lit(default))


def read_json(spark: SparkSession, path: str, default: str | None = None, name_filter: str = "*.json") -> DataFrame:
    """path, doc: one row a file; a malformed file has the default."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name_filter).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), json_or_default(F.col("value"), default).alias("doc"))


def answer_keys(files: DataFrame) -> DataFrame:
    """path, doc -> run_dir, layout, scope, instance_id, rollout, doc by the layout that the path has; others are dropped."""
    parts = None
    for name, pattern, rollout in LAYOUTS:
        found = files.where(F.col("path").rlike(pattern)).select(
            F.regexp_extract("path", r"^(.*?/run_[^/]+)/", 1).alias("run_dir"), F.lit(name).alias("layout"), F.regexp_extract("path", pattern, 1).alias("scope"),
            F.regexp_extract("path", pattern, 2).alias("instance_id"), (F.regexp_extract("path", pattern, rollout).cast("int") if rollout else F.lit(None).cast("int")).alias("rollout"), "doc")
        parts = found if parts is None else parts.unionByName(found)
    return parts


def log_lines(spark: SparkSession, path: str, names: str = "*.log", packed: bool = False) -> DataFrame:
    """trace_id, pos, text: the lines of all logs; a file is a trace, or holds many as ``write_packed`` leaves them.

    Files are cut into splits of ``spark.sql.files.maxPartitionBytes``, so a log of any
    size is read by many tasks. A line's place comes from where its split begins in the
    file and its place in the split, counted over ranges.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    order = [F.asc("split"), F.asc("row")]
    if packed:  # a trace may go on in the file that is next by name
        name = F.nullif(F.url_decode(F.substring_index("value", "\t", 1)), F.lit(""))
        lines = files.select(name.alias("trace_id"), F.col("_metadata.file_path").alias("file"), *place, F.expr("substring(value, instr(value, '\t') + 1)").alias("text"))
        order = [F.asc("file"), *order]
    else:
        lines = files.select(F.col("_metadata.file_path").alias("trace_id"), *place, F.col("value").alias("text"))
    placed = row_numbers(lines, ["trace_id"], order, "pos")
    return placed.select("trace_id", (F.col("pos") - 1).alias("pos"), "text")


def write_packed(lines: DataFrame, path: str) -> None:
    """trace_id, pos, text -> logs of many traces, each line after the name of its trace and a tab.

    To make, list and open a file for each trace costs more than its lines do where traces
    are short and many; here files grow in number with the lines. Lines are dealt by ranges
    of (trace_id, pos), so a trace of any length is written by many tasks. The null trace has no name.
    """
    name = F.concat(F.coalesce(F.url_encode(F.col("trace_id").cast("string")), F.lit("")), F.lit("\t"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), name))  # its further lines are named too
    lines.repartitionByRange("trace_id", "pos").sortWithinPartitions("trace_id", "pos").select(F.concat(name, text).alias("value")).write.text(path)


def read_traces(spark: SparkSession, path: str, names: str = "*.log", packed: bool = False) -> DataFrame:
    """Events of all trace logs; ``seq`` is the line order of a trace."""
    return split_tail(parse_records(join_continuations(log_lines(spark, path, names, packed))))


def flat_verdicts(reports: DataFrame) -> DataFrame:
    """(run_dir, doc) -> one row a verdict, in run order."""
    runs = reports.select("run_dir", F.posexplode(F.from_json("doc", VERDICTS.replace("runs ", "runs ", 1))["runs"]).alias("run_pos", "r"))
    return runs.select("run_dir", "run_pos", "r.validator", "r.scope", F.explode("r.verdicts").alias("v")).select(
        "run_dir", "run_pos", "validator", "scope", "v.instance_id", "v.passed", "v.details.pass_count", "v.details.rollouts")


def flat_rollouts(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("run_dir", "run_pos", "scope", "instance_id", F.explode("rollouts").alias("r")).select(
        "run_dir", "run_pos", "scope", "instance_id", "r.rollout", "r.passed", "r.reason")


def write_reports(rows: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    """One folder for each value of ``by``."""
    rows.write.partitionBy(*by).format(kind).save(path)
