"""Log text: files, text columns, and their sidecar metadata."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators.frames import attach_frame
from ..operators.skew import one_per_key
from ..storage import materialize
from . import schemas
from .model import EVENT_COLUMNS, run_row, source_ref

DEFAULT_PIPELINE = "Local pipeline"
DEFAULT_PLATFORM = "local"


def text_lines(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """One log text per row -> ``keys``, seq, line. Numbered inside the row."""
    return df.select(*keys, F.posexplode(parsing.split_lines(text)).alias("pos", "line")).select(
        *keys, F.col("pos").cast("bigint").alias("seq"),
        parsing.right_strip(F.col("line")).alias("line"))


#: Files up to so many bytes that fit one split are read whole, where the name says that they are plain text.
WHOLE_BYTES = 1 << 20
_PLAIN = r"\.(log|txt)$"
#: Bytes of small files that one task reads, unless there are more cores than that.
TASK_BYTES = 1 << 26
FOLDERS_AT_ONCE = 3


@contextmanager
def _plain_listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks a core, not by up to 10,000 that list a few folders each, and the driver tries no types on their names."""
    parallelism = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    settings = {parallelism: str(min(int(spark.conf.get(parallelism)), 8 * spark.sparkContext.defaultParallelism)),
                "spark.sql.sources.partitionColumnTypeInference.enabled": "false"}
    was = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def _few_tasks(files: DataFrame) -> DataFrame:
    """The scan of very many small files in tasks of TASK_BYTES; Spark plans a task for a few files."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.coalesce(max(4 * files.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))


def _file_lines(content: Column) -> Column:
    """The bytes of a file -> array of its non-blank lines, right-stripped, as the text reader gives them.

    It skips a byte order mark and keeps bytes that are no UTF-8; those go through an encoding of one byte a character.
    """
    mark = F.lit(bytes.fromhex("efbbbf"))
    body = F.when(F.substring(content, 1, 3) == mark, F.expr("substring(content, 4)")).otherwise(content)
    bytewise = F.transform(F.split(F.decode(body, "ISO-8859-1"), "\n"), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    text = body.cast("string")
    lines = F.when(F.is_valid_utf8(text), F.split(text, "\n")).otherwise(bytewise)
    return F.filter(F.transform(lines, parsing.right_strip), lambda x: parsing.strip(x) != "")


def _listed(spark: SparkSession, paths: str | list[str], **options: bool) -> DataFrame:
    with _plain_listing(spark):
        return spark.read.format("binaryFile").options(**options).load(paths)


def _whole(spark: SparkSession) -> Column:
    """Whether a file is read whole; those that aren't are left out by their listing, none is opened for it."""
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return (F.col("_metadata.file_size") <= min(WHOLE_BYTES, split)) & F.col("_metadata.file_name").rlike(_PLAIN)


def _path() -> Column:
    return F.col("_metadata.file_path").alias("path")


def _whole_files(files: DataFrame, whole: Column) -> DataFrame:
    """path, length, seq, line of the files read whole; a blank file is one row without a line."""
    return materialize(
        _few_tasks(files.filter(whole).select(_path(), "length", "content"))
        .select("path", "length", F.posexplode_outer(_file_lines(F.col("content"))).alias("pos", "line"))
        .select("path", "length", F.col("pos").cast("bigint").alias("seq"), "line"), "log_files")


def _split_files(spark: SparkSession, paths: str | list[str], whole: Column) -> DataFrame:
    """path, seq, line of all other files.

    Within a split the row order is the line order,
    so a line's number is the count of lines in the earlier splits of its file
    plus its offset in its own split. Only one row per split is aggregated. The
    lines are written once, as opening very many files costs most.
    """
    with _plain_listing(spark):
        texts = spark.read.option("lineSep", "\n").text(paths)
    lines = materialize(
        texts.filter(~whole)
        .select(_path(), F.col("_metadata.file_block_start").alias("split"),
                parsing.right_strip(F.col("value")).alias("line"))
        .filter(parsing.strip(F.col("line")) != "")
        .withColumn("at", F.monotonically_increasing_id()), "log_lines")
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("path", "split").agg(F.min("at").alias("start"), F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("path", "split", (F.col("before") - F.col("start")).alias("shift"))
    )
    return lines.join(splits, ["path", "split"]).select(
        "path", (F.col("at") + F.col("shift")).cast("bigint").alias("seq"), "line")


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Log files -> path, seq, line.

    A small file is one row, numbered inside it. All others are read splittably, without putting a file into one row.
    """
    files, whole = _listed(spark, paths), _whole(spark)
    lines = _whole_files(files, whole).filter(F.col("line").isNotNull()).select("path", "seq", "line")
    if files.filter(~whole).select("path").isEmpty():
        return lines
    return lines.unionByName(_split_files(spark, paths, whole))


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length of every file below ``paths`` (files, folders or globs), empty ones too; no content is read."""
    return _few_tasks(_listed(spark, paths, recursiveFileLookup=True)).select(_path(), "length")


def scan_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length, seq, line of every log file; a blank file is one row without a line."""
    files, whole = _listed(spark, paths), _whole(spark)
    scanned, listed = _whole_files(files, whole), files.select(_path(), "length")
    rest = listed.filter(~whole)
    if not set(files.columns) - {"path", "modificationTime", "length", "content"}:  # folders below that are no partitions
        below = list_files(spark, paths).join(listed.select("path"), "path", "left_anti")
        rest = rest.unionByName(below)
    if rest.isEmpty():
        return scanned
    lines = _split_files(spark, paths, whole).withColumnRenamed("path", "file")
    return scanned.unionByName(
        one_per_key(rest, "path").join(lines, F.col("path") == F.col("file"), "left").drop("file"))


def scan_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``scan_files`` of more files than the driver can list at once: a few folders at a time, so
    that the driver lists some while the tasks read others."""
    with _plain_listing(spark), ThreadPoolExecutor(FOLDERS_AT_ONCE) as threads:
        return reduce(DataFrame.unionByName, threads.map(lambda folder: scan_files(spark, folder), folders))


def parse_lines(lines: DataFrame, frames: bool = True) -> DataFrame:
    """Lines (run_id, platform, seq, line, source) -> log events."""
    line = F.col("line")
    events = lines.select(
        "run_id", "platform", "seq", parsing.parse_timestamp(line).alias("timestamp"),
        parsing.parse_severity(line).alias("severity"), parsing.strip(line).alias("message"),
        "source", F.lit(False).alias("redacted"))
    if frames:
        return attach_frame(events).select(*EVENT_COLUMNS)
    return events.withColumn("code", F.lit(None).cast(parsing.CODE_REF_TYPE)).select(*EVENT_COLUMNS)


def read_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sidecar files -> their values with ``meta_path``."""
    return spark.read.schema(schemas.META).option("multiLine", True).json(paths).select(
        F.col("_metadata.file_path").alias("meta_path"), "*")


def run_meta_join(logs: DataFrame, meta: DataFrame) -> DataFrame:
    """Logs (one row per ``path``) with their sidecar: ``<base>.meta.json``
    first, else ``meta.json`` of the folder, else defaults."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    base = F.regexp_replace("path", r"\.[^./]+$", "")
    own = meta.select(F.col("meta_path").alias("own_path"),
                      F.struct(*[c for c in meta.columns if c != "meta_path"]).alias("own"))
    shared = meta.select(F.col("meta_path").alias("shared_path"),
                         F.struct(*[c for c in meta.columns if c != "meta_path"]).alias("shared"))
    joined = (
        logs.withColumn("folder", folder)
        .withColumn("own_path", F.concat(base, F.lit(".meta.json")))
        .withColumn("shared_path", F.concat("folder", F.lit("meta.json")))
        .join(own, "own_path", "left").join(shared, "shared_path", "left")
        .withColumn("meta", F.coalesce("own", "shared"))
    )
    platform = F.coalesce("meta.platform", F.lit(DEFAULT_PLATFORM))
    return joined.select(
        *run_row(F.col("path"), platform,
                 F.coalesce("meta.pipeline", F.lit(DEFAULT_PIPELINE)), F.lit("failed"),
                 source_ref(platform, F.col("path"), file=F.col("path")),
                 failed_stage=F.col("meta.failedStage"), parameters=F.col("meta.parameters"),
                 baseline_id=F.when(F.col("meta.baseline").isNotNull(),
                                    F.concat("folder", "meta.baseline"))),
        F.col("meta.dependencies").alias("dependencies"),
        F.col("meta.environment").alias("environment"))


def _plain_path(path: Column) -> Column:
    """The path with ``folder/..`` and ``.`` steps resolved, as far as two steps up."""
    out = F.regexp_replace(path, r"/(\./)+", "/")
    for _ in range(2):
        out = F.regexp_replace(out, r"/(?!\.\./)[^/]+/\.\./", "/")
    return out


def link_baselines(runs: DataFrame, files: DataFrame) -> DataFrame:
    """``runs`` whose ``baseline_id`` is a listed file, or null: a missing baseline is no baseline.

    ``shares_metadata`` marks the pair: a sidecar's values describe the run and its baseline
    alike, so such a pair differs in its log alone, whoever else names the same file.
    """
    known = one_per_key(files.select(F.col("path").alias("known")).distinct(), "known")
    found = runs.withColumn("baseline_id", _plain_path(F.col("baseline_id"))).join(
        known, F.col("baseline_id") == F.col("known"), "left")
    return found.withColumn("baseline_id", F.col("known")).drop("known").withColumn(
        "shares_metadata", F.col("baseline_id").isNotNull())


def declared_baselines(runs: DataFrame) -> DataFrame:
    """Baseline runs named by sidecars, one per platform and file: status ``success``, no metadata
    of their own (that is the naming run's, see ``link_baselines``), no baseline."""
    own = ("run_id", "status", "baseline_id", "parameters", "dependencies", "environment", "source_ref", "shares_metadata")
    kept = [c for c in runs.columns if c not in (*own, "platform")]
    named = (
        runs.filter(F.col("baseline_id").isNotNull())
        .groupBy("platform", "baseline_id").agg(F.min_by(F.struct(*kept), "run_id").alias("meta"))
        .select("platform", F.col("baseline_id").alias("run_id"), F.lit("success").alias("status"), "meta.*")
    )
    named = named.join(one_per_key(runs.select("platform", "run_id"), "platform", "run_id"), ["platform", "run_id"], "left_anti")
    named = named.withColumn("source_ref", source_ref(F.col("platform"), F.col("run_id"), file=F.col("run_id")))
    return named.select(*[c if c in named.columns else F.lit(None).cast(runs.schema[c].dataType).alias(c)
                          for c in runs.columns])


def meta_config_explode(runs: DataFrame) -> DataFrame:
    """Sidecar dependencies and environment -> configuration snapshots."""
    snapshots = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("dependencies").alias("kind"),
                 F.col("dependencies").alias("values")),
        F.struct(F.lit(1).alias("ord"), F.lit("environment").alias("kind"),
                 F.col("environment").alias("values")))
    return runs.select("platform", "run_id", F.explode(snapshots).alias("c")).select(
        "platform", "run_id", "c.*").filter(F.col("values").isNotNull())


def scan_logs(spark: SparkSession, log_paths: list[str], meta_paths: list[str],
              baseline_paths: list[str] | None = None
              ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, events, configs) of log files with their sidecars.

    ``log_paths``: the runs, one per file, blank ones too. ``baseline_paths``: files that
    sidecars may name as baselines; they are runs only where they are named.
    Both take files, folders or globs.
    """
    files = list_files(spark, log_paths)
    listed = files
    if baseline_paths:
        baselines = list_files(spark, baseline_paths)
        files = files.join(one_per_key(baselines.select("path"), "path"), "path", "left_anti")
        listed = listed.unionByName(baselines)
    failed = materialize(link_baselines(run_meta_join(files.select("path"), read_meta(spark, meta_paths)), listed), "log_runs")
    runs = failed.unionByName(declared_baselines(failed))
    configs = meta_config_explode(runs)
    lines = read_log_lines(spark, log_paths + (baseline_paths or []))
    stages = runs.select(F.col("run_id").alias("path"), "platform", F.col("failed_stage").alias("source"))
    events = parse_lines(lines.join(stages, "path").withColumnRenamed("path", "run_id"))
    return runs.drop("dependencies", "environment"), events, configs
