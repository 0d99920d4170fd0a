"""Readers of what runs leave behind: metric exports of any schema, stage artefacts, decisions, fixtures, and the registry of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import number
from .tables import tail

#: Per stage the artefact's file, the label of its row, the paths of its four cells, and the path that must be there (if not the file alone).
STAGES = (
    ("stage31_baseline.json", "3.1 train", ("$.runtime.tokens_per_sec", "$.runtime.step_ms", "$.memory.device_used_mb", "$.quality.train_loss"), None),
    ("stage32_kv_generate.json", "3.2 generate KV", ("$.after_kv.tokens_per_sec", "$.after_kv.wall_s", "$.after_kv.kv_peak_mb", "$.speedup"), None),
    ("stage33_bpe_protocol.json", "3.3 BPE chars/tok", ("$.bpe.chars_per_token", "$.bpe.step_ms_mean", "$.bpe.vocab_size", "$.bpe.train_loss_last"), None),
    ("stage34_activation_account.json", "3.4 activations", ("$.largest_activation_bucket", "$.activation_cache_mb", "$.device_used_mb_after_forward", "$.parameter_mb"), None),
    ("stage35_fp16_storage.json", "3.5 FP16 storage", ("$.estimated_activation_savings_mb", "$.lm_head_grad_maxdiff", "$.parity_ok", "$.loss_fp16_storage_path"), None),
    ("stage36_allocator.json", "3.6 allocator", ("$.allocator_stats.reuse_count", "$.allocator_stats.alloc_count", "$.allocator_stats.peak_live_bytes", "$.reuse_observed"), None),
    ("stage37_timeline_meta.json", "3.7 timeline", ("$.summary.event_count", "$.summary.total_ms", "$.summary.by_name_ms", "$.timeline_path"), None),
    ("stage311_cuda_graph.json", "3.11 CUDA Graph", ("$.gpu_only_cast_graph.mode", "$.gpu_only_cast_graph.replay_ms", "$.decode_capture.mode", "$.decode_capture.reason"), None),
    ("stage34_activation_account.json", "3.9 process VRAM", ("$.device_used_mb_after_forward", "$.vram_driver_used_mb", "$.vram_source", "$.vram_source"), "$.vram_source"),
    ("stage35_fp16_storage.json", "3.10 FP16 device cast", ("$.cast_path", "$.parity_ok", "$.lm_head_grad_maxdiff", "$.estimated_activation_savings_mb"), "$.cast_path"),
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def _metrics(rows: DataFrame) -> DataFrame:
    """(file, ord, step, ...) of a read export: step above 0, every other column as a number."""
    step = F.col("step").cast("string").try_cast("long") if "step" in rows.columns else F.lit(None).cast("long")
    plain = lambda f: F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast("string")
    values = [number(plain(f)).alias(f.name) for f in rows.schema if f.name not in ("step", "_file", "_ord", "_corrupt_record")]
    return rows.select(F.col("_file").alias("file"), F.col("_ord").alias("ord"), step.alias("step"), *values).filter("step > 0")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_file": file_name(F.col("_metadata.file_path")), "_ord": F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)})


def read_json(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, ord, step, metrics) of JSON lines by the fields that any of them has; lines that don't parse are dropped."""
    rows = _placed(spark.read.option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").json(path))
    return _metrics(rows)


def read_csv(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same of CSV files, each by its own header; short lines have nulls. The driver holds a header for each file."""
    first = spark.read.option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("f"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    heads: dict[str, list[str]] = {}
    for r in first.groupBy("f").agg(F.min_by("value", "at").alias("head")).collect():
        heads.setdefault(r["head"], []).append(r["f"])
    parts = []
    for head, files in sorted(heads.items()):
        schema = T.StructType([T.StructField(c.strip().strip('"'), T.StringType()) for c in head.split(",")])
        parts.append(_metrics(_placed(spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(sorted(files)))))
    return united(parts or [spark.createDataFrame([], "file string, ord long, step long")])


def united(parts: list[DataFrame]) -> DataFrame:
    """Tables of unlike columns as one, by name; what a table doesn't have is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def structured(spark: SparkSession, folder: str, last: int | None = None) -> DataFrame:
    """(file, ord, step, every metric) of a folder's ``.jsonl`` and ``.csv`` exports, whatever their columns, without records of no step above 0.

    ``last`` keeps each file's last records.
    """
    kinds = {r[0] for r in spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\.[^./]+)$", 1)).distinct().collect()}
    parts = [f(spark, folder, f"*{k}") for k, f in ((".jsonl", read_json), (".csv", read_csv)) if k in kinds]
    rows = united(parts or [spark.createDataFrame([], "file string, ord long, step long")])
    return tail(rows, last) if last else rows


def losses(rows: DataFrame) -> DataFrame:
    """(file, ord, step, loss), the first of ``loss`` and ``avg_loss`` that is known."""
    given = [F.col(c) for c in ("loss", "avg_loss") if c in rows.columns]
    return rows.select("file", "ord", "step", (F.coalesce(*given) if given else F.lit(None).cast("double")).alias("loss")).filter("loss is not null")


def preferred(logs: DataFrame, exports: DataFrame, *keys: str) -> DataFrame:
    """The rows of logs, and those of exports whose key no log has."""
    return logs.unionByName(exports.join(logs.select(*keys).distinct(), list(keys), "left_anti"))


def json_files(spark: SparkSession, root: str, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, value) of small JSON files, each whole; files that don't parse are left out."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), "value").filter(F.get_json_object("value", "$").isNotNull())


def stage_table(spark: SparkSession, folder: str, stages: tuple = STAGES) -> DataFrame:
    """(nth, stage, a, b, c, d) of a folder's artefacts; missing and unreadable ones have no row."""
    rows = json_files(spark, folder, "*.json", False).withColumn("file", file_name(F.col("path")))
    cells = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(file).alias("of"), F.lit(label).alias("stage"), *[F.get_json_object("value", p).alias(k) for k, p in zip("abcd", paths, strict=True)], (F.lit("") if need is None else F.get_json_object("value", need)).alias("need")) for i, (file, label, paths, need) in enumerate(stages)])
    found = rows.select("file", F.explode(cells).alias("x")).filter("x.of = file and x.need is not null")
    return found.select("x.nth", "x.stage", "x.a", "x.b", "x.c", "x.d").orderBy("nth")


def decisions(spark: SparkSession, path: str, last: int = 80) -> DataFrame:
    """(file, ord, record) of the last lines of decision files that are JSON objects; ``record`` maps keys to texts."""
    rows = spark.read.text(path).select(file_name(F.col("_metadata.file_path")).alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("ord"), F.trim("value").alias("line"))
    return tail(rows, last).filter("line like '{%'").select("file", "ord", F.from_json("line", "map<string,string>").alias("record")).filter("record is not null and size(record) > 0")


def fixture(spark: SparkSession, path: str) -> DataFrame:
    """(query, intent, canonical) of the lines that have a query; a line that is no JSON is an error when it is read."""
    return spark.read.schema("query string, intent string, canonical string").option("mode", "FAILFAST").json(path).filter("query <> ''")


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Events (ord, pool, event, key, nbytes) of a memory timeline, as ``reports.residency`` takes them."""
    rows = spark.read.schema("pool string, event string, key string, nbytes long").json(path)
    return rows.select((F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("ord"), "pool", "event", "key", "nbytes")


def runs(spark: SparkSession, root: str, facts: str | None = None, default_facts: str = "facts.jsonl", weights: str = "weights.npz") -> DataFrame:
    """(id, name, title, bytes, chat, step, epoch, metrics, facts) of each folder below ``root`` that holds weights, by name.

    Config, state and metrics files join by their folder; the title is the configured name, else the folder's. Facts: the recorded path if it is a file of ``facts``, else the
    file there named like the run, else the default. Files are listed without reading weights.
    """
    base = root.rstrip("/")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", weights).load(root).select(folder_of(F.col("path")).alias("folder"), F.col("length").alias("bytes"))
    found = held.groupBy("folder").agg(F.max("bytes").alias("bytes"))
    for name in ("config", "state", "metrics"):
        side = json_files(spark, root, f"{name}.json").select(folder_of(F.col("path")).alias("folder"), F.col("value").alias(name))
        found = found.join(side, "folder", "left")
    clean = lambda p: F.regexp_replace(p, r"^file:(?://)?", "")
    name = file_name(F.col("folder"))
    title = F.coalesce(F.nullif(F.trim(F.get_json_object("config", "$.model.name")), F.lit("")), name)
    rel = F.regexp_replace(F.expr(f"substring(folder, instr(folder, '{base.removeprefix('file://')}') + {len(base.removeprefix('file://')) + 1})"), "^$", ".")
    out = found.select(rel.alias("id"), name.alias("name"), title.alias("title"), "bytes", (F.contains(F.lower(name), F.lit("chat")) | F.contains(F.lower(title), F.lit("chat"))).alias("chat"), F.get_json_object("state", "$.step").try_cast("long").alias("step"), F.get_json_object("state", "$.epoch").try_cast("long").alias("epoch"), F.from_json("metrics", "map<string,string>").alias("metrics"), F.trim(F.get_json_object("config", "$.dataset.path")).alias("recorded"))
    if facts is None:
        return out.select("*", F.lit(default_facts).alias("facts")).drop("recorded").orderBy("name", "id")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(facts).select(clean(F.col("path")).alias("path"))
    by_path, by_name = listed.select("path", F.col("path").alias("own")), listed.groupBy(F.regexp_replace(file_name(F.col("path")), r"\.jsonl$", "").alias("name")).agg(F.min("path").alias("named"))
    out = out.join(by_path, clean(F.col("recorded")) == F.col("path"), "left").drop("path").join(by_name, "name", "left")
    return out.select("id", "name", "title", "bytes", "chat", "step", "epoch", "metrics", F.coalesce("own", "named", F.lit(default_facts)).alias("facts")).orderBy("name", "id")
