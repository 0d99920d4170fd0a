"""Readers: Parquet tables, text lines, pair files, logs and structured exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame) -> DataFrame:
    """The column ``text``, else ``story``, else an error; null and empty rows dropped."""
    name = next((c for c in ("text", "story") if c in df.columns), None)
    if name is None:
        raise ValueError(f"neither text nor story among {df.columns}")
    return df.select(F.col(name).alias("text")).filter("text is not null and text <> ''")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, text) of the stripped, non-empty lines of text files, bad bytes replaced; ``ord`` follows the files' path order and the place in each.

    Files are numbered from their listing. Within a file a block's start is before all its lines' numbers and after those of the block before, as a line has a byte at least.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    order = listed.select("path", (F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("_file"))  # a row for each file
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("_place"), F.btrim("value", F.lit(" \t\n\r\x0b\f")).alias("text")).filter("text <> ''")
    return rows.join(F.broadcast(order), "path").select("path", (F.col("_file") * (1 << 40) + F.col("_place")).alias("ord"), "text")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """``lines`` of a file or of a folder's ``.txt`` files; no file or no text is an error."""
    folder = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    if not folder:
        raise ValueError(f"{path}: no text files")
    single = len(folder) == 1 and folder[0]["path"].rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1])
    if not single and not spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path").take(1):
        raise ValueError(f"{path}: no text files")
    rows = lines(spark, path if single else f"{path.rstrip('/')}/*.txt")
    if not rows.take(1):
        raise ValueError(f"{path}: no text")
    return rows


def discover(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Files below a folder by name, without reading them; colliding stems keep the relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    relative = F.regexp_replace(F.expr(f"substring_index(path, '{path.rstrip('/')}/', -1)"), r"\.[^./]*$", "")
    same = F.count(F.lit(1)).over(W.partitionBy(stem))
    return files.select(F.when(same > 1, relative).otherwise(stem).alias("name"), "path", "length")


def catalog(spark: SparkSession, path: str, pattern: str = "*.txt", chars: int = 90, head: int = 4096) -> DataFrame:
    """``discover`` with a preview: the first ``chars`` characters of a file's blank-collapsed start, of which ``head`` bytes are looked at."""
    found = discover(spark, path, pattern)
    starts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = X.collapse(F.decode(F.expr(f"substring(content, 1, {head})"), "UTF-8"))
    return found.join(starts.select("path", F.substring(text, 1, chars).alias("preview")), "path").select("name", "path", "length", "preview")


#: The small corpora that come with the library.
BUILTIN = {
    "minimal": ("cuda training operational step sequence setup complete.", "gpu acceleration optimizes matrix transformations.", "manual backpropagation gradient loops updating parameter histories."),
    "tiny_code": ("def forward pass through neural network layers", "cuda kernel launches gpu accelerated computation", "python manages memory allocation on device", "tensor operations execute in parallel threads", "gpu memory bandwidth limits data transfers"),
    "tiny_english": ("the quick brown fox jumps over the lazy dog", "machine learning trains models on large datasets", "artificial intelligence mimics human intelligence", "neural networks learn patterns from data", "deep learning uses multiple layers for feature extraction"),
}
#: Fixed value: the name that means all text files of the data folder together.
COMBINED = "data_dir"


def builtin(spark: SparkSession, name: str) -> DataFrame:
    """(ord, text) of a small corpus; an unknown name is an error that lists the known ones."""
    if name not in BUILTIN:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(BUILTIN)}")
    return spark.createDataFrame(list(enumerate(BUILTIN[name])), "ord long, text string")


def resolve(spark: SparkSession, config: dict, data_dir: str) -> DataFrame:
    """(ord, text) of a configured dataset: inline corpus, else a path (a file, or a folder combined or by name), else the combined data folder, else a name (built in, else a file's)."""
    if config.get("corpus"):
        return spark.createDataFrame(list(enumerate(config["corpus"])), "ord long, text string")
    combine = bool(config.get("combine")) or config.get("name") == COMBINED
    path, name = config.get("path") or config.get("dataset_path"), config.get("name", "minimal")
    if path:
        files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").limit(2).collect()]
        if len(files) == 1 and files[0].endswith(path.rstrip("/").rsplit("/", 1)[-1]):
            return corpus(spark, path).select("ord", "text")
        data_dir = path
    if combine:
        return corpus(spark, data_dir).select("ord", "text")
    if name in BUILTIN:
        return builtin(spark, name)
    named = discover(spark, data_dir).filter(F.col("name") == name).select("path").take(1)
    if not named:
        raise ValueError(f"unknown dataset {name}; known: {', '.join([*BUILTIN, COMBINED])} and the text files of {data_dir}")
    return corpus(spark, named[0]["path"]).select("ord", "text")


def split_shards(files: DataFrame) -> DataFrame:
    """(path, split) of Parquet files (path) by the prefix of their names, train or valid; others are left out, and a split without files is an error."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    rows = files.select("path", F.when(F.startswith(name, F.lit("valid")), "valid").when(F.startswith(name, F.lit("train")), "train").alias("split")).filter("split is not null and lower(path) like '%.parquet'")
    seen = {r["split"] for r in rows.select("split").distinct().collect()}
    if len(seen) < 2:
        raise ValueError(f"shard listing incomplete: {', '.join(sorted(seen)) or 'nothing'} only")
    return rows.orderBy("path")


def train_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, text) of mixed JSON lines: a record's text if it has one, else the native line of its pair; others are left out."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.from_json("value", T.StructType([*PAIR.fields, T.StructField("text", T.StringType())])).alias("p"))
    user, assistant = F.coalesce("p.query.user", "p.user"), F.coalesce("p.response.assistant", "p.assistant")
    native = F.when((F.trim(user) != "") & (F.trim(assistant) != ""), X.native_line(F.trim(user), F.trim(assistant)))
    return rows.select("ord", F.coalesce(F.nullif(F.trim("p.text"), F.lit("")), native).alias("text")).filter("text is not null")


PAIR = T.StructType([T.StructField("query", T.StructType([T.StructField("user", T.StringType())])), T.StructField("response", T.StructType([T.StructField("assistant", T.StringType())])), T.StructField("user", T.StringType()), T.StructField("assistant", T.StringType())])


def pair_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of JSON lines, nested or flat; several objects on one line all count, junk is skipped.

    Glued objects are parted at ``}{``, which inside a string value would only cost that line.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.explode(F.split(F.regexp_replace("value", r"\}\s*\{", "}\n{"), "\n")).alias("one"))
    return parse_pairs(rows)


def parse_pairs(rows: DataFrame) -> DataFrame:
    p = rows.select("ord", F.from_json("one", PAIR).alias("p"))
    both = p.select("ord", F.trim(F.coalesce("p.query.user", "p.user")).alias("user"), F.trim(F.coalesce("p.response.assistant", "p.assistant")).alias("assistant"))
    return both.filter("user <> '' and assistant <> ''")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """``.jsonl`` as JSON pairs, anything else as native lines, ``#`` comments skipped."""
    if path.endswith(".jsonl"):
        return pair_lines(spark, path)
    user, assistant = X.split_native(F.col("text"))
    return lines(spark, path).filter("text not like '#%'").select("ord", user.alias("user"), assistant.alias("assistant")).filter("user is not null")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a JSON array of questions; a missing or unreadable file holds none."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "key string")
    raw = text.select(F.explode(F.from_json("value", "array<string>")).alias("q"))
    return raw.select(X.question_key(F.col("q")).alias("key")).filter("key <> ''").distinct()


def aliases(spark: SparkSession, path: str, index: DataFrame, banned: DataFrame) -> DataFrame:
    """(alias, key) of a JSON object whose targets are known and not quarantined; first mapping wins."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e"))
    keyed = raw.select("ord", X.question_key(F.col("e.key")).alias("alias"), X.question_key(F.col("e.value")).alias("key"))
    known = keyed.join(index.select("key"), "key", "left_semi").join(banned, "key", "left_anti")
    return known.groupBy("alias").agg(F.min_by("key", "ord").alias("key"))


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each file."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("file").orderBy(F.desc("ord")))).filter(F.col("_r") <= n).drop("_r")
