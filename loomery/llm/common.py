"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: The ASCII characters that part words.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """The words of the lower-cased text, by WORD. Translating and splitting at blanks costs a fifth of a regular expression's matches."""
    spaced = F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` would also change letters beyond ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only for a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="loomery-")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: A key is hot with more than this share of all rows, so there are at most as many hot keys as its inverse.
HOT_SHARE = 1e-4


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int, how: str = "inner", least: int = 500, share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row for each ``key``, with its number ``n`` of rows) without a task for each hot key.

    Keys of over ``share`` of the ``total`` rows (and over ``least``) are broadcast, 1 / share of them at most; the others are shuffled.
    """
    bound = max(least, total * share)
    hot = materialize(keyed.filter(F.col(n) > bound))
    if not hot.take(1):
        return rows.join(keyed.drop(n), key, how)
    few = F.broadcast(hot.drop(n))  # at most 1 / share rows
    cold = rows.join(few.select(key), key, "left_anti").join(keyed.filter(F.col(n) <= bound).drop(n), key, how)
    return rows.join(few, key).select(cold.columns).unionByName(cold)
