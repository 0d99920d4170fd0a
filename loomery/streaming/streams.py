"""Structured Streaming: tails of record files, harvests, key states, live runs, diagnostics and learned facts.

The checkpoint of a query is its offset: a file is read once, a new file is new data. Grouped state is small and of fixed size per
key; the rows of a key in one micro-batch are ordered in memory, which ``maxBytesPerTrigger`` bounds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import pairs as P

#: The classes of answers worth training on again.
RETRAIN = ("TARGET_MISMATCH", "BINDING_ENTITY_SWAP", "TEMPLATE_NEIGHBOUR_SWAP")
RECORD = "typed_question string, canonical_question string, expected string, classification string"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only for a local master, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomery-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """A table as a stream. The pattern makes a single file as good as a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON records of the closed files in a folder, lines that don't parse skipped."""
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*").dropna("all")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream has now, written as Parquet with exactly-once commits and read again."""
    base = folder(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def pend(stream: DataFrame, pending: str, checkpoint: str) -> StreamingQuery:
    """X2, first half: records worth training on, one folder a batch, so that a batch run twice is written once."""

    def put(batch: DataFrame, i: int) -> None:
        keyed = batch.filter(F.col("classification").isin(*RETRAIN)).withColumn("key", T.question_key(F.coalesce("canonical_question", "typed_question"))).filter("key <> ''")
        at = F.struct(F.lit(i).cast("long").alias("nth"), F.monotonically_increasing_id().alias("place"))
        keyed.withColumn("ord", at).write.mode("overwrite").parquet(f"{pending}/batch={i}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def harvest(pending: DataFrame, done: DataFrame, ready: int = 5, most: int = 40) -> DataFrame:
    """X2, second half: the first pending row of each key that is neither consumed nor poisoned (``done``: key), oldest first.

    At most ``most``, and none if fewer than ``ready`` wait. Rows beyond ``most`` stay pending; the reference loses them.
    """
    first = P.first_per(pending.join(done.select("key").distinct(), "key", "left_anti"), "key")
    taken = first.orderBy("ord").limit(most)
    return taken.limit(0) if first.limit(ready).count() < ready else taken


KEYS = "key long, ord long, consumed boolean, poison boolean, retries int, reason string"


def key_states(outcomes: DataFrame, most: int = 2) -> DataFrame:
    """The state of each key after each outcome (key, ord, outcome, and optionally reason).

    ``promoted`` consumes and lifts poison with its reason, ``crash`` poisons, ``gate_fail`` counts and poisons at ``most`` (its reason behind ``gate:``), counting anew after that.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        consumed, poison, retries, why = state.get if state.exists else (False, False, 0, None)
        out = []
        for at, outcome, reason in pd.concat(frames).sort_values("ord")[["ord", "outcome", "reason"]].itertuples(index=False):
            retries = retries + 1 if outcome == "gate_fail" else 0
            if outcome == "promoted":
                consumed, poison, why = True, False, None
            elif outcome == "crash":
                poison, why = True, reason
            elif retries >= most:
                poison, retries, why = True, 0, f"gate:{reason}"
            out.append((key[0], at, consumed, poison, retries, why))
        state.update((consumed, poison, retries, why))
        yield pd.DataFrame(out, columns=["key", "ord", "consumed", "poison", "retries", "reason"]).astype({"reason": "object"})

    rows = outcomes if "reason" in outcomes.columns else outcomes.withColumn("reason", F.lit(""))
    return rows.groupBy("key").applyInPandasWithState(update, KEYS, "consumed boolean, poison boolean, retries int, reason string", "append", GroupStateTimeout.NoTimeout)


#: Rows that are put out at a time.
ROWS = 10_000
LIVE = "file string, run long, ord long, step long, action string, ema double"
STATE = "run long, step long, nth long, best double, best_at long, ema double, recent array<double>"


def live_runs(rows: DataFrame, ratio: float = 1.5, patience: int = 4, max_steps: int = 600, gap: int = 2000, alpha: float = 0.3) -> DataFrame:
    """Rows (file, ord, step, loss) as they arrive, with run, decision and exponential mean; equal to the batch operators."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, last, nth, best, best_at, ema, recent = state.get if state.exists else (0, None, 0, None, 0, None, [])
        recent, out, columns = list(recent), [], ["file", "run", "ord", "step", "action", "ema"]
        # Of a batch's rows three numbers each are held; they are put out in pieces.
        parts = [[f[c].to_numpy() for c in ("ord", "step", "loss")] for f in frames]
        held = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        for i in np.argsort(held[0], kind="stable"):
            at, step, loss = (x[i] for x in held)
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=columns).astype({"ema": "float64"})
                out = []
            if last is not None and (step < last or step - last > gap):
                run, nth, best, best_at, ema, recent = run + 1, 0, None, 0, None, []
            last = step
            if loss is None or loss != loss:
                out.append((key[0], run, at, step, "non_finite", ema))
                continue
            loss, nth = float(loss), nth + 1
            recent = [*recent, loss][-5:]
            middle = sorted(recent)
            median = (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2
            better = best is None or loss < best
            if median > 0 and loss > ratio * median:
                action = "spike"
            elif step >= max_steps:
                action = "max_steps"
            elif nth - 1 - best_at >= patience:
                action = "early_stop"
            else:
                action = "promote" if better else "continue"
            ema = loss if ema is None else loss * alpha + ema * (1 - alpha)
            if better:
                best, best_at = loss, nth
            out.append((key[0], run, at, step, action, ema))
        state.update((int(run), int(last), int(nth), best, int(best_at), ema, recent))
        yield pd.DataFrame(out, columns=columns).astype({"ema": "float64"})

    return rows.groupBy("file").applyInPandasWithState(update, LIVE, STATE, "append", GroupStateTimeout.NoTimeout)


def learned(found: DataFrame, index: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Pairs (user, ...) of a stream whose key neither the index (key) nor an earlier batch holds, each key once.

    What was learned lies in ``store``, a folder a batch, and not in the state of the stream. A batch that runs twice reads only
    the batches before it, so it writes the same keys again.
    """
    known = index.select("key")

    def put(batch: DataFrame, i: int) -> None:
        keyed = batch.withColumn("key", T.question_key(F.col("user"))).filter("key <> ''").dropDuplicates(["key"]).join(known, "key", "left_anti")
        if i:
            earlier = batch.sparkSession.read.schema("key string, batch long").parquet(store).filter(F.col("batch") < i)
            keyed = keyed.join(earlier.select("key"), "key", "left_anti")
        keyed.write.mode("overwrite").parquet(f"{store}/batch={i}")

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def diagnose(turns: DataFrame, facts: DataFrame, all_turns: str, retrain: str, checkpoint: str) -> StreamingQuery:
    """A record for each turn (typed, generated) with a known question; those that don't match go to ``retrain`` too.

    Facts (ord, user, assistant) that share a key count once, by their first answer.
    """
    known = P.build_index(facts).select("key", F.col("assistant").alias("expected"))
    scored = turns.withColumn("key", T.question_key(F.col("typed"))).join(known, "key").withColumn("match", F.coalesce(T.answers_match(F.col("expected"), F.col("generated")), F.lit(False)))

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{all_turns}/batch={i}")
        batch.sparkSession.read.parquet(f"{all_turns}/batch={i}").filter("not match").write.mode("overwrite").parquet(f"{retrain}/batch={i}")

    return scored.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
