"""Registered queries over exports and runs' folders that are written from events and read back, with their SQL."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import exports as X
from ..sources.tables import table
from ..streaming.cursor import local_path
from ..streaming.streams import folder

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""with e as (select *, event_id % 3 as kind, event_id % 500 as step from events where event_id % 500 > 0)
select kind, event_id, step, case when kind <> 2 and event_id % 7 <> 0 then round(value, 4) end as loss, case when kind = 0 then event_id % 10 / 10.0 end as lr, case when kind = 1 then cast(event_id % 90 as double) end as tok_s, case when kind = 2 then round(value, 4) end as avg_loss,
  case when kind = 2 and event_id % 5 <> 0 then round(value * 2, 4) end as grad_norm, case when kind <> 2 and event_id % 7 = 0 then null when kind = 2 then round(value, 4) else round(value, 4) end as first_loss from e""")
def ragged_exports(spark: SparkSession, d: str) -> DataFrame:
    """Events as two JSON exports of unlike fields and a CSV one, read as one table."""
    base, i = folder(spark, "exports"), F.col("event_id")
    e = table(spark, d, "events").withColumns({"step": i % 500, "v": F.round("value", 4), "w": F.round(F.col("value") * 2, 4)})
    known = F.when(i % 7 != 0, F.col("v"))
    sets = (("json", e.filter(i % 3 == 0).select("event_id", "step", known.alias("loss"), (i % 10 / 10).alias("lr"))), ("json", e.filter(i % 3 == 1).select("event_id", "step", F.coalesce(known.cast("string"), F.lit("nan")).alias("loss"), (i % 90).alias("tok_s"), F.struct(F.lit("x").alias("note")).alias("notes"))), ("csv", e.filter(i % 3 == 2).select("step", "event_id", F.col("v").alias("avg_loss"), F.when(i % 5 != 0, F.col("w")).alias("grad_norm"))))
    for n, (kind, rows) in enumerate(sets):
        if kind == "json":
            rows.select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "none").text(f"{base}/{n}")
        else:
            rows.write.option("header", True).csv(f"{base}/{n}")
    # The writers' own folders, by what they hold.
    parts = [X.read_json(spark, f"{base}/0"), X.read_json(spark, f"{base}/1"), X.read_csv(spark, f"{base}/2")]
    rows = X.united(parts)
    loss = F.coalesce("loss", "avg_loss")
    return rows.select((F.col("event_id").cast("long") % 3).alias("kind"), F.col("event_id").cast("long").alias("event_id"), "step", "loss", "lr", "tok_s", "avg_loss", "grad_norm", loss.alias("first_loss"))


RUN = "user_id % 50"


@query(f"""with r as (select {RUN} as r, count(*) as n, max(event_id) as step, round(avg(value), 4) as loss from events group by 1)
select 'group-' || r % 3 || '/run-' || r as id, 'run-' || r as name, case when r % 4 = 0 then 'Chat model ' || r when r % 4 = 1 then 'run-' || r else 'Model ' || r end as title, n * 1 as bytes, r % 4 = 0 as chat, case when r % 5 <> 0 then step end as step, loss,
  case when r % 4 <> 1 and r % 3 = 0 then 'own-' || r || '.jsonl' when r % 7 = 0 then 'run-' || r || '.jsonl' else 'facts.jsonl' end as facts from r""")
def run_registry(spark: SparkSession, d: str) -> DataFrame:
    """Fifty runs in nested folders with weights as large as their events, some without config or state, read as a registry."""
    base = f"{local_path(folder(spark, 'registry'))}"
    per = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("step"), F.round(F.avg("value"), 4).alias("loss"))

    def put(path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r, n, step, loss in frame[["r", "n", "step", "loss"]].itertuples(index=False):
                home, own = f"{base}/runs/group-{r % 3}/run-{r}", f"{base}/data/deep/own-{r}.jsonl"
                put(f"{home}/weights.npz", b"0" * int(n))
                title = f"Chat model {r}" if r % 4 == 0 else "" if r % 4 == 1 else f"Model {r}"
                put(f"{home}/config.json", b"{broken" if r % 4 == 1 else json.dumps({"model": {"name": title}, "dataset": {"path": own}}).encode())
                put(f"{home}/metrics.json", json.dumps({"loss": float(loss)}).encode())
                if r % 5:
                    put(f"{home}/state.json", json.dumps({"step": int(step)}).encode())
                if r % 3 == 0:
                    put(own, b"{}")
                if r % 7 == 0:
                    put(f"{base}/data/run-{r}.jsonl", b"{}")
            yield pd.DataFrame({"r": frame["r"]})

    per.mapInPandas(write, "r long").write.format("noop").mode("overwrite").save()
    found = X.runs(spark, f"{base}/runs", facts=f"{base}/data")
    return found.select("id", "name", "title", "bytes", "chat", "step", F.col("metrics")["loss"].cast("double").alias("loss"), X.file_name(F.col("facts")).alias("facts"))
