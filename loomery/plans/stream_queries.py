"""Registered queries over growing files and keyed gates, with their SQL."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import cursor as C
from ..streaming import starts as G
from ..streaming import streams as S

QUERIES, SQL = {}, {}
RECORD = "event_id long, user_id long, event_type string, value double"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def append(rows: DataFrame, folder: str, until: float, files: int = 8) -> None:
    """Renders rows as JSON lines of ``files`` logs up to a share of each log's bytes, wherever that falls; a task owns its logs, and a task that runs twice writes the same bytes."""
    columns = ["event_id", "user_id", "event_type", "value"]
    placed = rows.select(*columns, (F.col("user_id") % files).cast("int").alias("log")).repartition(files, "log").sortWithinPartitions("log", "event_id")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_log, f = None, None  # rows are sorted by log, so one is open at a time; a batch of lines is held, never a log

        def close() -> None:
            with f:
                f.write(b"not a record\n")
                f.truncate(int(f.tell() * until))

        for frame in frames:
            for log, rows in frame.groupby("log", sort=True):
                if log != open_log:
                    if f:
                        close()
                        yield pd.DataFrame({"log": [open_log]})
                    path = f"{folder}/log-{log}.jsonl"
                    os.makedirs(folder, exist_ok=True)
                    open_log, f = log, open(path, "r+b" if os.path.exists(path) else "w+b")  # noqa: SIM115  the same file grows
                lines = (json.dumps(dict(zip(columns, (x.item() if hasattr(x, "item") else x for x in values), strict=True))) for values in rows[columns].itertuples(index=False))
                f.writelines(f"{line}\n".encode() for line in lines)
        if f:
            close()
            yield pd.DataFrame({"log": [open_log]})

    placed.mapInPandas(write, "log int").write.format("noop").mode("overwrite").save()


@query("select 'log-' || (user_id % 8) || '.jsonl' as file, event_id, user_id, event_type, value from events")
def growing_logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as logs that grow twice, the first time into the middle of a line, read by one cursor in two runs."""
    base = S.folder(spark, "growing")
    logs = f"{C.local_path(base)}/logs"
    for until in (0.5, 1.0):
        append(table(spark, d, "events"), logs, until)
        stream = C.growing_records(spark, logs, RECORD).drop("at")
        stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"file string, {RECORD}").parquet(f"{base}/rows")


OUTCOME = "case when event_type = 'error' then 'fail' when event_type = 'purchase' then 'ok' else 'start' end"
#: One step of the recursion for each event of a key: the gate's state goes on from event to event.
GATE_SQL = f"""with recursive e as (select cast(user_id % 50 as varchar) as key, event_id as ord, epoch_us(ts) / 1000000.0 as t, {OUTCOME} as o, row_number() over (partition by user_id % 50 order by ts, event_id) as n from events),
g as (select key, 0::bigint as n, 0::bigint as ord, 'none' as o, 0 as failures, 0::double as until, []::double[] as starts, null::boolean as allowed, null::varchar as reason from (select distinct key from e)
  union all select key, n, ord, o, case o when 'ok' then 0 when 'fail' then failures + 1 else failures end, case o when 'ok' then 0 when 'fail' then t + least(3600, 300 * power(2, failures)) else until end,
    case when o = 'start' and t >= until and len(kept) < 2 then list_append(kept, t) else kept end, case when o = 'start' then t >= until and len(kept) < 2 end, case when o <> 'start' or (t >= until and len(kept) < 2) then null when t < until then 'backoff' else 'max_starts_per_hour' end
  from (select e.key, e.n, e.ord, e.o, e.t, g.failures, g.until, list_filter(g.starts, lambda s: s >= e.t - 3600) as kept from g join e on e.key = g.key and e.n = g.n + 1))
select key, ord, allowed, reason, cast(failures as int) as failures, cast(len(starts) as int) as starts from g where o = 'start'"""


def outcomes(rows: DataFrame) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "ok").otherwise("start")
    return rows.select((F.col("user_id") % 50).cast("string").alias("key"), F.col("event_id").alias("ord"), "ts", outcome.alias("outcome"))


@query(GATE_SQL)
def allowed_starts(spark: SparkSession, d: str) -> DataFrame:
    """Errors as failures, purchases as successes, all else as requests to start, over a table."""
    return G.allowed_starts_batch(outcomes(table(spark, d, "events"))).drop("ts")


@query(GATE_SQL)
def live_starts(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream with state and timers. The state of this query lives in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return S.drain(G.allowed_starts(outcomes(S.table_stream(spark, d, "events"))), "starts").drop("ts")
    finally:
        spark.conf.set(name, before)
