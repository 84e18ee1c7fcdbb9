"""The event log as a stream: breach, recovered and silenced as ticks arrive.

A key's state is five numbers. It lives in RocksDB on the executors, not on their heap,
so the number of keys is not bounded by memory, and it goes when its time to live is
over. Within a micro-batch a key's ticks are taken in order, whatever order they arrive
in; a tick that is before one of an earlier micro-batch is late: it changes nothing and
is told as such, so nothing is lost unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "key string, kind string, at long, seq long, held_ms long, suppressed boolean"
STATE = "firing boolean, since long, last_fired long, last_at long, last_seq long"
_FRESH = (False, -1, -1, -(2**63), -(2**63))
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EdgeProcessor(StatefulProcessor):
    def __init__(self, cooldown: int, live_ms: int | None) -> None:
        self.cooldown, self.live_ms = cooldown, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("edge", STATE, self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get() if self.state.exists() else None
        firing, since, last, at_before, seq_before = found or _FRESH
        ticks = sorted((t for pdf in rows for t in zip(pdf["at"].tolist(), pdf["seq"].tolist(), pdf["fires"].tolist(), pdf["enabled"].tolist())), key=lambda t: t[:2])
        out = []
        for at, seq, fires, enabled in ticks:
            if (at, seq) < (at_before, seq_before):
                out.append((key[0], "late", at, seq, None, False))
                continue
            at_before, seq_before = at, seq
            if not enabled:
                if firing:
                    out.append((key[0], "silenced", at, seq, at - since, False))
                    firing = False
            elif fires is None or fires != fires or bool(fires) == firing:
                continue
            elif fires:
                out.append((key[0], "breach", at, seq, None, last >= 0 and at - last < self.cooldown))
                firing, since, last = True, at, at
            else:
                out.append((key[0], "recovered", at, seq, at - since, False))
                firing = False
        self.state.update((bool(firing), int(since), int(last), int(at_before), int(seq_before)))
        yield pd.DataFrame(out, columns=["key", "kind", "at", "seq", "held_ms", "suppressed"]).astype({"held_ms": "Int64", "suppressed": bool})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that begin after this keep their state in RocksDB, which they need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def edge_stream(ticks: DataFrame, cooldown: int = 0, live_ms: int | None = None) -> DataFrame:
    """Events of a stream of ticks (key string, at long, fires boolean, enabled boolean, and
    seq long where `at` alone is no order), in the order of (at, seq).

    A tick that is not armed (`fires` null) keeps the state, one that is disabled while
    firing silences it. A key of which nothing comes for `live_ms` begins anew.
    """
    use_rocksdb(ticks.sparkSession)
    ticks = ticks if "seq" in ticks.columns else ticks.withColumn("seq", F.lit(0).cast("long"))
    return ticks.groupBy("key").transformWithStateInPandas(EdgeProcessor(cooldown, live_ms), EVENT, "Append", "ProcessingTime" if live_ms else "None")


def replay(events: DataFrame, folder: str, name: str, wait_s: float | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns the events it wrote; a run that
    breaks off goes on from its checkpoint in the same folder. A stream with a time to live
    looks at its clock for ever: it is stopped after `wait_s` seconds."""
    query = events.writeStream.format("parquet").option("path", f"{folder}/{name}-events").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(wait_s)
    query.stop()
    return events.sparkSession.read.schema(events.schema).parquet(f"{folder}/{name}-events")
