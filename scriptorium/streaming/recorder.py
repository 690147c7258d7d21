"""Recording of messages as they come, in any order, with a cap on each conversation.

A message's place is its sequence number, and whether it is recorded depends
on those before it alone.  So a message that comes before its turn is held in
the state until the gap is filled, and the result is that of sorted input,
however the messages were shuffled over micro-batches.  A gap is given up when
more is held than may be, or when its time is over where a patience is given:
then what is held goes on, and a message that comes for a place given up is
``late``.  State is bounded by ``max_held`` messages and ``max_held_bytes`` for
each conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..model import HEADING_ROLES, MAX_IMPORT_BYTES, MAX_IMPORT_MESSAGES, MAX_MESSAGE_BYTES

COLUMNS = ["sequence", "role", "content"]
#: Messages recorded, their bytes, the place that is waited for, how many are held, and when waiting ends (0: never).
TOTALS = "messages int, bytes long, next int, held int, until long"
HELD = "role string, content string, size long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def within_caps(sizes: np.ndarray, messages: int, total: int, max_messages: int, max_bytes: int) -> np.ndarray:
    """Which messages are recorded, in order; one that does not fit leaves room for a smaller one after it."""
    if messages + len(sizes) <= max_messages and total + int(sizes.sum()) <= max_bytes:
        return np.ones(len(sizes), bool)
    out = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes.tolist()):
        if messages < max_messages and total + size <= max_bytes:
            out[i], messages, total = True, messages + 1, total + size
    return out


class Recorder(StatefulProcessor):
    """The state of one conversation: its totals, the messages that came too early, and a timer for the gap before them."""

    def __init__(self, max_messages: int, max_bytes: int, max_message: int, max_held: int, max_held_bytes: int, patience_ms: int | None):
        self.max_messages, self.max_bytes, self.max_message = max_messages, max_bytes, max_message
        self.max_held, self.max_held_bytes, self.patience_ms = max_held, max_held_bytes, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.held = handle.getMapState("held", "sequence int", HELD)

    def close(self) -> None:
        pass

    def _waiting(self) -> pd.DataFrame:
        rows = [(k[0], *v) for k, v in self.held.iterator()] if self.held.exists() else []
        return pd.DataFrame(rows, columns=[*COLUMNS, "size"]).assign(old=True)

    def _verdicts(self, key: tuple, rows: pd.DataFrame, accepted, reason) -> pd.DataFrame:
        return pd.DataFrame({"archive_id": key[0], "sequence": rows["sequence"].astype("Int32"), "role": rows["role"], "content": rows["content"], "accepted": accepted, "reason": reason})

    def _go_on(self, key: tuple, pool: pd.DataFrame, totals: tuple, timers, give_up: bool) -> Iterator[pd.DataFrame]:
        """Records what has its turn out of ``pool``, one row for each place in order, and holds the rest."""
        messages, total, awaited, _, until = totals
        places, sizes = pool["sequence"].to_numpy(np.int64), pool["size"].to_numpy(np.int64)
        before, done = awaited, 0
        while True:
            if give_up and done < len(pool):
                awaited, give_up = int(places[done]), False
            # places that follow each other without a gap
            apart = np.flatnonzero(places[done:] != awaited + np.arange(len(pool) - done))
            n = int(apart[0]) if len(apart) else len(pool) - done
            awaited, done = awaited + n, done + n
            if len(pool) - done <= self.max_held and int(np.maximum(sizes[done:], 0).sum()) <= self.max_held_bytes:
                break
            give_up = True
        ready, rest = pool.iloc[:done], pool.iloc[done:]
        # what was refused when it came has no size, and only its place was held
        said = ready[ready["size"] >= 0]
        ok = within_caps(said["size"].to_numpy(np.int64), messages, total, self.max_messages, self.max_bytes)
        for place in ready.loc[ready["old"], "sequence"].tolist():
            self.held.removeKey((int(place),))
        for r in rest[~rest["old"]].itertuples(index=False):
            self.held.updateValue((int(r.sequence),), (r.role, r.content, int(r.size)))
        if until and (rest.empty or awaited != before):
            self.handle.deleteTimer(until)
            until = 0
        if not rest.empty and not until and self.patience_ms is not None:
            until = timers.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(until)
        self.totals.update((messages + int(ok.sum()), total + int(said["size"].to_numpy(np.int64)[ok].sum()), awaited, len(rest), until))
        if len(said):
            yield self._verdicts(key, said, ok, np.where(ok, None, "full"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        totals = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, 0)
        new = pd.concat(list(rows))[COLUMNS].reset_index(drop=True)
        unplaced = new["sequence"].isna() | (new["sequence"] < 0)
        new["size"] = [len(c.encode()) if isinstance(c, str) else -1 for c in new["content"]]
        bad = ~new["role"].isin(HEADING_ROLES) | (new["size"] < 0) | (new["size"] > self.max_message)
        late = ~unplaced & (new["sequence"] < totals[2])
        waiting = self._waiting() if totals[3] else pd.DataFrame(columns=[*COLUMNS, "size", "old"])
        fresh = ~unplaced & ~late
        again = fresh & (new["sequence"].isin(waiting["sequence"]) | new.loc[fresh, "sequence"].duplicated().reindex(new.index, fill_value=False))
        reasons = np.select([unplaced | (bad & ~late & ~again), late, again], ["message", "late", "repeated"], "")
        refused = new[reasons != ""]
        if len(refused):
            yield self._verdicts(key, refused, False, reasons[reasons != ""])
        # a refused message keeps its place, without its text
        kept = new[fresh & ~again].assign(old=False)
        kept.loc[bad, ["role", "content", "size"]] = [None, None, -1]
        pool = pd.concat([waiting, kept]) if len(waiting) else kept
        yield from self._go_on(key, pool.sort_values("sequence"), totals, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        totals = (*self.totals.get()[:4], 0)
        yield from self._go_on(key, self._waiting().sort_values("sequence"), totals, timerValues, True)


def record_stream(
    messages: DataFrame, max_messages: int = MAX_IMPORT_MESSAGES, max_bytes: int = MAX_IMPORT_BYTES, max_message: int = MAX_MESSAGE_BYTES,
    max_held: int = MAX_IMPORT_MESSAGES, max_held_bytes: int = MAX_IMPORT_BYTES, patience_ms: int | None = None,
) -> DataFrame:
    """Messages (archive_id, sequence, role, content) with whether each was recorded, and why not.

    Reasons: ``message`` for an unknown role, no text, more bytes than a message
    may have or no sequence number from 0 on; ``full`` where the conversation's
    caps are reached; ``late`` for a place that was given up or recorded in an
    earlier batch; ``repeated`` for a place that is taken in this batch or held.
    With ``patience_ms`` a timer gives a gap up after so long; such a query runs
    batches without data too, so it ends only when it is stopped, or where the
    session's ``noDataMicroBatches`` are off.  The session's state store becomes
    that of RocksDB, which this operator needs.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    key = messages.schema["archive_id"]
    output = StructType([StructField("archive_id", key.dataType), *StructType.fromDDL("sequence int, role string, content string, accepted boolean").fields, StructField("reason", StringType())])
    recorder = Recorder(max_messages, max_bytes, max_message, max_held, max_held_bytes, patience_ms)
    return messages.select("archive_id", *COLUMNS).groupBy("archive_id").transformWithStateInPandas(recorder, output, "append", "none" if patience_ms is None else "processingTime")


def recorded_messages(recorded: DataFrame) -> DataFrame:
    """(archive_id, sequence, role, content) of the recorded messages, numbered without gaps, as an import has them."""
    place = F.row_number().over(Window.partitionBy("archive_id").orderBy("sequence")) - 1
    return recorded.filter("accepted").select("archive_id", place.alias("sequence"), "role", "content")


def record_once(spark: SparkSession, source: str, target: str, batches: int | None = None, **caps) -> DataFrame:
    """Records what lies in a folder of Parquet files, in ``batches`` micro-batches, and gives the verdicts written to ``target``.

    Without ``batches`` each file is one.  A session of its own has the state
    store, as many state partitions as there are cores, and no batches without
    data, so that it ends; verdicts and checkpoint lie in ``target``, so a run
    that was broken off goes on where it was.  Messages that are still held at
    the end have no verdict.
    """
    own, there = spark.newSession(), spark.read.parquet(source)
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    files = 1 if batches is None else -(-len(there.inputFiles()) // batches)
    stream = own.readStream.schema(there.schema).option("maxFilesPerTrigger", max(files, 1)).parquet(source)
    recorded = record_stream(stream, **caps).writeStream.format("parquet").option("path", f"{target}/verdicts").option("checkpointLocation", f"{target}/checkpoint")
    recorded.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/verdicts")
