"""Streaming probes: incidents from status changes and windowed counts; late and repeated probes end where they belong."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ledgerline.operators.incidents import incident_intervals
from ledgerline.operators.jobs import latest_per_key
from ledgerline.streaming.epochs import compact, read_epochs, write_epoch

#: Seconds of a part of a link's time; a busy link is spread over as many parts as it has times.
PART_SECONDS = 6 * 3600
#: Micro-batches after which epochs are folded.
FOLD_EVERY = 16
_COUNTS = "start timestamp, status string, n bigint"
_RUNS = "link_id string, part bigint, seen bigint, runs array<struct<at: bigint, probe_id: bigint, status: string>>"


#: A probe as kept in state.
_PROBE = np.dtype([("at", "<i8"), ("probe_id", "<i8"), ("up", "?")])


class _Runs(StatefulProcessor):
    """State of one part of a link: its probes by (time, id), in one value, so that a micro-batch reads and writes it once however
    many probes it brings.  New probes give the part's runs of equal status anew."""

    def init(self, handle) -> None:
        self.probes = handle.getValueState("probes", "packed binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = self.probes.get()
        known = np.frombuffer(bytes(held[0]), _PROBE) if held is not None else np.empty(0, _PROBE)
        came = np.array([(row["at"], row["probe_id"], row["status"] == "UP") for row in rows], _PROBE)
        both = np.concatenate([known, came])
        both = both[np.lexsort((np.arange(len(both)), both["probe_id"], both["at"]))]  # of a probe that comes again the first counts
        first = np.ones(len(both), bool)
        first[1:] = (both["at"][1:] != both["at"][:-1]) | (both["probe_id"][1:] != both["probe_id"][:-1])
        seen = both[first]
        if len(seen) == len(known):
            return
        self.probes.update((seen.tobytes(),))
        change = np.ones(len(seen), bool)
        change[1:] = seen["up"][1:] != seen["up"][:-1]
        yield Row(link_id=key[0], part=key[1], seen=len(seen), runs=[Row(at=a, probe_id=b, status="UP" if up else "DOWN") for a, b, up in seen[change].tolist()])

    def close(self) -> None:
        pass


def status_runs(probes: DataFrame) -> DataFrame:
    """Runs of equal status by link and part of its time, for each part that a micro-batch brings new probes of.

    A late probe changes its own part only, whatever the length of the history; a repeated one changes nothing.  ``seen``, the number
    of probes known, grows with each change, so the row with the largest is current.
    """
    probes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = probes.filter(F.col("status").isin("UP", "DOWN") & F.col("link_id").isNotNull() & F.col("ts").isNotNull() & F.col("probe_id").isNotNull())
    part = F.floor(F.unix_timestamp("ts") / PART_SECONDS).cast("bigint")
    keyed = known.select("link_id", part.alias("part"), F.unix_micros("ts").alias("at"), "probe_id", "status").groupBy("link_id", "part")
    return keyed.transformWithState(_Runs(), _RUNS, "Update", "None")


def probe_incidents_stream(probes: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Keep the runs behind the incidents of a probe stream (link_id, probe_id, ts, status), in any order of arrival.

    A repeated micro-batch rewrites its own epoch.  Probes without link, time or id, or of an unknown status, say nothing.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, f"{folder}/runs", epoch)
        if epoch and epoch % FOLD_EVERY == 0:
            compact(batch.sparkSession, f"{folder}/runs", _RUNS, _newest, epoch - 1)

    return status_runs(probes).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)


def _newest(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs, ["link_id", "part"], "seen")


def incidents_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents from the newest runs of every part; of probes in a row with one status only the first is read."""
    runs = _newest(read_epochs(spark, f"{folder}/runs", _RUNS)).select("link_id", F.inline("runs"))
    return incident_intervals(runs.select("link_id", F.timestamp_micros("at").alias("ts"), "probe_id", "status"))


def window_counts(probes: DataFrame, width: str = "1 hour") -> DataFrame:
    """Probes per time window and status."""
    return probes.groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def probe_window_counts(probes: DataFrame, folder: str, checkpoint: str, width: str = "1 hour", keep: Column | None = None, fold_every: int = FOLD_EVERY) -> DataStreamWriter:
    """Partial counts of each micro-batch, kept by its epoch: late probes add to their window, and a repeated batch rewrites its own.

    Every ``fold_every`` micro-batches the epochs before are folded into one table; with ``keep``, a condition on ``start``, windows that
    fail it are dropped then.
    """

    def fold(parts: DataFrame) -> DataFrame:
        return _total(parts if keep is None else parts.filter(keep))

    def step(batch: DataFrame, epoch: int) -> None:
        write_epoch(window_counts(batch, width), folder, epoch)
        if epoch and epoch % fold_every == 0:
            compact(batch.sparkSession, folder, _COUNTS, fold, epoch - 1)

    return probes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("start", "status").agg(F.sum("n").alias("n"))


def window_counts_so_far(spark: SparkSession, folder: str, keep: Column | None = None) -> DataFrame:
    """All windows, open ones too; expired ones, whether already dropped or not, are left out with ``keep``."""
    counts = _total(read_epochs(spark, folder, _COUNTS))
    return counts if keep is None else counts.filter(keep)
