"""Structured Streaming: landed records to partitions, sequence continuity with state, activity windows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import schemas
from tidemark.operators import tables
from tidemark.operators.journal import CHANGES, Continuity, Coverage


def landed(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed records with their fields and, as `value`, the line as it came."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.from_json("value", schemas.STREAM).alias("r")).select("r.*", "value")


def write_hourly(records: DataFrame, path: str, checkpoint: str):
    """Lines verbatim, also with fields that no schema names, in folders by the UTC date and hour of receipt; exactly once by the file sink."""
    at = F.timestamp_millis("recv_ts")
    out = records.select("value", F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH").alias("hour"))
    return out.writeStream.format("text").partitionBy("date", "hour").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SequenceState(StatefulProcessor):
    """Continuity of one (conn, market) across batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "channel string", "seq bigint")
        self.flag = handle.getValueState("resyncing", "value boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["line", "channel"])  # order of arrival within a batch is not given
        state = Continuity({k[0]: v[0] for k, v in self.last.iterator()}, bool(self.flag.exists() and self.flag.get()[0]))
        got = [state.take(k, c, int(s)) for k, c, s in zip(pdf["kind"], pdf["channel"], pdf["seq"], strict=True)]
        self.last.clear()
        for channel, seq in state.last.items():
            self.last.updateValue((channel,), (seq,))
        self.flag.update((state.resyncing,))
        yield pd.DataFrame({"conn": key[0], "market": key[1], "line": pdf["line"].to_numpy(), "channel": pdf["channel"].to_numpy(), "result": [r for r, _ in got], "expected": [e for _, e in got]})

    def close(self) -> None:
        pass


def sequence_stream(messages: DataFrame) -> DataFrame:
    """messages: conn, market, line, channel, kind, seq as a stream."""
    return messages.groupBy("conn", "market").transformWithStateInPandas(SequenceState(), "conn string, market string, line bigint, channel string, result string, expected bigint", "Append", "None")


class CoverageState(StatefulProcessor):
    """Open windows of one recorder across batches; a timer tells when its lines, heartbeats among them, stop coming.

    What is known of a recorder is one value, so that its time to live starts anew with every line.
    """

    def __init__(self, silence_ms: int, keep_ms: int):
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string", self.keep_ms)

    def _known(self) -> Coverage:
        if not self.held.exists():
            return Coverage()
        was = json.loads(self.held.get()[0])
        return Coverage(was["ts"], was["line"], set(was["known"]), set(was["up"]), {int(k): v for k, v in was["events"].items()}, was["open"])

    def _keep(self, known: Coverage) -> None:
        self.held.update((json.dumps(asdict(known) | {"known": sorted(known.known), "up": sorted(known.up)}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("line")  # order of arrival within a batch is not given
        known, changes = self._known(), []
        plain = lambda x: None if x is None or (not isinstance(x, list) and pd.isna(x)) else x
        for r in pdf.to_dict("records"):
            slot, slots = (None if plain(r[c]) is None else int(r[c]) for c in ("slot", "slots"))
            events = None if r["events"] is None or not hasattr(r["events"], "__len__") else list(r["events"])
            changes += known.take(int(r["line"]), int(r["ts"]), r["kind"], slot, slots, events, plain(r["market"]), plain(r["detail"]))
        self._keep(known)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.silence_ms)
        if changes:
            yield self._frame(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        changes = known.silent()
        if changes:
            self._keep(known)
            yield self._frame(key, changes)

    def _frame(self, key, changes: list[dict]) -> pd.DataFrame:
        names = [c.split()[0] for c in CHANGES.split(", ")]
        rows = [[key[0], *[x.get(c) for c in names[1:]]] for x in changes]
        return pd.DataFrame(rows, columns=names).astype({"start": "Int64", "end": "Int64", "slot": "Int32", "opened": "Int64", "line": "Int64"})

    def close(self) -> None:
        pass


def coverage_stream(lines: DataFrame, silence_ms: int = 180_000, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """Changes of the windows without data while a journal comes in; lines: env, line, ts, kind, slot, slots, events, market, detail as a stream.

    `journal.current_windows` of all changes gives the rows of `journal.missing_windows` of the same lines.  After `silence_ms` without a line
    of a recorder that was up a window of all opens at its last line; the next line voids it, and if that is a start the
    crash's own window takes its place.  A recorder is forgotten `keep_ms` after its last line.
    """
    return lines.groupBy("env").transformWithStateInPandas(CoverageState(silence_ms, keep_ms), CHANGES, "Append", "ProcessingTime")


def upsert_stream(rows: DataFrame, path: str, keys: list[str], rule: tables.Rule, order: str, checkpoint: str, buckets: int = 256):
    """Writes a stream into a table by keys, batch by batch; of several rows of a key in a batch the last in the given order counts.

    The batch's number is its name in the table's ledger, so a batch that is replayed after a failure changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        tables.upsert_keyed(tables.last_by_key(batch, keys, order), path, keys, rule, str(number), buckets)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(records: DataFrame, ts: str, key: str, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Rows per key and window of event time; late rows count until the watermark."""
    return records.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(records: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    return records.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
