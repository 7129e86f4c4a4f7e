"""Counters and gauges of running queries in the text format that monitoring scrapes."""

from __future__ import annotations

import os
import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper ends of the buckets of the end-to-end latency, in seconds.
LATENCIES = (1.0, 5.0, 10.0, 30.0, 60.0, 300.0)


def latency_counts(events: DataFrame, since: str = "event_ts", seen: str = "ingest_ts") -> dict[float, int]:
    """How many events were seen within each of LATENCIES of their time, one pass; the last key, inf, counts all."""
    seconds = (F.unix_micros(seen) - F.unix_micros(since)) / 1e6
    row = events.agg(*[F.count(F.when(seconds <= x, 1)).alias(f"b{i}") for i, x in enumerate(LATENCIES)], F.count(seconds).alias("all")).first()
    return {x: row[f"b{i}"] for i, x in enumerate(LATENCIES)} | {float("inf"): row["all"]}


class Metrics(StreamingQueryListener):
    """Add to spark.streams; text() is what an endpoint returns, and with a path it is written there after every batch."""

    def __init__(self, path: str | None = None):
        self.path, self.lock = path, threading.Lock()
        self.rows: dict[str, int] = {}
        self.produced = 0
        self.lag: dict[str, int] = {}
        self.late: dict[str, int] = {}
        self.at: dict[str, float] = {}
        self.latency: dict[float, int] = {}

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        with self.lock:
            self.rows[name] = self.rows.get(name, 0) + p.numInputRows
            self.late[name] = self.late.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            self.lag[name] = sum(int(s.metrics.get("maxOffsetsBehindLatest", 0)) for s in p.sources if s.metrics)
            self.at[name] = datetime.now(timezone.utc).timestamp()
        self.write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write()

    def add_produced(self, n: int) -> None:
        with self.lock:
            self.produced += n
        self.write()

    def add_latency(self, counts: dict[float, int]) -> None:
        with self.lock:
            for x, n in counts.items():
                self.latency[x] = self.latency.get(x, 0) + n
        self.write()

    def text(self) -> str:
        with self.lock:
            out = [f"rides_events_produced_total {self.produced}"]
            for metric, values in (
                ("spark_streaming_processed_rows_total", self.rows), ("rides_bronze_consumer_lag_messages", self.lag), ("spark_streaming_late_rows_total", self.late),
                ("spark_streaming_last_progress_seconds", self.at),
            ):
                out += [f'{metric}{{query="{name}"}} {value}' for name, value in sorted(values.items())]
            out += [f'rides_event_e2e_latency_seconds_bucket{{le="{"+Inf" if x == float("inf") else x}"}} {n}' for x, n in sorted(self.latency.items())]
        return "\n".join(out) + "\n"

    def write(self) -> None:
        if self.path:
            with open(f"{self.path}.part", "w") as f:
                f.write(self.text())
            os.replace(f"{self.path}.part", self.path)
