"""python -m tripstream bronze|silver|gold|all|generate|produce ...: a job, or events from hire records."""

from __future__ import annotations

import argparse
import logging
import sys

from tripstream.sources import generator, readers
from tripstream.streaming import jobs, layers
from tripstream.streaming.metrics import Metrics

log = logging.getLogger("tripstream")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m tripstream", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, cadence: str | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("-v", "--verbose", action="store_true")
        c.add_argument("--shuffle-partitions", type=int, default=4)
        if cadence:
            c.add_argument("--warehouse-root", default="lakehouse/warehouse", help="where all tables lie")
            c.add_argument("--once", action="store_true", help="work off what is there, then end")
            c.add_argument("--processing-time", default=cadence, help="time between batches, without --once")
            c.add_argument("--metrics", help="a file for the metrics of the running job")
        return c

    def records(c: argparse.ArgumentParser) -> None:
        c.add_argument("--bootstrap-servers", default="localhost:19092")
        c.add_argument("--record-path", help="files of records instead of a broker")

    for name in ("bronze", "all"):
        c = command(name, "5 seconds")
        records(c)
        c.add_argument("--starting-offsets", default="earliest")
        if name == "bronze":
            c.add_argument("--topic", required=True, choices=sorted(layers.PAYLOADS))
    command("silver", "10 seconds").add_argument("--stream", required=True, choices=sorted(layers.SILVER))
    command("gold", "30 seconds").add_argument("--mart", required=True, choices=sorted(layers.GOLD))
    for name in ("generate", "produce"):
        c = command(name)
        c.add_argument("--hires", required=True, help="parquet hire records")
        c.add_argument("--zones", required=True, help="CSV of their zones")
        c.add_argument("--max-trips", type=int, default=100, help="0 for all")
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("--ping-interval", type=float, default=1.0)
        if name == "produce":
            records(c)
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 1 where records were not all delivered."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(asctime)s %(name)s %(levelname)s %(message)s", stream=sys.stderr)
    spark = jobs.session(jobs.SessionConfig(f"tripstream-{args.command}", shuffle_partitions=args.shuffle_partitions))
    if args.command in ("generate", "produce"):
        return _events(spark, args)
    metrics = Metrics(args.metrics) if args.metrics else None
    if metrics:
        spark.streams.addListener(metrics)
    try:
        config = layers.LayerConfig(args.warehouse_root, None if args.once else args.processing_time)
        if args.command in ("bronze", "all"):
            source = layers.RecordConfig(args.bootstrap_servers, args.starting_offsets, record_path=args.record_path)
        if args.command == "all":
            for name, progress in layers.run_all(spark, config, source).items():
                log.info("%s ended: %s", name, progress)
            return 0
        if args.command == "bronze":
            query = layers.bronze(spark, config, args.topic, source, True)
        else:
            query = (layers.SILVER[args.stream] if args.command == "silver" else layers.GOLD[args.mart])(spark, config, True)
        log.info("%s ended: %s", query.name, jobs.progress(query))
        return 0
    finally:
        if metrics:
            spark.streams.removeListener(metrics)


def _events(spark, args) -> int:
    trips = readers.hire_files(spark, args.hires, args.zones, args.seed, args.max_trips)
    events = generator.events(trips, args.ping_interval, args.seed)
    if args.command == "produce":
        try:
            if args.record_path:
                readers.write_records(events, args.record_path)
            else:
                log.info("%d records sent", readers.send(events, args.bootstrap_servers))
        except Exception:
            log.exception("records were not all delivered")
            return 1
        return 0
    try:
        for row in readers.json_lines(events).toLocalIterator(prefetchPartitions=True):  # a partition at a time
            sys.stdout.write(row.value + "\n")
    except BrokenPipeError:  # the reader has had enough
        return 0
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
