"""``python -m candlewick.cli stream|archive-status``."""

from __future__ import annotations

import argparse
import signal
import threading
from datetime import date, datetime

from pyspark.sql import functions as F

from . import session
from .plans import report
from .sources import archive, feed, log, universe
from .streaming import ingest


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="candlewick")
    commands = parser.add_subparsers(dest="command", required=True)
    stream = commands.add_parser("stream", help="ingest raw events from a folder")
    stream.add_argument("--source", required=True)
    stream.add_argument("--once", action="store_true", help="take what is there and end")
    status = commands.add_parser("archive-status", help="coverage of a UTC day")
    status.add_argument("--date", type=date.fromisoformat, default=None)
    for p in (stream, status):
        p.add_argument("--data-dir", default="./data")
    args = parser.parse_args(argv)
    spark = session.local()
    if args.command == "archive-status":
        now = ingest.utcnow()
        day = args.date or now.date()
        print(report.rendered(report.archive_status(spark, args.data_dir, day, now), day))
        return 0
    return run_stream(spark, args.data_dir, args.source, args.once)


def run_stream(spark, root: str, source: str, once: bool, started: datetime | None = None) -> int:
    """One session of the ingest. The next one goes on where this one's source ended."""
    archive.quarantine(spark, root)
    at = started or ingest.utcnow()
    own = log.start_session(spark, root, at)
    names = [r["exchange"] for r in universe.exchanges(spark).collect()]
    ingest.record_state(spark, root, own, "connected", at, names)
    raw = feed.stream(spark, source).withColumn("session_id", F.lit(own).cast("long"))
    run = ingest.Ingest(spark, raw, root, own, f"{root}/_checkpoints")
    stopped = _stop_on_signals()
    try:
        queries = run.start(once)
        if once:
            for q in queries:
                q.awaitTermination()
        else:
            run.watch()
    except KeyboardInterrupt:
        pass
    finally:
        run.finish(names)
        if stopped is not None:
            signal.signal(signal.SIGTERM, stopped)
    return 0


def _stop_on_signals():
    """SIGTERM shuts down as ^C does; the former handler, or null outside the main thread."""

    def stop(*_):
        raise KeyboardInterrupt

    if threading.current_thread() is threading.main_thread():
        return signal.signal(signal.SIGTERM, stop)
    return None


if __name__ == "__main__":
    raise SystemExit(main())
