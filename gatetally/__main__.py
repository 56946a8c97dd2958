"""Run the jobs from the command line: ``spark-submit``-able, or ``python -m gatetally``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from gatetally.constants import RESCAN_INTERVAL
from gatetally.plans import run_batch
from gatetally.session import get_session
from gatetally.sinks.streams import AVAILABLE_NOW
from gatetally.streaming import run_stream


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gatetally", description=__doc__)
    parser.add_argument("mode", choices=("batch", "stream"))
    parser.add_argument("source", help="directory of log files")
    parser.add_argument("output", help="directory that gets one directory per report")
    parser.add_argument("--quarantine", help="directory for malformed lines; without, they fail")
    parser.add_argument("--checkpoints", help="directory for stream state, shared by all executors")
    parser.add_argument("--once", action="store_true", help="stream what is there, then stop")
    parser.add_argument("--interval", default=RESCAN_INTERVAL, help="time between micro-batches")
    parser.add_argument("--max-files", type=int, help="files read per micro-batch, at most")
    parser.add_argument("--max-file-age", help="a stream ignores new files older than this, next to the newest")
    parser.add_argument("--archive", help="directory that a stream moves the files to that it has read")
    parser.add_argument("--retention", help="age, such as 7d, at which files leave a stream's account of its output")
    parser.add_argument("--out-files", type=int, help="tasks that write per micro-batch, at most")
    args = parser.parse_args(arguments)

    spark = get_session()
    if args.mode == "batch":
        run_batch(spark, args.source, args.output, args.quarantine)
        return
    if not args.checkpoints:
        parser.error("stream needs --checkpoints")
    options = {"maxFilesPerTrigger": args.max_files, "maxFileAge": args.max_file_age}
    run_stream(
        spark,
        args.source,
        args.output,
        args.checkpoints,
        quarantine=args.quarantine,
        trigger=AVAILABLE_NOW if args.once else {"processingTime": args.interval},
        files=args.out_files,
        archive=args.archive,
        retention=args.retention,
        **{name: value for name, value in options.items() if value},
    )


if __name__ == "__main__":
    main()
