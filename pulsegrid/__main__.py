"""python -m pulsegrid JOB --root FOLDER [--start DAY --end DAY]: refine, aggregate, report, stream-silver, stream-gold."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pulsegrid.plans import medallion
from pulsegrid.session import build


def parse(args: list[str], today: dt.date | None = None) -> argparse.Namespace:
    """Arguments; a range is half open, its end defaults to today and may not lie in the future."""
    today = today or dt.datetime.now(dt.timezone.utc).date()
    p = argparse.ArgumentParser(prog="pulsegrid", description=__doc__)
    p.add_argument("job", choices=["refine", "aggregate", "report", "stream-silver", "stream-gold"])
    p.add_argument("--root", required=True)
    p.add_argument("--start", type=dt.date.fromisoformat)
    p.add_argument("--end", type=dt.date.fromisoformat)
    p.add_argument("--kinds", nargs="+", choices=list(medallion.KINDS), default=list(medallion.KINDS))
    p.add_argument("--datasets", nargs="+", choices=medallion.GOLD, default=list(medallion.GOLD))
    p.add_argument("--retract", action="store_true")
    p.add_argument("--servers", default="localhost:9092")
    out = p.parse_args(args)
    if out.end and not out.start:
        p.error("--end needs --start")
    if out.start and not out.end:
        out.end = today
    if out.end and out.end > today:
        p.error("--end lies in the future")
    if out.start and out.start >= out.end:
        p.error("--start must be before --end")
    return out


def main(args: list[str]) -> int:
    o = parse(args)
    spark, at = build(f"pulsegrid {o.job}"), medallion.Layout(o.root)
    if o.job == "refine":
        for kind in o.kinds:
            print(kind, "refined" if medallion.refine(spark, at, kind, o.start, o.end) else "has no raw rows")
    elif o.job == "aggregate":
        for name, n in medallion.aggregate(spark, at, o.datasets, o.start, o.end, o.retract).items():
            print(name, n)
    elif o.job == "report":
        for name, df in medallion.reports(spark, at).items():
            print(name)
            df.show(50, truncate=False)
    else:
        start = medallion.stream_gold(spark, at) if o.job == "stream-gold" else medallion.stream_silver(spark, at, o.servers, {k: k for k in o.kinds})
        if start:
            spark.streams.awaitAnyTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
