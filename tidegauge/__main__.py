"""python -m tidegauge {gps VALUE... | list | run QUERY SF_DIR}: times, and registered queries."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if args[:1] == ["gps"] and args[1:]:
        from tidegauge.functions.gpstime import gps

        print(gps(" ".join(args[1:])))
        return 0
    if args[:1] in (["list"], ["run"]):
        from tidegauge.plans import event_queries, extra_queries, registry, segment_queries, series_queries  # noqa: F401

        if args[0] == "list":
            print(*registry.QUERIES, sep="\n")
            return 0
        if len(args) == 3 and args[1] in registry.QUERIES:
            from pyspark.sql import SparkSession

            registry.QUERIES[args[1]](SparkSession.builder.getOrCreate(), args[2]).show(50, truncate=False)
            return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
