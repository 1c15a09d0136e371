"""Index a folder of archives: python -m framelake --input FOLDER --output FOLDER --segment-duration SECONDS."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framelake", description="Index every .mp4 of a folder; refused archives are listed.")
    for name, kind in (("--input", str), ("--output", str), ("--segment-duration", float)):
        parser.add_argument(name, type=kind, required=True)
    given = parser.parse_args(args)
    from pyspark.sql import SparkSession

    from .plans.build import index_archives

    refused = index_archives(SparkSession.builder.getOrCreate(), given.input, given.output, given.segment_duration).collect()  # a row for each refused archive
    for r in refused:
        print(f"{r['archive_id']}: {r['variant']} {r['detail']}".rstrip())
    return 1 if refused else 0


if __name__ == "__main__":
    raise SystemExit(main())
