"""Run one job: ``python -m millrace.cli -i INPUT -o OUTPUT -j MODULE:JOB``.

JOB is a ``Job``, or a function that makes one. Exit status is 0 only if the result was written.
"""

from __future__ import annotations

import argparse
import atexit
import hashlib
import importlib
import importlib.util
import io
import shutil
import sys
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from millrace.operators.job import Job
from millrace.session import DEFAULTS
from millrace.sources.tables import read_text


def load(name: str) -> Job:
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "job")
    return found if isinstance(found, Job) else found()


def ship(spark: SparkSession, module: str) -> None:
    """Send this package and the job's module (or the package it's in) to the executors, whose Python may have neither."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for top in sorted({(__package__ or "millrace").partition(".")[0], module.partition(".")[0]}):
            found = importlib.util.find_spec(top)
            if found and found.submodule_search_locations:
                for root in map(Path, found.submodule_search_locations):
                    for file in sorted(root.rglob("*.py")):
                        archive.write(file, f"{top}/{file.relative_to(root)}")
            elif found and found.origin and found.origin.endswith(".py"):
                archive.write(found.origin, Path(found.origin).name)
    folder = tempfile.mkdtemp(prefix="millrace-job-")  # executors fetch from there as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, f"job-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip")
    path.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(path))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("-i", "--input", required=True, help="text file or folder")
    parser.add_argument("-o", "--output", required=True, help="folder that doesn't exist yet")
    parser.add_argument("-j", "--job", required=True, help="module:attribute")
    parser.add_argument("-m", "--master", help="only where spark-submit doesn't set it")
    parser.add_argument("--parts", action="store_true", help="leave the result in parts instead of one file")
    options = parser.parse_args(args)
    builder = SparkSession.builder.appName(f"millrace {options.job}").config(map=DEFAULTS)
    try:
        spark = (builder.master(options.master) if options.master else builder).getOrCreate()
        began = time.monotonic()
        ship(spark, options.job.partition(":")[0])
        load(options.job).run_to_text(read_text(spark, options.input), options.output, not options.parts)
    except Exception as error:  # the exit status must say so, whatever went wrong
        print(f"failed: {error}", file=sys.stderr)
        return 1
    print(f"done in {(time.monotonic() - began) * 1000:.0f} ms")
    return 0


if __name__ == "__main__":
    sys.exit(main())
