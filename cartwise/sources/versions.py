"""Outputs of a step that appear all at once or not at all.

A run writes its tables and models to a folder of its own and, last, a manifest
that names them.  Readers follow the newest manifest of a step, so a run that dies
between two writes changes nothing for them, and a run on the same inputs finds its
manifest and does nothing.

    <out>/run-<time>-<id>/...             what a run wrote
    <out>/_steps/<step>/<number>-<run>.json   its manifest
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, text: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def new_run(out_dir: str) -> str:
    """The folder of a new run below ``out_dir``."""
    now = time.strftime("%Y%m%d%H%M%S", time.gmtime())
    return f"{out_dir.rstrip('/')}/run-{now}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, out_dir: str, step: str, run: str, paths: dict[str, str],
            key: str, inputs: dict[str, str] | None = None) -> dict:
    """Write the manifest of a finished run: from now on it is the step's newest.
    The file is written under another name and renamed, so it is never half there."""
    folder = f"{out_dir.rstrip('/')}/_steps/{step}"
    number = 1 + max((int(n.split("-")[0]) for n in _names(spark, folder)
                      if n.endswith(".json")), default=0)
    name = run.rsplit("/", 1)[-1]
    entry = {"step": step, "run": name, "paths": paths, "key": key, "inputs": inputs or {}}
    final, fs = _path(spark, f"{folder}/{number:010d}-{name}.json")
    part, _ = _path(spark, f"{folder}/.{name}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(entry).encode()))
    stream.close()
    if not fs.rename(part, final):
        raise OSError(f"the manifest {final} could not be put in place")
    return entry


def latest(spark: SparkSession, out_dir: str, step: str) -> dict | None:
    """The newest manifest of a step: step, run, paths, key, inputs."""
    folder = f"{out_dir.rstrip('/')}/_steps/{step}"
    names = [n for n in _names(spark, folder) if n.endswith(".json")]
    if not names:
        return None
    return json.loads(spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0])


def needed(spark: SparkSession, out_dir: str, step: str) -> dict:
    """The newest manifest of a step that must have run."""
    entry = latest(spark, out_dir, step)
    if entry is None:
        raise FileNotFoundError(f"no finished run of '{step}' below {out_dir}")
    return entry


def prune(spark: SparkSession, out_dir: str, steps: tuple[str, ...]) -> list[str]:
    """Delete the folders of runs that no newest manifest names, as a run's output or
    as its input.  Call it while no run is under way; returns the deleted names."""
    used = ""
    for step in steps:
        entry = latest(spark, out_dir, step)
        used += json.dumps(entry) if entry else ""
    gone = [n for n in _names(spark, out_dir) if n.startswith("run-") and n not in used]
    for n in gone:
        p, fs = _path(spark, f"{out_dir.rstrip('/')}/{n}")
        fs.delete(p, True)
    return gone
