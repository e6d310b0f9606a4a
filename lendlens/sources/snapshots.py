"""Versions of a set of tables: written aside, then made current in one atomic step.

A version is a folder of tables. It becomes current by one small file in the log
folder, named by the version's number: a file that is there or not, so a reader
sees one whole version or the one before, whenever a writer stops. Numbers are
taken by creating the file without overwriting, so of two writers the later one
takes the next number. Folders that no kept version names are removed afterwards.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

LOG = "_versions"
KEPT = 2  # the current version and the one that running readers may still hold
ABANDONED = 24 * 3600 * 1000  # milliseconds after which a folder without a version was given up


def _files(spark: SparkSession, path: str):
    paths = spark._jvm.org.apache.hadoop.fs.Path
    return paths(path).getFileSystem(spark._jsc.hadoopConfiguration()), paths


def _numbers(spark: SparkSession, target: str) -> list[int]:
    files, paths = _files(spark, target)
    log = paths(f"{target}/{LOG}")
    if not files.exists(log):
        return []
    names = [status.getPath().getName() for status in files.listStatus(log)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())


def _entry(target: str, number: int) -> str:
    return f"{target}/{LOG}/{number:020d}.json"


def _read(spark: SparkSession, path: str) -> dict:
    files, paths = _files(spark, path)
    stream = files.open(paths(path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def new_folder(target: str) -> str:
    """A folder for the tables of a version to be."""
    return f"{target}/load-{uuid.uuid4().hex}"


def commit(spark: SparkSession, target: str, folder: str, facts: dict) -> int:
    """Make the folder the current version and return its number."""
    files, paths = _files(spark, target)
    draft = paths(f"{target}/{LOG}/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"folder": folder.rsplit("/", 1)[1], "facts": facts}).encode()))
    out.close()
    number = max(_numbers(spark, target), default=0) + 1
    # a rename to a name that is taken returns false or raises, and never replaces
    while files.exists(paths(_entry(target, number))) or not files.rename(draft, paths(_entry(target, number))):
        number += 1
    _tidy(spark, target)
    return number


def current(spark: SparkSession, target: str) -> tuple[str, dict] | None:
    """(folder, facts) of the current version, None before the first one."""
    numbers = _numbers(spark, target)
    if not numbers:
        return None
    entry = _read(spark, _entry(target, numbers[-1]))
    return f"{target}/{entry['folder']}", entry["facts"]


def _tidy(spark: SparkSession, target: str) -> None:
    """Remove versions before the kept ones, and folders that a stopped writer left long ago."""
    files, paths = _files(spark, target)
    numbers = _numbers(spark, target)
    kept = {_read(spark, _entry(target, n))["folder"] for n in numbers[-KEPT:]}
    dropped = {_read(spark, _entry(target, n))["folder"] for n in numbers[:-KEPT]}
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for status in files.listStatus(paths(target)):
        name = status.getPath().getName()
        old = name in dropped or now - status.getModificationTime() > ABANDONED
        if name.startswith("load-") and name not in kept and old:
            files.delete(status.getPath(), True)
    for n in numbers[:-KEPT]:
        files.delete(paths(_entry(target, n)), False)
