"""Numbered versions of a table in a folder: a version's file is created without overwriting, so of two writers one must begin again."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has published the version first."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str, number: int, state: dict) -> None:
    """Create the file of version `number`; Conflict if there is one."""
    path, files = _files(spark, folder)
    files.mkdirs(path)
    try:
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:010d}.json"), False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {number} of {folder} exists") from e
        raise
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The newest complete version and its state; 0 and None if there is none."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return 0, None
    names = sorted((s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json")), reverse=True)
    for name in names:
        stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return int(name.split(".")[0]), json.loads(text)
        except ValueError:  # its writer is not done
            continue
    return 0, None


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of a table's files (names, sizes, times of change): another one means that what was derived from it is stale."""
    import hashlib

    root, files = _files(spark, path)
    found, todo = [], [root]
    while todo:  # folders of one table
        for s in files.listStatus(todo.pop()):
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


def remove(spark: SparkSession, folder: str) -> None:
    path, files = _files(spark, folder)
    files.delete(path, True)
