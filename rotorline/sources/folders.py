"""Numbered folders under a path, each written whole by one Spark job."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at) and files.getFileStatus(at).isFile()


def complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders `name`=number that their job has finished, in order."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return []
    found = []
    for entry in files.listStatus(at):
        key, _, number = entry.getPath().getName().partition("=")
        if key == name and number.isdigit() and exists(spark, f"{path}/{key}={number}/_SUCCESS"):
            found.append(int(number))
    return sorted(found)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder."""
    files, at = _files(spark, path)
    return sorted(entry.getPath().getName() for entry in files.listStatus(at)) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    files, at = _files(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file appear whole under a name that is not taken; False if it is."""
    draft = f"{path}.draft-{uuid4().hex}"
    files, at = _files(spark, draft)
    files.mkdirs(at.getParent())
    stream = files.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getUri().getScheme() != "file":
        if files.rename(at, target):
            return True
        files.delete(at, False)
        return False
    try:  # a local rename would replace the file
        os.link(at.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(at, False)
