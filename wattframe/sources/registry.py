"""Published runs in immutable versions.

A run writes into a folder of its own that no one reads yet. Committing it creates the
next numbered file of a log, which fails if another writer was first, and names the
folder. A reader takes the last file of the log once and sees models, bounds and tables
of one run, whatever is being written meanwhile; older versions stay where they are.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError


class Version(NamedTuple):
    number: int
    path: str


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def new_version(registry: str) -> str:
    """A folder for a run; nobody sees it before it is committed."""
    return f"{registry.rstrip('/')}/versions/{uuid.uuid4().hex}"


def versions(spark: SparkSession, registry: str) -> list[Version]:
    """What is committed, oldest first. One short name per published run."""
    log, fs, _ = _files(spark, f"{registry.rstrip('/')}/log")
    if not fs.exists(log):
        return []
    out = []
    for status in fs.listStatus(log):
        number, _, name = status.getPath().getName().partition("-")
        if number.isdigit() and name:
            out.append(Version(int(number), f"{registry.rstrip('/')}/versions/{name}"))
    return sorted(out)


def current(spark: SparkSession, registry: str) -> Version | None:
    """The version committed last."""
    return max(versions(spark, registry), default=None)


def commit(spark: SparkSession, registry: str, version: str) -> Version:
    """Make ``version`` the current one.

    The number is taken by a file that only one writer can create; then the entry appears
    under its full name. A writer that dies in between leaves a number without an entry.
    """
    name, base = version.rstrip("/").rsplit("/", 1)[1], registry.rstrip("/")
    number = max([v.number for v in versions(spark, registry)], default=0) + 1
    while True:
        claim, fs, _ = _files(spark, f"{base}/claims/{number:010d}")
        try:
            fs.create(claim, False).close()
        except (Py4JJavaError, CapturedException) as e:
            if not fs.exists(claim):
                raise e
            number += 1
            continue
        entry, fs, _ = _files(spark, f"{base}/log/{number:010d}-{name}")
        fs.create(entry, False).close()
        return Version(number, version)
