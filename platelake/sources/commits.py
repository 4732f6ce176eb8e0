"""Commits: small JSON files that appear whole or not at all.

A table's data files are written first, under names that nothing refers to; the commit that names them is written beside its
place and renamed into it.  Readers only follow commits, so a lost job changes nothing and its files are swept later.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made this commit first."""


class Files:
    """The few file operations that commits need, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> dict:
        source = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def write_once(self, name: str, content: dict) -> None:
        """Put a file in its place; Conflict if it is taken."""
        scratch = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(scratch, False)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
        finally:
            out.close()
        place = self.path(name)
        if self.fs.exists(place) or not self.fs.rename(scratch, place):
            self.fs.delete(scratch, False)
            raise Conflict(str(place.toString()))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Versions:
    """Numbered commits ``commits/v<number>.json`` of one table; the newest is the table."""

    def __init__(self, files: Files):
        self.files = files

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"v(\d+)\.json", n) for n in self.files.names("commits"))
        return sorted(int(m[1]) for m in found if m)

    def read(self, number: int) -> dict:
        return self.files.read(f"commits/v{number:012d}.json")

    def newest(self) -> tuple[int, dict | None]:
        done = self.numbers()
        return (done[-1], self.read(done[-1])) if done else (0, None)

    def commit(self, after: int, content: dict) -> int:
        self.files.write_once(f"commits/v{after + 1:012d}.json", content)
        return after + 1

    def forget(self, keep: int) -> list[dict]:
        """Remove all but the newest ``keep`` commits; returns the contents of those kept."""
        done = self.numbers()
        for number in done[:-keep]:
            self.files.remove(f"commits/v{number:012d}.json")
        return [self.read(n) for n in done[-keep:]]
