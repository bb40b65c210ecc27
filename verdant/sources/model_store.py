"""Versioned store of fitted models (S8, K6).

    <root>/<name>/<version>/<table>/   parquet, one folder a table
    <root>/<name>/<version>/meta/      one JSON text
    <root>/<name>/<version>/COMPLETE   written last

A version counts only once its marker is there: a writer that died leaves an
unfinished version, which readers pass over and a later save numbers past.
Versions are compared as numbers.  All files go through Spark's file system
interface, so the root may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MARKER = "COMPLETE"
NAME = re.compile(r"[A-Za-z0-9._-]+")


@dataclass
class Stored:
    name: str
    version: int
    meta: dict
    tables: dict[str, DataFrame]


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folder(self, name: str, version: int | None = None) -> str:
        if not NAME.fullmatch(name):
            raise ValueError(f"model name {name!r} must be made of letters, digits, '.', '_' and '-'")
        return f"{self.root}/{name}" if version is None else f"{self.root}/{name}/{version}"

    def versions(self, name: str) -> dict[int, bool]:
        """Numbered versions, and whether each is complete; other folders are passed over."""
        fs, p = self._fs(self._folder(name))
        if not fs.exists(p):
            return {}
        found = {}
        for s in fs.listStatus(p):
            own = s.getPath().getName()
            if s.isDirectory() and own.isdigit():
                marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), MARKER)
                found[int(own)] = found.get(int(own), False) or fs.exists(marker)
        return found

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and NAME.fullmatch(s.getPath().getName()))

    def save(self, name: str, tables: Mapping[str, DataFrame], meta: dict, version: int | None = None, complete: bool = True) -> int:
        """Writes a new version (one past the largest, or the given number) and
        returns it; without ``complete`` more tables may follow before it counts."""
        have = self.versions(name)
        number = max(have, default=0) + 1 if version is None else version
        if number in have:
            raise ValueError(f"{name} has a version {number} already")
        self.add(name, number, tables)
        text = json.dumps(meta, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self._folder(name, number)}/meta")
        if complete:
            self.complete(name, number)
        return number

    def add(self, name: str, version: int, tables: Mapping[str, DataFrame]) -> None:
        """Writes tables of a version that isn't complete yet."""
        if self.versions(name).get(version):
            raise ValueError(f"version {version} of {name} is complete")
        for t, df in tables.items():
            if not NAME.fullmatch(t) or t in ("meta", MARKER):
                raise ValueError(f"bad table name {t!r}")
            df.write.parquet(f"{self._folder(name, version)}/{t}")

    def complete(self, name: str, version: int) -> None:
        fs, p = self._fs(f"{self._folder(name, version)}/{MARKER}")
        fs.create(p, False).close()

    def table(self, name: str, version: int, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(name, version)}/{table}")

    def latest(self, name: str) -> int:
        """The newest complete version; an error if there is none."""
        done = [v for v, complete in self.versions(name).items() if complete]
        if not done:
            raise FileNotFoundError(f"no complete version of {name} under {self.root}")
        return max(done)

    def load(self, name: str, version: int | None = None) -> Stored:
        """The newest complete version, or the given one, which has to be complete."""
        number = self.latest(name) if version is None else version
        if not self.versions(name).get(number):
            raise FileNotFoundError(f"no complete version {number} of {name} under {self.root}")
        folder = self._folder(name, number)
        fs, p = self._fs(folder)
        tables = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != "meta")
        meta = json.loads(self.spark.read.text(f"{folder}/meta").first()[0])
        return Stored(name, number, meta, {t: self.table(name, number, t) for t in tables})
