"""Keyed tables on Parquet: insert if absent, replace, upsert, alias append. There is no delete.

A table is a folder of versions and of numbered pointers to them. A write makes a new
version and then one pointer more; the highest number is current. Nothing is ever
overwritten or deleted, so a reader sees the old version or the new one, whenever a write
is cut off. Pointers are one-row text datasets, written and read through Spark, so any
store and session will do. Versions without a pointer are no empty table but an error,
unless they are new (a write that did not get that far), and so are two pointers of one
number, which two writers at once leave; ``settle`` then says which of them is to be current.

A version is either whole (``write``) or a manifest of buckets (``Changes``): rows lie in buckets by hash
of their key, a change reads and rewrites the buckets that its keys fall into, and the
manifest takes over the files of all others. So what a change writes grows with the change, not
with the table. Changes of several tables become visible by one file that points to all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import conform


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in this order, which should be total."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def insert_absent(existing: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows of new whose key is neither in existing nor earlier in new; a row that breaks uniqueness is left out, not an error."""
    return latest_by(new.filter(F.col(key).isNotNull()), [key], *order).join(existing.select(key), key, "left_anti").select(new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """existing with the rows of new put in whole: no column of a replaced row survives."""
    newest = latest_by(new, keys, *order)
    kept = existing.join(newest.select(*keys), keys, "left_anti").select(existing.columns)
    return kept.unionByName(conform(newest, existing.schema))


def add_aliases(existing: DataFrame, aliases: DataFrame) -> DataFrame:
    """existing with ``aka_domains`` widened by aliases (id, alias): a sorted set without the row's own domain."""
    more = aliases.groupBy("id").agg(F.collect_set("alias").alias("_more"))
    joined = existing.join(more, "id", "left")
    old = F.coalesce("aka_domains", F.array().cast("array<string>"))
    union = F.array_sort(F.array_remove(F.array_union(old, F.col("_more")), F.col("domain")))
    return joined.withColumn("aka_domains", F.when(F.col("_more").isNull(), F.col("aka_domains")).otherwise(F.when(F.size(union) > 0, union))).select(existing.columns)


class LostPointer(RuntimeError):
    """A table has versions, but it cannot be told which of them is current."""


BUCKETS = 64


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _lines(self, pattern: str) -> list[str]:
        """Lines of the text datasets of a pattern; none where nothing fits it."""
        try:
            return [r.value for r in self.spark.read.text(f"{self.root}/{pattern}").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _pointers(self, name: str) -> list[tuple[int, str]]:
        """(number, version) of a table's own pointers and of the commits that it is part of."""
        own = [line.split(" ") for line in self._lines(f"{name}/pointer-*")]
        shared = [line.split(" ")[1:] for line in self._lines("commit-*") if line.split(" ")[0] == name]
        return [(int(n), at) for n, at in own + shared]

    def _current(self, name: str) -> tuple[int, str | None]:
        """(number, version) of the highest pointer, (0, None) where the table has never been written."""
        found = self._pointers(name)
        if not found:
            if self._lines(f"{name}/begun"):
                raise LostPointer(f"{self.root}/{name} has been written, but no pointer is left")
            return 0, None
        top = max(found)
        if sum(n == top[0] for n, _ in found) > 1:
            raise LostPointer(f"{self.root}/{name} has been written twice at once: pointer {top[0]}")
        return top

    def _manifest(self, name: str, at: str) -> dict[int, list[str]]:
        """The folders of each bucket's files; a list of a bounded number of buckets."""
        out: dict[int, list[str]] = {}
        for r in self.spark.read.parquet(f"{self.root}/{name}/{at}").collect():
            out.setdefault(r.bucket, []).append(r.path)
        return out

    def _of(self, name: str, schema: T.StructType | str, paths: list[str]) -> DataFrame:
        paths = [f"{self.root}/{name}/{p}" for p in paths]
        return conform(self.spark.read.parquet(*paths), schema) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, schema: T.StructType | str, buckets: set[int] | None = None) -> DataFrame:
        """The current version in this schema, empty where there is none; of some buckets only, if the table has them."""
        _, at = self._current(name)
        if at is None or at.startswith("version-"):
            return self._of(name, schema, [at] if at else [])
        manifest = self._manifest(name, at)
        return self._of(name, schema, sorted({p for b, paths in manifest.items() if buckets is None or b in buckets for p in paths}))

    def _note(self, path: str, line: str) -> None:
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(path)

    def write(self, name: str, df: DataFrame) -> None:
        """A whole new version."""
        number, _ = self._current(name)
        tag = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/version-{tag}")
        self._note(f"{self.root}/{name}/pointer-{number + 1:012d}-{tag}", f"{number + 1} version-{tag}")
        if not number:
            self._note(f"{self.root}/{name}/begun", "1")

    def versions(self, name: str) -> list[tuple[int, str]]:
        """(number, version) of all pointers there are, the newest first."""
        return sorted(self._pointers(name), reverse=True)

    def settle(self, name: str, at: str) -> None:
        """Make one of ``versions`` current, after two writers at once or to go back; what the others hold stays."""
        found = self._pointers(name)
        if at not in [v for _, v in found]:
            raise ValueError(f"{at} is no version of {name}")
        number = max(found)[0] + 1
        self._note(f"{self.root}/{name}/pointer-{number:012d}-{uuid.uuid4().hex}", f"{number} {at}")

    def buckets_of(self, keys: DataFrame, key: str) -> set[int]:
        """The buckets that keys fall into, of which there are BUCKETS at most."""
        return {r.bucket for r in keys.select(_bucket(F.col(key)).alias("bucket")).distinct().collect()}

    def changes(self) -> Changes:
        return Changes(self)


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Changes:
    """Changes of one or more tables that become visible together, at the end of a ``with`` block, or not at all."""

    def __init__(self, store: TableStore) -> None:
        self.store, self.tag, self.lines = store, uuid.uuid4().hex, {}

    def __enter__(self) -> Changes:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None and self.lines:
            lines = self.store.spark.createDataFrame([(x,) for x in self.lines.values()], "value string")
            lines.coalesce(1).write.mode("errorifexists").text(f"{self.store.root}/commit-{self.tag}")

    def merge(self, name: str, schema: str, key: str, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put merged(old, new) in the place of the buckets that the keys of new fall into; old holds their rows.

        A table that was written whole is dealt to buckets at its first change. A table changes once in a commit.
        """
        if name in self.lines:
            raise ValueError(f"{name} changes already in this commit")
        store = self.store
        number, at = store._current(name)
        touched = store.buckets_of(new, key)
        if at is not None and at.startswith("version-"):
            manifest, old = {}, store.read(name, schema)
        else:
            manifest = store._manifest(name, at) if at else {}
            old = store._of(name, schema, sorted({p for b, paths in manifest.items() if b in touched for p in paths}))
        if not touched and manifest:
            return
        rows = conform(merged(old, new), schema).withColumn("bucket", _bucket(F.col(key)))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{store.root}/{name}/data-{self.tag}")
        kept = [(b, p) for b, paths in manifest.items() if b not in touched for p in paths]
        made = [(b, f"data-{self.tag}/bucket={b}") for b in (touched if manifest else range(BUCKETS))]
        there = {r.bucket for r in store.spark.read.schema(f"{_ddl(schema)}, bucket int").parquet(f"{store.root}/{name}/data-{self.tag}").select("bucket").distinct().collect()}
        lines = kept + [x for x in made if x[0] in there]
        store.spark.createDataFrame(lines, "bucket int, path string").coalesce(1).write.parquet(f"{store.root}/{name}/manifest-{self.tag}")
        self.lines[name] = f"{name} {number + 1} manifest-{self.tag}"

    def upsert(self, name: str, schema: str, new: DataFrame, key: str, *order: Column) -> None:
        """Rows of new replace those of their key in whole."""
        self.merge(name, schema, key, new, lambda old, rows: upsert(old, conform(rows, schema), [key], *order))

    def insert(self, name: str, schema: str, new: DataFrame, key: str, *order: Column) -> None:
        """Rows of new whose key is not there yet are added."""
        self.merge(name, schema, key, new, lambda old, rows: old.unionByName(conform(insert_absent(old, rows, key, *order), schema)))


def _ddl(schema: T.StructType | str) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
