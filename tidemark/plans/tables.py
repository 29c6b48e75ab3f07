"""Tables as immutable versions, published by one swap of a manifest.

A transaction writes new versions beside the old ones.  Committing replaces the manifest
file, so readers see all of a batch or nothing of it; aborting deletes what was written.
The manifest names the one before it, from which the last batch can be run again exactly.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import BatchOrderError
from tidemark.sources.files import Files

MANIFEST = "_manifest.json"


@dataclass
class Manifest:
    """tables: name -> version path; slices: name -> {batch: version path}."""

    tables: dict[str, str] = field(default_factory=dict)
    slices: dict[str, dict[str, str]] = field(default_factory=dict)
    batches: list[int] = field(default_factory=list)
    watermarks: dict[str, str] = field(default_factory=dict)
    previous: dict | None = None

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=1, sort_keys=True)


class TableStore:
    """The tables below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def manifest(self) -> Manifest:
        path = f"{self.root}/{MANIFEST}"
        return Manifest(**json.loads(self.files.read_text(path))) if self.files.exists(path) else Manifest()

    def table(self, name: str) -> DataFrame | None:
        """The published version, or None."""
        path = self.manifest().tables.get(name)
        return self.spark.read.parquet(f"{self.root}/{path}") if path else None

    def slice(self, name: str, batch: int, schema: T.StructType | None = None) -> DataFrame | None:
        path = self.manifest().slices.get(name, {}).get(str(batch))
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{path}") if path else None

    def slices(self, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        """The slices of all published batches together; rows carry their ``batch_id``."""
        paths = [f"{self.root}/{p}" for _, p in sorted(self.manifest().slices.get(name, {}).items(), key=lambda x: int(x[0]))]
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*paths) if paths else None

    def export(self, name: str, path: str, by: Sequence[str] = ("batch_id", "layer"), batch: int | None = None) -> None:
        """Writes slices, of one batch or all, to a folder partitioned ``by`` columns.

        Only partitions that the rows have are replaced; those of other batches stay.
        """
        rows = self.slices(name) if batch is None else self.slice(name, batch)
        if rows is not None:
            rows.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    def begin(self, batch: int) -> Transaction:
        """A transaction for ``batch``: the next one, or the last again from the state before it."""
        base = self.manifest()
        seen = base.to_json()
        last = max(base.batches, default=0)
        if batch == last and last:
            base = Manifest(**base.previous) if base.previous else Manifest()
        elif batch != last + 1:
            raise BatchOrderError(f"batch {batch} after batch {last}: run {last + 1}, or {last} again")
        return Transaction(self, base, batch, seen)

    def reset(self) -> None:
        self.files.delete(self.root)

    def write_json(self, path: str, value: object) -> str:
        full = f"{self.root}/{path}"
        self.files.write_text(full, json.dumps(value, indent=1, default=str))
        return full


class Transaction:
    """New versions on top of ``base``, seen by nobody until :meth:`commit`."""

    def __init__(self, store: TableStore, base: Manifest, batch: int, seen: str):
        self.store, self.base, self.batch, self.seen = store, base, batch, seen
        self.next = Manifest(**deepcopy(base.__dict__))
        before = Manifest(**deepcopy(base.__dict__))
        before.previous = None  # one step back is kept
        self.next.previous = before.__dict__
        self.written: list[str] = []

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{name.replace('.', '/')}/v-{self.batch}-{uuid.uuid4().hex[:12]}"
        self.written.append(path)
        df.write.parquet(f"{self.store.root}/{path}")
        return path

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a whole new version and reads it back; ``df`` may derive from the old one."""
        self.next.tables[name] = self._write(name, df)
        return self.table(name)

    def put_slice(self, name: str, df: DataFrame) -> DataFrame:
        """Writes this batch's slice, replacing one of an earlier attempt, also if empty."""
        path = self._write(name, df)
        self.next.slices.setdefault(name, {})[str(self.batch)] = path
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{path}")

    def table(self, name: str) -> DataFrame | None:
        path = self.next.tables.get(name)
        return self.store.spark.read.parquet(f"{self.store.root}/{path}") if path else None

    def commit(self) -> None:
        """Publishes, unless another run has published since this one began."""
        if self.store.manifest().to_json() != self.seen:
            raise BatchOrderError(f"batch {self.batch}: another run has published since this one began")
        if self.batch not in self.next.batches:
            self.next.batches.append(self.batch)
        self.store.files.write_text(f"{self.store.root}/{MANIFEST}", self.next.to_json())

    def abort(self) -> None:
        for path in self.written:
            self.store.files.delete(f"{self.store.root}/{path}")
