"""Tables on disk: any DataFrame source as input, versioned snapshots and deltas, bucketed tables.

A `Store` is a folder with one sub-folder per version.  The data of a version goes to a fresh folder of its own, as
Parquet that is partitioned by ``pmod(xxhash64(keys), n)`` and sorted by key within its files, so a point read
opens one directory and skips row groups by key range.  Last a commit file is put in place, which names that folder
and says what it holds; only then is the version there.  A write that was broken off leaves data that no
commit names: it is never read, and removed when the version is written again.  One writer at a time.

A version is full, or a delta: the updates since another version, one row a key, which are merged when
they are read.  So a small write costs as much as its updates, not as the table.  Bucketed tables join without a shuffle.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.merge import OVERWRITE, Algebraic, OrderBy, Overwrite
from ..operators.frame import KeyedFrame, _cols

_PLACE, _LAYER, _COMMIT = "__p", "__layer", "_commit.json"

#: Bytes of Parquet files for each partition of a layout: a million rows or so, for a task to sort or hash.
PARTITION_BYTES = 16 << 20


def partitions_for(spark: SparkSession, paths: Iterable[str], least: int = 1) -> int:
    """Partitions for tables of these files and folders (patterns too; what is not there counts nothing): so many
    that the rows of one, and with them the memory of a task, do not grow with the data."""
    context, size = spark.sparkContext, 0
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        size += sum(files.getContentSummary(found.getPath()).getLength() for found in files.globStatus(at) or ())
    return max(least, -(-size // PARTITION_BYTES))


def read_table(spark: SparkSession, path: str, keys: str | Sequence[str], values: str | Sequence[str] | None = None, format: str = "parquet", **how: Any) -> KeyedFrame:
    """A keyed table of any source that Spark reads; options of KeyedFrame.from_df may follow."""
    return KeyedFrame.from_df(spark.read.format(format).load(path), keys, values, **how)


def _natural(version: str) -> list[tuple[int, int, str]]:
    """Orders versions by the numbers in their names: 9 before 10."""
    return [(0, int(p), "") if p.isdecimal() else (1, 0, p) for p in re.split(r"(\d+)", version) if p]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- files ----

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Versions that are there, in natural order of their names."""
        files = self._files()
        if not files.exists(self._at()):
            return []
        found = [s.getPath().getName() for s in files.listStatus(self._at()) if s.isDirectory()]
        return sorted((v.removeprefix("v=") for v in found if v.startswith("v=") and files.exists(self._at(v, _COMMIT))), key=_natural)

    def _about(self, version: str) -> dict:
        stream = self._files().open(self._at(f"v={version}", _COMMIT))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, table: KeyedFrame, version: str, **about: Any) -> None:
        files, top = self._files(), f"v={version}"
        if files.exists(self._at(top, _COMMIT)):
            raise ValueError(f"version {version} exists")
        files.delete(self._at(top), True)  # what a write that was broken off has left
        n, data = table.num_partitions, f"data-{uuid.uuid4().hex}"
        place = F.pmod(F.xxhash64(*_cols(table.keys)), F.lit(n)).cast("int")
        rows = table.to_df().withColumn(_PLACE, place).repartition(n, _PLACE).sortWithinPartitions(_PLACE, *_cols(table.keys))
        rows.write.partitionBy(_PLACE).mode("errorifexists").parquet(f"{self.path}/{top}/{data}")
        self._commit(version, {"data": data, "keys": table.keys, "values": table.values, "n": n, "schema": rows.schema.jsonValue(), **about})

    def _commit(self, version: str, about: dict) -> None:
        files, draft = self._files(), self._at(f"v={version}", f"_draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(about).encode())
        out.close()
        if not files.rename(draft, self._at(f"v={version}", _COMMIT)):
            raise OSError(f"version {version} could not be committed")

    # ---- writes ----

    def save(self, table: KeyedFrame, version: str) -> None:
        """Writes a new full version; an existing one is an error."""
        self._write(table, version, base=None, merge=None)

    def save_delta(self, updates: DataFrame, version: str, base: str, merge: Overwrite | Algebraic = OVERWRITE, order_by: OrderBy = None) -> None:
        """Writes a new version that is `base` with the updates merged in, as the updates alone."""
        before = self._about(base)
        name = merge.name if isinstance(merge, Algebraic) else "overwrite"
        if before["merge"] not in (None, name):
            raise ValueError(f"version {base} is a delta by {before['merge']}, not by {name}")
        one = KeyedFrame.from_df(updates, before["keys"], before["values"], n=before["n"], merge=merge, order_by=order_by)
        self._write(one, version, base=base, merge=name)

    # ---- reads ----

    def chain(self, version: str) -> list[str]:
        """The versions that this one is read from: a full one, then deltas in order."""
        found = [version]
        while (base := self._about(found[0])["base"]) is not None:
            found.insert(0, base)
        return found

    def _read(self, version: str) -> DataFrame:
        about = self._about(version)
        return self.spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{self.path}/v={version}/{about['data']}")

    def _merged(self, version: str, narrowed=lambda rows: rows) -> KeyedFrame:
        about, chain = self._about(version), self.chain(version)
        keys, values, n = list(about["keys"]), list(about["values"]), about["n"]
        layers = [narrowed(self._read(v)).select(*_cols(keys), *_cols(values), F.lit(i).alias(_LAYER)) for i, v in enumerate(chain)]
        if len(layers) == 1:
            return KeyedFrame(layers[0].drop(_LAYER), keys, values, n)
        rows = layers[0]
        for layer in layers[1:]:
            rows = rows.union(layer)
        if about["merge"] == "overwrite":
            return KeyedFrame.from_df(rows, keys, values, n=n, order_by=_LAYER)
        return KeyedFrame.from_df(rows.drop(_LAYER), keys, values, n=n, merge=Algebraic(about["merge"]))

    def load(self, version: str | None = None) -> KeyedFrame:
        """A version, by default the last, in its layout (one shuffle)."""
        table = self._merged(version or self.versions()[-1])
        return KeyedFrame(table._placed(table.to_df()), table.keys, table.values, table.num_partitions)

    def lookup(self, keys: Iterable[Any], version: str | None = None) -> DataFrame:
        """Reads only the directories that own a requested key."""
        version = version or self.versions()[-1]
        about = self._about(version)
        names, wanted = list(about["keys"]), list(dict.fromkeys(keys))

        def narrowed(rows: DataFrame) -> DataFrame:
            if not wanted:
                return rows.limit(0)
            kinds = [rows.schema[k].dataType for k in names]
            own: Column | None = None
            for k in wanted:  # constant-folded: partition filters
                literal = [F.lit(x).cast(t) for x, t in zip(k if len(names) > 1 else (k,), kinds, strict=True)]
                one = F.col(_PLACE) == F.pmod(F.xxhash64(*literal), F.lit(about["n"])).cast("int")
                own = one if own is None else own | one
            return rows.where(own).where(KeyedFrame(rows, names, about["values"], about["n"])._in(wanted))

        return self._merged(version, narrowed).to_df()

    def get(self, key: Any, version: str | None = None) -> Any:
        version = version or self.versions()[-1]
        row = self.lookup([key], version).select(*_cols(self._about(version)["values"])).first()
        return None if row is None else row[0] if len(row) == 1 else tuple(row)


def save_bucketed(table: KeyedFrame, name: str, path: str | None = None) -> None:
    """A catalog table in as many buckets as the table has partitions; overwrites.  path: its folder, else the warehouse's."""
    writer = table.to_df().write.mode("overwrite").bucketBy(table.num_partitions, *table.keys).sortBy(*table.keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def load_bucketed(spark: SparkSession, name: str, keys: str | Sequence[str], n: int) -> KeyedFrame:
    """Its layout is that of the buckets, so it needs no shuffle to be joined."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = spark.table(name)
    return KeyedFrame(rows, keys, [c for c in rows.columns if c not in keys], n)
