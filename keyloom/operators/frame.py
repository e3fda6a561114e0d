"""The keyed table: an immutable DataFrame with unique keys and a hash layout.

A `KeyedFrame` holds rows hash-partitioned by key into n partitions.  Every operation returns a
new one; earlier versions stay valid.  Operations between tables with the same keys and n need no
shuffle of either; anything else is dealt to this table's layout first, so the table itself is never moved.

Named merges combine rows of a key before they are shuffled.  Where n is spark.sql.shuffle.partitions, as by
default, that takes one shuffle: the aggregation's own, which is the layout's.  With another n the combined rows
are shuffled once more, and overwrites, whose keys mostly differ, are dealt first and combined then.
A layout that the input has already (a bucketed table, repartition by the keys) is kept.

Null keys are an error.  Null values are kept, and count as absent where they are folded or probed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import check_keys, reject_null
from ..functions.merge import OVERWRITE, Algebraic, Fold, Merge, OrderBy, Overwrite, PandasFold, ordering, run_fold

#: Requested keys up to this number become an IN list, which prunes; more become a join.
IN_LIST = 1000
_OLD, _NEW = 0, 1


class KeyedFrame:
    def __init__(self, df: DataFrame, keys: Sequence[str], values: Sequence[str], n: int, name: str | None = None):
        """df must be unique on keys and partitioned by them into n partitions; use from_df for other input."""
        self._df, self.keys, self.values, self.num_partitions, self.name = df, tuple(keys), tuple(values), n, name

    # ---- construction ----

    @classmethod
    def from_df(cls, df: DataFrame, keys: str | Sequence[str], values: str | Sequence[str] | None = None, n: int | None = None, merge: Merge = OVERWRITE, order_by: OrderBy = None, value_type: str | None = None) -> KeyedFrame:
        """Builds a table; rows that share a key are merged in the order of order_by.

        value_type: type of the folded value, where a Fold changes it.
        n: partitions; by default those of df, if it is hash-partitioned by the keys, else spark.sql.shuffle.partitions."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        values = [values] if isinstance(values, str) else [c for c in df.columns if c not in keys] if values is None else list(values)
        check_keys(df, keys)
        n = n or layout_of(df, keys) or _default_n(df.sparkSession)
        empty = cls(df.limit(0).select(*_cols(keys), *_cols(values)), keys, values, n)
        return empty._like(empty._fold(empty._rows(df, order_by), merge, value_type))

    def _like(self, df: DataFrame, values: Sequence[str] | None = None) -> KeyedFrame:
        return KeyedFrame(df, self.keys, self.values if values is None else values, self.num_partitions)

    # ---- columns ----

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def key(self) -> Column:
        """The key as one column: itself, or a struct of the key columns."""
        return F.col(f"`{self.keys[0]}`") if len(self.keys) == 1 else F.struct(*_cols(self.keys))

    @property
    def value(self) -> Column:
        return F.col(f"`{self.values[0]}`") if len(self.values) == 1 else F.struct(*_cols(self.values))

    def _unpack(self, value: Column, names: Sequence[str] | None = None) -> list[Column]:
        names = self.values if names is None else names
        return [value.alias(names[0])] if len(names) == 1 else [value[c].alias(c) for c in names]

    def _packed(self) -> DataFrame:
        return self._df.select(*_cols(self.keys), self.value.alias("__v"))

    # ---- layout ----

    def _placed(self, df: DataFrame) -> DataFrame:
        """df in this layout; no shuffle where it has it already."""
        return df.repartition(self.num_partitions, *_cols(self.keys))

    def _rows(self, other: DataFrame, order_by: OrderBy) -> DataFrame:
        """other as keys, __u (its value) and __ord."""
        check_keys(other, self.keys)
        names = [c for c in other.columns if c not in self.keys]
        if set(self.values) <= set(names):  # other columns may serve order_by
            names = list(self.values)
        value = F.col(f"`{names[0]}`") if len(names) == 1 else F.struct(*_cols(names))
        return reject_null(other, self.keys).select(*_cols(self.keys), value.alias("__u"), ordering(order_by).alias("__ord"))

    def _combined(self, rows: DataFrame, found: Column, repeats: bool) -> DataFrame:
        """keys and __u, one row a key, in this layout.  repeats: whether keys are expected to repeat much."""
        if not repeats and self.num_partitions != _default_n(self.spark):
            rows = self._placed(rows)
        return self._placed(rows.groupBy(*_cols(self.keys)).agg(found.alias("__u")))

    def _wanted(self, keys: DataFrame) -> DataFrame:
        """The key columns of keys in this layout; may repeat where that saves a shuffle."""
        rows = keys.select(*_cols(self.keys))
        return self._placed(rows.distinct() if self.num_partitions == _default_n(self.spark) else rows)

    # ---- folding ----

    def _fold(self, updates: DataFrame, merge: Merge, value_type: str | None = None, base: DataFrame | None = None) -> DataFrame:
        """Keys and values after the updates (keys, __u, __ord) are merged into base (keys, __v); layout kept."""
        group = _cols(self.keys)
        kind = value_type or (base.schema["__v"] if base is not None else updates.schema["__u"]).dataType.simpleString()
        if isinstance(merge, Overwrite | Algebraic):
            rows = updates.withColumn("__u", F.col("__u").cast(kind))
            one = self._combined(rows, _last(rows) if isinstance(merge, Overwrite) else merge.aggregate(F.col("__u")), isinstance(merge, Algebraic))
            rows = one.withColumnRenamed("__u", "__v")
            if base is not None:
                both = base.select(*group, "__v", F.lit(_OLD).alias("__src")).union(rows.select(*group, "__v", F.lit(_NEW).alias("__src")))
                found = F.max_by("__v", "__src") if isinstance(merge, Overwrite) else merge.aggregate(F.col("__v")).cast(rows.schema["__v"].dataType)
                rows = both.groupBy(*group).agg(found.alias("__v"))
            return rows.select(*group, *self._unpack(F.col("__v")))
        updates = self._placed(updates)
        item = updates.schema["__u"].dataType
        rows = updates.select(*group, F.lit(_NEW).alias("src"), F.col("__ord").alias("ord"), F.lit(None).cast(kind).alias("v"), F.col("__u").alias("u"))
        if base is not None:
            order = F.lit(None).cast(updates.schema["__ord"].dataType)
            rows = base.select(*group, F.lit(_OLD).alias("src"), order.alias("ord"), F.col("__v").alias("v"), F.lit(None).cast(item).alias("u")).union(rows)
        if isinstance(merge, PandasFold):
            return self._python_fold(rows, merge, kind)
        listed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("src", "ord", "v", "u"))).alias("l"))
        return listed.select(*group, *self._unpack(run_fold(merge, self.key, F.col("l"), kind)))

    def _python_fold(self, rows: DataFrame, merge: PandasFold, kind: str) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql import Window
        from pyspark.sql import types as T
        from pyspark.sql.pandas.types import to_arrow_type

        keys, single = list(self.keys), len(self.keys) == 1
        fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
        result = to_arrow_type(T._parse_datatype_string(kind))

        def run(key: tuple, group: pa.Table) -> pa.Table:
            name = key[0].as_py() if single else tuple(k.as_py() for k in key)
            acc = None
            group = group.sort_by("at")
            for src, v, u in zip(*(group[c].to_pylist() for c in ("src", "v", "u")), strict=True):
                acc = v if src == _OLD else merge.project(name, u) if acc is None else merge.merge(name, acc, u)
            return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(keys, key, strict=True)}, "v": pa.array([acc], result)})

        # The order travels as a rank: Arrow cannot sort every Spark type.
        placed = rows.withColumn("at", F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy("src", "ord"))).drop("ord")
        folded = placed.groupBy(*_cols(keys)).applyInArrow(run, f"{fields}v {kind}")
        return self._placed(folded.select(*_cols(keys), *self._unpack(F.col("v"))))

    # ---- reads ----

    def to_df(self) -> DataFrame:
        return self._df

    def collect(self) -> list:
        return self._df.collect()

    def count(self) -> int:
        return self._df.count()

    def lookup(self, keys: Iterable[Any] | DataFrame) -> DataFrame:
        """The rows of the requested keys; absent keys are left out, repeated ones collapse."""
        if isinstance(keys, DataFrame):
            return self._df.join(self._wanted(keys), list(self.keys), "left_semi")
        wanted = list(dict.fromkeys(keys))
        if len(wanted) > IN_LIST:
            return self.lookup(self._frame({k: None for k in wanted}, with_value=False))
        return self._df.where(self._in(wanted))

    def _in(self, wanted: Sequence[Any]) -> Column:
        if not wanted:
            return F.lit(False)
        if len(self.keys) == 1:
            return F.col(f"`{self.keys[0]}`").isin(list(wanted))
        one = lambda k: [F.col(f"`{c}`") == F.lit(x) for c, x in zip(self.keys, k, strict=True)]
        whole = F.lit(False)
        for k in wanted:
            part = F.lit(True)
            for c in one(k):
                part = part & c
            whole = whole | part
        return whole

    def multiget(self, keys: Iterable[Any]) -> dict:
        """Driver map of the requested keys that are there."""
        m = len(self.keys)
        pick = lambda r: r[m] if len(self.values) == 1 else tuple(r[m:])
        return {(r[0] if m == 1 else tuple(r[:m])): pick(r) for r in self.lookup(keys).select(*self.keys, *self.values).collect()}

    def get(self, key: Any) -> Any:
        """The value, or None where the key is absent or its value null."""
        return self.multiget([key]).get(key)

    def contains(self, key: Any) -> bool:
        """Whether the key has a value that is not null."""
        return self.get(key) is not None

    # ---- projections ----

    def filter(self, predicate: Column | Callable[[Column, Column], Column]) -> KeyedFrame:
        return self._like(self._df.where(predicate if isinstance(predicate, Column) else predicate(self.key, self.value)))

    def map_values(self, f: Callable[..., Column], with_key: bool = False, name: str | None = None) -> KeyedFrame:
        """f(value), or f(key, value) with with_key."""
        new = f(self.key, self.value) if with_key else f(self.value)
        name = name or (self.values[0] if len(self.values) == 1 else "value")
        return self._like(self._df.select(*_cols(self.keys), new.alias(name)), [name])

    # ---- writes ----

    def _frame(self, entries: Mapping[Any, Any], with_value: bool = True, kind: Any = None) -> DataFrame:
        """A driver map as a DataFrame."""
        from pyspark.sql import types as T

        fields = [self._df.schema[k] for k in self.keys]
        rows = [(*(k if len(self.keys) > 1 else (k,)), *((v,) if with_value else ())) for k, v in entries.items()]
        if with_value and kind is None:
            kind = self._packed().schema["__v"].dataType
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + ([T.StructField("__value", T._parse_datatype_string(kind) if isinstance(kind, str) else kind)] if with_value else []))
        return self.spark.createDataFrame(rows, schema)

    def put(self, key: Any, value: Any) -> KeyedFrame:
        return self.multiput({key: value})

    def multiput(self, entries: Mapping[Any, Any], merge: Merge = OVERWRITE, update_type: str | None = None) -> KeyedFrame:
        """Writes a driver map.  update_type: type of its values where it is not that of the table's.
        A small overwrite only filters the table's rows and adds the new ones."""
        if isinstance(merge, Overwrite) and update_type is None and 0 < len(entries) <= IN_LIST:
            new = reject_null(self._frame(entries), self.keys)
            rows = self._packed().where(~self._in(list(entries))).union(self._placed(new))
            return self._like(rows.select(*_cols(self.keys), *self._unpack(F.col("__v"))))
        return self.multiput_df(self._frame(entries, kind=update_type), merge)

    def multiput_df(self, updates: Other, merge: Merge = OVERWRITE, order_by: OrderBy = None) -> KeyedFrame:
        """Writes rows of any number; each row of a key folds in turn, in the order of order_by.  A Fold or
        PandasFold gathers the rows of one key in one row or task, so a key's updates must fit in memory."""
        return self._like(self._fold(self._rows(_frame_of(updates), order_by), merge, base=self._packed()))

    def delete(self, keys: Iterable[Any]) -> KeyedFrame:
        keys = list(dict.fromkeys(keys))
        if len(keys) > IN_LIST:
            return self.delete_df(self._frame({k: None for k in keys}, with_value=False))
        return self._like(self._df.where(~self._in(keys)))

    def delete_df(self, keys: Other) -> KeyedFrame:
        return self._like(self._df.join(self._wanted(_frame_of(keys)), list(self.keys), "left_anti"))

    # ---- joins ----

    def _side(self, other: Other, order_by: OrderBy) -> DataFrame:
        """other as unique keys and __u in this layout; of repeated keys the last by order_by."""
        other = _table_of(other)
        if isinstance(other, KeyedFrame):
            if other.keys != self.keys:
                raise ValueError(f"key columns differ: {self.keys} and {other.keys}")
            rows = other._packed().withColumnRenamed("__v", "__u")
            return rows if other.num_partitions == self.num_partitions else self._placed(rows)
        rows = self._rows(other, order_by)
        return self._combined(rows, _last(rows), False)

    def inner_join(self, other: Other, f: Callable[[Column, Column, Column], Column], order_by: OrderBy = None, name: str = "value") -> KeyedFrame:
        """Keys of both; f(key, mine, theirs).  A null value of theirs is no match."""
        both = self._packed().join(self._side(other, order_by), list(self.keys)).where(F.col("__u").isNotNull())
        return self._like(both.select(*_cols(self.keys), f(self.key, F.col("__v"), F.col("__u")).alias(name)), [name])

    def left_join(self, other: Other, f: Callable[[Column, Column, Column], Column], order_by: OrderBy = None, name: str = "value") -> KeyedFrame:
        """My keys; f(key, mine, theirs or null)."""
        both = self._packed().join(self._side(other, order_by), list(self.keys), "left")
        return self._like(both.select(*_cols(self.keys), f(self.key, F.col("__v"), F.col("__u")).alias(name)), [name])

    def update_join(self, other: Other, f: Callable[[Column, Column, Column], Column] | Overwrite | Algebraic, order_by: OrderBy = None) -> KeyedFrame:
        """My keys; each of their rows of a key folds in turn, f(key, mine so far, theirs).  Values keep their type;
        keys that are only theirs are dropped, and my null values stay null.  f may be a named merge, which combines
        their rows of a key before the shuffle; a function gathers them in one row."""
        other = _frame_of(other)
        kind = self._packed().schema["__v"].dataType.simpleString()
        mine, rows = F.col("__v"), self._rows(other, order_by)
        if isinstance(f, Overwrite | Algebraic):
            found = F.struct(_last(rows)) if isinstance(f, Overwrite) else f.aggregate(F.col("__u"))
            both = self._packed().join(self._combined(rows, found, True), list(self.keys), "left")
            theirs = F.col("__u")
            new = F.when(theirs.isNotNull(), theirs["col1"]).otherwise(mine) if isinstance(f, Overwrite) else f.pair(mine, theirs)
            return self._like(both.select(*_cols(self.keys), *self._unpack(F.when(mine.isNotNull(), new.cast(kind)))))
        items = self._placed(rows).groupBy(*_cols(self.keys)).agg(F.array_sort(F.collect_list(F.struct("__ord", "__u"))).alias("__l"))
        both = self._packed().join(items, list(self.keys), "left")
        step = lambda acc, x: F.when(acc.isNotNull(), f(self.key, acc, x["__u"])).cast(kind)
        folded = F.when(F.col("__l").isNull(), mine).otherwise(F.aggregate("__l", mine.cast(kind), step))
        return self._like(both.select(*_cols(self.keys), *self._unpack(folded)))

    def full_outer_join(self, other: Other, f: Callable[[Column, Column, Column], Column], order_by: OrderBy = None, lazy: bool = False, name: str | None = None):
        """Keys of either; f(key, mine or null, theirs or null).  lazy keeps both as layers that are
        merged when they are read; it needs values of one type and an f that returns it."""
        from .layered import LayeredFrame

        name = name or (self.values[0] if len(self.values) == 1 else "value")
        if lazy and isinstance(other, KeyedFrame | LayeredFrame):
            return LayeredFrame.of(self, other, f)
        sides = [self._packed(), self._side(other, order_by).withColumnRenamed("__u", "__v")]
        return self._like(merge_sides(sides, self.keys, lambda key, a, b: f(key, a, b), self.key, name), [name])

    def diff(self, other: Other, order_by: OrderBy = None) -> KeyedFrame:
        """Keys of both whose values differ, with my value; a null value of theirs is no match."""
        both = self._packed().join(self._side(other, order_by), list(self.keys))
        both = both.where(F.col("__u").isNotNull() & ~F.col("__v").eqNullSafe(F.col("__u")))
        return self._like(both.select(*_cols(self.keys), *self._unpack(F.col("__v"))))

    # ---- aggregation that shares the layout ----

    def aggregate_using_index(self, rows: Other, merge: Merge, order_by: OrderBy = None) -> KeyedFrame:
        """The rows reduced by key, in this layout.  Their keys alone count, not this table's."""
        return KeyedFrame.from_df(_frame_of(rows), self.keys, n=self.num_partitions, merge=merge, order_by=order_by)

    def create_using_index(self, rows: Other, order_by: OrderBy = None, values: str | Sequence[str] | None = None) -> KeyedFrame:
        """A new table of the rows, in this layout; the last by order_by wins."""
        return KeyedFrame.from_df(_frame_of(rows), self.keys, values, n=self.num_partitions, order_by=order_by)

    # ---- persistence ----

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> KeyedFrame:
        """Keeps the rows, sorted within partitions, so that point reads skip batches by their key ranges."""
        kept = self._df.sortWithinPartitions(*_cols(self.keys)).persist(level)
        return KeyedFrame(kept, self.keys, self.values, self.num_partitions, self.name)

    cache = persist

    def unpersist(self, blocking: bool = True) -> KeyedFrame:
        self._df.unpersist(blocking)
        return self

    def set_name(self, name: str) -> KeyedFrame:
        self._df.createOrReplaceTempView(name)
        return KeyedFrame(self._df, self.keys, self.values, self.num_partitions, name)

    def reindex(self) -> KeyedFrame:
        """Already one table: itself."""
        return self

    def compact(self) -> KeyedFrame:
        """Cuts the plan of many writes: the rows go through the checkpoint folder, then back to the layout."""
        shared_folder(self.spark)
        return self._like(self._placed(self._df.checkpoint())).persist()

    def assert_unique(self) -> None:
        """Raises if a key occurs twice (it never should)."""
        if twice := self._df.groupBy(*_cols(self.keys)).count().where("count > 1").take(1):
            raise ValueError(f"key occurs more than once: {twice[0]}")


#: What another side may be: rows, a table, or a lazy stack of tables.
Other = Any


def _table_of(other: Other) -> DataFrame | KeyedFrame:
    """A lazy stack as the table it stands for, anything else as it is."""
    from .layered import LayeredFrame

    return other.merged() if isinstance(other, LayeredFrame) else other


def _frame_of(other: Other) -> DataFrame:
    other = _table_of(other)
    return other.to_df() if isinstance(other, KeyedFrame) else other


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def _last(rows: DataFrame) -> Column:
    """The last __u by __ord; any, where nothing orders them."""
    return F.max_by("__u", "__ord") if isinstance(rows.schema["__ord"].dataType, StructType) else F.first("__u")


def _default_n(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def layout_of(df: DataFrame, keys: Sequence[str]) -> int | None:
    """Partitions of df where it is hash-partitioned by just these columns, in this order; else None."""
    plan = df._jdf.queryExecution().sparkPlan()
    place = plan.outputPartitioning()
    if place.getClass().getSimpleName() != "HashPartitioning":
        return None
    of = lambda xs: [xs.apply(i) for i in range(xs.size())]
    named = {a.exprId().id(): a.name() for a in of(plan.output())}
    found = [named.get(e.exprId().id()) if e.getClass().getSimpleName() == "AttributeReference" else None for e in of(place.expressions())]
    return place.numPartitions() if found == list(keys) else None


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset a local session gets a temporary one; a cluster, whose
    machines would not see it, gets an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if named is None:
            import tempfile

            named = tempfile.mkdtemp(prefix="keyloom-")
        context.setCheckpointDir(named)
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def merge_sides(sides: Sequence[DataFrame], keys: Sequence[str], f: Callable[[Column, Column, Column], Column], key: Column, name: str) -> DataFrame:
    """Left to right full outer merge of tables (keys, __v) of one layout, as a tagged union and one
    aggregation: unlike a full outer join it keeps the layout.  A side that lacks the key is null."""
    rows = None
    for i, side in enumerate(sides):
        tagged = side.select(*_cols(keys), *(F.struct(F.col("__v").alias("x") if i == j else F.lit(None).cast(s.schema["__v"].dataType).alias("x"), F.lit(i == j).alias("here")).alias(f"__s{j}") for j, s in enumerate(sides)))
        rows = tagged if rows is None else rows.union(tagged)
    found = rows.groupBy(*_cols(keys)).agg(*(F.first(F.when(F.col(f"__s{i}.here"), F.col(f"__s{i}")), ignorenulls=True).alias(f"__s{i}") for i in range(len(sides))))
    acc, here = F.col("__s0.x"), F.col("__s0").isNotNull()
    for i in range(1, len(sides)):
        theirs = F.col(f"__s{i}").isNotNull()
        both = f(key, acc, F.col(f"__s{i}.x"))
        acc = both if i == 1 and len(sides) == 2 else F.when(here | theirs, both)
        here = here | theirs
    return found.select(*_cols(keys), acc.alias(name))
