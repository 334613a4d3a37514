"""The feature lake: feature groups as versioned tables, read aligned to one master index."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S
from .functions.runtime import roots, with_columns_topo
from .functions.transforms import transform_exprs
from .operators.deltas import Deltas, index_deltas, preprocess, replaced, upserted, without_empty
from .operators.reading import align, between, gather, quote
from .plans.catalog import by_table, last_updated, latest_per_feature, named
from .plans.tracing import traced
from .plans.transactions import again, atomically, transaction
from .sources.shared import literal, local_frame, spark_frame, spark_schema, wider
from .sources.table_io import ParquetTableIO, TableIO, codec

#: A group of so many rows at most is sent to all tasks of a read.
FEW_ROWS = 2_000

FrameModifier = Callable[[DataFrame], DataFrame]


def no_op_modifier(df: DataFrame) -> DataFrame:
    """What :meth:`FeatureLake.read` applies to its result if nothing else is given."""
    return df


class BaseFeatureLake(ABC):
    @abstractmethod
    def initialize(self, schema: T.StructType = S.DEFAULT_INDEX): ...

    @abstractmethod
    def add_features(self, df: DataFrame, owner: str = "missing_owner", metadata: DataFrame | None = None, overlap_mode: str = "copy") -> None: ...

    @abstractmethod
    def add_targets(self, df: DataFrame, owner: str = "missing_owner", metadata: DataFrame | None = None, overlap_mode: str = "copy") -> None: ...

    @abstractmethod
    def add_as_of_features(self, df: DataFrame, params: dict, owner: str = "missing_owner", metadata: DataFrame | None = None, overlap_mode: str = "copy") -> None: ...

    @abstractmethod
    def add_sparse_features(self, df: DataFrame, owner: str = "missing_owner", metadata: DataFrame | None = None, overlap_mode: str = "copy") -> None: ...

    @abstractmethod
    def read(self, features, targets: list[str] | None = None, start=None, end=None, materialized: bool = True) -> DataFrame: ...

    def add_index_rows(self, df: DataFrame) -> None:
        raise NotImplementedError


class FeatureLake(BaseFeatureLake):
    """A lake at ``base_path``, a folder that all executors share.

    ``io`` may be any :class:`TableIO`. With the one of this package a write is seen whole or not at all, however
    many tables it goes to, and of several writers at a time each builds on what the others have published.
    """

    def __init__(self, spark: SparkSession, base_path: str, feature_metadata_path: str = "feature_metadata", table_metadata_path: str = "table_metadata", index_path: str = "index", transaction_log_path: str = "transaction_log", table_name_prefix: str = "", primary_sort_key: str = "timestamp", compression: str = "zstd", target_file_size: int = 128 << 20, enable_runtime_computed_features: bool = False, io: TableIO | None = None):
        self.spark, self.base_path = spark, base_path.rstrip("/")
        self.feature_metadata, self.table_metadata, self.index, self.transaction_log = feature_metadata_path, table_metadata_path, index_path, transaction_log_path
        self.table_name_prefix, self.primary = table_name_prefix, primary_sort_key
        self.enable_runtime_computed_features = enable_runtime_computed_features
        self.compression = codec(compression)
        self.io = io or ParquetTableIO(spark, self.base_path, compression, target_file_size)
        self.keys: list[str] = []
        if self.io.exists(self.index):
            self._keys_from(self.io.schema(self.index))

    # set-up

    def _keys_from(self, schema: T.StructType) -> None:
        if self.primary not in schema.fieldNames():
            raise ValueError(f"the primary sort key {self.primary!r} is not among {schema.fieldNames()}")
        self.keys, self.index_schema = schema.fieldNames(), schema

    @traced
    def initialize(self, schema: T.StructType = S.DEFAULT_INDEX) -> FeatureLake:
        """Create the system tables that are missing. An existing index must have the same schema.

        The schema may also be an Arrow schema.
        """
        schema = spark_schema(schema)
        if self.primary not in schema.fieldNames():
            raise ValueError(f"the primary sort key {self.primary!r} is not among {schema.fieldNames()}")
        if self.io.exists(self.index):
            there = self.io.schema(self.index)
            if [(f.name, f.dataType) for f in there] != [(f.name, f.dataType) for f in schema]:
                raise ValueError(f"the lake has the sort keys {there.simpleString()}")
        self.ensure_transaction_log()  # no part of what is published together
        kinds = {self.index: schema, self.feature_metadata: S.FEATURE_METADATA, self.table_metadata: S.table_metadata(schema[self.primary].dataType)}

        def create(touched) -> None:
            for target, kind in kinds.items():
                if not self.io.exists(target):
                    self.io.commit(touched(target), [], kind, "create", "error")

        if not all(map(self.io.exists, kinds)):
            atomically(self.io, create)
        self._keys_from(self.io.schema(self.index))
        return self

    def ensure_initialized(self) -> None:
        self.io.pin()
        if not self.keys:
            if not self.io.exists(self.index):
                raise S.UninitializedLakeException(f"no lake at {self.base_path}: call initialize() first")
            self._keys_from(self.io.schema(self.index))

    def ensure_transaction_log(self) -> None:
        if not self.io.exists(self.transaction_log):
            self.io.commit(self.transaction_log, [], S.TRANSACTION_LOG, "create", "error")

    def get_path(self, target: str) -> str:
        return f"{self.base_path}/{target}"

    def gen_table_addr(self) -> str:
        return f"{self.table_name_prefix}group_{uuid.uuid4().hex[:8]}"

    # frames

    def index_frame(self, start=None, end=None) -> DataFrame:
        self.ensure_initialized()
        return between(self.io.scan(self.index, ranges={self.primary: (start, end)}), self.primary, start, end)

    def feature_metadata_frame(self, start=None, end=None) -> DataFrame:
        """All feature rows. They have no sort key, so bounds can't apply and are refused."""
        self.ensure_initialized()
        if start is not None or end is not None:
            raise ValueError("feature metadata has no sort key that start and end could bound")
        return self.io.scan(self.feature_metadata)

    def table_metadata_frame(self, start=None, end=None) -> DataFrame:
        """Updates of tables; bounds apply to ``last_updated``."""
        self.ensure_initialized()
        return between(self.io.scan(self.table_metadata), "last_updated", start, end)

    def transaction_log_frame(self) -> DataFrame:
        self.ensure_initialized()
        return self.io.scan(self.transaction_log)

    # writing

    @traced
    def add_features(self, df, owner="missing_owner", metadata=None, overlap_mode="copy"):
        self._add(df, S.FEATURE, owner, metadata, None, overlap_mode)

    @traced
    def add_targets(self, df, owner="missing_owner", metadata=None, overlap_mode="copy"):
        self._add(df, S.TARGET, owner, metadata, None, overlap_mode)

    @traced
    def add_as_of_features(self, df, params, owner="missing_owner", metadata=None, overlap_mode="copy"):
        """Observations that index rows match by ``params``: strategy, tolerance, allow_exact_matches."""
        self._add(df, S.AS_OF, owner, metadata, params, overlap_mode)

    @traced
    def add_sparse_features(self, df, owner="missing_owner", metadata=None, overlap_mode="copy"):
        self._add(df, S.SPARSE, owner, metadata, None, overlap_mode)

    @traced
    def add_index_rows(self, df: DataFrame) -> None:
        """Extend the index by keys; every group reads as null there."""
        self.ensure_initialized()
        df = spark_frame(self.spark, df)
        staged: list = []

        def body(touched) -> None:
            rows, files = staged or self._staged(df.select(*self.keys), staged)
            self._extend_index(rows, files, self._deltas(rows, files), touched)

        transaction(self, "missing_owner", "index", body)

    def _staged(self, df: DataFrame, kept: list) -> list:
        """The cleaned input and its files, written once: laid out by range of keys, so that ranges of the primary key prune files.

        They are put in ``kept`` too, for a second attempt at publishing them.
        """
        self._check_keys(df)
        rest = [c for c in df.columns if c not in self.keys]
        cast = df.select(*[F.col(f"`{k}`").cast(self.index_schema[k].dataType).alias(k) for k in self.keys], *[F.col(f"`{c}`") for c in rest])
        clean = preprocess(cast, self._order())
        files = [f for f in self.io.stage(clean, self.keys, like=cast) if f["rows"] != 0]
        if not files:
            raise ValueError("Provided dataframe has no rows!")
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in clean.schema.fields])
        kept[:] = self._frame(files, schema), files
        return kept

    def _frame(self, files: list[dict], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.base_path}/{f['path']}" for f in files])

    def _check_keys(self, df: DataFrame) -> None:
        if missing := [k for k in self.keys if k not in df.columns]:
            raise ValueError(f"sort keys are missing: {', '.join(missing)}")

    def _deltas(self, rows: DataFrame, files: list[dict]) -> Deltas:
        low, high = self.io.range_of(files, self.primary, self.index_schema[self.primary].dataType)
        return index_deltas(rows, self.io.scan(self.index, ranges={self.primary: (low, high)}), self.keys, self.primary)

    def _extend_index(self, rows: DataFrame, files: list[dict], d: Deltas, touched) -> None:
        kind = T.StructType([self.index_schema[k] for k in self.keys])
        if d.new_rows == d.rows:  # the staged files already hold these keys
            self.io.commit(touched(self.index), files, kind, "extend")
        elif d.new_rows:
            self.io.commit(touched(self.index), self.io.stage(d.new, self.keys), kind, "extend")

    def _add(self, df: DataFrame, signal_type: str, owner: str, metadata: DataFrame | None, params: dict | None, overlap_mode: str) -> None:
        self.ensure_initialized()
        if overlap_mode not in ("copy", "merge"):
            raise ValueError(f"overlap_mode {overlap_mode!r} is neither copy nor merge")
        df = spark_frame(self.spark, df)
        self._check_keys(df)
        columns = [c for c in df.columns if c not in self.keys]
        if not columns:
            raise ValueError("there are no feature columns")
        # metadata= says which tables need no alignment rows; reads align by key here, so none are stored for any
        if metadata is not None and "table_addr" not in metadata.columns:
            raise ValueError("metadata= must be rows of the feature metadata, with their table_addr")
        text = None if params is None else json.dumps(params)
        staged: list = []

        def body(touched) -> None:
            latest = self._latest(columns)
            if taken := [c for c in columns if c in latest and latest[c].signal_type == S.RUNTIME]:
                raise ValueError(f"registered as runtime features: {', '.join(taken)}")
            marks = last_updated(self.table_metadata_frame(), [r.table_addr for r in latest.values()])
            groups: dict[str | None, list[str]] = {}
            for c in columns:
                groups.setdefault(latest[c].table_addr if c in latest else None, []).append(c)
            rows, files = staged or self._staged(df, staged)
            d = self._deltas(rows, files)
            tables, features = [], []
            for addr, own in groups.items():
                table, published = self._update(rows, files, d, addr, own, latest, marks, signal_type, overlap_mode, touched)
                tables.append((table, d.high if table not in marks else max(marks[table], d.high)))
                features += [(c, v, table, owner, signal_type, text) for c, v in published]
            self._extend_index(rows, files, d, touched)
            self._publish(tables, features, touched)

        transaction(self, owner, signal_type, body)

    def _update(self, rows, files, d: Deltas, addr, own, latest, marks, signal_type, overlap_mode, touched):
        """Write one group; its table, and (feature, version) of what is published anew."""
        kind = T.StructType([rows.schema[c] for c in (*self.keys, *own)])
        mine = rows.select(*self.keys, *[F.col(f"`{c}`") for c in own])
        if addr is None:  # new group: a table of its own that lists the staged files
            table = self.gen_table_addr()
            self._list(table, mine, files, kind, signal_type, touched)
            return table, [(c, 0) for c in own]
        mark = marks.get(addr)
        if d.new_rows == d.rows or mark is None or d.low > mark:  # nothing of it is replaced
            self._list(addr, mine, files, kind, signal_type, touched)
            return addr, []
        table = self.gen_table_addr() if overlap_mode == "copy" else addr
        there = self.io.schema(addr)
        names = own if overlap_mode == "copy" else [f.name for f in there if f.name not in self.keys]
        ranges = {self.primary: (d.low, d.high)}
        held = self.io.holding(addr, ranges) if all(there[c].dataType == rows.schema[c].dataType for c in own) else None
        if held is None:  # columns whose type changes, and other storage
            old = self.io.scan(addr).select(*self.keys, *[F.col(f"`{c}`") for c in names])
            self.io.write(self._ordered(self._overlapped(old, mine, own, d, signal_type)), touched(table), "overwrite", self.keys)
        else:
            self._swap(addr, table, held, ranges, rows, files, mine, names, own, d, signal_type, touched)
        return table, [(c, latest[c].version + 1) for c in own]

    def _overlapped(self, old: DataFrame, mine: DataFrame, own: list[str], d: Deltas, signal_type: str) -> DataFrame:
        """Stored rows after an overlapping upload."""
        if signal_type == S.AS_OF:
            return upserted(old, mine, self.keys, own)
        whole = replaced(old, mine, self.keys, self.primary, own, d.low, d.high)
        return without_empty(whole, self.keys) if signal_type == S.SPARSE else whole

    def _swap(self, addr, table, held, ranges, rows, files, mine, names, own, d: Deltas, signal_type, touched) -> None:
        """An overlapping upload by file: files without rows that it touches stay listed, in a copy too.

        Where a table has no columns besides the upload's, its rows in [low, high] go and the staged files come in
        their place: of the files there only those that also have other rows are written anew, without them. An as-of
        upload touches only the files that hold one of its keys.
        """
        if signal_type == S.AS_OF:
            held = self.io.holding(addr, ranges, mine.select(*self.keys))
        old = self.io.of_files(addr, held).select(*self.keys, *[F.col(f"`{c}`") for c in names])
        if set(names) > set(own):
            new = self._stage(self._overlapped(old, mine, own, d, signal_type))
        else:
            if signal_type == S.AS_OF:
                kept, border = old.join(mine.select(*self.keys), self.keys, "left_anti"), held
            else:
                replaced_whole = self.io.inside(addr, held, ranges)
                border = [f for f in held if f not in replaced_whole]
                rest = self.io.of_files(addr, border).select(*self.keys, *[F.col(f"`{c}`") for c in names])
                low, high = (literal(x, self.index_schema[self.primary].dataType) for x in (d.low, d.high))
                kept = rest.where(~F.col(f"`{self.primary}`").between(low, high))
            new = self._stage(kept) if border else []
            if signal_type == S.SPARSE and not mine.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in own]).isNull()).isEmpty():
                new += self._stage(without_empty(mine, self.keys))
            else:
                new += files
        kind = T.StructType([f for f in self.io.schema(addr) if f.name in self.keys or f.name in names])
        self.io.swap(addr, touched(table), held, new, kind, "overlap")

    def _stage(self, df: DataFrame) -> list[dict]:
        return [f for f in self.io.stage(self._ordered(df), self.keys) if f["rows"] != 0]

    def _list(self, table: str, mine: DataFrame, files: list[dict], kind: T.StructType, signal_type: str, touched) -> None:
        if self.io.exists(table):
            there = {f.name: f.dataType for f in self.io.schema(table)}
            if changed := {f.name: wider(self.spark, f.name, there[f.name], f.dataType) for f in kind if f.name in there and there[f.name] != f.dataType}:
                mine = mine.select(*[F.col(f"`{f.name}`").cast(changed.get(f.name, f.dataType)).alias(f.name) for f in kind])
                if all(there[n] == t for n, t in changed.items()):  # the table holds such values already
                    self.io.write(mine, touched(table), "append", self.keys)
                else:  # its files are rewritten in the wider type
                    old = self.io.scan(table)
                    old = old.select(*[F.col(f"`{c}`").cast(changed[c]).alias(c) if c in changed else F.col(f"`{c}`") for c in old.columns])
                    self.io.write(self._ordered(old.unionByName(mine, allowMissingColumns=True)), touched(table), "overwrite", self.keys)
                return
        self.io.commit(touched(table), files, kind, "append")

    def _ordered(self, df: DataFrame) -> DataFrame:
        """Laid out by range of the keys, so that ranges of the primary key prune files."""
        return df.repartitionByRange(*self._order()).sortWithinPartitions(*self._order())

    def _order(self) -> list[str]:
        return [self.primary, *[k for k in self.keys if k != self.primary]]

    def _latest(self, names) -> dict:
        """The latest metadata row of each of these features that is known."""
        return latest_per_feature(self.feature_metadata_frame(), names)

    def _publish(self, tables: list[tuple], features: list[tuple], touched) -> None:
        """One commit for each metadata table, after the data."""
        now = dt.datetime.now(dt.UTC)
        kind = S.table_metadata(self.index_schema[self.primary].dataType)
        for target, rows, schema in ((self.table_metadata, [(*t, now) for t in tables], kind), (self.feature_metadata, features, S.FEATURE_METADATA)):
            if rows:
                self.io.write(local_frame(self.spark, rows, schema), touched(target))

    @traced
    def compact(self, features: list[str] | None = None, by: list[str] | None = None) -> dict[str, int]:
        """Join the small files of system tables, and of the tables of features (all if none are named).

        How many files were joined, by table. Nothing that is read changes, and older versions stay readable. With
        ``by``, sort keys, all files of these tables and of the index are written anew, in an order that keeps rows
        close that are close in these keys (one: by range of it; several: a Z-order), so that reads which bound any of
        them open few files.
        """
        self.ensure_initialized()
        rows = self.feature_metadata_frame()
        rows = rows if features is None else named(rows, "feature_name", features)
        tables = [r.table_addr for r in rows.select("table_addr").distinct().collect() if r.table_addr != S.NO_TABLE]
        if by and (wrong := [k for k in by if k not in self.keys]):
            raise ValueError(f"not sort keys: {', '.join(wrong)}")


        def body(touched) -> dict[str, int]:
            own, system = [self.index, *sorted(tables)], [self.feature_metadata, self.table_metadata]
            for t in (*own, *system):
                touched(t)
            return self.io.compact(own, self._order(), by=by or ()) | self.io.compact(system)

        return atomically(self.io, body) | again(lambda: self.io.compact([self.transaction_log]))

    @traced
    def consolidate_feature_groups(self, features: list[str]) -> str | None:
        """Bring dense features of several tables into one; its address, or None if they are in one already."""
        self.ensure_initialized()

        def body(touched) -> str | None:
            latest = self._latest(features)
            if missing := [f for f in features if f not in latest]:
                raise S.MissingFeaturesException(f"unknown: {', '.join(missing)}")
            rows = [latest[f] for f in dict.fromkeys(features)]
            if wrong := [r.feature_name for r in rows if r.signal_type not in (S.FEATURE, S.TARGET)]:
                raise ValueError(f"only dense features can be consolidated: {', '.join(wrong)}")
            if len({r.table_addr for r in rows}) < 2:
                return None
            marks = last_updated(self.table_metadata_frame(), [r.table_addr for r in rows])
            table = self.gen_table_addr()
            self.io.write(self._ordered(self._assemble(rows, None, None)), touched(table), "overwrite", self.keys)
            mark = max(marks[r.table_addr] for r in rows if r.table_addr in marks)
            self._publish([(table, mark)], [(r.feature_name, r.version + 1, table, r.owner, r.signal_type, r.feature_params) for r in rows], touched)
            return table

        return transaction(self, "missing_owner", S.FEATURE, body)

    # runtime features

    def _ensure_runtime(self) -> None:
        if not self.enable_runtime_computed_features:
            raise ValueError("runtime-computed features are not enabled: pass enable_runtime_computed_features=True")

    @traced
    def add_runtime_computed_features(self, exprs: dict[str, str], owner: str = "missing_owner") -> None:
        """Register outputs as SQL over features; sort keys may be used too, as in OVER (ORDER BY ...)."""
        self.ensure_initialized()
        self._ensure_runtime()
        of = {n: [r for r in roots(self.spark, e) if r not in self.keys] for n, e in exprs.items()}

        def body(touched) -> None:
            latest = self._latest([*exprs, *(r for own in of.values() for r in own)])
            for n, own in of.items():
                if n in own:
                    raise ValueError(f"{n} refers to itself")
                if n in self.keys:
                    raise ValueError(f"{n} is a sort key")
                if missing := [r for r in own if r not in latest and r not in exprs]:
                    raise S.MissingFeaturesException(f"{n} refers to unknown features: {', '.join(missing)}")
            if again := [n for n in exprs if n in latest]:
                raise ValueError(f"registered already: {', '.join(again)}")
            self._publish([], [(n, 0, S.NO_TABLE, owner, S.RUNTIME, json.dumps({"expr": e, "roots": of[n]})) for n, e in exprs.items()], touched)

        transaction(self, owner, S.RUNTIME, body)

    @traced
    def add_runtime_transforms(self, features: list[str], transforms: list[str], owner: str = "missing_owner") -> None:
        """Register ``<feature>__<transform>`` for all pairs."""
        exprs = transform_exprs(features, transforms)
        self.ensure_initialized()
        if clash := [n for n in exprs if n in self.keys]:
            raise ValueError(f"names of sort keys: {', '.join(clash)}")
        self.add_runtime_computed_features(exprs, owner)

    # reading

    @traced
    def read(self, features, targets: list[str] | None = None, start=None, end=None, materialized: bool = True, strict: bool = False, modifier: FrameModifier = no_op_modifier, where: dict[str, list] | None = None) -> DataFrame:
        """Features as one wide frame, keyed by the index in [start, end] and sorted by its keys.

        ``features`` is a list of names (latest versions) or a metadata frame (pinned rows). The result is
        lazy in either case; ``materialized=False`` leaves out the sort, as further plans may follow. ``modifier``
        is applied to the result. ``where`` lists the values that secondary sort keys may have; files whose ranges
        of these keys hold none of them aren't opened (see :meth:`compact` for a layout that suits).
        """
        return self._asked(features, targets, start, end, materialized, strict, where or {}).transform(modifier)

    def _asked(self, features, targets, start, end, materialized: bool, strict: bool, where: dict[str, list]) -> DataFrame:
        self.ensure_initialized()
        if wrong := [k for k in where if k not in self.keys or k == self.primary]:
            raise ValueError(f"not secondary sort keys: {', '.join(wrong)}")
        if isinstance(features, DataFrame):
            picked = features.collect()
            names = [r.feature_name for r in picked]
            if len(set(names)) < len(names):
                raise ValueError("multiple versions of a feature are asked for")
            if not picked:
                raise S.MissingFeaturesException("no features are asked for")
            return self._read(names, {r.feature_name: r for r in picked}, start, end, materialized, where)
        if not isinstance(features, (list, tuple)):
            raise TypeError(f"features must be a list of names or a metadata frame, not {type(features).__name__}")
        latest = self._latest([*features, *(targets or [])])
        if wrong := [t for t in targets or [] if t not in latest or latest[t].signal_type != S.TARGET]:
            raise S.MissingOrMisregisteredSignalsException(f"not registered as targets: {', '.join(wrong)}")
        names = list(dict.fromkeys([*features, *(targets or [])]))
        known = [n for n in names if n in latest]
        if not known or (strict and len(known) < len(names)):
            raise S.MissingFeaturesException(f"unknown: {', '.join(n for n in names if n not in latest)}")
        return self._read(known, {n: latest[n] for n in known}, start, end, materialized, where)

    def _read(self, names: list[str], picked: dict, start, end, materialized: bool, where: dict[str, list]) -> DataFrame:
        if any(r.signal_type == S.RUNTIME for r in picked.values()):
            self._ensure_runtime()
        # runtime features need their roots, and theirs; roots are in the output too
        todo = list(picked.values())
        while todo:
            asked = [root for r in todo if r.signal_type == S.RUNTIME for root in json.loads(r.feature_params)["roots"]]
            new = [root for root in dict.fromkeys(asked) if root not in picked]
            found = self._latest(new) if new else {}
            if missing := [n for n in new if n not in found]:
                raise S.MissingFeaturesException(f"unknown: {', '.join(missing)}")
            picked |= found
            names = [*names, *new]
            todo = list(found.values())
        runtime = {n: json.loads(r.feature_params) for n, r in picked.items() if r.signal_type == S.RUNTIME}
        df = self._assemble([r for r in picked.values() if r.signal_type != S.RUNTIME], start, end, where, ranged=materialized and not runtime)
        if runtime:
            df = with_columns_topo(df, {n: x["expr"] for n, x in runtime.items()}, {n: x["roots"] for n, x in runtime.items()})
        df = df.selectExpr(*map(quote, [*names, *self.keys]))
        return df.orderBy(*self.keys) if materialized else df

    def _assemble(self, rows: list, start, end, where: dict[str, list] | None = None, ranged: bool = False) -> DataFrame:
        """The bounded index with each group's features, of which only asked columns and ranges are read.

        What the first group holds in files that it shares with the index is read as it stands: there each index row
        has its values. Groups of few rows are sent to the index. All others, however many, meet the index in one
        exchange (:func:`gather`); ``ranged`` lets it lay out the result by range of the keys. As-of groups come last.
        """
        ranges = {self.primary: (start, end), **{k: list(v) for k, v in (where or {}).items()}}

        def clip(df: DataFrame, low=start, high=end) -> DataFrame:
            df = between(df, self.primary, low, high)
            for k, v in (where or {}).items():
                df = df.where(F.col(f"`{k}`").isin(list(v)))
            return df

        def scan(addr, low=start, high=end) -> DataFrame:
            return clip(self.io.scan(addr, ranges=ranges | {self.primary: (low, high)}), low, high)

        def of(own, df: DataFrame) -> DataFrame:
            return df.selectExpr(*map(quote, [*self.keys, *(r.feature_name for r in own)]))  # one call to the JVM, however many

        groups = list(by_table(rows).items())
        near, far = [(g[0], own) for g, own in groups if g[1] != S.AS_OF], [g for g in groups if g[0][1] == S.AS_OF]
        few, many = [], []
        for addr, own in near[1:]:
            known = self.io.rows(addr, ranges)
            (few if known is not None and known <= FEW_ROWS else many).append((addr, own))
        df = None
        if near:
            addr, own = near[0]
            common, index, rest = self.io.split(self.index, addr, ranges)
            if many:
                parts = [] if common is None else [(of(own, clip(common)), 0, True)]
                parts += [] if index is None else [(clip(index), None, True), (of(own, clip(rest)), 0, False)]
                parts += [(of(o, scan(a)), k, False) for k, (a, o) in enumerate(many, 1)]
                df = gather(parts, self.keys, ranged and not far and not few)
            else:
                parts = [] if common is None else [of(own, clip(common))]
                parts += [] if index is None else [clip(index).join(of(own, clip(rest)), self.keys, "left")]
                df = reduce(DataFrame.unionByName, parts) if parts else scan(self.index).join(of(own, scan(addr)), self.keys, "left")
        if df is None:
            df = scan(self.index)
        for addr, own in few:
            df = df.join(F.broadcast(of(own, scan(addr))), self.keys, "left")
        for (addr, signal_type, params), own in far:

            def count(low, high, addr=addr):
                known = [self.io.rows(addr, ranges | {self.primary: (low, high)}), self.io.rows(self.index, ranges)]
                return None if None in known else sum(known)

            df = align(df, lambda low, high, addr=addr: scan(addr, low, high), signal_type, params, [r.feature_name for r in own], self.keys, self.primary, start, end, count)
        return df

    @staticmethod
    def merge(left: FeatureLake, right: FeatureLake, left_features: list[str] | None = None, right_features: list[str] | None = None, left_targets: list[str] | None = None, right_targets: list[str] | None = None, start=None, end=None, suffix: str = "_right") -> DataFrame:
        """A full outer join of two lakes' reads on their common sort keys; clashing names on the right get the suffix."""
        left.ensure_initialized()
        right.ensure_initialized()
        if left.keys != right.keys:
            raise ValueError(f"sort keys differ: {left.keys} and {right.keys}")
        a = left.read(left_features or [], left_targets, start, end, materialized=False)
        b = right.read(right_features or [], right_targets, start, end, materialized=False)
        for c in [c for c in b.columns if c in a.columns and c not in left.keys]:
            b = b.withColumnRenamed(c, c + suffix)
        joined = a.join(b, left.keys, "full")
        names = [c for c in (*a.columns, *b.columns) if c not in left.keys]
        return joined.select(*[F.col(f"`{c}`") for c in names], *left.keys).orderBy(*left.keys)

    # annotations and history

    @traced
    def annotate(self, annotations: DataFrame) -> None:
        """Store comment and tags of features with their tables; of several rows for one, the newest version's."""
        self.ensure_initialized()
        if [(f.name, f.dataType) for f in annotations.schema] != [(f.name, f.dataType) for f in S.ANNOTATIONS]:
            raise ValueError(f"annotations must have the schema {S.ANNOTATIONS.simpleString()}")
        notes: dict[str, dict[str, tuple]] = {}
        for r in annotations.collect():
            if r.comment is None and not r.tags:
                continue
            own = notes.setdefault(r.table_addr, {})
            if r.feature_name not in own or (r.version or 0) > own[r.feature_name][0]:
                note = {"tags": list(r.tags or [])} | ({"comment": r.comment} if r.comment is not None else {})
                own[r.feature_name] = (r.version or 0, note)

        def body(touched) -> None:
            for addr, own in notes.items():
                if self.io.exists(addr):
                    self.io.annotate(touched(addr), {n: note for n, (_, note) in own.items()})

        atomically(self.io, body)

    def describe(self, features_metadata: DataFrame) -> DataFrame:
        """The metadata with comment and tags; versions that share a table share them."""
        self.ensure_initialized()
        rows = features_metadata.collect()
        notes = {a: self.io.describe(a, [r.feature_name for r in rows if r.table_addr == a]) for a in {r.table_addr for r in rows} if self.io.exists(a)}
        none = {"comment": None, "tags": []}
        full = [(*[r[f] for f in S.FEATURE_METADATA.fieldNames()], n["comment"], n["tags"]) for r in rows for n in [notes.get(r.table_addr, {}).get(r.feature_name, none)]]
        return local_frame(self.spark, full, S.ANNOTATIONS)

    @traced
    def restore_to_timestamp(self, timestamp: dt.datetime) -> None:
        """Bring index, metadata and the tables that the metadata then names back to a time; the log is kept."""
        self.ensure_initialized()
        if timestamp.tzinfo is None:
            raise ValueError("the timestamp needs a time zone")

        def body(touched) -> None:
            then = self.io.versions_at(timestamp)

            def restore(target: str) -> None:
                if then is None:
                    self.io.restore_to_timestamp(touched(target), timestamp)
                else:
                    self.io.restore_to_version(touched(target), then[target])

            for target in (self.index, self.table_metadata, self.feature_metadata):
                restore(target)
            for (addr,) in self.feature_metadata_frame().select("table_addr").distinct().collect():
                if addr != S.NO_TABLE:
                    restore(addr)

        atomically(self.io, body)
