"""Versioned tables: Parquet files under a small commit log.

A table is ``<root>/<name>/_log/<version>.json``. A commit holds the schema, the files added last, up to
``INLINE`` of them, and the names of manifests, immutable lists of earlier files. When a commit's own list is
full it becomes a manifest, and ``FANOUT`` small manifests become one of about ``FULL`` files. So a file is listed
anew twice at most, however many commits follow, and of the manifests those without rows of a wanted key range
aren't read.

Files are immutable and lie in ``<root>/_data``; several tables may list one file, each reading the columns of
its own schema. A frame is therefore written once, however many tables it goes to. Row counts and key ranges
stand with each file; dates and times in them are whole numbers, that no time zone enters into.

Commits of several tables become one by the lake's own log, ``<root>/_lake/_log``: a commit there names the versions
of the tables that it changes, every ``WHOLE``-th those of all. Tables that it names are read in these versions, so what
a writer that was killed has left behind is never seen.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.layout import z_order
from ..schemas import ConcurrentWriteError
from .shared import literal, local_frame, micros, whole

CODECS = ("zstd", "gzip", "lz4", "snappy", "none", "uncompressed")


def codec(name: str) -> str:
    """A codec's name as the writer wants it; case doesn't matter."""
    if str(name).lower() not in CODECS:
        raise ValueError(f"compression {name!r} is none of {', '.join(CODECS)}")
    return str(name).lower()


INLINE, FANOUT, FULL = 64, 32, 2048
#: Rows that show how many bytes one takes; about the bytes of a file's header and footer.
LEARNT, ENDS = 5_000, 2_000
#: The name of the lake's own log, of whose commits every so many-th names all tables.
LAKE, WHOLE = "_lake", 32
_PUTTING = threading.Lock()
#: The newest manifests that a process remembers.
REMEMBERED = 512


@dataclass
class Commit:
    version: int
    timestamp_us: int
    op: str
    schema: T.StructType
    tail: list[dict] = field(default_factory=list)
    manifests: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "timestamp_us": self.timestamp_us, "op": self.op, "schema": self.schema.jsonValue(), "tail": self.tail, "manifests": self.manifests})

    @classmethod
    def from_json(cls, text: str) -> Commit:
        x = json.loads(text)
        return cls(x["version"], x["timestamp_us"], x["op"], T.StructType.fromJson(x["schema"]), x["tail"], x["manifests"])


class TableIO(ABC):
    """What a lake needs of its storage."""

    @abstractmethod
    def scan(self, target: str, version: int | None = None, timestamp: dt.datetime | None = None, ranges: dict | None = None) -> DataFrame: ...

    def split(self, target: str, other: str, ranges: dict | None = None) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
        """What two tables have in common, as ``other`` has it, and the rest of each.

        In common are rows that both are known to hold, once each. None, of the first two, is known to have no rows.
        """
        return None, self.scan(target, ranges=ranges), self.scan(other, ranges=ranges)

    def compact(self, targets: Iterable[str], order: Iterable[str] = (), below: float = 0.5, least: int = 2, by: Iterable[str] = ()) -> dict[str, int]:
        """Join small files, where the storage has such; how many there were, by table."""
        return {t: 0 for t in targets}

    def holding(self, target: str, ranges: dict | None = None, keys: DataFrame | None = None) -> list[dict] | None:
        """The files that may hold rows of these ranges, and of these keys; None where the storage can't tell.

        Without ranges and keys: all files. ``keys`` are looked for in the files, by those columns of the frame.
        """
        return None

    def inside(self, target: str, files: list[dict], ranges: dict) -> list[dict]:
        """Those of a table's files that are known to hold only rows of these ranges."""
        return []

    def of_files(self, target: str, files: list[dict]) -> DataFrame:
        """The rows of some of a table's files."""
        raise NotImplementedError

    def swap(self, source: str, target: str, gone: list[dict], files: list[dict], schema: T.StructType, op: str) -> int:
        """Publish ``target`` as ``source`` is now, without the files ``gone`` and with ``files``. Nothing else is written."""
        raise NotImplementedError

    def rows(self, target: str, ranges: dict | None = None) -> int | None:
        """A bound on the rows that a scan of these ranges gives, where it is known without reading them."""
        return None

    def pin(self) -> None:
        """See, from now on, what the lake's newest commit shows; between begin and publish or undo nothing changes."""

    def begin(self) -> None:
        """Begin writes that are to be seen together."""

    def publish(self, targets: Iterable[str]) -> None:
        """Show what was written to these tables since :meth:`begin`, all at once.

        ConcurrentWriteError if something else was published since.
        """

    def undo(self, before: dict[str, int | None]) -> None:
        """Give up writes since :meth:`begin`; ``before`` has the versions of the tables before them."""
        for target, version in reversed(before.items()):
            if self.version(target) is not None:
                self.restore_to_version(target, version)

    def versions_at(self, timestamp: dt.datetime) -> dict[str, int] | None:
        """The version of each table that was seen at a time; None where only the tables themselves can tell."""
        return None

    @abstractmethod
    def write(self, df: DataFrame, target: str, mode: str = "append", stats: Iterable[str] = ()) -> int: ...

    @abstractmethod
    def stage(self, df: DataFrame, stats: Iterable[str] = (), like: DataFrame | None = None) -> list[dict]: ...

    def range_of(self, files: list[dict], key: str, kind: T.DataType) -> tuple:
        """A range that the staged files' values of a key lie in, as :meth:`scan` takes it; None is no bound."""
        return None, None

    @abstractmethod
    def commit(self, target: str, files: list[dict], schema: T.StructType, op: str, mode: str = "append") -> int: ...

    @abstractmethod
    def merge(self, df: DataFrame, target: str, on: list[str], matched_predicate: str | None = None, when_matched_update: dict | None = None, when_not_matched_insert: dict | None = None, stats: Iterable[str] = ()) -> int: ...

    @abstractmethod
    def exists(self, target: str) -> bool: ...

    @abstractmethod
    def version(self, target: str) -> int | None: ...

    @abstractmethod
    def schema(self, target: str) -> T.StructType: ...

    @abstractmethod
    def restore_to_timestamp(self, target: str, timestamp: dt.datetime) -> None: ...

    @abstractmethod
    def restore_to_version(self, target: str, version: int | None) -> None: ...

    @abstractmethod
    def annotate(self, target: str, notes: dict[str, dict]) -> None: ...

    @abstractmethod
    def describe(self, target: str, names: Iterable[str]) -> dict[str, dict]: ...


def plain(x):
    """A statistic as JSON has it; types without an order that JSON keeps have none."""
    return x if isinstance(x, (int, float, str)) or x is None else None


class ParquetTableIO(TableIO):
    def __init__(self, spark: SparkSession, root: str, compression: str = "zstd", target_file_size: int = 128 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.compression, self.target_file_size = codec(compression), target_file_size
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._newest: dict[str, int] = {}
        self._bytes_a_row: dict[str, float] = {}
        #: The versions in which tables are seen, by the lake's commit of that number; None: there is none.
        self.view: dict[str, int] | None = None
        self.seen: int | None = None
        self.writing: dict[str, int] | None = None
        self._manifests: dict[str, list[dict]] = {}

    # files

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        fs = self._fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _log(self, target: str) -> str:
        return f"{self.root}/{target}/_log"

    def _read(self, path: str) -> str:
        p = self._path(path)
        stream = self._fs(p).open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        p = self._path(path)
        fs = self._fs(p)
        fs.mkdirs(p.getParent())
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _load(self, target: str, version: int) -> Commit:
        return Commit.from_json(self._read(f"{self._log(target)}/{version:020d}.json"))

    def _has(self, target: str, version: int) -> bool:
        p = self._path(f"{self._log(target)}/{version:020d}.json")
        return self._fs(p).exists(p)

    def versions(self, target: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(self._log(target)) if n.endswith(".json") and n[:-5].isdigit()]

    def history(self, target: str) -> list[Commit]:
        return [self._load(target, v) for v in self.versions(target)]

    def exists(self, target: str) -> bool:
        return self.version(target) is not None

    def version(self, target: str) -> int | None:
        """The newest version; the log is listed once, later commits are looked for by name."""
        last = self._newest.get(target)
        if last is None or not self._has(target, last):
            last = max(self.versions(target), default=None)
        while last is not None and self._has(target, last + 1):
            last += 1
        if last is None:
            self._newest.pop(target, None)
        else:
            self._newest[target] = last
        return last

    def snapshot(self, target: str, version: int | None = None, timestamp: dt.datetime | None = None) -> Commit:
        last = self.version(target)
        if last is None:
            raise FileNotFoundError(f"no table at {self.root}/{target}")
        if version is None and timestamp is not None:
            if (of := (self.versions_at(timestamp) or {}).get(target)) is not None:
                return self._load(target, of)
            found = _last_before(last, micros(timestamp), lambda v: self._load(target, v).timestamp_us)
            if found is None:
                raise ValueError(f"{target} has no version as old as {timestamp}")
            return self._load(target, found)
        return self._load(target, (self.view or {}).get(target, last) if version is None else version)

    def files(self, target: str, c: Commit, ranges: dict | None = None) -> list[dict]:
        """A version's files that may hold rows of ``ranges``, in the order in which they were added.

        A range is a pair of bounds, or a list of values.
        """
        one = lambda k, r: _bounds(self.spark, r, c.schema[k].dataType)
        bounds = {k: [one(k, (v, v)) for v in r] if isinstance(r, list) else [one(k, r)] for k, r in (ranges or {}).items()}
        found = [f for m in c.manifests if _overlaps(m, bounds) for f in self._entries(target, m)]
        return [f for f in (*found, *c.tail) if _overlaps(f, bounds)]

    def _entries(self, target: str, manifest: dict) -> list[dict]:
        name = manifest["name"]
        if name not in self._manifests:
            if len(self._manifests) >= REMEMBERED:
                self._manifests.pop(next(iter(self._manifests)))
            self._manifests[name] = json.loads(self._read(f"{self.root}/{manifest.get('table', target)}/_manifests/{name}.json"))
        return self._manifests[name]

    def _manifest(self, target: str, files: list[dict], level: int) -> dict:
        name = uuid.uuid4().hex
        self._create(f"{self.root}/{target}/_manifests/{name}.json", json.dumps(files))
        return {"name": name, "level": level, "files": len(files), **_summary(files)}

    def _listed(self, target: str, tail: list[dict], manifests: list[dict]) -> tuple[list[dict], list[dict]]:
        """The lists of a commit, with full ones moved to manifests."""
        manifests = list(manifests)
        if len(tail) > INLINE:
            parts = [tail[k : k + FULL] for k in range(0, len(tail), FULL)]
            manifests += [self._manifest(target, part, int(2 * len(part) > FULL)) for part in parts]
            tail = []
        if len(small := [m for m in manifests if m["level"] == 0]) >= FANOUT:
            entries = [f for m in small for f in self._entries(target, m)]
            manifests = [*(m for m in manifests if m["level"]), self._manifest(target, entries, 1)]
        return tail, manifests

    def schema(self, target: str) -> T.StructType:
        return self.snapshot(target).schema

    def _publish(self, target: str, op: str, schema: T.StructType, tail: list[dict], manifests: list[dict], before: Commit | None) -> int:
        now, last = time.time_ns() // 1000, before.version if before else None
        if before and target in (self.view or {}):
            last = self.version(target)  # of what others left unpublished only the number is taken
        stamp = (before if last == before.version else self._load(target, last)).timestamp_us if before else 0
        commit = Commit(0 if last is None else last + 1, max(now, stamp + 1), op, schema, *self._listed(target, tail, manifests))
        self._put(target, commit.version, commit.to_json())
        if self.view is not None and (self.writing is not None or target in self.view):
            self.view[target] = commit.version
        return commit.version

    def _put(self, target: str, version: int, text: str) -> None:
        """Write a commit, if there is none of that version: aside, and renamed, so readers see all of it or nothing."""
        p = self._path(f"{self._log(target)}/{version:020d}.json")
        fs = self._fs(p)
        aside = f"{self._log(target)}/.{uuid.uuid4().hex}"
        self._create(aside, text)
        with _PUTTING:  # a local file system may overwrite in a rename
            if fs.exists(p) or not fs.rename(self._path(aside), p):
                fs.delete(self._path(aside), False)
                raise ConcurrentWriteError(f"version {version} of {target} is there already")
        self._newest[target] = version

    # the lake's commits

    def _lake(self, version: int) -> dict[str, int]:
        """The version of each table as of a commit of the lake."""
        of: dict[str, int] = {}
        while True:
            c = json.loads(self._read(f"{self._log(LAKE)}/{version:020d}.json"))
            of = c["tables"] | of
            if c["whole"]:
                return of
            version -= 1

    def pin(self) -> None:
        if self.writing is None and (last := self.version(LAKE)) != self.seen:
            self.view, self.seen = None if last is None else self._lake(last), last

    def begin(self) -> None:
        self.pin()
        self.view = dict(self.view or {})
        self.writing = dict(self.view)

    def publish(self, targets: Iterable[str]) -> None:
        version = 0 if self.seen is None else self.seen + 1
        whole = version % WHOLE == 0
        tables = self.view if whole else {t: self.view[t] for t in targets}
        stamp = json.loads(self._read(f"{self._log(LAKE)}/{self.seen:020d}.json"))["timestamp_us"] if version else 0
        self._put(LAKE, version, json.dumps({"version": version, "timestamp_us": max(time.time_ns() // 1000, stamp + 1), "whole": whole, "tables": tables}))
        self.seen, self.writing = version, None

    def undo(self, before: dict[str, int | None]) -> None:
        """New tables go; of others the versions that were not published are never seen."""
        self.view, self.writing = self.writing, None
        if self.seen is None:
            self.view = None
            super().undo(before)
        for target in [t for t, version in before.items() if version is None and self.exists(t)]:
            self.restore_to_version(target, None)

    def versions_at(self, timestamp: dt.datetime) -> dict[str, int] | None:
        last = self.version(LAKE)
        if last is None:
            return None
        found = _last_before(last, micros(timestamp), lambda v: json.loads(self._read(f"{self._log(LAKE)}/{v:020d}.json"))["timestamp_us"])
        return None if found is None else self._lake(found)

    # reading

    def scan(self, target: str, version: int | None = None, timestamp: dt.datetime | None = None, ranges: dict | None = None) -> DataFrame:
        """A version's rows, from the files that may hold rows of ``ranges`` (column -> (low, high), inclusive)."""
        c = self.snapshot(target, version, timestamp)
        return self._frame(self.files(target, c, ranges), c.schema)

    def _frame(self, files: list[dict], schema: T.StructType) -> DataFrame:
        if not files:
            return local_frame(self.spark, [], schema)
        # a staged folder all of whose files are wanted is named once
        of: dict[str, list[dict]] = {}
        for f in files:
            of.setdefault(f["path"].rpartition("/")[0], []).append(f)
        paths = [p for folder, some in of.items() for p in ([folder] if len(some) == some[0]["of"] else [f["path"] for f in some])]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def range_of(self, files: list[dict], key: str, kind: T.DataType) -> tuple:
        known = _summary(files)
        low, high = known["min"].get(key), known["max"].get(key)
        if low is None or high is None:
            return None, None
        zone = dt.UTC if isinstance(kind, T.TimestampType) else None
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return tuple(dt.datetime(1970, 1, 1, tzinfo=zone) + dt.timedelta(microseconds=x) for x in (low, high))
        if isinstance(kind, T.DateType):
            return tuple(dt.date(1970, 1, 1) + dt.timedelta(days=x) for x in (low, high))
        return low, high

    def rows(self, target: str, ranges: dict | None = None) -> int | None:
        counts = [f["rows"] for f in self.files(target, self.snapshot(target), ranges)]
        return None if None in counts else sum(counts)

    def split(self, target: str, other: str, ranges: dict | None = None) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
        mine, theirs = self.snapshot(target), self.snapshot(other)
        a, b = self.files(target, mine, ranges), self.files(other, theirs, ranges)
        both = {f["path"] for f in a} & {f["path"] for f in b}
        rest = lambda files: [f for f in files if f["path"] not in both]
        common = self._frame([f for f in b if f["path"] in both], theirs.schema) if both else None
        return common, self._frame(rest(a), mine.schema) if rest(a) else None, self._frame(rest(b), theirs.schema)

    # writing

    def stage(self, df: DataFrame, stats: Iterable[str] = (), like: DataFrame | None = None) -> list[dict]:
        """Write a frame's files, without any table listing them yet.

        A file is begun anew where its rows come to the target size, compressed: by the bytes a row that earlier files
        of such columns took, else the first rows of ``like``, a frame of the same columns that is cheap to begin
        reading; else by a guess. :meth:`compact` joins small files.
        """
        rel = f"_data/{uuid.uuid4().hex}"
        path = f"{self.root}/{rel}"
        kinds = ", ".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
        if kinds not in self._bytes_a_row and like is not None:
            self._learn(kinds, self.stage(like.limit(LEARNT).coalesce(1), list(stats)[:1]))
        width = self._bytes_a_row.get(kinds) or sum(_width(f.dataType) for f in df.schema)
        df.write.option("compression", self.compression).option("parquet.block.size", self.target_file_size).option("maxRecordsPerFile", max(1, int(self.target_file_size / width))).parquet(path)
        p = self._path(path)
        sizes = {x.getPath().getName(): x.getLen() for x in self._fs(p).listStatus(p) if x.getPath().getName().startswith("part-")}
        stats = [k for k in stats if isinstance(df.schema[k].dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
        known: dict[str, dict] = {}
        if stats:
            name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
            value = {k: whole(F.col(f"`{k}`"), df.schema[k].dataType) for k in stats}
            found = self.spark.read.schema(df.schema).parquet(path).groupBy(name.alias("f")).agg(F.count("*").alias("n"), *[g(value[k]).alias(f"{a}{i}") for i, k in enumerate(stats) for g, a in ((F.min, "lo"), (F.max, "hi"))]).collect()
            known = {r.f: {"rows": r.n, "min": {k: plain(r[f"lo{i}"]) for i, k in enumerate(stats)}, "max": {k: plain(r[f"hi{i}"]) for i, k in enumerate(stats)}} for r in found}
        nothing = {"rows": 0 if stats else None, "min": {}, "max": {}}
        of = len(known) if stats else len(sizes)  # files without rows needn't be listed
        files = [{"path": f"{rel}/{n}", "bytes": size, "of": of, **known.get(n, nothing)} for n, size in sorted(sizes.items())]
        if sum(f["rows"] or 0 for f in files) >= LEARNT:
            self._learn(kinds, files)
        return files

    def _learn(self, kinds: str, files: list[dict]) -> None:
        """Remember the bytes that a row of such columns takes; each file's ends are counted off."""
        if rows := sum(f["rows"] or 0 for f in files):
            self._bytes_a_row[kinds] = max(1.0, sum(max(0, f["bytes"] - ENDS) for f in files) / rows)

    def commit(self, target: str, files: list[dict], schema: T.StructType, op: str, mode: str = "append") -> int:
        """Publish a version that lists ``files``, besides those there (append) or instead of them (overwrite)."""
        before = self.snapshot(target) if self.exists(target) else None
        if before and mode == "error":
            raise FileExistsError(f"{target} exists")
        manifests = []
        if before and mode == "append":
            names = {f.name for f in before.schema.fields}
            schema = T.StructType([*before.schema.fields, *(f for f in schema.fields if f.name not in names)])
            files, manifests = [*before.tail, *files], before.manifests
        return self._publish(target, op, _nullable(schema), files, manifests, before)

    def write(self, df: DataFrame, target: str, mode: str = "append", stats: Iterable[str] = ()) -> int:
        return self.commit(target, self.stage(df, stats), df.schema, f"write {mode}", mode)

    def merge(self, df: DataFrame, target: str, on: list[str], matched_predicate: str | None = None, when_matched_update: dict | None = None, when_not_matched_insert: dict | None = None, stats: Iterable[str] = ()) -> int:
        """Upsert: rows that match on the keys are updated, others inserted; by default all columns of ``df``.

        The predicate and the maps (column -> SQL) see the columns as ``target.c`` and ``source.c``. Copy-on-write by
        file: those that hold a row to be updated are found by key ranges and by a join for their names, and only they
        are written anew. ValueError if several rows of ``df`` would update one row; of rows without a match each is
        inserted, also where they share a key.
        """
        kind = df.schema
        staged = [f for f in self.stage(df, on) if f["rows"] != 0]
        source = self._frame(staged, kind).alias("source")
        here = self.snapshot(target)
        names = [*here.schema.names, *(c for c in df.columns if c not in here.schema.names)]
        known = _summary(staged)
        extent = {k: [(known["min"][k], known["max"][k])] for k in on if k in known["min"] and k in here.schema.names and here.schema[k].dataType == kind[k].dataType}
        near = [f for f in self.files(target, here) if _overlaps(f, extent)] if staged else []
        met = [F.col(f"target.`{k}`") == F.col(f"source.`{k}`") for k in on]
        hit = F.coalesce(F.expr(matched_predicate), F.lit(False)) if matched_predicate else F.lit(True)
        near_rows = self._frame(near, here.schema)
        found = {r[0] for r in self._named(near_rows).alias("target").join(source, met).where(hit).select("target._path").distinct().collect()} if near else set()
        touched = [f for f in near if f["path"] in found]

        def columns(of: dict, kept) -> list:
            kinds = {f.name: f.dataType for f in (*kind, *here.schema)}
            return [of.get(c, kept(c)).cast(kinds[c]).alias(c) for c in names]

        parts = []
        if touched:
            update = {c: F.expr(e) for c, e in when_matched_update.items()} if when_matched_update is not None else {c: F.col(f"source.`{c}`") for c in df.columns}
            kept = lambda c: F.col(f"target.`{c}`") if c in here.schema.names else F.lit(None)
            to = source.withColumn("_s", F.lit(True)).alias("source")
            joined = self._frame(touched, here.schema).alias("target").join(to, [*met, hit], "left")
            parts.append(joined.select(*columns({c: F.when(F.col("source._s"), e).otherwise(kept(c)) for c, e in update.items()}, kept)))
        if staged:
            insert = {c: F.expr(e) for c, e in when_not_matched_insert.items()} if when_not_matched_insert is not None else {c: F.col(f"source.`{c}`") for c in df.columns}
            fresh = source.join(near_rows.alias("target"), met, "left_anti") if near else source
            parts.append(fresh.select(*columns(insert, lambda c: F.lit(None))))
        schema = T.StructType([*here.schema.fields, *(f for f in kind if f.name not in here.schema.names)])
        written = [[f for f in self.stage(part, list(stats) or on) if f["rows"] != 0] for part in parts]
        if touched and self._count(written[0], schema) > self._count(touched, here.schema):
            raise ValueError(f"several rows would update one row of {target}")
        added = [f for some in written for f in some]
        return self.swap(target, target, touched, added, schema, "merge")

    def _count(self, files: list[dict], schema: T.StructType) -> int:
        counts = [f["rows"] for f in files]
        return self._frame(files, schema).count() if None in counts else sum(counts)

    def _named(self, df: DataFrame) -> DataFrame:
        """With the path of each row's file, as commits have it."""
        return df.select("*", F.substring_index("_metadata.file_path", "/", -3).alias("_path"))

    def holding(self, target: str, ranges: dict | None = None, keys: DataFrame | None = None) -> list[dict] | None:
        c = self.snapshot(target)
        near = self.files(target, c, ranges)
        if keys is None or not near:
            return near
        of = keys.columns
        found = {r[0] for r in self._named(self._frame(near, c.schema)).join(keys, of, "left_semi").select("_path").distinct().collect()}
        return [f for f in near if f["path"] in found]

    def inside(self, target: str, files: list[dict], ranges: dict) -> list[dict]:
        kinds = self.snapshot(target).schema
        bounds = {k: _bounds(self.spark, r, kinds[k].dataType, -1) for k, r in ranges.items()}
        known = lambda f, k: f["min"].get(k) is not None and f["max"].get(k) is not None
        return [f for f in files if all(known(f, k) and None not in b and b[0] <= f["min"][k] and f["max"][k] <= b[1] for k, b in bounds.items())]

    def of_files(self, target: str, files: list[dict]) -> DataFrame:
        return self._frame(files, self.snapshot(target).schema)

    def swap(self, source: str, target: str, gone: list[dict], files: list[dict], schema: T.StructType, op: str) -> int:
        """Manifests that list none of the files that go are named again, also in another table's commit."""
        here = self.snapshot(source)
        before = here if target == source else self.snapshot(target) if self.exists(target) else None
        out = {f["path"] for f in gone}
        left = lambda some: [f for f in some if f["path"] not in out]
        tail, manifests = left(here.tail), []
        for m in here.manifests:
            entries = self._entries(source, m) if out and any(_overlaps(m, _extent(f)) for f in gone) else None
            kept = entries and left(entries)
            if entries is None or len(kept) == len(entries):
                manifests.append(m | {"table": m.get("table", source)})
            elif len(kept) > INLINE:
                manifests.append(self._manifest(target, kept, m["level"]))
            else:
                tail = kept + tail
        return self._publish(target, op, _nullable(schema), [*tail, *files], manifests, before)

    def restore_to_timestamp(self, target: str, timestamp: dt.datetime) -> None:
        self.restore_to_version(target, self.snapshot(target, timestamp=timestamp).version)

    def restore_to_version(self, target: str, version: int | None) -> None:
        """Publish an earlier version again; a no-op if it is the newest. None: the table goes."""
        if version is None:
            p = self._path(f"{self.root}/{target}")
            self._fs(p).delete(p, True)
            self._newest.pop(target, None)
            return
        now = self.snapshot(target)
        then = self._load(target, version)
        if now.version != version and (now.tail != then.tail or now.manifests != then.manifests or now.schema != then.schema):
            self._publish(target, f"restore {version}", then.schema, then.tail, then.manifests, now)

    def annotate(self, target: str, notes: dict[str, dict]) -> None:
        c = self.snapshot(target)
        fields = [T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), **notes[f.name]}) if f.name in notes else f for f in c.schema.fields]
        self._publish(target, "annotate", T.StructType(fields), c.tail, c.manifests, c)

    def compact(self, targets: Iterable[str], order: Iterable[str] = (), below: float = 0.5, least: int = 2, by: Iterable[str] = ()) -> dict[str, int]:
        """Join files of less than ``below`` of the target size; how many there were, by table.

        With ``by`` files of any size are written anew, laid out by range of that column, or in a Z-order of several.

        Files that the same tables list are joined, where there are ``least`` of them, to files that these tables
        list: what tables share they go on sharing. Rows are laid out by range of ``order``, so that ranges still
        prune. Older versions keep their files.
        """
        order, by, snaps = list(order), list(by), {t: self.snapshot(t) for t in targets}
        lists = {t: self.files(t, c) for t, c in snaps.items()}
        owners: dict[str, list[str]] = {}
        for t, files in lists.items():
            for f in files:
                owners.setdefault(f["path"], []).append(t)
        classes: dict[tuple, dict[str, dict]] = {}
        for t, files in lists.items():
            for f in files:
                if by or f["bytes"] < below * self.target_file_size:
                    classes.setdefault(tuple(owners[f["path"]]), {})[f["path"]] = f
        new: dict[str, list[dict]] = {t: [] for t in snaps}
        gone: set[str] = set()
        for own, some in classes.items():
            fields = {f.name: f for t in own for f in snaps[t].schema.fields}
            if len(some) < (1 if by else least) or any(fields[f.name].dataType != f.dataType for t in own for f in snaps[t].schema.fields):
                continue
            parts = max(1, round(sum(f["bytes"] for f in some.values()) / self.target_file_size))
            df = self._frame(list(some.values()), T.StructType(list(fields.values())))
            if by:
                along = ["_z"] if len(by) > 1 else by
                laid = df.withColumn("_z", z_order(df, by)) if len(by) > 1 else df
                df = laid.repartitionByRange(parts, *along).sortWithinPartitions(*along).drop("_z")
            else:
                df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else df.coalesce(parts)
            joined = [f for f in self.stage(df, order) if f["rows"] != 0]
            for t in own:
                new[t] += joined
            gone |= some.keys()
        done = {}
        for t, files in lists.items():
            kept = [f for f in files if f["path"] not in gone]
            done[t] = len(files) - len(kept)
            if done[t]:
                self._publish(t, "compact", snaps[t].schema, [*kept, *new[t]], [], snaps[t])
        return done

    def vacuum(self, older_than: dt.datetime) -> int:
        """Delete data that no table lists at or after that time, of folders staged before it; how many folders went.

        Versions older than that can't be read afterwards. The newest version of each table always stays.
        """
        limit = micros(older_than)
        used: set[str] = set()
        newest = self.version(LAKE)
        seen: dict[str, set[int]] = {}  # versions that the lake has shown since
        if newest is not None:
            time_of = lambda v: json.loads(self._read(f"{self._log(LAKE)}/{v:020d}.json"))["timestamp_us"]
            for v in range(_last_before(newest, limit, time_of) or 0, newest + 1):
                for t, n in self._lake(v).items():
                    seen.setdefault(t, set()).add(n)
        for target in [n for n in self._names(self.root) if n[:1] != "_" and self.exists(n)]:
            history = self.history(target)
            first = max((i for i, c in enumerate(history) if c.timestamp_us <= limit), default=0)
            kept = [*history[first:], *(c for c in history[:first] if c.version in seen.get(target, ()))]
            used |= {f["path"].rpartition("/")[0] for c in kept for f in self.files(target, c)}
        base = self._path(f"{self.root}/_data")
        fs = self._fs(base)
        gone = [x.getPath() for x in (fs.listStatus(base) if fs.exists(base) else []) if f"_data/{x.getPath().getName()}" not in used and x.getModificationTime() * 1000 < limit]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def describe(self, target: str, names: Iterable[str]) -> dict[str, dict]:
        fields = {f.name: f.metadata or {} for f in self.schema(target).fields}
        return {n: {"comment": fields.get(n, {}).get("comment"), "tags": fields.get(n, {}).get("tags", [])} for n in names}


def _last_before(last: int, us: int, time_of: Callable[[int], int]) -> int | None:
    """The last version, of 0 to ``last``, whose time is ``us`` at most; their times ascend."""
    low, high, found = 0, last, None
    while low <= high:
        mid = (low + high) // 2
        low, high, found = (mid + 1, high, mid) if time_of(mid) <= us else (low, mid - 1, found)
    return found


def _summary(files: list[dict]) -> dict:
    """Rows and key ranges of several files; a range is known if all of them know theirs."""
    keys = set.intersection(*[{k for k, v in f["min"].items() if v is not None and f["max"].get(k) is not None} for f in files]) if files else set()
    counts = [f["rows"] for f in files]
    return {"rows": None if None in counts else sum(counts), "min": {k: min(f["min"][k] for f in files) for k in keys}, "max": {k: max(f["max"][k] for f in files) for k in keys}}


def _width(kind: T.DataType) -> int:
    """About how many bytes a value takes before it is compressed."""
    if isinstance(kind, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(kind, (T.IntegerType, T.ShortType, T.FloatType, T.DateType)):
        return 4
    return 8 if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType)) else 32


def _bounds(spark: SparkSession, r: tuple, kind: T.DataType, wide: int = 1) -> tuple:
    """A range in the form of the statistics; None where there is no bound, or none that they can be compared with.

    Where it is known to a day only, it is the wider range, or the narrower one if ``wide`` is -1.
    """

    def one(x, slack: int):
        if x is None or not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return plain(x)
        if isinstance(kind, T.TimestampNTZType) and isinstance(x, dt.datetime) and x.tzinfo is None:
            return micros(x.replace(tzinfo=dt.UTC))
        if isinstance(kind, T.TimestampType) and isinstance(x, dt.datetime):
            return micros(x)
        if isinstance(kind, T.DateType) and not isinstance(x, str):
            # times are compared with midnights of some zone, so a day more on either side is looked at
            return x.toordinal() - dt.date(1970, 1, 1).toordinal() + (slack if isinstance(x, dt.datetime) else 0)
        return spark.sql("SELECT 1").select(whole(literal(x, kind).cast(kind), kind)).first()[0]

    return one(r[0], -wide), one(r[1], wide)


def _overlaps(f: dict, bounds: dict[str, list[tuple]]) -> bool:
    """Whether a file or manifest may have rows in one of each key's ranges."""
    return all(any(_meets(f["min"].get(key), f["max"].get(key), *r) for r in some) for key, some in bounds.items())


def _meets(a, b, low, high) -> bool:
    if a is None or b is None:
        return True
    try:
        return not ((low is not None and b < low) or (high is not None and a > high))
    except TypeError:  # a bound of another type is left to the filter
        return True


def _extent(f: dict) -> dict:
    """A file's key ranges, as bounds."""
    return {k: [(f["min"][k], f["max"].get(k))] for k in f["min"]}


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
