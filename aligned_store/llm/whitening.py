"""Whitening of embeddings by a covariance that is computed in tiles.

Vectors become whole numbers, and the fit list has each distinct one once. Its rows are dealt in row-blocks; a
row-block's columns go in column blocks, which meet by row-block in a shuffle. There each pair of column blocks, a
tile of the covariance, is centred, multiplied and added to the task's sum of that tile; tasks' sums are added tile by
tile. The assembled matrix, of as many rows as a vector has entries, is decomposed by the driver, and every row is
projected on the first eigenvectors.

Defined results: rows whose vector is null, has no entries, or has a null, NaN or infinite one are left out. Vectors
of other lengths than the rest can't be whitened together, and raise a ValueError. Repeated vectors count once in the
fit and are whitened each. Entries beyond 64 bits when scaled are cut to that range. A component without variance (all
vectors equal, or fewer distinct ones than components) has the explained share that it has, and null for whitened; the
identity error is over the others, and null if there are none. A deviation beyond 64 bits is null. Ids may be of any
type, null or repeated. Extra columns are ignored. An empty table gives no rows. There are no more components than
entries in a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import local_frame
from .common import cut, forget, lean_batches

#: Entries of a row-block, and the columns of a column block.
BLOCK_ENTRIES, WIDTH = 1 << 20, 32
#: Sums of tiles are added in this many groups for each tile, and then these.
GROUPS = 64


def scaled(vector: Column, scale: int) -> Column:
    """Whole numbers: the floor of each entry times ``scale``; null for vectors that are left out."""
    def fine(c: Column) -> Column:
        wide = c.cast("double")
        return c.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf")))

    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return F.when((F.size(vector) > 0) & F.forall(vector, fine), whole)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, all of ``dims`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many rows ``fit`` has, and the exact sum of each dimension of x, which may be beyond 64 bits."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("d", "high", "low", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(high), pa.array(low), pa.array(np.full(dims, n))], names=schema.names)

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, schema).groupBy("d").agg(wide("high"), wide("low"), F.sum("n").alias("n")).collect()
    total = {r.d: int(r.high) * (1 << 32) + int(r.low) for r in rows}
    return (rows[0].n if rows else 0), [total[d] for d in range(dims)] if rows else []


def covariance(frame: DataFrame, mean: np.ndarray, n: int, width: int = WIDTH, entries: int = BLOCK_ENTRIES) -> np.ndarray:
    """The covariance of the vectors in column ``x``, with divisor ``n``; ``mean`` is theirs."""
    dims = len(mean)
    tall, columns = max(1, entries // dims), -(-dims // width)
    whole = isinstance(frame.schema["x"].dataType.elementType, T.LongType)
    blocks = T.StructType([T.StructField("row_block", T.LongType()), T.StructField("column_block", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("entries", T.BinaryType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, some, rows = TaskContext.get().partitionId() << 32, [], 0

        def blocks_of() -> pa.RecordBatch:
            x = np.concatenate(some)
            # of whole numbers the shortest kind that holds them travels
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max) if whole else "<f8"
            parts = [np.ascontiguousarray(x[:, c * width : (c + 1) * width], kind).tobytes() for c in range(columns)]
            return pa.RecordBatch.from_arrays([pa.array([number] * columns), pa.array(range(columns), pa.int32()), pa.array([kind] * columns), pa.array(parts, pa.binary())], names=blocks.names)

        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), tall):
                some.append(x[at : at + tall])
                rows += len(some[-1])
                if rows >= tall:
                    yield blocks_of()
                    number, some, rows = number + 1, [], 0
        if some:
            yield blocks_of()

    tiles = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("sums", T.BinaryType())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        met: dict[int, np.ndarray] = {}
        now = None

        def tile_pairs() -> None:
            for i in met:
                for j in met:
                    if i <= j:
                        product = met[i].T @ met[j]
                        sums[i, j] = sums[i, j] + product if (i, j) in sums else product

        for batch in batches:
            for block, c, kind, raw in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if block != now:
                    tile_pairs()
                    met.clear()
                    now = block
                own = mean[c * width : (c + 1) * width]
                met[c] = np.frombuffer(raw, kind).reshape(-1, len(own)).astype(np.float64) - own
        tile_pairs()
        if sums:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([part] * len(sums)), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=tiles.names)

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s, np.float64) for s in group.column("sums").to_pylist()], axis=0)
        return pa.Table.from_arrays([*[group.column(k).slice(0, 1) for k in ("i", "j", "part")], pa.array([total.tobytes()], pa.binary())], names=tiles.names)

    lean_batches(frame.sparkSession)
    met_by_row = frame.select("x").mapInArrow(split, blocks).repartition("row_block").sortWithinPartitions("row_block", "column_block")
    parts = met_by_row.mapInArrow(multiply, tiles).withColumn("part", F.col("part") % GROUPS)
    whole_tiles = parts.groupBy("i", "j", "part").applyInArrow(added, tiles).groupBy("i", "j").applyInArrow(added, tiles)
    out = np.zeros((dims, dims))
    for r in whole_tiles.collect():  # of each tile one row
        a, b = (slice(k * width, min((k + 1) * width, dims)) for k in (r.i, r.j))
        tile = np.frombuffer(r.sums, np.float64).reshape(a.stop - a.start, b.stop - b.start)
        out[a, b] = tile
        out[b, a] = tile.T
    return out / n


@dataclass
class Whitening:
    """n and sums: of the fit list; values and vectors: the first eigenvalues of its covariance, falling, and eigenvectors; trace: the sum of all."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def varied(self) -> np.ndarray:
        """Whether each component has variance beyond rounding."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (x.astype(np.float64) - self.mean) @ self.vectors / np.sqrt(np.maximum(self.values, 0))
        return np.where(self.varied, out, np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) squared, exact; None beyond 64 bits."""
        most = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums)) if len(x) else 0
        if len(self.sums) * most * most < 1 << 63:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fitted(fit: DataFrame, dims: int, components: int, width: int = WIDTH) -> Whitening:
    """The whitening of the vectors in column x of ``fit``, all distinct."""
    n, sums = exact_sums(fit, dims)
    v = covariance(fit, np.array([s / n for s in sums]), n, width)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    # either sign will do; of these the one whose largest entry is above zero
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return Whitening(n, sums, values[order], vectors, float(np.trace(v)))


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest entry, without sign, of the whitened fit list's covariance minus the identity."""
    varied = np.flatnonzero(model.varied)
    if not len(varied):
        return None
    doubles = T.ArrayType(T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.whitened(_matrix(batch.column(0), len(model.sums)))[:, varied]
            yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.list_(pa.float64()))], names=["x"])

    y = fit.select("x").mapInArrow(run, T.StructType([T.StructField("x", doubles)]))
    means = y.agg(*[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(len(varied))]).first()
    return float(np.abs(covariance(y, np.array(means), model.n) - np.eye(len(varied))).max())


_OUT = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, width: int = WIDTH) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).alias("vec_id"), scaled(F.col(vector_col), scale).alias("x")).where("x is not null")
    schema = T.StructType([T.StructField("vec_id", base.schema["vec_id"].dataType), *[T.StructField(n, t) for n, t in _OUT]])
    fit = cut(base.select("x").distinct(), "vectors")
    sizes = [r[0] for r in fit.select(F.size("x")).distinct().limit(2).collect()]
    if not sizes:
        return local_frame(spark, [], schema)
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    model = fitted(fit, sizes[0], components, width)
    error, k = identity_error(fit, model), len(model.values)
    forget(fit)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(model.sums))
            m = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            whitened = model.whitened(x).ravel()
            columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([model.n] * (m * k), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(whitened, mask=np.isnan(whitened)), pa.array(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=schema.names)

    return base.mapInArrow(run, schema)
