"""Whitening of bidder profiles over Spark MLlib block matrices.

Centred rows of the distinct profiles are indexed and cut into distributed
blocks. The scatter matrix is the blocks' transposed product, summed over as many
splits of the long side as there are row blocks, so no task meets all blocks. Its
eigenvectors are found locally (entries x entries), and a second block product
with the whitening matrix projects the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..session import written
from .profiles import integers, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How a dense matrix is stored in a column.
MATRIX = pa.struct(
    [
        ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())),
        ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_()),
    ]
)
SCALE = 256
COMPONENTS = 4
# Rows of a block: enough that the number of blocks, which the driver lays out, stays near ``BLOCKS``.
LEAST_ROWS = 128
MOST_ROWS = 1 << 16
BLOCKS = 2048
# Eigenvalues below this share of the largest are rounding of 0.
FLAT = 1e-12


def indexed(points: DataFrame) -> tuple[DataFrame, int]:
    """Distinct ``point`` rows with an ``index`` from 0 on, and their number.

    The place inside its task is stored with each row, so indexes don't depend on
    how the table is read; the driver adds up one count per task.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(points.groupBy("point").agg(F.lit(1).alias("one")).select("point", F.spark_partition_id().alias("part"), place.alias("place")))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = placed.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, start long")
    return placed.join(offsets, "part").select((F.col("start") + F.col("place")).alias("index"), "point"), starts[-1]


def row_blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Block matrix of ``index, row`` (array of doubles).

    Rows are dealt out by block and a task lays each block out whole. MLlib's own way
    from indexed rows sends every entry as an object of its own.
    """
    per_block = min(MOST_ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))
    place = T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])
    schema = T.StructType([T.StructField("_1", place), T.StructField("_2", MatrixUDT())])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            index, values = (np.concatenate(x) for x in zip(*held))
            entry = {
                "type": 1, "numRows": len(index), "numCols": width, "colPtrs": None, "rowIndices": None,
                "values": values[np.argsort(index)].ravel(order="F"), "isTransposed": False,
            }
            at = {"_1": int(index[0]) // per_block, "_2": 0}
            kinds = [pa.struct([("_1", pa.int64()), ("_2", pa.int64())]), MATRIX]
            return pa.RecordBatch.from_arrays([pa.array([at], kinds[0]), pa.array([entry], kinds[1])], names=["_1", "_2"])

        for batch in batches:
            index = batch.column(1).to_numpy()
            values = batch.column(2).flatten().to_numpy().reshape(-1, width)
            cuts = np.flatnonzero(np.diff(index // per_block)) + 1
            for part in zip(np.split(index, cuts), np.split(values, cuts)):
                if not part[0].size:
                    continue
                if held and held[0][0][0] // per_block != part[0][0] // per_block:
                    yield block()
                    held = []
                held.append(part)
        if held:
            yield block()

    dealt = rows.select((F.col("index") / per_block).cast("long").alias("block"), "index", "row")
    laid = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lay_out, schema)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", laid, per_block, width, n, width), per_block, width)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Sum of the outer products of a block matrix's rows."""
    turned = blocks.transpose()
    splits = int(blocks.numRows() // blocks.rowsPerBlock) + 1
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _rows_of(blocks: BlockMatrix) -> DataFrame:
    """``index, row`` of a block matrix, without a way through Python."""
    rows = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("row"))


def whiten_bidders(profiles: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``bidder, component, n, deviation, whitened, explained, identity_error``: a row per usable profile and component.

    ``profiles``: ``bidder`` of any type and ``profile``, an array of numbers (see
    ``profiles.bidder_profiles``); other columns don't matter. Usable are profiles of
    finite numbers that have as many entries as the longest such profile; the others
    have no row. Entries count as integers ``floor(scale * x)``. The fit takes each
    distinct profile once: ``n`` of them with sums S. Components are the unit
    eigenvectors of their covariance (divisor n), numbered from 1 by falling
    eigenvalue e, at most ``components`` and no more than there are entries.
    ``deviation`` is the exact sum of (n * x - S)^2 (null beyond a long), ``whitened``
    (x - S / n) projected on the component over sqrt(e), ``explained`` e over the trace,
    and ``identity_error`` the largest absolute entry of the covariance of ``whitened``
    over the fit minus the identity. A component without variance has null
    ``whitened``; ``explained`` is null if nothing varies, ``identity_error`` if no
    component does. Repeated rows repeat in the result; an empty table gives no rows.
    """
    spark = profiles.sparkSession
    most = 1 << 40
    usable = profiles.where(whole(F.col("profile"))).select("bidder", integers(F.col("profile"), scale, most).alias("point"))
    table = written(usable.where(F.size("point") > 0))
    width = table.agg(F.max(F.size("point"))).first()[0] or 0
    table = table.where(F.size("point") == width)
    fit, n = indexed(table)
    fit = written(fit)
    kind = f"bidder {dict(profiles.dtypes)['bidder']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], kind)
    found = fit.agg(*(F.sum(F.col("point")[i]) for i in range(width)), F.max(F.array_max(F.transform("point", F.abs)))).first()
    sums, top = list(found[:width]), found[width]
    mean = F.array(*(F.lit(s / n) for s in sums))
    blocks = row_blocks(fit.select("index", F.zip_with("point", mean, lambda x, m: x - m).alias("row")), n, width)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    shown = min(components, width)
    live = [j for j in range(shown) if values[j] > FLAT * values[0] and values[j] > 0]
    trace = float(values.sum())
    whitening = np.zeros((width, shown))
    for j in live:
        whitening[:, j] = vectors[:, j] / np.sqrt(values[j])
    factor = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(width, shown, whitening.ravel(order="F").tolist()))], 1), width, shown)
    whitened = written(_rows_of(blocks.multiply(factor)))
    blocks.blocks.unpersist()
    error = _identity_error(whitened, live, n)
    exact = 64 * width * (n * (top + 1)) ** 2 < 1 << 63
    wide = "long" if exact else "decimal(38,0)"
    off = F.zip_with("point", F.array(*(F.lit(str(s)).cast(wide) for s in sums)), lambda x, s: F.lit(n).cast("long" if exact else "decimal(12,0)") * x - s)
    squares = F.aggregate(off, F.lit(0).cast(wide), lambda acc, x: (acc + x * x).cast(wide)).try_cast("long")
    facts = fit.join(whitened, "index").select("point", squares.alias("deviation"), "row")
    listed = F.array(
        *(
            F.struct(
                F.lit(j + 1).alias("component"), (F.col("row")[j] if j in live else F.lit(None).cast("double")).alias("whitened"),
                F.lit(float(values[j]) / trace if trace else None).cast("double").alias("explained"),
            )
            for j in range(shown)
        )
    )
    each = table.join(facts, "point").select("bidder", "deviation", F.inline(listed))
    return each.select("bidder", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


def _identity_error(whitened: DataFrame, live: list[int], n: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity."""
    if not live:
        return None
    pairs = [(i, j) for i in live for j in live if i <= j]
    sums = [F.sum(F.col("row")[i]) for i in live]
    products = whitened.agg(*sums).first()
    mean = dict(zip(live, (s / n for s in products)))
    found = whitened.agg(*(F.sum((F.col("row")[i] - mean[i]) * (F.col("row")[j] - mean[j])) for i, j in pairs)).first()
    return max(abs(found[at] / n - (i == j)) for at, (i, j) in enumerate(pairs))
