"""Tables of vectors as blocks: what exact search and the graph index share.

A block is a row with about ``size`` vectors as one binary value. Rows are dealt to blocks by a hash of their place in
the input, so blocks are of one size, give or take a few square roots of it, whatever the ids and the partitions. Queries come in blocks too; each query block meets every data block of its dimension by an equi-join on
the block number, so the work is a grid of bounded tasks and nothing else is broadcast or paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVERY = 20


def valid(vector: Column, zero: bool) -> Column:
    """Not null, without null or non-finite components; zero: whether zero vectors pass."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = vector.isNotNull() & ~F.coalesce(bad, F.lit(False))
    return ok if zero else ok & F.exists(x, lambda v: v != 0)


def rows_of(table: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id, vec (array<double>), dim of the vectors that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).filter(valid(F.col("vec"), zero))
    return rows.select("id", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim"))


BLOCKS = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("data", pa.binary())])


def blocked(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(dim, block, ids, nulls, data: float64 row by row; how many blocks the rows are dealt to)."""
    n = max(1, -(-rows.count() // size))

    def gather(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        data = table.column("vec").combine_chunks()
        data = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in data.chunks]) if isinstance(data, pa.ChunkedArray) else data.flatten().to_numpy(zero_copy_only=False)
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks)
        key = {k: table.column(k)[0].as_py() for k in ("dim", "block")}
        nulls = np.array(ids.is_null().to_pylist(), bool)
        return pa.table([[key["dim"]], [key["block"]], [ids.fill_null(0).to_numpy().astype(np.int64).tobytes()], [nulls.tobytes()], [np.asarray(data, np.float64).tobytes()]], schema=BLOCKS)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(gather, "dim int, block int, ids binary, nulls binary, data binary"), n


def asked_blocks(queries: DataFrame) -> DataFrame:
    return queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))


def grid(asked: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Every query block (as from asked_blocks) with every data block of its dimension: the columns of both."""
    return asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, ["dim", "block"])


FOUND = "q_dim int, q_block int, q_row int, query_id long, vec_id long, score {kind}"


def found_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("q_dim", pa.int32()), ("q_block", pa.int32()), ("q_row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row over all blocks: query_id, rank, vec_id, score."""
    order = Window.partitionBy("q_dim", "q_block", "q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sampled(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``every``."""
    return rows.filter(F.col("id") % every == 0)
