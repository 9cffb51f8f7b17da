"""Ordered folds: what a key's rows mean depends on what came before, and no window function expresses it."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Generator, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..work import discard, work_dir, written

#: Rows that one task sorts of a sequence.
ROWS = 1_000_000


def scan(df: DataFrame, keys: list[str], order: list[str], start: Any, step: Callable[[Any, dict], tuple[Any, tuple]], adds: str, reads: list[str]) -> DataFrame:
    """``df`` with the columns ``adds`` (name type, ...), found by ``step(state, row) -> (state, values)`` along each key's rows.

    One sort, one pass, and only the current key's state in memory, however many rows a key has: a key's rows are never
    gathered. ``row`` has the columns ``reads``; each key begins with ``start``. Without keys all rows are one sequence in one
    task: for aggregates only. Rows are those of ``df``, and so is their number.
    """
    names = [a.split()[0] for a in adds.split(", ")]
    types = {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}
    kinds = [types[a.split()[1]] for a in adds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, start
        for batch in batches:
            of = [batch.column(k).to_pylist() for k in keys]
            rows = zip(*(batch.column(r).to_pylist() for r in reads), strict=True)
            out: list[tuple] = []
            for key, values in zip(zip(*of, strict=True) if of else [()] * batch.num_rows, rows, strict=True):
                if key != here:
                    here, state = key, start
                state, made = step(state, dict(zip(reads, values, strict=True)))
                out.append(made)
            more = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    dealt = (df.repartition(*keys) if keys else df.repartition(1)).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, f"{schema}, {adds}")


def relay(rows: DataFrame, order: list[str], reads: list[str], start: Any, fold: Callable[[Any, Iterator[pa.RecordBatch]], Generator[pa.RecordBatch, None, Any]], schema: str) -> DataFrame:
    """All rows as one sequence in ``order``: ``fold(state, batches)`` yields batches of ``schema`` and returns its last state.

    ``batches`` have the columns ``reads``. The rows are dealt by ranges of their order into parts of about ``ROWS`` rows, so no
    task sorts more, however many there are; parts are folded one after the other, as each needs the state of the one before.
    They are read once. One part is left lazy, more are folded at once and written. Rows equal in all of ``order`` share a part.
    """
    spark, kinds = rows.sparkSession, StructType.fromDDL(schema)
    kept = written(rows.select(*dict.fromkeys((*order, *reads))), "sequence")
    parts, types = -(-kept.count() // ROWS), to_arrow_schema(kinds)
    kinds = kinds.add("_state", "binary")

    def folded(part: DataFrame, state: Any) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = fold(state, batches)
            while True:
                try:
                    batch = next(made)
                except StopIteration as end:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types.types), pa.array([pickle.dumps(end.value)], pa.binary())], names=kinds.names)
                    return
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], names=kinds.names)

        return part.repartition(1).sortWithinPartitions(*order).select(*reads).mapInArrow(run, kinds)

    if parts <= 1:
        return folded(kept, start).where("_state IS NULL").drop("_state")
    dealt = written(kept.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges", "_part")
    discard(kept)
    path, state = f"{work_dir(spark)}/tidewater/relay-{uuid.uuid4().hex}", start
    for i in range(parts):
        folded(dealt.where(F.col("_part") == i).drop("_part"), state).write.parquet(f"{path}/{i}")
        state = pickle.loads(spark.read.schema(kinds).parquet(f"{path}/{i}").where("_state IS NOT NULL").first()["_state"])
    discard(dealt)
    return spark.read.schema(kinds).parquet(*[f"{path}/{i}" for i in range(parts)]).where("_state IS NULL").drop("_state")
