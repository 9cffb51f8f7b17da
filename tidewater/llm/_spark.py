"""Shared pieces of the corpus operators: work tables, skew-safe joins, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import discard, work_dir, written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a worker turns few texts at a time into Python's own."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def if_small(keys: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``keys`` (a written table of one long) marked to be broadcast if it has at most ``rows`` rows, 16 MB; else to be merged."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys.hint("merge")


def join_on_hot_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a long key that may be hot on the left side and is unique on the right.

    The key is inverted on both sides, so that neither side's earlier partitioning serves the join: both are
    exchanged just for it, and then adaptive execution can split a hot key's partition.
    """
    a = left.withColumn("_not", F.bitwise_not(F.col(key)))
    b = right.withColumn("_not", F.bitwise_not(F.col(key))).drop(key)
    return a.join(b, "_not", how).drop("_not")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u long, v long): rows (node, root), root the smallest node.

    Every round replaces each edge (u, v) by an edge from v to the smallest neighbour of u, and links u to it too;
    connectivity stays, paths shorten by half or more, and at the fixed point each component is a star around its
    smallest node. Each round is written, so lineage doesn't grow. Loops (u = v) and null ends are ignored. No edges
    give no rows.
    """
    seen = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = seen.unionAll(seen.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = join_on_hot_key(both, least, "u")
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after = written(moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        n, total = after.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        discard(seen)
        seen = after
        if state == (n, total):
            return seen.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (n, total)


def mod_crc(column: str | Column, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; null for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % n
