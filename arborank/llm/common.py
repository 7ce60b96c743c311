"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir, written

#: White space that separates words, as a Java and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null document id inside the operators: one document, before all others.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(column: str = "doc_id"):
    """The document id with nulls as NULL_ID, so that equal joins and minima treat nulls as one smallest id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, longer where df has them in any letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with more than this share of the rows, and this many rows, is dealt over several tasks; there are at most 1 / share of them.
HOT_SHARE, HOT_ROWS, HOT_PARTS = 0.001, 5000, 64


def hot_keys(rows: DataFrame, key: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """The hot keys of rows, a written table of at most 1 / HOT_SHARE rows, with __hot = true. sizes: key and __n, if they are known."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")) if sizes is None else sizes
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    return written(sizes.filter(F.col("__n") > max(HOT_ROWS, HOT_SHARE * total)).select(*key, F.lit(True).alias("__hot")), "hot-keys")


def dealt(rows: DataFrame, lookup: DataFrame, key: list[str], by: Column, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with __part: rows of a hot key are dealt to HOT_PARTS parts by the hash `by`, and the key's lookup row goes to each."""
    hot = F.broadcast(hot)
    part = F.when(F.col("__hot"), F.pmod(by, F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(hot, key, "left").withColumn("__part", part).drop("__hot"), lookup.join(hot, key, "left").withColumn("__part", F.explode(parts)).drop("__hot")


def spread_join(rows: DataFrame, lookup: DataFrame, key: list[str], by: Column, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) with lookup, which has one row a key at most and no column of rows but the key.

    No key's rows need meet in one task; see dealt(). rows are read twice and should be a table, or cheap, unless the sizes (key, __n) are given.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")) if sizes is None else sizes
    largest, total = sizes.agg(F.max("__n"), F.sum("__n")).first()
    if (largest or 0) <= max(HOT_ROWS, HOT_SHARE * (total or 0)):  # nothing to write
        return rows.join(lookup, key, how)
    hot = hot_keys(rows, key, sizes)
    left, right = dealt(rows, lookup, key, by, hot)
    return left.join(right, [*key, "__part"], how).drop("__part")


def probed(rows: DataFrame, shards: DataFrame, by: Column, test: Callable[[tuple, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows that `test`, a mask of a batch by what their shard holds, lets through. Rows whose shard isn't there go.

    rows: any columns and `shard`; shards: `shard` and what it holds, one row each, no other column of rows. What a shard holds is sent
    to where its rows are dealt and comes before them in the order of the partition, so a task keeps one shard at a time and no group.
    """
    held = [c for c in shards.columns if c != "shard"]
    left, right = dealt(rows, shards, ["shard"], by, hot_keys(rows, ["shard"]))
    both = left.withColumn("__row", F.lit(True)).unionByName(right.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    both = both.select("__row", "shard", "__part", *held, *[c for c in rows.columns if c != "shard"]).repartition("shard", "__part").sortWithinPartitions("shard", "__part", "__row")
    width = 3 + len(held)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, what = None, ()
        for batch in batches:
            is_row, shard, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for a, b in zip(cuts := [0, *np.flatnonzero(~is_row).tolist()], [*cuts[1:], len(is_row)], strict=True):
                if a < b and not is_row[a]:
                    now, what = (shard[a], part[a]), tuple(batch.column(3 + k)[a].as_py() for k in range(len(held)))
                    a += 1
                # rows of this shard come first, then those of shards that hold nothing
                n = int(((shard[a:b] == now[0]) & (part[a:b] == now[1])).sum()) if now else 0
                if n:
                    own = pa.RecordBatch.from_arrays(batch.slice(a, n).columns[width:], batch.schema.names[width:])
                    yield own.filter(pa.array(test(what, own)))

    kept = rows.drop("shard")
    return both.mapInArrow(each, kept.schema)


def parts_of(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `limit` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """parts_of() with their texts as UTF-8; null is empty."""
    for part in parts_of(batches, column, limit):
        text = pc.fill_null(part.column(column), "")
        yield part, text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_pylist()


def ids_of(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return pc.fill_null(batch.column(column), NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


__all__ = ["NULL_ID", "SPACE", "doc_key", "free_names", "ids_of", "parts_of", "probed", "shared_dir", "slices", "spread_join", "table", "written"]
