"""As-of join: each row of one table with the last row of another before it, for whole tables.

Both sides are put into one table and sorted once, by keys, time, side and then by a hash, so that neither a frequent key nor a frequent moment is bound to one partition. Going
through its sorted rows, a partition carries the last row of the right side along. Rows for which that row lies in an earlier partition are completed by a second step: each partition's
last right row, one for each partition, gives the row that the next one begins with. No pair of rows is formed and then dropped, and a lost executor repeats its partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarn.sources.shared import shared_folder


def as_of_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: tuple[str, ...] = (), values: tuple[str, ...] | None = None, order: tuple[str, ...] = (), strict: bool = True, partitions: int | None = None
) -> DataFrame:
    """The columns of ``left`` and ``values`` of the last right row whose ``right_on`` is before ``left_on`` (with ``strict=False`` also at it), among those with the same ``keys``.

    Of several right rows at one moment the last by ``order``, then by all their columns, is taken. Left rows without a match, without a moment or with a null key have nulls, right rows
    without a moment or with a null key are not taken. Values must not be named like columns of ``left``. Rows that repeat are all returned.
    """
    spark = left.sparkSession
    values = tuple(c for c in right.columns if c not in keys) if values is None else values
    if clash := set(values) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    moment = F.col(right_on).cast(left.schema[left_on].dataType) if left.schema[left_on].dataType != right.schema[right_on].dataType else F.col(right_on)
    own, other = (F.struct(*(F.col(f"`{c}`") for c in columns)) for columns in (left.columns, values))
    own_type, other_type = left.select(own.alias("v")).schema["v"].dataType, right.select(other.alias("v")).schema["v"].dataType
    names = [f"key{i}" for i in range(len(keys))]
    ties = [f"tie{i}" for i in range(len(order))]

    def side(df: DataFrame, when: Column, last: bool, l: Column, r: Column, tied: list[Column], mixed: Column) -> DataFrame:
        held = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
        return df.select(*held, when.alias("moment"), F.lit(last).alias("side"), *(c.alias(n) for c, n in zip(tied, ties)), mixed.alias("mixed"), l.alias("l"), r.alias("r"))

    known = F.col(f"`{right_on}`").isNotNull()
    for k in keys:
        known = known & F.col(f"`{k}`").isNotNull()
    none = [F.lit(None).cast(right.schema[c].dataType) for c in order]
    rows = side(left, F.col(f"`{left_on}`"), not strict, own, F.lit(None).cast(other_type), none, F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)))
    known_rows = right.where(known)
    rows = rows.unionByName(side(known_rows, moment, strict, F.lit(None).cast(own_type), other, [F.col(f"`{c}`") for c in order], F.xxhash64(*(F.col(f"`{c}`") for c in values))))
    by = [*names, "moment", "side", *ties, "mixed"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)

    key_types = [T.StructField(k, placed.schema[k].dataType) for k in names]
    schema = T.StructType([*key_types, T.StructField("l", own_type), T.StructField("r", other_type), T.StructField("part", T.IntegerType()), T.StructField("what", T.StringType())])
    width = len(names)

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Left rows with the last right row of this partition before them, ``open`` ones without any yet, and the partition's last right row."""
        part = TaskContext.get().partitionId()
        last: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if last is not None:
                table = pa.concat_tables([last, table])
            table = table.combine_chunks()
            from_right = pc.is_valid(table["r"]).to_numpy(zero_copy_only=False)
            source = np.maximum.accumulate(np.where(from_right, np.arange(len(table)), -1))
            mine = np.flatnonzero(~from_right)
            at = pa.array(source[mine], pa.int64(), mask=source[mine] < 0)
            same = np.ones(len(mine), bool)
            for k in names:
                equal = pc.equal(table[k].take(at), table[k].take(pa.array(mine)))
                same &= pc.fill_null(equal, False).to_numpy(zero_copy_only=False)
            found = table["r"].take(pa.array(source[mine], pa.int64(), mask=(source[mine] < 0) | ~same))
            columns = [table[k].take(pa.array(mine)) for k in names]
            what = pa.array(np.where(source[mine] < 0, "open", "done"), pa.string())
            if len(mine):
                yield from pa.table([*columns, table["l"].take(pa.array(mine)), found, pa.array([part] * len(mine), pa.int32()), what], names=[*names, "l", "r", "part", "what"]).to_batches()
            if source[-1] >= 0:
                last = table.slice(int(source[-1]), 1)
        if last is not None:
            cells = [last[k] for k in names]
            yield from pa.table([*cells, last["l"], last["r"], pa.array([part], pa.int32()), pa.array(["last"], pa.string())], names=[*names, "l", "r", "part", "what"]).to_batches()

    path = f"{shared_folder(spark, 'as-of')}/rows"
    placed.select(*names, "l", "r").mapInArrow(carry, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    # one row for each partition: what the partitions before it end with
    ends = written.where("what = 'last'").select("part", F.struct(*names, "r").alias("end"))
    starts = spark.range(n).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    before = F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("part", before.alias("before"))
    rest = written.where("what <> 'last'").join(F.broadcast(starts), "part")  # as many rows as partitions
    match = F.col("what") == "open"
    for k in names:
        match = match & (F.col(k) == F.col(f"before.{k}"))
    found = F.when(F.col("what") == "done", F.col("r")).when(match, F.col("before.r"))
    # a left row without a moment is sorted before all others, so only the border could give it something
    found = F.when(F.col(f"l.`{left_on}`").isNotNull(), found)
    return rest.select("l.*", found.alias("found")).select(*(F.col(f"`{c}`") for c in left.columns), *(F.col(f"found.`{c}`").alias(c) for c in values))
