"""Places and neighbours in an order, and values at a rank, without any group in one task.

Rows are sorted by range of (group, order), so a group of any size is many ranges. A range knows its rows; what it needs of those before it, how many of
its first group they hold and their last row, is one short line a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.functions.paths import basename
from framesieve.operators.tables import materialised, small_table


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; null is a value."""
    values = np.array(column.to_pylist(), dtype=object)
    return np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)


def ranked(rows: DataFrame, by: str, order: list[Column], place: str | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``place``, from 1 in each group in the given order, and with columns of the row before (new name: column; null for a group's first).

    Rows equal in all of ``order`` are placed anyhow, so let it end in a key; they stay in one range. Null groups are a group. The order is one range
    shuffle; of each range its first and last group, their counts and its last row come to the driver.
    """
    before = before or {}
    spark = rows.sparkSession
    carried = list(before.values())
    plain = [f"c{i}" for i in range(len(rows.columns))]
    at = {c: n for c, n in zip(rows.columns, plain, strict=True)}
    group = at[by]
    first_group = F.col(by).asc_nulls_first()
    ranges = rows.repartitionByRange(first_group, *order).sortWithinPartitions(first_group, *order).toDF(*plain)
    kept = materialised(ranges.withColumn("_range", F.spark_partition_id()))
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    edge = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("first", kinds[group]), T.StructField("last", kinds[group]), T.StructField("single", T.BooleanType()), T.StructField("n", T.LongType()), *(T.StructField(f"v{i}", kinds[at[c]]) for i, c in enumerate(carried))])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first = last = None
        single, n, row = True, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.names.index(group))
            change = np.flatnonzero(_changes(own)).tolist()
            if row is None:
                number, first, last = batch.column(batch.schema.names.index("_range"))[0].as_py(), own[0].as_py(), own[0].as_py()
            elif own[0].as_py() != last:
                single, n = False, 0
            if len(change) > 1:
                single, n = False, 0
            last, n = own[batch.num_rows - 1].as_py(), n + batch.num_rows - change[-1]
            row = batch.slice(batch.num_rows - 1, 1)
        if row is not None:
            cells = [row.column(row.schema.names.index(at[c])) for c in carried]
            kind = row.column(row.schema.names.index(group)).type
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([first], kind), pa.array([last], kind), pa.array([single]), pa.array([n], pa.int64()), *cells], names=edge.names)

    offsets, previous, so_far, last = {}, {}, 0, None
    started = False
    for e in sorted(kept.mapInArrow(edges, edge).collect(), key=lambda e: e["range"]):  # one row a range
        goes_on = started and e["first"] == last
        offsets[e["range"]] = so_far if goes_on else 0
        previous[e["range"]] = tuple(carry) if goes_on else None
        so_far = e["n"] + (so_far if goes_on and e["single"] else 0)
        last, started, carry = e["last"], True, [e[f"v{i}"] for i in range(len(carried))]
    sent = spark.sparkContext.broadcast((offsets, previous))
    names = ([place] if place else []) + list(before)
    out = T.StructType([*kept.schema.fields[:-1], *([T.StructField("p", T.LongType())] if place else []), *(T.StructField(f"b{i}", kinds[at[c]]) for i, c in enumerate(carried))])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, previous = sent.value
        count, last, row = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.names.index(group))
            change = _changes(own)
            if row is None:
                number = batch.column(batch.schema.names.index("_range"))[0].as_py()
                count, row = offsets[number], previous[number]
                change[0] = row is None and not count
            else:
                change[0] = own[0].as_py() != last
            index = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(change, index, -1))
            places = np.where(start < 0, count + index + 1, index - start + 1)
            added = [pa.array(places)] if place else []
            for i, c in enumerate(carried):
                values = batch.column(batch.schema.names.index(at[c]))
                head = pa.array([None if row is None else row[i]], values.type)
                shifted = pa.concat_arrays([head, values.slice(0, batch.num_rows - 1)])
                added.append(pa.array(shifted.to_pylist(), values.type, mask=change) if not pa.types.is_nested(values.type) else pa.array([None if x else v for x, v in zip(change.tolist(), shifted.to_pylist(), strict=True)], values.type))
            last, count = own[batch.num_rows - 1].as_py(), int(places[-1])
            row = tuple(batch.column(batch.schema.names.index(at[c]))[batch.num_rows - 1].as_py() for c in carried)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=out.names)

    return kept.mapInArrow(walked, out).toDF(*rows.columns, *names)


#: Buckets of a round of selection; magnitudes apart from which on a value is infinite, or none.
BUCKETS, INFINITE, NOT_A_NUMBER = 4096, 5000, 9999


def selected(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, one column for each of ``ranks``): the values at places of the sorted ones of each group, exactly; n counts values that are not null.

    ranks: place, from 0, as an expression of column ``n``. Groups without a value have no row. nan is above all others, -0 is 0.

    Only counts are shuffled, a row for each group and bucket of a task. The first round's buckets are signs and powers of two, those of the next equal parts between the
    least and greatest value of the bucket that holds the rank, until these are one: six rounds at most, as two doubles of one power of two have 2**52 values between
    them. No group's values meet in a task.
    """
    keys = [f"g{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    given = rows.where(v.isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.when(v == 0, 0.0).otherwise(v).alias("v"))
    size = F.abs(F.col("v"))
    power = F.when(F.isnan("v"), NOT_A_NUMBER).when(size == float("inf"), INFINITE).when(size == 0, 0).otherwise(F.floor(F.log2(size)) + 1080).cast("int")
    bucket = F.when(F.isnan("v"), NOT_A_NUMBER).otherwise(F.signum("v").cast("int") * power)
    counts = given.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
    inside = W.partitionBy(*keys).orderBy("bucket")  # a group's buckets, not its rows
    counts = materialised(counts.withColumns({"before": F.sum("m").over(inside) - F.col("m"), "n": F.sum("m").over(W.partitionBy(*keys))}))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in ranks.items())))
    named = counts.select("*", asked.alias("a")).select("*", "a.name", "a.place").drop("a")
    state = named.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m"))).select(*keys, "n", "name", "low", "high", (F.col("place") - F.col("before")).alias("place"))
    done = state.where("low = high")
    while True:
        state = materialised(state.where("low < high"))
        if state.isEmpty():
            break
        near = small_table(state)
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        met = given.alias("r").join(near.alias("s"), [*same, F.col("r.v").between(F.col("s.low"), F.col("s.high"))])
        span = F.col("high") - F.col("low")
        share = F.when(span < float("inf"), (F.col("v") - F.col("low")) / span).otherwise((F.col("v") / 2 - F.col("low") / 2) / F.greatest(F.col("high") / 2 - F.col("low") / 2, F.lit(5e-324)))
        part = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        split = met.select(*(F.col(f"s.{k}").alias(k) for k in keys), "n", "name", "place", "v", part)
        counts = split.groupBy(*keys, "n", "name", "place", "bucket").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        inside = W.partitionBy(*keys, "name").orderBy("bucket")
        counts = counts.withColumn("before", F.sum("m").over(inside) - F.col("m"))
        state = materialised(counts.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m"))).select(*keys, "n", "name", "low", "high", (F.col("place") - F.col("before")).alias("place")))
        done = done.unionByName(state.where("low = high"))
    out = done.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks))
    return out.toDF(*by, "n", *ranks)


def exact_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the mean of the two middle values of each group, of its only middle one if their number is odd."""
    n = F.col("n")
    found = selected(rows, by, value, {"_low": F.expr("(n - 1) div 2"), "_high": F.expr("n div 2")})
    return found.select(*by, F.when(n % 2 == 1, F.col("_low")).otherwise((F.col("_low") + F.col("_high")) / 2).alias("median"))


def nth_element(rows: DataFrame, by: str, value: str, share: float = 0.5) -> DataFrame:
    """(by, value): the value at that share of the sorted ones, the lower of two."""
    return selected(rows, [by], value, {value: F.greatest(F.ceil(F.col("n") * share) - 1, F.lit(0))}).select(by, value)


def frame_index(files: DataFrame, by: str, path: str, loaded: str) -> DataFrame:
    """files with ``frame_index``, from 0, by file name in code point order, then by the order of loading."""
    named = files.withColumn("_name", basename(F.col(path)))
    return ranked(named, by, [F.col("_name").asc_nulls_first(), F.col(loaded).asc_nulls_first()], "_place").withColumn("frame_index", F.col("_place") - 1).drop("_name", "_place")
