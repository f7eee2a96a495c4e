"""Ordered recursion along a key's rows, in time linear in them.

``carried`` shuffles once by key, sorts inside the partitions and carries a state from row to row through Arrow batches: a key
may be longer than memory, since only its state is held. ``running_max`` is the max-plus recursion as a prefix scan over blocks
of a key, in the JVM: a long key is spread over its blocks. ``ordered`` gathers the rows of small keys (the boxes of a frame, the
clips of a media) into an array; ``most`` guards it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

MOST = 200_000


def ordered(rows: DataFrame, key: list[str], order: list[str], keep: list[str], most: int = MOST) -> DataFrame:
    """One row per key with ``items``: its rows as structs in the given order."""
    fields = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    items = F.array_sort(F.collect_list(F.struct(*fields, *[F.col(k) for k in keep])))
    out = rows.groupBy(*key).agg(items.alias("items"))
    slim = F.transform("items", lambda x: F.struct(*[x[k].alias(k) for k in keep]))
    guarded = F.when(F.size("items") <= most, slim).otherwise(F.raise_error(F.lit(f"a key has more than {most} rows")))
    return out.withColumn("items", guarded)


def carried(
    rows: DataFrame, key: list[str], order: list[str], keep: list[str], out: str, begin: Callable[[], Any],
    step: Callable[[Any, tuple, tuple | None], tuple[Any, tuple | None]], finish: Callable[[Any], Iterable[tuple]] = lambda s: (),
) -> DataFrame:
    """Along each key's rows in order: step(state, row, next row or None) gives the next state and an output row or None; begin
    makes the state of a new key, finish gives more rows at its end. Rows are tuples of ``keep``, output rows have the key
    and the columns of ``out`` (DDL)."""
    k, kinds = len(key), dict(rows.dtypes)
    schema = f"{', '.join(f'{c} {kinds[c]}' for c in key)}, {out}"
    made_schema = to_arrow_schema(_parse_datatype_string(schema))
    names, types = made_schema.names, made_schema.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, told = None, None, []

        def put(nxt: tuple | None) -> None:
            nonlocal state
            state, made = step(state, held[1], nxt)
            if made is not None:
                told.append((*held[0], *made))
            if nxt is None:
                told.extend((*held[0], *r) for r in finish(state))

        def pack() -> pa.RecordBatch:
            columns = list(zip(*told, strict=True)) if told else [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            told.clear()
            return made

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, row = r[:k], r[k:]
                if held is not None:
                    put(row if own == held[0] else None)
                if held is None or own != held[0]:
                    state = begin()
                held = own, row
            if told:
                yield pack()
        if held is not None:
            put(None)
        if told:
            yield pack()

    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key, *[F.asc_nulls_last(o) for o in order])
    return sorted_rows.select(*key, *keep).mapInArrow(run, schema)


def running_max(rows: DataFrame, key: list[str], at: str, order: list[str], value: Column, gain: int, name: str, block: int) -> DataFrame:
    """rows with ``name``, the result of r = max(value, r of the row before + gain) in order of at and order, and ``_n``, the
    place of the row in its key from 1 on. Blocks are spans of ``block`` of ``at``: inside a block a running maximum, between
    blocks a scan over one row each."""
    w = Window.partitionBy(*key, "_block").orderBy(at, *order)
    inside = rows.withColumns({"_block": F.floor(F.col(at) / block), "_v": value}).withColumn("_k", F.row_number().over(w))
    level = F.col("_v") - F.col("_k") * gain  # of all rows of a block alike: r - place * gain never falls
    local = inside.withColumn("_m", F.max(level).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = inside.groupBy(*key, "_block").agg(F.count("*").alias("_c"), F.max(level).alias("_top"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    placed = placed.withColumn("_carry", F.max(F.col("_top") - F.col("_before") * gain).over(before)).drop("_c", "_top")
    both = local.join(placed, [*key, "_block"])
    n = F.col("_before") + F.col("_k")
    reached = F.greatest(F.col("_m") - F.col("_before") * gain, F.col("_carry")) + n * gain
    return both.withColumns({name: reached, "_n": n}).drop("_block", "_v", "_k", "_m", "_before", "_carry")
