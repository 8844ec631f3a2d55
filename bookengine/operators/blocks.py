"""Windows over a key of any size: prefix sums and as-of values in two passes, over blocks and then inside them.

A window over one book puts the whole book into one task. Here rows are dealt by (key, block of positions): a block's sum or
last value is one row, a window over these rows alone gives what stands before each block, and the rows' own windows end at
their block. Positions are whole numbers, dense as a rule; where they are sparse the blocks are just smaller. What is
given is read twice, so it should be a written table or a cheap scan. Where no key reaches over one block, which
``block_size`` finds out, the plain window is the same thing with fewer exchanges, and the size is None.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 1 << 16


def block_size(rows: DataFrame, by: str, size: int = BLOCK) -> int | None:
    """``size``, or None if all positions are below it, so that each key is one block."""
    most = rows.agg(F.max(by)).first()[0]
    return None if most is None or most < size else size


def _with_block(rows: DataFrame, by: str, size: int) -> DataFrame:
    return rows.withColumn("_block", F.expr(f"`{by}` div {size}"))


def _joined(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what stands before their block; keys may be null."""
    return rows.join(before, [rows[k].eqNullSafe(before[f"_{k}"]) for k in keys] + [rows["_block"] == before["_before"]]).drop("_block", "_before", *(f"_{k}" for k in keys))


def running_sums(rows: DataFrame, keys: list[str], by: str, sums: dict[str, Column], size: int | None = BLOCK) -> DataFrame:
    """Rows with the sums of expressions over all rows of the key up to this one. Rows of one position are summed in any order."""
    if size is None:
        whole = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns(sums).withColumns({n: F.sum(n).over(whole) for n in sums})
    valued = _with_block(rows.withColumns(sums), by, size)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = valued.groupBy(*keys, "_block").agg(*(F.sum(n).alias(n) for n in sums))
    before = blocks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_before"), *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "_block").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    local = valued.withColumns({n: F.sum(n).over(inside) for n in sums})
    return _joined(local, before, keys).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*(f"_{n}" for n in sums))


def row_numbers(rows: DataFrame, keys: list[str], by: str, name: str, size: int | None = BLOCK) -> DataFrame:
    """Rows with their number (from 1) in the key, by a position that no two rows of a key share."""
    return running_sums(rows, keys, by, {name: F.lit(1)}, size)


def last_values_before(rows: DataFrame, keys: list[str], by: str, values: dict[str, str], size: int | None = BLOCK) -> DataFrame:
    """Rows with, for each name, the last value of its column that is not null in the rows before them in the key; null where there is none."""
    if size is None:
        whole = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({name: F.last(value, ignorenulls=True).over(whole) for name, value in values.items()})
    valued = _with_block(rows, by, size)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = valued.groupBy(*keys, "_block").agg(*(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(by))).alias(f"_value{k}") for k, value in enumerate(values.values())))
    carried = [F.last(f"_value{k}", ignorenulls=True).over(ahead).alias(f"_carried{k}") for k in range(len(values))]
    before = blocks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_before"), *carried)
    inside = Window.partitionBy(*keys, "_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = valued.withColumns({name: F.last(value, ignorenulls=True).over(inside) for name, value in values.items()})
    found = _joined(local, before, keys).withColumns({name: F.coalesce(name, f"_carried{k}") for k, name in enumerate(values)})
    return found.drop(*(f"_carried{k}" for k in range(len(values))))


def last_before(rows: DataFrame, keys: list[str], by: str, value: str, name: str, size: int | None = BLOCK) -> DataFrame:
    """``last_values_before`` of one column."""
    return last_values_before(rows, keys, by, {name: value}, size)


def first_after(rows: DataFrame, keys: list[str], by: str, value: str, name: str, size: int | None = BLOCK) -> DataFrame:
    """As ``last_before``, looking ahead: the first value that is not null of the rows behind."""
    turned = rows.withColumn("_turned", -F.col(by))
    return last_before(turned, keys, "_turned", value, name, size).drop("_turned")
