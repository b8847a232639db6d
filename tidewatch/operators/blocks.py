"""Series read in blocks: one exchange by key, sorted within partitions, then Python once for many whole series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

#: rows that a block holds, beyond the last whole series in it
ROWS = 50_000


def _starts(table, keys: int) -> np.ndarray:
    """Where the first `keys` columns change; nulls are equal, and so are NaN."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in range(keys):
        c = table.column(k)
        a, b = c.slice(0, n - 1), c.slice(1)
        moved = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(c.type):
            moved = pc.and_(moved, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        moved = pc.or_(moved, pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= moved.to_numpy(zero_copy_only=False).astype(bool) if isinstance(moved, pa.Array) else moved.combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new)


def _whole(batches, keys: int, rows: int) -> Iterator:
    """(table, starts) of whole series in the order given, of about `rows` rows or one series."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        starts = _starts(table, keys)
        held, size = [table], table.num_rows
        if len(starts) > 1:
            cut = int(starts[-1])
            yield table.slice(0, cut), starts[:-1]
            held, size = [table.slice(cut)], table.num_rows - cut
    if size:
        table = pa.concat_tables(held).combine_chunks()
        yield table, _starts(table, keys)


def map_series(df: DataFrame, key: list[str], order: str, columns: list[str], schema: str, fn: Callable, dealt: bool = False, rows: int = ROWS) -> DataFrame:
    """What `fn(table, starts)` makes of blocks of whole series, as Arrow tables of `schema`.

    The table has the key columns, `order` and `columns`; a series lies in one block, in order, and begins at one of
    `starts`. `dealt`: the rows are partitioned by the key already.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = list(dict.fromkeys([*key, order, *columns]))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    keys = len(key)

    def task(batches):
        for table, starts in _whole(batches, keys, rows):
            found = fn(table, starts)
            yield from found.select(arrow.names).cast(arrow).to_batches()

    ready = df.select(*names) if dealt else df.select(*names).repartition(*key)
    return ready.sortWithinPartitions(*key, order).mapInArrow(task, schema)


def ddl(df: DataFrame, names: list[str]) -> str:
    """The types of some columns, for a schema."""
    return ", ".join(f"`{c}` {t}" for c, t in df.select(*names).dtypes)


def numbers(table, name: str) -> np.ndarray:
    """A column as doubles, NaN for null."""
    import pyarrow as pa

    c = table.column(name).cast(pa.float64()).combine_chunks()
    return c.to_numpy(zero_copy_only=False)


def owners(starts: np.ndarray, n: int) -> np.ndarray:
    """The series of each row."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def grid(table, starts: np.ndarray, value: str, place: np.ndarray, steps: int) -> np.ndarray:
    """Series x steps, each value at its place, NaN where there is none."""
    out = np.full((len(starts), steps), np.nan)
    out[owners(starts, table.num_rows), place] = numbers(table, value)
    return out


def lists(a: np.ndarray):
    """Rows of a matrix as an Arrow array of lists, NaN as null."""
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(a).ravel(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), flat)
