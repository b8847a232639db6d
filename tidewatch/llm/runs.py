"""Rows that Spark has dealt and sorted by a key, read run by run inside a task."""

from __future__ import annotations

import numpy as np


def sorted_runs(batches, most: int | None):
    """(table, starts): whole runs of rows equal in the first column, which the rows are sorted by, and where each begins.

    A run that passes from batch to batch is held until it ends. One of more than `most` rows, where that is given,
    is not held: it comes in pieces with None in place of the starts. A run that lies in one batch always comes whole.
    """
    import pyarrow as pa

    held, flowing = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = table.column(0).to_numpy()
        if flowing is not None:
            to = int(np.searchsorted(keys != flowing, True))
            if to:
                yield table.slice(0, to), None
            table, keys = table.slice(to), keys[to:]
            held = None
            if not len(keys):
                continue
            flowing = None
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1]
        held = table.slice(last).combine_chunks()
        if most is not None and held.num_rows > most:
            yield held, None
            flowing, held = keys[-1], None
    if held is not None:
        yield held, np.zeros(1, np.int64)
