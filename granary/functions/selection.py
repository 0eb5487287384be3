"""Exact quantiles of many shares and groups in four scans, without a sort.

A double's bits, with those of negative numbers turned around, order as the numbers do. Each scan looks at the next 16 of
the 64 bits, only in rows that agree with a wanted rank on the bits before, and counts; after four scans a rank's value is
known. A scan moves counts only: at most 65,536 for each group and wanted prefix, and that many reach the driver. All groups,
the whole, and all shares are settled together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

BITS, SCANS = 16, 4


def _keys(values):
    """Doubles as unsigned integers of the same order."""
    import numpy as np

    bits = (values + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def _value(key: int) -> float:
    import struct

    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return struct.unpack(">d", bits.to_bytes(8, "big"))[0]


def _counts(rows: DataFrame, scan: int, wanted: dict[str | None, list[int]]) -> dict[tuple[str | None, int], int]:
    """(group, leading bits) -> rows, for the rows whose bits before this scan's are wanted; None: all groups."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shift, found = np.uint64(64 - BITS * (scan + 1)), {}
        for batch in batches:
            keys, groups = _keys(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)), batch.column(0).dictionary_encode()
            names, of = groups.dictionary.to_pylist(), groups.indices.to_numpy(zero_copy_only=False)
            for k, g in [*enumerate(names), (-1, None)]:
                mine = (keys if g is None else keys[of == k]) >> shift
                for head in wanted.get(g, ()):
                    here = mine[(mine >> np.uint64(BITS)) == np.uint64(head)] if scan else mine
                    slots, n = np.unique(here, return_counts=True)
                    for slot, more in zip(slots.tolist(), n.tolist()):
                        found[g, slot] = found.get((g, slot), 0) + more
        if found:
            heads = np.array([head for _, head in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array(heads), pa.array(list(found.values()), pa.int64())], ["g", "head", "n"])

    sums = rows.select("g", "x").mapInArrow(run, "g string, head long, n long").groupBy("g", "head").agg(F.sum("n").alias("n"))
    return {(r.g, r.head & ((1 << 64) - 1)): r.n for r in sums.collect()}


def select_quantiles(df: DataFrame, value: Column, shares: list[float], group: Column | None = None, whole: bool = True) -> dict[str | None, list[float]]:
    """For each group (as text), and under None for all rows: the quantiles at these shares, by linear interpolation.

    Null and NaN values take no part. whole: whether all rows together are asked for. Without values there is no entry.
    """
    of = F.coalesce(group.cast("string"), F.lit("")) if group is not None else F.lit("")
    x = value.cast("double")
    rows = materialize(df.select(of.alias("g"), x.alias("x")).where(x.isNotNull() & ~F.isnan(x)), "selection")
    sizes = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}  # a row for each group
    asked: dict[str | None, int] = dict(sizes) if group is not None else {}
    if whole and sizes:
        asked[None] = sum(sizes.values())
    places = {g: [s * (n - 1) for s in shares] for g, n in asked.items()}
    # of each wanted rank (from 0): the leading bits so far, and its rank among rows that share them
    state = {g: {r: (0, r) for p in at for r in (math.floor(p), math.ceil(p))} for g, at in places.items()}
    for scan in range(SCANS):
        wanted = {g: sorted({head for head, _ in ranks.values()}) for g, ranks in state.items()}
        held: dict[tuple[str | None, int], list[tuple[int, int]]] = {}
        for (g, head), n in sorted(_counts(rows, scan, wanted).items(), key=lambda c: c[0][1]):
            held.setdefault((g, head >> BITS), []).append((head, n))
        for g, ranks in state.items():
            for rank, (head, inside) in ranks.items():
                for leading, n in held[g, head]:
                    if inside < n:
                        ranks[rank] = (leading, inside)
                        break
                    inside -= n
    out = {}
    for g, at in places.items():
        x = {rank: _value(head) for rank, (head, _) in state[g].items()}
        out[g] = [x[a] if (a := math.floor(p)) == p else x[a] + (x[a + 1] - x[a]) * (p - a) for p in at]
    return out
