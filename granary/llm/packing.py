"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition encodes its documents and packs the pieces best-fit, longest first, with no shuffle. Bins that are
nearly full are emitted. The others climb a tree: a node takes the underfull bins of a few neighbours as items, packs
them best-fit again, emits what is nearly full and passes the rest on. A node with more than NODE_BINS underfull bins is
several tasks, among which they are dealt by a hash; the root goes on in rounds, dealt anew each time, until one task
holds all that is left or a round merges none. So a node's memory is bounded and every underfull bin takes part.

Only light rows (document ids, lengths, checksums) climb the tree. Token ids are produced where the text is read; with_ids
moves them once, to their places.

Edge cases. Null or empty text is one piece that holds the end id alone. Null and repeated ids are packed row by row; ids
may have any type.
An empty table gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import default_path, encoder, rows

CAPACITY = 2048
FAN_IN = 8
NEARLY_FULL = 0.998
NODE_BINS = 50_000


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: for each item its bin and its place there; and the bins' loads.

    Bins of equal room share a stack; a bit set over the rooms finds the tightest that still fits.
    """
    stacks: dict[int, list[int]] = {}
    rooms, loads = 0, []
    where, place = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            k = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            k, room = len(loads), capacity
            loads.append(0)
        where[i], place[i] = k, loads[k]
        loads[k] += size
        left = room - size
        if left:
            stacks.setdefault(left, []).append(k)
            rooms |= 1 << left
    return where, place, loads


def _pieces(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter."""
    head = n % capacity or capacity
    yield 0, min(head, n)
    for start in range(head, n, capacity):
        yield start, capacity


def pack_local(df: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """A row for each piece, with its bin, its place there and, if it is the bin's first, the bin's load.

    with_ids: pieces are numbered (nth), and further rows (nth, ids) hold their ids. These leave the task as they are made,
    so that it holds the light columns of a partition only.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = to_arrow_type(texts.schema[0].dataType)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "load", *["nth", "ids"] * with_ids]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [kind, pa.int32(), *[pa.int64()] * 6]

        encode, end = encoder(path), end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32
        ids, piece, start, length, crc, raw = [], [], [], [], [], []

        def payload():
            """The ids of the latest pieces, under their numbers; the light columns come at the end."""
            nth = pa.array(range(base + len(ids) - len(raw), base + len(ids)), pa.int64())
            none = [pa.nulls(len(raw), c) for c in kinds]
            return pa.RecordBatch.from_arrays([*none, nth, pa.array(raw, pa.binary())], names)

        for doc_id, text in rows(batches, "doc_id", "text"):
            data = encode(text or "") + end
            for k, (at, n) in enumerate(_pieces(len(data) // 4, capacity)):
                part = data[4 * at : 4 * (at + n)]
                ids.append(doc_id)
                piece.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(part))
                if with_ids:
                    raw.append(part)
            if len(raw) >= 1024:
                yield payload()
                raw.clear()
        if raw:
            yield payload()
        where, place, loads = best_fit(length, capacity)
        light = [ids, piece, start, length, crc, [base + k for k in where], place, [loads[k] if not p else None for k, p in zip(where, place)]]
        cols = [pa.array(c, t) for c, t in zip(light, kinds)]
        if with_ids:
            cols += [pa.array(range(base, base + len(ids)), pa.int64()), pa.nulls(len(ids), pa.binary())]
        out = pa.RecordBatch.from_arrays(cols, names)
        yield from (out.slice(at, 10_000) for at in range(0, out.num_rows, 10_000))

    schema = f"doc_id {texts.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, bin long, place long, load long"
    return texts.mapInArrow(run, schema + ", nth long, ids binary" * with_ids)


def _merge(capacity: int, full: float):
    """One node of the tree: its bins as items; (bin, new bin, shift, load, open)."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["load", "bin"], ascending=[False, True])
        bins, sizes = pdf["bin"].tolist(), pdf["load"].tolist()
        where, place, loads = best_fit(sizes, capacity)
        first = {}
        for b, k, p in zip(bins, where, place):
            if not p:
                first[k] = b
        return pd.DataFrame({"bin": bins, "root": [first[k] for k in where], "shift": place, "load": [loads[k] for k in where], "open": [loads[k] < full for k in where]})

    return run


def pack(
    df: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    node_bins: int = NODE_BINS,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids as bytes)."""
    made = materialize(pack_local(df, path or default_path("byte_bpe_50k.json"), end_id, capacity, id_col, text_col, with_ids), "pieces")
    pieces = made.where("bin is not null")
    full = NEARLY_FULL * capacity
    bins = pieces.where("load is not null").select("bin", "load")
    moved = bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"))
    node = F.shiftright("bin", 32)
    top = pieces.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0
    open_ = bins.where(F.col("load") < full)
    width, round_, before = 1, 0, None
    while True:
        width, round_ = width * FAN_IN, round_ + 1
        at = F.floor(node / width)
        sizes = open_.groupBy(at.alias("node")).agg(F.count("*").alias("n"))  # a row for each node
        deal = sizes.select("node", F.ceil(F.col("n") / node_bins).alias("tasks"))
        dealt = open_.withColumn("node", at).join(deal, "node").withColumn("task", F.pmod(F.xxhash64(F.lit(round_), "bin"), "tasks"))
        step = dealt.groupBy("node", "task").applyInPandas(_merge(capacity, full), "bin long, root long, shift long, load long, open boolean")
        step = materialize(step, "merge")
        by = step.select(F.col("bin").alias("root"), F.col("root").alias("to"), F.col("shift").alias("by"))
        moved = moved.join(by, "root", "left").select("bin", F.coalesce("to", "root").alias("root"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
        took, left = step.agg(F.count("*"), F.count_if(F.expr("open and shift = 0"))).first()
        if width > top and (took <= node_bins or before is not None and left >= before):
            break
        before = left if width > top else None
        open_ = step.where("open and shift = 0").select(F.col("root").alias("bin"), "load")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("root").alias("sequence_id"), (F.col("place") + F.col("shift")).alias("offset")]
    placed = pieces.join(moved, "bin").select(*keep, *["nth"] * with_ids)
    if not with_ids:
        return placed
    # ids meet their places once, in a merge at every size
    return placed.hint("merge").join(made.where("bin is null").select("nth", "ids"), "nth").drop("nth")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
