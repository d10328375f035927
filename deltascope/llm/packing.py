"""Best-fit packing of token pieces into sequences of a fixed capacity.

Hierarchical residual packing: every partition best-fits its items (longest first,
each into the open bin that it leaves least room in), bins that are nearly full are
emitted, and the contents of the others become single items of the next round, in an
eighth of the partitions, until one partition is left. A partition holds a bounded
number of items, whatever the data; what crosses a shuffle after the first round is
the few underfull bins.

Nulls are empty texts: one piece, the end id. Texts are encoded whole, however long;
repeated rows and rows that share a doc_id (or have none) are pieces of their own; an empty
table gives no rows. `pieces` reads doc_id and text only.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Items that one task packs, and the partitions that one task of the next round takes.
ITEMS, FAN_IN = 8192, 8
#: Bins with at most this many free places are emitted.
NEARLY_FULL = 4


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """One row for each piece of each document: ids of the whole text (null: empty)
    and an end id, cut only where they are more than `capacity`."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part, _ in texts(batch, chars=8 << 20):
                ids, counts = enc.encode(part["text"], end)
                ids = ids.astype("<u4")
                rows, at = [], 0
                for doc, n in zip(part["doc_id"].to_pylist(), counts.tolist()):
                    for k, s in enumerate(range(0, n, capacity)):
                        e = min(n, s + capacity)
                        rows.append((doc, k, s, e - s, zlib.crc32(ids[at + s : at + e])))
                    at += n
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of the lengths, longest first: each item's bin and place in it, and
    how full each bin is. Bit r of `rooms` says that a bin with room r is open."""
    bins, places, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    rooms, by_room = 0, [[] for _ in range(capacity + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, places, np.array(fills, dtype=np.int64)


def pack(items: DataFrame, capacity: int = 4096, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Adds sequence_id and offset to `items` (any columns but these two, one of them
    `length`, from 1 to `capacity`). Pieces of a sequence lie in it without gaps from 0. An
    empty input gives no rows; equal rows are separate items, dealt out by their place in
    the stored table; items of equal length are put in the order in which they come. Nulls
    in other columns are kept.

    Rounds: each takes at most an eighth of the partitions of the one before, so ITEMS * 8**r
    items take at most r + 1 rounds, and one more for each time that more than ITEMS bins
    are left open in every partition; a round that joins no bins is the last."""
    own = items.columns

    def free(name: str) -> str:
        """An inner column's name that no column of the items has."""
        return name if name not in own else free(name + "_")

    item_, fill_, at_, closed_, deal_ = map(free, ("_item", "_fill", "_at", "_closed", "_deal"))
    state = items.select(*own, F.lit(None).cast("long").alias(item_), F.col("length").cast("long").alias(fill_), F.lit(0).cast("long").alias(at_), F.monotonically_increasing_id().alias(deal_))
    state = cut(state, "pack-items")
    schema = state.schema
    n = state.count()
    parts, level, done, open_bins = max(1, math.ceil(n / ITEMS)), 0, None, -1
    out_schema = schema.simpleString()[len("struct<") : -1] + f",{closed_}:boolean"
    while True:

        def run(batches, level=level, last=parts == 1):
            from pyspark import TaskContext

            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            table = pa.Table.from_batches(batches)
            item = table[item_].to_numpy() if level else np.arange(table.num_rows)
            order = np.argsort(item, kind="stable")
            _, first, inverse = np.unique(item[order], return_index=True, return_inverse=True)
            lengths = table[fill_].to_numpy()[order][first]
            bins, places, fills = best_fit(lengths, capacity)
            code = (level << 54) | (TaskContext.get().partitionId() << 28)
            of = bins[inverse]
            table = table.take(order)
            at = table[at_].to_numpy() + places[inverse]
            closed = np.ones(len(of), dtype=bool) if last else fills[of] >= capacity - nearly_full
            for name, values in ((item_, of + code), (fill_, fills[of]), (at_, at)):
                table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
            yield from table.append_column(closed_, pa.array(closed)).to_batches(max_chunksize=10_000)

        key = F.col(item_) if level else F.xxhash64(deal_)
        packed = cut(state.repartition(parts, key).mapInArrow(run, out_schema), f"pack-{level}")
        full = packed.where(F.col(closed_)).drop(closed_)
        done = full if done is None else done.unionByName(full)
        if parts == 1:
            break
        state = packed.where(~F.col(closed_)).drop(closed_)
        # a task's share of the next round is bounded by what is left, not only by the
        # tree; bins that no round can join any more (all over half full) end here
        left = state.select(item_).distinct().count()
        if left == open_bins:
            done = done.unionByName(state)
            break
        open_bins = left
        parts, level = max(min(math.ceil(parts / FAN_IN), parts - 1), math.ceil(left / ITEMS), 1), level + 1
    return done.select(*own, F.col(item_).alias("sequence_id"), F.col(at_).alias("offset"))
