"""Counts of very many distinct keys, told back to every unit that asks.

A unit (a chunk of text) asks once for each of its distinct 64-bit keys, sorted and cut by
key range. The ranges are `fan ** levels`, about PART_KEYS keys each. With one level every
range adds up what all units count and answers each in the order it asked. With more, a
unit cuts its keys into `fan` wide ranges only; the asks of a squad of units in a wide
range are merged into one unit that asks in the next level, and its answers are dealt back
to the squad. So a unit emits at most `fan` rows however large the table is, the rows grow
with the units, and no group holds more than about PART_KEYS keys.

An answer has the total over all units, the total over `dev` units (for those units only),
and whether another unit asked for the key too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, spans_of

#: Keys that one range adds up, about, and the most rows that a unit emits.
PART_KEYS, FAN = 6_000_000, 4096
ASKS = "unit long, range long, dev boolean, keys binary, n binary, held binary, shared binary"
ANSWERS = "unit long, range long, n binary, held binary, shared binary, flagged long"
_ASKS = pa.schema([("unit", pa.int64()), ("range", pa.int64()), ("dev", pa.bool_()), *((c, pa.binary()) for c in ("keys", "n", "held", "shared"))])
_ANSWERS = pa.schema([("unit", pa.int64()), ("range", pa.int64()), *((c, pa.binary()) for c in ("n", "held", "shared")), ("flagged", pa.int64())])


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as byte planes of the least width that holds them: equal high
    bytes then compress well."""
    top = int(a.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + a.astype(f"<u{width}").view(np.uint8).reshape(len(a), width).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def pack_bits(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes() if a.any() else b""


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).astype(bool) if b else np.zeros(n, dtype=bool)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Number of each key's range among so many (below 2 ** 32) of equal width."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def levels(keys: int) -> tuple[int, int]:
    """Fan and number of levels for about so many keys over all units."""
    parts = max(1, math.ceil(keys / PART_KEYS))
    depth = 1
    while FAN**depth < parts:
        depth += 1
    return max(1, math.ceil(round(parts ** (1 / depth), 9))), depth


def ask(unit: int, dev: bool, keys: np.ndarray, n: np.ndarray, ranges: int, first: int = 0, count: int | None = None, held: np.ndarray | None = None, shared: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows in which a unit asks for sorted keys; those of ranges first to first + count."""
    count = ranges if count is None else count
    edges = np.searchsorted(range_of(keys, ranges), np.arange(first, first + count + 1))
    rows = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            rows.append({
                "unit": unit, "range": first + k, "dev": dev, "keys": pack_keys(keys[a:b]), "n": pack(n[a:b]),
                "held": b"" if held is None else pack(held[a:b]), "shared": b"" if shared is None else pack_bits(shared[a:b]),
            })
    return pa.RecordBatch.from_pylist(rows, schema=_ASKS)


class Merged:
    """The distinct keys of several asks, with their sums; `at` has the place among them of
    each ask's keys, one ask after the other (ask i from edges[i] on)."""

    def __init__(self, rows: list[dict]):
        keys = [unpack_keys(r["keys"]) for r in rows]
        self.edges = spans_of(np.array([len(k) for k in keys]))
        self.keys, self.at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        self.n, self.held = np.zeros(len(self.keys), dtype=np.int64), np.zeros(len(self.keys), dtype=np.int64)
        times = np.zeros(len(self.keys), dtype=np.uint8)  # 2: more than one
        for r, a, b in zip(rows, self.edges, self.edges[1:]):
            at, n = self.at[a:b], unpack(r["n"]).astype(np.int64)
            self.n[at] += n  # the keys of an ask are distinct
            if r["held"]:
                self.held[at] += unpack(r["held"]).astype(np.int64)
            elif r["dev"]:
                self.held[at] += n
            times[at] = np.minimum(times[at] + 1 + unpack_bits(r["shared"], b - a), 2)
        self.shared = times > 1

    def tell(self, rows: list[dict], n: np.ndarray, held: np.ndarray, shared: np.ndarray, flagged: int) -> pa.Table:
        """What each ask is told of the sums for all keys."""
        out = []
        for r, a, b in zip(rows, self.edges, self.edges[1:]):
            at = self.at[a:b]
            out.append({"unit": r["unit"], "range": r["range"], "n": pack(n[at]), "held": pack(held[at]) if r["dev"] else b"", "shared": pack_bits(shared[at]), "flagged": 0})
        out[0]["flagged"] = flagged
        return pa.Table.from_pylist(out, schema=_ANSWERS)


def answers(asks: DataFrame, keys: int, fan: int, depth: int, level: int = 1) -> DataFrame:
    """The answers to asks cut into fan ** level ranges, of about so many keys in all.
    `flagged` sums up to the number of distinct keys with the lowest bit set and a count."""

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        m = Merged(rows)
        out = m.tell(rows, m.n, m.held, m.shared, int(((m.n > 0) & (m.keys & np.uint64(1) == 1)).sum()))
        del m, rows
        release()
        return out

    if level == depth:
        return asks.groupBy("range").applyInArrow(add, ANSWERS)
    asks = cut(asks, "keys-asks")
    ranges = fan**level
    squads = max(1, math.ceil(keys / ranges / PART_KEYS))
    dealt = asks.withColumn("squad", F.pmod(F.xxhash64("unit"), F.lit(squads)))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        m, own = Merged(rows), rows[0]["range"]
        return pa.Table.from_batches([ask(own * squads + rows[0]["squad"], True, m.keys, m.n, ranges * fan, own * fan, fan, m.held, m.shared)], schema=_ASKS)

    told = answers(dealt.groupBy("range", "squad").applyInArrow(merge, ASKS), keys, fan, depth, level + 1)
    own = F.col("unit").cast("long")
    told = told.withColumns({"wide": F.floor(own / squads).cast("long"), "squad": F.pmod(own, F.lit(squads).cast("long"))})

    def deal(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, back = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: r["range"])
        m = Merged(rows)
        n, held = (np.concatenate([unpack(r[c]) for r in back]).astype(np.int64) for c in ("n", "held"))
        sizes = [len(unpack(r["n"])) for r in back]
        shared = np.concatenate([unpack_bits(r["shared"], k) for r, k in zip(back, sizes)])
        return m.tell(rows, n, held, shared, sum(r["flagged"] for r in back))

    return dealt.groupBy("range", "squad").cogroup(told.groupBy("wide", "squad")).applyInArrow(deal, ANSWERS)


def told(rows: list[dict], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total, held-out total (zero if not asked for) and sharing of a unit's keys in order."""
    rows = sorted(rows, key=lambda r: r["range"])
    n = np.concatenate([unpack(r["n"]) for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
    assert len(n) == size
    held = np.concatenate([unpack(r["held"]) if r["held"] else np.zeros(len(unpack(r["n"])), np.int64) for r in rows] or [n]).astype(np.int64)
    shared = np.concatenate([unpack_bits(r["shared"], len(unpack(r["n"]))) for r in rows] or [np.zeros(0, bool)])
    return n, held, shared
