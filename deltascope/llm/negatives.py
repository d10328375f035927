"""Hard negatives by threshold joins with an L2AP-style index.

For each anchor the positives are its best rows of the same label, the negatives the best
rows of other labels whose score lies in a window below a positive's. Both are found by
joins "all rows with a score of at least t": t starts high and is lowered, only for the
anchors or windows that are not full yet, until they are full or t reaches their least score.

A join deals anchors and rows out in blocks of bounded size and cogroups each block of anchors
with each block of rows. A block of rows is indexed by coordinate: coordinates are ordered by
their weight, of each row the light ones are left out as long as their norm times the
largest anchor's cannot reach the least threshold, and rows are ordered by what is left out, so
that the postings of a coordinate are the first rows of the block. Partial scores are added up from the
heaviest coordinates on; a pair goes as soon as its partial score and the product of the
remaining norms cannot reach the anchor's threshold; what survives gets its left-out
coordinates from the rows themselves. A block emits at most its best few rows of each window,
so copies of one vector, however many, cannot make a result or a group grow.

Scores are exact integers. Rows with a null label, a null vector or any null or non-finite component
take no part. Vectors of different lengths count as filled up with zeros; an empty one
scores zero. A null vec_id is no anchor, stands last among ties and is no multiple of
anything. Rows that share a vec_id are different rows; each that is an anchor gets its own
rows in the result. Vectors so long that a score might not fit a long (norms over 2**31) raise an error. An
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_dir

ANCHOR_EVERY, RELABELLED_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of its positive's.
LOW, HIGH = 30, 90
#: Rows and anchors of a block.
ROWS, ANCHORS = 8192, 1024
#: Thresholds for positives, as shares of the largest score an anchor could have; for
#: negatives, in hundredths of the positive's score (the window's own end comes last).
SHARES, HUNDREDTHS = (0.6, 0.35, 0.15, 0.0), (60, LOW)
#: Coordinates added up between two looks at the bounds, and anchors at a time.
STRIDE, SLICE = 8, 64
#: Once fewer pairs than this share are left, they are followed one by one.
DENSE = 0.25
LARGEST = float(1 << 31)
FOUND = "uid long, window int, other_id long, score long"


def prepared(rows: DataFrame) -> DataFrame:
    """uid, vec_id, label, q, norm of the rows that take part, labels partly moved on."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % RELABELLED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    q = F.transform(x, lambda v: F.floor(v * 256).cast("double"))
    out = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), q.alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v))
    return out.withColumns({"norm": norm, "uid": F.monotonically_increasing_id()})


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    if len(column):
        at = np.repeat(np.arange(len(column)), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[at, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _rests(x: np.ndarray) -> np.ndarray:
    """For each row and k the norm of its coordinates from k on, rounded up."""
    squares = np.concatenate([(x**2)[:, ::-1], np.zeros((len(x), 1))], axis=1)
    squares = np.concatenate([np.zeros((len(x), 1)), np.cumsum(squares[:, :-1], axis=1)], axis=1)
    return np.sqrt(squares[:, ::-1]) * (1 + 1e-9)


class BlockIndex:
    """The rows of a block, ready for joins at thresholds of `least` or more with anchors
    whose norm is at most `largest`."""

    def __init__(self, rows: np.ndarray, largest: float, least: float) -> None:
        self.width = rows.shape[1]
        self.order = np.argsort(-(rows**2).sum(axis=0), kind="stable")  # heaviest coordinate first
        x = rows[:, self.order]
        rest = _rests(x)
        indexed = (rest * largest + 1e-6 >= least).sum(axis=1)  # 0: not even the whole vector can reach it
        indexed = np.where(indexed > 0, np.minimum(-(-indexed // STRIDE) * STRIDE, self.width), -1)
        self.places = np.argsort(-indexed, kind="stable")[: int((indexed >= 0).sum())]
        self.x, self.rest, self.indexed = x[self.places], rest[self.places], indexed[self.places]
        #: Coordinates added up, a measure of the work.
        self.touched = 0

    def search(self, anchors: np.ndarray, thresholds: np.ndarray, exact: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is at least the anchor's threshold."""
        x = self.x.astype(exact, copy=False)
        found = [(np.zeros(0, np.int64),) * 3]
        for a in range(0, len(anchors), SLICE):
            i, j, score = self._slice(anchors[a : a + SLICE][:, self.order], x, thresholds[a : a + SLICE], exact)
            found.append((i + a, self.places[j], score.astype(np.int64)))
        return tuple(np.concatenate(parts) for parts in zip(*found))

    def _slice(self, anchors: np.ndarray, x: np.ndarray, thresholds: np.ndarray, exact: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, a, least = _rests(anchors), anchors.astype(exact), thresholds[:, None]
        score, end, share = np.zeros((len(a), len(x)), dtype=exact), 0, 1.0
        while end < self.width and share > DENSE:  # along the postings
            k, end = end, min(end + STRIDE, self.width)
            posted = int(np.searchsorted(-self.indexed, -k, side="left"))  # rows indexed beyond k
            score[:, :posted] += a[:, k:end] @ x[:posted, k:end].T
            self.touched += posted * len(a) * (end - k)
            done = np.minimum(self.indexed, end)
            alive = score + rest[:, done] * self.rest[np.arange(len(x)), done] + 1e-6 >= least
            share = alive.mean() if alive.size else 0.0
        i, j = np.nonzero(alive if end else score >= least)
        score, done = score[i, j], np.minimum(self.indexed[j], end)
        for k in range(int(done.min(initial=self.width)), self.width, STRIDE):  # pair by pair
            end, on = min(k + STRIDE, self.width), done <= k
            score[on] += np.einsum("ij,ij->i", a[i[on], k:end], x[j[on], k:end])
            self.touched += int(on.sum()) * (end - k)
            done = np.where(on, end, done)
            keep = score + rest[i, done] * self.rest[j, done] + 1e-6 >= thresholds[i]
            i, j, score, done = i[keep], j[keep], score[keep], done[keep]
        good = score >= thresholds[i]
        return i[good], j[good], score[good]


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each group, by falling score, then id, unknown ids last."""
    order = np.lexsort((ids, ~known, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < most]


def _block_join(same: bool, width: int):
    """The cogroup function: rows of a block against anchors of a block, whose windows are
    (window, low, high) lists; what it emits are the first of each window."""

    def join(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        empty = pa.table({"uid": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "other_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not rows.num_rows or not anchors.num_rows:
            return empty
        x, a = _matrix(rows["q"], width), _matrix(anchors["q"], width)
        row_label, label = rows["label"].to_numpy(), anchors["label"].to_numpy()
        row_uid, uid = rows["uid"].to_numpy(), anchors["uid"].to_numpy()
        known = rows["vec_id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        ids = rows["vec_id"].combine_chunks().fill_null(0).to_numpy()
        windows = anchors["windows"].combine_chunks()
        spots, flat = windows.offsets.to_numpy(), windows.flatten()
        number, low, high = (flat.field(f).to_numpy() for f in ("window", "low", "high"))
        of = np.repeat(np.arange(len(a)), np.diff(spots))
        thresholds = np.full(len(a), np.inf)
        np.minimum.at(thresholds, of, low.astype(float))
        norms = float(np.sqrt((a**2).sum(axis=1)).max() * np.sqrt((x**2).sum(axis=1)).max())
        exact = np.float64 if norms < 1 << 52 else np.int64
        out = [[], [], [], []]
        for part in np.unique(label):
            mine = np.flatnonzero(label == part)
            take = np.flatnonzero((row_label == part) == same)
            if not len(take):
                continue
            index = BlockIndex(x[take], float(np.sqrt((a[mine] ** 2).sum(axis=1)).max()), float(thresholds[mine].min()))
            i, j, score = index.search(a[mine], thresholds[mine], exact)
            i, j = mine[i], take[j]
            other = uid[i] != row_uid[j]
            i, j, score = i[other], j[other], score[other]
            for w in range(int(np.diff(spots)[mine].max(initial=0))):
                has = spots[i] + w < spots[i + 1]
                at = np.where(has, spots[i] + w, 0)
                fit = np.flatnonzero(has & (score >= low[at]) & (score <= high[at]))
                first = fit[first_of_each(i[fit], score[fit], ids[j[fit]], known[j[fit]], POSITIVES if same else NEGATIVES)]
                for c, v in zip(out, (uid[i[first]], number[at[first]], pa.array(ids[j[first]], mask=~known[j[first]]), score[first])):
                    c.append(v)
        if not out[0]:
            return empty
        return pa.table({"uid": np.concatenate(out[0]), "window": pa.array(np.concatenate(out[1]), pa.int32()), "other_id": pa.chunked_array(out[2], pa.int64()), "score": np.concatenate(out[3])})

    return join


def threshold_join(rows: DataFrame, anchors: DataFrame, same: bool, width: int, blocks: int, chunks: int, most: int) -> DataFrame:
    """For each window (uid, label, q, windows) of the anchors its first `most` rows of the same
    label, or of other labels: uid, window, other_id, score, rank."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    left = rows.select("uid", "vec_id", "label", "q", dealt(blocks).alias("block"), spread(chunks).alias("chunk"))
    right = anchors.select("uid", "label", "q", "windows", dealt(chunks).alias("chunk"), spread(blocks).alias("block"))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_block_join(same, width), FOUND)
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _with_thresholds(anchors: DataFrame, low: Callable[[Column], Column]) -> DataFrame:
    """The anchors with the threshold of this round in each of their windows."""
    names = ("window", "high", "end")
    return anchors.withColumn("windows", F.transform("windows", lambda w: F.struct(*[w[n].alias(n) for n in names], F.greatest(low(w), w["end"]).cast("long").alias("low"))))


def filled(rows: DataFrame, anchors: DataFrame, same: bool, width: int, blocks: int, most: int, lows: list[Callable[[Column], Column]]) -> DataFrame:
    """Threshold joins at falling thresholds: those windows are asked again that are not full.
    `anchors` has uid, label, q and its windows as (window, high, end), `end` the least
    score that counts; `lows` are functions from a window to a threshold of a round."""
    done, left = [], anchors
    for r, low in enumerate(lows):
        asked = cut(_with_thresholds(left, low), "negatives-asked")
        n = asked.count()
        if not n:
            drop_dir(asked)
            break
        found = cut(threshold_join(rows, asked, same, width, blocks, -(-n // ANCHORS), most), "negatives-found")
        if r == len(lows) - 1:
            done.append(found)
            break
        full = found.groupBy("uid", "window").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("uid", "window")
        # a window whose threshold was its end already cannot get fuller
        window = asked.select("uid", F.explode("windows").alias("w")).select("uid", F.col("w.window").alias("window"), (F.col("w.low") <= F.col("w.end")).alias("ended"), F.col("w").alias("w"))
        state = window.join(full.withColumn("full", F.lit(True)), ["uid", "window"], "left").withColumn("over", F.col("ended") | F.col("full").isNotNull())
        state = cut(state, "negatives-state")
        done.append(found.join(state.where("over").select("uid", "window"), ["uid", "window"]))
        again = state.where("not over").groupBy("uid").agg(F.collect_list(F.struct(F.col("w.window").alias("window"), F.col("w.high").alias("high"), F.col("w.end").alias("end"))).alias("windows"))
        left = anchors.drop("windows").join(again, "uid")
    out = rows.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    for d in done:
        out = out.unionByName(d)
    return out


def mine(rows: DataFrame, anchor_every: int = ANCHOR_EVERY, block_rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    own = cut(prepared(rows), "negatives-rows")
    n, width, largest = own.agg(F.count("*"), F.max(F.size("q")), F.max("norm")).first()
    if n and largest >= LARGEST:
        raise ValueError(f"a vector's norm is {largest:.3g} after scaling: scores might not fit a long")
    n, width, largest, blocks = n or 0, width or 0, largest or 0.0, max(1, -(-(n or 0) // block_rows))
    anchors = own.where(F.col("vec_id") % anchor_every == 0).select("uid", F.col("vec_id").alias("anchor_id"), "label", "q", "norm")
    window = lambda number, high, end: F.struct(number.cast("int").alias("window"), high.cast("long").alias("high"), end.cast("long").alias("end"))
    # negative positives have no negatives, so no score below 0 is asked for
    first = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit((1 << 62)), F.lit(0))))
    # shares of the largest score that an anchor can have
    lows = [lambda w, s=s: F.ceil(F.col("norm") * largest * s) for s in SHARES]
    positives = cut(filled(own, first, True, width, blocks, POSITIVES, lows).select("uid", F.col("rank").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    p = F.col("positive_score")
    whole, rest = F.expr("positive_score div 100"), p % 100  # in whole numbers
    floor, ceil = whole * HIGH + F.floor(rest * HIGH / 100), whole * LOW + F.ceil(rest * LOW / 100)
    asked = positives.groupBy("uid").agg(F.collect_list(window(F.col("window"), floor, ceil)).alias("windows"))
    second = anchors.join(asked, "uid")
    steps = [lambda w, h=h: F.ceil(w["high"] * h / HIGH) for h in HUNDREDTHS]
    negatives = filled(own, second, False, width, blocks, NEGATIVES, steps)
    names = anchors.select("uid", "anchor_id").join(positives, "uid")
    return negatives.join(names, ["uid", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {RELABELLED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}"""
