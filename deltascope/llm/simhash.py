"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of k or fewer differing bits agree up to threshold t_i in some part i, when
sum(t_i + 1) = k + 1 (a part of threshold -1 is not looked at). Correlated bits are
grouped into the same part; unequal thresholds come from dynamic programming over the
candidate counts estimated from the fingerprints' bit statistics; each fingerprint is
indexed by its parts and probes every value in reach of its part; candidates that meet
in a bucket are verified.

Only distinct fingerprints (and, where texts decide, distinct texts) take part. A bucket
emits no pairs but a spanning forest of its links, so that edges grow with the rows; a
large bucket is cut into blocks whose pairs are separate groups, so no task gets it all.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, gather_runs, spans_of
from .components import components
from .textarrays import mix, slices

BITS = 64
#: Fingerprints of a bucket that one group holds of each block.
BLOCK = 1024
#: Bands of a text's shingles, and least hashes in each: two texts of Jaccard similarity s
#: share a band with probability 1 - (1 - s**LEAST)**BANDS, 0.9998 at 0.8.
BANDS, LEAST = 16, 4
#: Candidate checks (some 5 ns each) that cost as much as one probe row (some 2 us).
PROBE = 400.0
ONE = np.uint64(1)


# fingerprints ---------------------------------------------------------------------


def majority(hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Fingerprint of each group of consecutive hashes (edges in `groups`): bit i is set
    if it is in over half of them; an empty group has zero."""
    out = np.zeros(len(groups) - 1, dtype=np.uint64)
    sizes = np.diff(groups)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, groups[:-1][full], axis=0, dtype=np.int32)
    packed = np.packbits(2 * sums > sizes[full, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(packed).view(np.uint64)[:, 0]
    return out


def shingle_hashes(t, i: int, words: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of text i, repeats included: its words joined by
    single spaces, all of them if they are fewer than a shingle has."""
    a, b = int(t.words[i]), int(t.words[i + 1])
    if a == b:
        return []
    starts, ends = t.starts[a:b], t.ends[a:b]
    sizes = ends - starts
    text = t.text[gather_runs(starts, np.minimum(sizes + 1, np.append(np.diff(starts), sizes[-1])))]
    at = spans_of(sizes + 1)
    text = text.copy()
    text[at[1:-1] - 1] = 32
    text = text.tobytes()
    hash64 = xxhash.xxh64_intdigest
    n = max(1, b - a - words + 1)
    begin, stop = at[:n].tolist(), (at[min(words, b - a) :][:n] - 1).tolist()
    return [hash64(text[x:y], 42) for x, y in zip(begin, stop)]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            for lo, hi, t in slices(batch["text"], lower=True):
                all_hashes, sizes = [], []
                for i in range(t.n):
                    h = shingle_hashes(t, i, shingle)
                    all_hashes += h
                    sizes.append(len(h))
                fp = majority(np.array(all_hashes, dtype=np.uint64), spans_of(np.array(sizes)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# parts and thresholds -------------------------------------------------------------


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them bits i and j are both set, over
    all rows (65 x 64 numbers for each partition are added up)."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array(np.append(total.ravel(), n), pa.float64())], names=["cell", "n"])

    rows = prints.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r.cell] = r.n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of equal size (give or take one); each group starts with
    the bit left that is most correlated overall and takes its closest ones."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts, 0, -1):
        size = math.ceil(len(left) / k)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            b = max(left, key=lambda x: (corr[x, own].sum(), -x))
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def reach(width: int, t: int) -> int:
    return sum(math.comb(width, d) for d in range(t + 1))


def closeness(n: int, both: np.ndarray, bits: list[int], t: int) -> float:
    """Estimated share of pairs that differ in at most t of these bits: the bits'
    disagreements as independent (Poisson-binomial), raised by their correlation to that
    of fewer, effective bits."""
    p = np.diag(both)[bits] / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 1)
    q = p[:, None] * (1 - p[None, :]) + p[None, :] * (1 - p[:, None])
    cov = both[np.ix_(bits, bits)] / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1) ** 2
    effective = len(bits) ** 2 / max(corr.sum(), 1)  # participation ratio
    del q
    dist = np.zeros(t + 1)
    dist[0] = 1
    for d in differ:
        dist[1:], dist[0] = dist[1:] * (1 - d) + dist[:-1] * d, dist[0] * (1 - d)
    share = min(1.0, dist.sum())
    return share ** (min(effective, len(bits)) / len(bits))


def thresholds(costs: list[list[float]], k: int) -> tuple[float, list[int]]:
    """Dynamic programming: t_i >= -1 with sum(t_i + 1) = k + 1 of least total cost;
    costs[i][t + 1] is part i's cost at threshold t."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (k + 1)
    for own in costs:
        new: list[tuple[float, list[int]] | None] = [None] * (k + 2)
        for used, held in enumerate(best):
            for step in range(min(len(own), k + 2 - used)) if held else ():
                c = held[0] + own[step]
                if new[used + step] is None or c < new[used + step][0]:
                    new[used + step] = (c, [*held[1], step - 1])
        best = new
    return best[k + 1]


def plan(n: int, both: np.ndarray, k: int, most: int = 7) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost over the numbers of parts; a row that
    is shuffled, sorted and read costs about as much as PROBE checks of a candidate."""
    best = None
    for parts in range(1, min(k + 2, most) + 1):
        groups = group_bits(n, both, parts)
        costs = []
        for g in groups:
            own = [0.0]
            for t in range(k + 1):
                size = reach(len(g), t)
                own.append(n * (size + (t > 0)) * PROBE + 0.5 * n * n * closeness(n, both, g, t) if size <= 5000 else math.inf)
            costs.append(own)
        found = thresholds(costs, k)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [(g, t) for g, t in zip(groups, found[1]) if t >= 0])
    return best[1]


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & ONE) << np.uint64(j)
    return out


def flips(width: int, t: int) -> np.ndarray:
    """Masks of all values in reach: those of 1 to t bits."""
    return np.array([sum(1 << b for b in c) for d in range(1, t + 1) for c in itertools.combinations(range(width), d)], dtype=np.uint64)


# buckets --------------------------------------------------------------------------


def buckets(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """One row for each node, part and value: its own (probe false) and, in a part with a
    threshold above 0, those in reach (probe true)."""
    names = nodes.columns

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                few = batch.slice(a, 2000)
                fp = few["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
                for p, (bits, t) in enumerate(parts):
                    own = part_values(fp, bits)
                    masks = flips(len(bits), t) if t else np.zeros(0, dtype=np.uint64)
                    value = np.concatenate([own, (own[:, None] ^ masks[None, :]).ravel()])
                    rows = np.concatenate([np.arange(len(fp)), np.repeat(np.arange(len(fp)), len(masks))])
                    probe = np.arange(len(value)) >= len(fp)
                    cols = [few[c].take(pa.array(rows)) for c in names]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(value), p), pa.int32()), pa.array(value.view(np.int64)), pa.array(probe)], names=[*names, "part", "value", "probe"])

    schema = nodes.schema.simpleString()[len("struct<") : -1]
    return nodes.mapInArrow(run, schema + ",part:int,value:long,probe:boolean")


def blocked(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Adds the groups (part, value, left, right) that a row belongs to. A bucket of at
    most `block` rows is one group; others are cut into blocks by a hash of the key, and
    every pair of blocks is a group."""
    heavy = rows.groupBy("part", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    heavy = heavy.select("part", "value", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    many = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64(key), many).cast("int")
    out = rows.join(heavy, ["part", "value"], "left").withColumn("_own", own).withColumn("_many", many)
    out = out.withColumn("_other", F.explode(F.expr("sequence(0, _many - 1)")))
    return out.select(*rows.columns, F.least("_own", "_other").alias("left"), F.greatest("_own", "_other").alias("right"))


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def close_pairs(fp: np.ndarray, probe: np.ndarray, k: int):
    """Row pairs of a group within k bits, closest first; one of a pair at least stands
    in the bucket with its own value."""
    own = np.flatnonzero(~probe)
    xs, ys, ds = [], [], []
    for i in range(0, len(own), 256):
        rows = own[i : i + 256]
        d = np.bitwise_count(fp[rows, None] ^ fp[None, :])
        x, y = np.nonzero(d <= k)
        d, x = d[x, y], rows[x]
        keep = probe[y] | (x < y)
        xs.append(x[keep])
        ys.append(y[keep])
        ds.append(d[keep])
    x, y, d = np.concatenate(xs), np.concatenate(ys), np.concatenate(ds)
    order = np.argsort(d, kind="stable")
    return x[order], y[order]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < similarity * len(b):
        return len(a) == len(b)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= similarity * (len(a) + len(b) - common)


def group_edges(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, k: int, sets=None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's rows. With sets, a link also needs
    that Jaccard similarity; pairs already connected need no look."""
    x, y = close_pairs(fp, probe, k)
    forest, out = Forest(len(fp)), []
    for a, b in zip(x.tolist(), y.tolist()):
        if forest.root(a) == forest.root(b):
            continue
        if sets is not None and key[a] != key[b] and not similar(sets[a], sets[b], similarity):
            continue
        forest.join(a, b)
        if key[a] != key[b]:
            out.append((int(key[a]), int(key[b])))
    return out


def _groups(batches, columns: list[str]):
    """Whole groups of a partition sorted by (part, value, left, right), as one slice of
    consecutive rows at a time; a group is bounded by two blocks."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        edge = np.flatnonzero(_changes(held))
        if len(edge):
            yield held.slice(0, int(edge[-1]) + 1)
            held = held.slice(int(edge[-1]) + 1)
    if held is not None and held.num_rows:
        yield held


def _changes(t: pa.Table) -> np.ndarray:
    out = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
    for c in ("part", "value", "left", "right"):
        v = t[c].to_numpy()
        out |= v[1:] != v[:-1]
    return out


def link(rows: DataFrame, parts: int, k: int, similarity: float | None = None) -> DataFrame:
    """Edges (a, b) of keys, from the rows of `blocked`; with a similarity, rows carry
    `sketch`, a binary of sorted 64-bit shingle hashes."""
    names = ["key", "fp", "probe"] + (["sketch"] if similarity is not None else [])

    def run(batches):
        for t in _groups(batches, names):
            edges = spans_of(np.diff(np.concatenate([[-1], np.flatnonzero(_changes(t)), [t.num_rows - 1]])))
            key, fp, probe = t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["probe"].to_numpy()
            out = []
            sizes = np.diff(edges)
            for g in np.flatnonzero(sizes > 1).tolist():
                a, b = int(edges[g]), int(edges[g + 1])
                if probe[a:b].all():
                    continue
                if b - a == 2 and int(fp[a] ^ fp[a + 1]).bit_count() > k:
                    continue
                sets = None
                if similarity is not None:
                    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t["sketch"].slice(a, b - a)]
                out += group_edges(key[a:b], fp[a:b], probe[a:b], k, sets, similarity or 0.0)
            if out:
                cols = np.array(out, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["a", "b"])

    order = ["part", "value", "left", "right"]
    dealt = rows.select(*order, *names).repartition(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long")


def partners(rows: DataFrame, parts: int, k: int) -> DataFrame:
    """The rows of `blocked` that have another within k bits in their group."""
    order = ["part", "value", "left", "right"]
    names = [*order, "key", "fp", "probe"]

    def run(batches):
        for t in _groups(batches, names):
            edges = spans_of(np.diff(np.concatenate([[-1], np.flatnonzero(_changes(t)), [t.num_rows - 1]])))
            fp, probe = t["fp"].to_numpy().view(np.uint64), t["probe"].to_numpy()
            hit = np.zeros(t.num_rows, dtype=bool)
            for g in np.flatnonzero(np.diff(edges) > 1).tolist():
                a, b = int(edges[g]), int(edges[g + 1])
                if not probe[a:b].all():
                    x, y = close_pairs(fp[a:b], probe[a:b], k)
                    hit[a + x] = hit[a + y] = True
            if hit.any():
                yield from t.filter(pa.array(hit)).to_batches()

    schema = "part int, value long, left int, right int, key long, fp long, probe boolean"
    return rows.select(*names).repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def passages(words: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, text after text, and where each text's begin
    (and the end); a text of fewer words has one shingle of them all."""
    n = np.diff(bounds)
    counts = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    at = spans_of(counts)
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    factors = np.random.default_rng(17).integers(0, 1 << 63, shingle, dtype=np.uint64) | ONE
    for size in range(1, shingle + 1):
        these = np.flatnonzero(n == size if size < shingle else n >= size)
        if len(these):
            starts = gather_runs(bounds[:-1][these], counts[these])
            out[gather_runs(at[:-1][these], counts[these])] = sum(mix(words[starts + j] * factors[j]) for j in range(size))
    return out, at


def band_values(hashes: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """For each text a list of BANDS values, each a hash of the least of its shingles in
    LEAST orders; an empty list if it has no words."""
    full = np.flatnonzero(np.diff(at))
    factors = np.random.default_rng(23).integers(0, 1 << 63, (BANDS, LEAST), dtype=np.uint64) | ONE
    out = np.zeros((len(full), BANDS), dtype=np.uint64)
    for i, j in np.ndindex(factors.shape) if len(full) else ():
        out[:, i] = mix(out[:, i] ^ np.minimum.reduceat(hashes * factors[i, j], at[:-1][full]))
    offsets = spans_of(np.where(np.diff(at) > 0, BANDS, 0)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))


def text_keys(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order, zero if it has none."""
    n = np.diff(bounds)
    key = np.zeros(len(n), dtype=np.uint64)
    if len(words):
        place = (np.arange(len(words)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
        full = np.flatnonzero(n)
        key[full] = np.add.reduceat(mix(words ^ mix(place + np.uint64(1))), bounds[:-1][full]) + n[full].astype(np.uint64)
    return key


def set_prints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, key (a hash of the text's words in order), fp (of its distinct words, A-Z
    in lower case), the bands of its shingles and how many it has."""

    def run(batches):
        for batch in batches:
            for lo, hi, t in slices(batch["text"], lower=True):
                words, n = t.word_hashes(), np.diff(t.words)
                of = np.repeat(np.arange(t.n), n)
                order = np.lexsort((words, of))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
                distinct = words[order][new]
                fp = majority(distinct, spans_of(np.bincount(of[order][new], minlength=t.n)))
                key = text_keys(words, t.words)
                hashes, at = passages(words, t.words, shingle)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), band_values(hashes, at), pa.array(np.diff(at))], names=["doc_id", "key", "fp", "bands", "shingles"])

    return docs.mapInArrow(run, "doc_id long, key long, fp long, bands array<long>, shingles long")


def sketches(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """key (of set_prints) and sketch: the distinct shingles' hashes, of all words if they
    are fewer."""

    def run(batches):
        for batch in batches:
            for _, _, t in slices(batch["text"], lower=True):
                words = t.word_hashes()
                hashes, at = passages(words, t.words, shingle)
                found = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(text_keys(words, t.words).view(np.int64)), pa.array(found, pa.binary())], names=["key", "sketch"])

    return rows.select("text").mapInArrow(run, "key long, sketch binary")


def with_keys(docs: DataFrame, name: str) -> DataFrame:
    """The rows with the key of set_prints of their text as a last column."""

    def run(batches):
        for batch in batches:
            text = batch["text"].cast(pa.string())
            for lo, hi, t in slices(text, lower=True):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text_keys(t.word_hashes(), t.words).view(np.int64))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def drop_near_copies(docs: DataFrame, k: int = 6, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; all
    columns. Texts with the same words in order are copies; others are linked if their
    sets of shingles of five words have a Jaccard similarity of at least 0.8, checked on
    whole texts. Those are looked at whose fingerprints over distinct words differ in at
    most k bits and, for copies cut short, extended or with a block put in, those that
    share a band of shingles.

    Links are made among distinct texts only, first by fingerprint; only texts that have
    a partner there bring their shingles, once for each bucket in which they have one.
    Then bands link the groups found so far, and only texts that share a band with one of
    another group bring their shingles.
    Nulls are empty texts; texts without words are copies of each other; rows that share
    a doc_id but not their text stay or go each by its own text, and rows of a group that
    have the smallest doc_id stay; rows whose doc_id is null stay; repeated rows stay or go
    together; texts are compared whole, however long; an empty table gives no rows; columns
    may have any names.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(set_prints(slim, shingle), "copies")
    classes = cut(prints.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.max("shingles").alias("shingles")), "copies-classes")

    def dealt(rows: DataFrame) -> int:
        """Partitions for rows that bring their shingles."""
        all_ = rows.select("key").join(classes.select("key", "shingles"), "key").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles")).first()
        return shuffle_parts(all_.n, 8 * (all_.shingles or 0))

    def sketched(keys: DataFrame) -> DataFrame:
        ids = classes.join(keys.distinct(), "key", "left_semi").select(F.col("first").alias("doc_id")).distinct()
        # a doc_id may stand for several texts: each has its own key, and equal keys have equal sketches
        found = sketches(slim.join(ids, "doc_id", "left_semi"), shingle)
        return found.groupBy("key").agg(F.max_by("sketch", F.octet_length("sketch")).alias("sketch"))

    nodes = classes.select("key", "fp")
    n, both = bit_statistics(nodes)
    p = plan(n, both, k)
    spread = shuffle_parts(n * sum(1 + len(flips(len(b), t)) for b, t in p))
    near = cut(partners(blocked(buckets(nodes, p), "key"), spread, k), "copies-partners")
    edges = cut(link(near.join(sketched(near.select("key")), "key"), dealt(near), k, similarity), "copies-edges")
    tree = components(edges)
    rooted = classes.join(tree.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = cut(rooted.select("key", "fp", "first", "root", "bands"), "copies-roots")
    met = cut(band_partners(rooted), "copies-bands")
    # the link is between groups: a row counts as its group's, its own shingles are compared
    looked = cut(blocked(met, "key"), "copies-met")
    held = looked.join(sketched(met.select("key")), "key").withColumn("key", F.col("root"))
    joined = components(cut(link(held, dealt(looked), BITS, similarity), "copies-band-edges"))
    named = rooted.join(joined.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left").select("key", "first", F.coalesce("whole", "root").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("winner"))
    final = cut(named.join(best, "root").select("key", "winner"), "copies-winners")
    judged = prints.select("doc_id", "key").join(final, "key").where("doc_id is not null").withColumn("goes", F.col("doc_id") != F.col("winner"))

    def free(name: str) -> str:
        """An inner column's name that no column of the documents has."""
        return name if name not in docs.columns else free(name + "_")

    id_, key_, gone_ = map(free, ("_id", "_key", "_gone"))
    per_id = judged.groupBy(F.col("doc_id").alias(id_)).agg(F.bool_and("goes").alias("all_"), F.bool_or("goes").alias("some_"))
    gone = cut(per_id.where("some_"), "copies-gone")
    whole, mixed = gone.where("all_").select(id_), gone.where("not all_").select(id_)
    own = docs["doc_id"].cast("long")
    if mixed.isEmpty():
        return docs.join(whole, own == F.col(id_), "left_anti")
    # ids of which one text goes and another stays: the row's own text decides
    keyed = with_keys(docs.join(mixed, own == F.col(id_), "left_semi"), key_)
    texts = judged.where("goes").select(F.col("doc_id").alias(id_), F.col("key").alias(gone_)).join(mixed, id_).distinct()
    stay = keyed.join(texts, (keyed["doc_id"].cast("long") == F.col(id_)) & (F.col(key_) == F.col(gone_)), "left_anti").drop(key_)
    return docs.join(gone.select(id_), own == F.col(id_), "left_anti").unionByName(stay)


def band_partners(rooted: DataFrame) -> DataFrame:
    """part, value, key, root, fp and probe (false) of the texts that share a band with a
    text of another root; buckets within one root have nothing to link, and of buckets that hold
    the same texts one is enough."""
    rows = rooted.where("first is not null").select("key", "root", "fp", F.lit(False).alias("probe"), F.posexplode("bands").alias("part", "value"))
    held = [F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("texts")]
    several = rows.groupBy("part", "value").agg(F.min("root").alias("a"), F.max("root").alias("b"), *held).where("a < b")
    one = several.groupBy("a", "b", "n", "texts").agg(F.min(F.struct("part", "value")).alias("one")).select("one.*")
    return rows.join(one, ["part", "value"], "left_semi")


def shuffle_parts(rows: int, size: int = 0) -> int:
    """Partitions of at most about 200,000 rows and 16 MB."""
    return max(8, math.ceil(rows / 200_000), math.ceil(size / (16 << 20)))


def near_duplicates(docs: DataFrame, shingle: int = 3, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id
    that links of at most k bits reach.

    A null text is empty; texts without words have fingerprint zero, linked like any
    other; rows that share a doc_id are separate rows with their own fingerprint; null
    doc_ids never are a component's name unless it has no other; an empty table gives no
    rows. A text is fingerprinted whole by one task, whatever its length. Columns besides
    doc_id and text are not read.
    """
    prints = cut(fingerprints(docs, shingle), "simhash")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    nodes = classes.select(F.col("fp").alias("key"), "fp")
    n, both = bit_statistics(nodes)
    edges = cut(link(blocked(buckets(nodes, p := plan(n, both, k)), "key"), shuffle_parts(n * sum(1 + len(flips(len(b), t)) for b, t in p)), k), "simhash-edges")
    tree = components(edges)
    linked = tree.join(classes.withColumnRenamed("fp", "node"), "node")
    names = linked.groupBy("root").agg(F.min("first").alias("component"))
    names = linked.join(names, "root").select(F.col("node").alias("fp"), "component")
    own = classes.join(names, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    own = cut(own, "simhash-names")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(own, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
