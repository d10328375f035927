"""Benchmark decontamination: passages of training texts query a BM25 index of test items.

Index: shards of at most about SHARD_WORDS words of items of like length, built by Spark; for
each term the postings (item, weight) in item order with the term's greatest weight, and for
each block of BLOCK items in which it occurs the greatest weight there. Both are lists: what
an index takes grows with its postings. A weight is the BM25 term score as a share of the
item's score for its own text, so that 1 is a full match and one threshold fits items of any
length.

Query: every text is cut into passages of two segments that overlap by one; a segment is as
long as the shard's longest item. Block maxima are added up for all passages of a slice at
once, the terms with the longest lists by their greatest weight only; a passage without a
block that can reach the threshold is done. The others go through block-max WAND, document
at a time over the whole shard: a pivot where the terms' greatest weights reach the
threshold, a look at the maxima of the pivot's block, and a jump beyond it where they do
not. It retrieves all items above the threshold. A retrieved item is a leak if its question
and its answer are each covered to OVERLAP by five-word shingles that the passage has too.

All shards are carried in one pass over the texts, as long as their measured size stays
within PASS_BYTES; each further PASS_BYTES of indexes take one more pass.

An item's answer is what follows its last sentence end, or the last quarter of its words
if it is one sentence. Items without words match nothing; nulls are empty texts; texts are
searched whole, however long; rows that share an id are judged by themselves; of the
passages of a text that hold an item, the one of greatest score counts (then of greatest
overlap); empty tables give no rows. item_id may be of any type that a string can be cast
to; `find_leaks` reads no other columns, `drop_leaks` keeps all, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_dir, gather_runs, spans_of
from .textarrays import NO_WORD, Texts, mix, slices

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
BLOCK, SHARD_WORDS = 2, 1_000_000
#: Items of fewer than 2 ** LEAST_SCALE words share shards, longer ones by power of two.
LEAST_SCALE = 7
#: Bytes of indexes that one pass over the texts carries to every executor, at most.
PASS_BYTES = 128 << 20
#: Share of the threshold that a segment's terms with the longest lists may reach by their
#: greatest weights, without a look at their blocks.
UNLISTED = 0.05
SENTENCE_END = re.compile(r"[.?!:\n]+\s+(?=\S)")
_MULTIPLIERS = np.random.default_rng(13).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return Texts(raw, np.array([0, len(raw)]), True, NO_WORD).word_hashes()


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the shingle at each place; of all words if they are fewer."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return mix(words[None, :] * _MULTIPLIERS[: len(words)]).sum(axis=1, dtype=np.uint64) if len(words) else words
    return sum(mix(words[j : j + n] * _MULTIPLIERS[j]) for j in range(SHINGLE))


def answer_from(text: str, words: np.ndarray) -> int:
    """Number of the first word of the answer."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    for e in reversed(ends):
        n = len(words_of(text[e:]))
        if 0 < n < len(words):
            return len(words) - n
    return len(words) - max(1, len(words) // 4)


class Index:
    """One shard: terms sorted by hash; postings of term t in places at[t] : at[t + 1]."""

    def __init__(self, ids: list, texts: list[str], df: dict[int, int], n_items: int, mean_length: float):
        docs = [words_of(t or "") for t in texts]
        # items with the same common words side by side: block maxima are then tighter
        order = sorted((i for i, w in enumerate(docs) if len(w)), key=lambda i: sorted(set(docs[i].tolist()), key=lambda h: (-df[h], h))[:3])
        self.ids = [ids[i] for i in order]
        docs = [docs[i] for i in order]
        self.words = docs
        self.answer = [answer_from(texts[i] or "", w) for i, w in zip(order, docs)]
        self.longest = max(map(len, docs), default=1)
        rows = []
        for d, w in enumerate(docs):
            terms, tf = np.unique(w, return_counts=True)
            idf = np.array([math.log(1 + (n_items - df[h] + 0.5) / (df[h] + 0.5)) for h in terms.tolist()])
            s = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_length))
            rows.append((terms, np.full(len(terms), d), s / s.sum()))
        terms, items, weights = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        by = np.lexsort((items, terms))
        self.terms, first = np.unique(terms[by], return_index=True)
        self.at = np.append(first, len(by))
        self.items, self.weights = items[by].astype(np.int32), weights[by]
        self.n_blocks = -(-len(docs) // BLOCK)
        term_of = np.repeat(np.arange(len(self.terms)), np.diff(self.at))
        #: the blocks of term t in places block_at[t] : block_at[t + 1], and its greatest weights
        new = np.ones(len(by), dtype=bool)
        new[1:] = (term_of[1:] != term_of[:-1]) | (self.items[1:] // BLOCK != self.items[:-1] // BLOCK)
        edges = np.flatnonzero(new)
        self.blocks = (self.items[edges] // BLOCK).astype(np.int32)
        self.block_at = np.searchsorted(term_of[edges], np.arange(len(self.terms) + 1))
        up = np.float32(1 + 1e-6)  # maxima round up
        self.block_max = (np.maximum.reduceat(self.weights, edges) if len(edges) else self.weights).astype(np.float32) * up
        self.most = (np.maximum.reduceat(self.weights, first) if len(first) else self.weights).astype(np.float32) * up
        near = np.zeros(1 << 16, dtype=bool)
        near[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        self.near = near

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their term numbers."""
        maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        k = np.searchsorted(self.terms, hashes[maybe])
        k[k == len(self.terms)] = 0
        hit = self.terms[k] == hashes[maybe] if len(self.terms) else np.zeros(0, bool)
        return maybe[hit], k[hit]

    def search(self, terms: np.ndarray, blocks: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose weights for these distinct terms sum up to the
        threshold, with their scores. `blocks`: in order, those that can hold such items."""
        items, out, least = self.items, [], threshold - 1e-6

        def seek(cursor: list, item: int) -> bool:
            cursor[1] = bisect_left(items, item, cursor[1], cursor[2])
            if cursor[1] < cursor[2]:
                cursor[0] = int(items[cursor[1]])
                return True
            return False

        def maximum(term: int, block: int) -> float:
            a, b = self.block_at[term], self.block_at[term + 1]
            k = bisect_left(self.blocks, block, a, b)
            return float(self.block_max[k]) if k < b and self.blocks[k] == block else 0.0

        # cursors: [item, place, end, greatest weight, term]
        cursors = [[0, int(self.at[t]), int(self.at[t + 1]), float(self.most[t]), t] for t in terms.tolist()]
        target = blocks[0] * BLOCK
        cursors = [c for c in cursors if seek(c, target)]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            k = bisect_left(blocks, block)
            if k == len(blocks):
                break
            if blocks[k] != block:
                target = blocks[k] * BLOCK
            elif sum(maximum(c[4], block) for c in cursors[: pivot + 1]) < least:
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):  # before that, more terms join
                    target = min(target, cursors[pivot + 1][0])
            elif cursors[0][0] == item:
                score = float(sum(self.weights[c[1]] for c in cursors[: pivot + 1]))
                if score >= threshold - 1e-9:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
            cursors = [c for c in cursors if c[0] >= target or seek(c, target)]
        return out

    def passages(self, t: Texts, hashes: np.ndarray, segment: int, threshold: float):
        """(text, first word, last word, terms, blocks) of the passages that may match and
        the blocks they may match in."""
        place, code = self.codes(hashes)
        if not len(place):
            return
        text = np.searchsorted(t.words, place, side="right") - 1
        per_text = -(-np.diff(t.words) // segment)
        base = spans_of(per_text)
        seg = base[text] + (place - t.words[text]) // segment
        key = np.unique(seg * len(self.terms) + code)
        seg, code = key // len(self.terms), key % len(self.terms)
        # terms with the longest lists first, as long as their greatest weights are small
        listed = np.diff(self.block_at)[code]
        order = np.lexsort((-listed, seg))
        most = self.most[code[order]].astype(np.float64)
        edges = np.flatnonzero(np.diff(seg, prepend=-1))
        sums = np.cumsum(most)
        sums -= np.repeat(sums[edges] - most[edges], np.diff(edges, append=len(seg)))
        unlisted = sums <= UNLISTED * threshold
        rest = np.bincount(seg[order][unlisted], most[unlisted], int(base[-1]) + 1)
        of = order[~unlisted]
        at = gather_runs(self.block_at[code[of]], listed[of])
        cell, bound = self._added(np.repeat(seg[of], listed[of]) * self.n_blocks + self.blocks[at], self.block_max[at].astype(np.float64))
        # a segment counts for the passage it begins and for the one before
        begins = np.zeros(int(base[-1]) + 1, dtype=bool)
        begins[base[:-1]] = True
        two = ~begins[cell // self.n_blocks]
        cell, bound = self._added(np.concatenate([cell, cell[two] - self.n_blocks]), np.concatenate([bound, bound[two]]))
        p = cell // self.n_blocks
        follows = ~begins[p + 1] & (p + 1 < base[-1])
        able = bound + rest[p] + np.where(follows, rest[p + 1], 0.0) >= threshold - 1e-5
        p, block, follows = p[able], (cell % self.n_blocks)[able], follows[able]
        first_at = np.searchsorted(seg, np.arange(int(base[-1]) + 2))
        owner = np.repeat(np.arange(t.n), per_text)
        edges = np.flatnonzero(np.diff(p, prepend=-1))
        for x, y in zip(edges.tolist(), np.append(edges[1:], len(p)).tolist()):
            s = int(p[x])
            i = int(owner[s])
            a = int(t.words[i]) + (s - int(base[i])) * segment
            yield i, a, min(a + 2 * segment, int(t.words[i + 1])), np.unique(code[first_at[s] : first_at[s + 2 if follows[x] else s + 1]]), block[x:y].tolist()

    @staticmethod
    def _added(cell: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells in order, and the sum of the values of each."""
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        edges = np.flatnonzero(np.diff(cell, prepend=-1))
        return cell[edges], np.add.reduceat(value[order], edges) if len(edges) else value

    def overlap(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's words that shared shingles cover."""
        own = self.words[item]
        size = min(SHINGLE, len(own))
        if len(own) < SHINGLE:  # a short item must occur as a whole
            n = len(words) - size + 1
            there = any((words[k : k + size] == own).all() for k in range(max(n, 0)))
            return float(there), float(there)
        hit = np.isin(shingles(own), shingles(words) if len(words) >= SHINGLE else np.zeros(0, np.uint64))
        covered = np.zeros(len(own), dtype=bool)
        for j in range(size):
            covered[j : j + len(hit)] |= hit
        a = self.answer[item]
        return float(covered[:a].mean()) if a else 1.0, float(covered[a:].mean())


def term_statistics(items: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, df) over all items, the number of items with words and their mean length."""

    def run(batches):
        for batch in batches:
            for text in batch["text"].to_pylist():
                w = words_of(text or "")
                if len(w):
                    terms = np.unique(w)
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.append(len(w), np.zeros(len(terms) - 1, np.int64)))], names=["term", "length"])

    rows = items.mapInArrow(run, "term long, length long")
    total = rows.agg(F.count_if(F.col("length") > 0).alias("n"), F.sum("length").alias("words")).first()
    return rows.groupBy("term").agg(F.count("*").alias("df")), total.n or 0, (total.words or 0) / max(total.n or 0, 1)


def shard_indexes(items: DataFrame) -> DataFrame:
    """(shard, data): a pickled Index each. A shard holds items of like length (below
    2 ** LEAST_SCALE words, else within a power of two), of about SHARD_WORDS words at most, and gets its items' terms with their
    counts over all items, not the whole vocabulary."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    df, n, mean = term_statistics(items)

    def sized(batches):
        for batch in batches:
            words = [len(words_of(text or "")) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([max(LEAST_SCALE, w.bit_length()) for w in words], pa.int32()), pa.array(words, pa.int64())], names=["item_id", "text", "scale", "words"])

    with_words = items.mapInArrow(sized, "item_id string, text string, scale int, words long")
    scales = with_words.groupBy("scale").agg(F.sum("words").alias("words")).collect()  # one row a power of two
    shards = {r.scale: max(1, math.ceil(r.words / SHARD_WORDS)) for r in scales} or {0: 1}
    many = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("scale"))
    placed = with_words.withColumn("shard", F.col("scale").cast("long") * (1 << 32) + F.pmod(F.xxhash64("item_id", "text"), many)).select("item_id", "text", "shard")

    def terms(batches):
        for batch in batches:
            for s, text in zip(batch["shard"].to_pylist(), batch["text"].to_pylist()):
                found = np.unique(words_of(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), s), pa.int64()), pa.array(found.view(np.int64))], names=["shard", "term"])

    own = placed.mapInArrow(terms, "shard long, term long").distinct().join(df, "term")

    def build(key, left: pa.Table, right: pa.Table) -> pa.Table:
        counts = dict(zip(right["term"].to_numpy().view(np.uint64).tolist(), right["df"].to_pylist()))
        index = Index(left["item_id"].to_pylist(), left["text"].to_pylist(), counts, n, mean)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([pickle.dumps(index)], pa.binary())})

    return placed.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(build, "shard long, data binary")


def leaks_in(batch_texts: Texts, indexes: list[Index], threshold: float, overlap: float):
    """(text, item_id, score, question and answer overlap) of all leaks, the best passage
    of each pair."""
    hashes = batch_texts.word_hashes()
    for index in indexes:
        segment, best = max(32, index.longest), {}
        if not index.ids:
            continue
        for i, a, b, terms, blocks in index.passages(batch_texts, hashes, segment, threshold):
            for item, score in index.search(terms, blocks, threshold):
                lo, hi = max(int(batch_texts.words[i]), a - segment), min(int(batch_texts.words[i + 1]), b + segment)
                q, r = index.overlap(item, hashes[lo:hi])
                if q >= overlap and r >= overlap:
                    best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), (score, q, r))
        for (i, item), (score, q, r) in sorted(best.items()):
            yield i, index.ids[item], score, q, r


def passes(items: DataFrame):
    """The shards' indexes in groups of PASS_BYTES by their measured sizes, at least one
    shard (of about SHARD_WORDS words) each: what a pass carries is bounded."""
    built = cut(shard_indexes(items), "leaks-index")
    sizes = sorted((r.shard, r.size) for r in built.select("shard", F.octet_length("data").alias("size")).collect())
    groups, room = [], 0
    for shard, size in sizes:
        if size > room or not groups:
            groups.append([])
            room = PASS_BYTES
        groups[-1].append(shard)
        room -= size
    for group in groups:
        yield [pickle.loads(r.data) for r in built.where(F.col("shard").isin(group)).collect()]
    drop_dir(built)


LEAKS = "doc_id long, item_id string, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every leak."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for indexes in passes(items):
        carried = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches, carried=carried):
            for batch in batches:
                for lo, hi, t in slices(batch["text"], lower=True, breaks=NO_WORD):
                    ids = batch["doc_id"].slice(lo, hi - lo).to_pylist()
                    rows = [(ids[i], item, s, q, r) for i, item, s, q, r in leaks_in(t, carried.value, threshold, overlap)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.mapInArrow(run, LEAKS))
    return out.withColumn("item_id", F.col("item_id").cast(kind))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows whose text has no leak, with all columns; each row is judged by its own
    text, so rows that share a doc_id stay or go by themselves, and null and empty texts
    stay. One filter over the rows for each pass."""
    schema = docs.schema
    for indexes in passes(items):
        carried = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches, carried=carried):
            for batch in batches:
                for lo, hi, t in slices(batch["text"], lower=True, breaks=NO_WORD):
                    clean = np.ones(t.n, dtype=bool)
                    clean[[i for i, *_ in leaks_in(t, carried.value, threshold, overlap)]] = False
                    yield batch.slice(lo, hi - lo).take(pa.array(np.flatnonzero(clean)))

        docs = docs.mapInArrow(run, schema)
    return docs
