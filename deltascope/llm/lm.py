"""Language-model scores by deleted interpolation of trigrams, bigrams, unigrams and the
uniform distribution.

P2(w | v)    = a2 c(v,w)/c(v) + a1 c(w)/N + a0/(V+1), weights a by the bucket of c(v)
P3(w | u,v)  = b3 c(u,v,w)/c(u,v) + (1 - b3) P2(w | v), b3 by the bucket of c(u,v)

Buckets are powers of two of the context's frequency. The weights come from
expectation-maximisation on a twentieth of the training texts, held out of the counts while
the weights are learned; the counts that score are those of all training texts.

Texts are put into chunks of about CHUNK bytes. A chunk asks once for each of its distinct
words and word pairs (see keycounts). Then it asks for its word triples, but not for those
of which a pair occurs in no other chunk: all their occurrences are its own, and it has
counted them. So a frequent word is one key a chunk, no group is hot, and what is gathered
grows with the text.

Nulls are empty texts, whose only token is the end; repeated rows are separate texts; texts
of equal score are not told apart; a text is always in one chunk, however long; an empty
table gives no rows; without training texts only the uniform part is left. Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, drop_dir, id_crc, release, shuffles_freed, spans_of
from .keycounts import ASKS, answers, ask, levels, pack, pack_keys, told, unpack, unpack_keys
from .textarrays import mix, slices

FOLDS, HELD_OUT, DEV = 5, 1, 20
CHUNK = 2 << 20
BUCKETS, ROUNDS = 24, 12
END = np.uint64(0x656E64206F662061)
_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_ONE = np.uint64(1)
CHUNKS = "unit long, dev boolean, doc_ids array<long>, sizes binary, train binary, vocab binary, places binary, n_tokens long, n_train long, n_dev long"


def chunks(docs: DataFrame) -> DataFrame:
    """The tokens of all texts, a row for each chunk: its distinct word hashes and each
    token's place among them. A chunk is of texts to learn weights from, or of others."""

    def run(batches):
        from pyspark import TaskContext

        held = {False: [], True: []}
        size, seq = {False: 0, True: 0}, 0

        def flush(dev):
            nonlocal seq
            ids, counts, train, tokens = zip(*held[dev])
            held[dev], size[dev] = [], 0
            counts, train = np.concatenate(counts), np.concatenate(train)
            vocab, places = np.unique(np.concatenate(tokens), return_inverse=True)
            seq += 1
            learned = int(counts[train > 0].sum())
            row = {
                "unit": (TaskContext.get().partitionId() << 24) + seq, "dev": dev, "doc_ids": [i for x in ids for i in x], "sizes": pack(counts), "train": train.tobytes(),
                "vocab": pack_keys(vocab), "places": pack(places), "n_tokens": len(places), "n_train": learned, "n_dev": learned if dev else 0,
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("unit", pa.int64()), ("dev", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "train", "vocab", "places")), *((c, pa.int64()) for c in ("n_tokens", "n_train", "n_dev"))])
        for batch in batches:
            for lo, hi, t in slices(batch["text"], lower=True):
                ids = batch["doc_id"].slice(lo, hi - lo).to_pylist()
                crc = np.array([id_crc(i) for i in ids], dtype=np.int64)
                train = crc % FOLDS != HELD_OUT
                dev = train & (crc // FOLDS % DEV == 0)
                counts = np.diff(t.words)
                tokens = np.full(int(counts.sum()) + t.n, END, dtype=np.uint64)
                tokens[np.arange(len(t.starts)) + np.repeat(np.arange(t.n), counts)] = t.word_hashes()
                edges = spans_of(counts + 1)
                for kind in (False, True):
                    rows = np.flatnonzero(dev == kind)
                    if len(rows):
                        held[kind].append(([ids[i] for i in rows], counts[rows] + 1, train[rows].astype(np.uint8), np.concatenate([tokens[edges[i] : edges[i + 1]] for i in rows])))
                        size[kind] += int(np.diff(t.offsets)[rows].sum())
                        if size[kind] >= CHUNK:
                            yield flush(kind)
        for kind in (False, True):
            if held[kind]:
                yield flush(kind)

    return docs.mapInArrow(run, CHUNKS)


class Tokens:
    """A chunk's tokens; its words and pairs as sorted keys, with each token's place there.
    The lowest bit of a key tells words (1) from pairs (0)."""

    def __init__(self, row: dict):
        self.unit, self.dev, self.doc_ids = row["unit"], row["dev"], row["doc_ids"]
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.edges = spans_of(self.sizes)
        self.first = self.edges[:-1]
        #: whether a token is of a training text
        self.learns = np.repeat(np.frombuffer(row["train"], dtype=np.uint8).astype(bool), self.sizes)
        vocab, places = unpack_keys(row["vocab"]), unpack(row["places"]).astype(np.int32)
        word = vocab[places]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.first] = END
        pair = mix(mix(before + _C2) + word * _C1) & ~_ONE
        keys = np.concatenate([vocab | _ONE, pair])
        self.keys, at = np.unique(keys, return_inverse=True)
        vocab_at = at[: len(vocab)].astype(np.int32)
        self.word, self.pair = vocab_at[places], at[len(vocab) :].astype(np.int32)
        #: a token's context as a place among the keys; every text has an end, so END is there
        end = vocab_at[np.searchsorted(vocab, END)]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[self.first] = end
        #: the pair before a token; a text's first token has none, its triple is its pair
        self.inner = np.ones(len(word), dtype=bool)
        self.inner[self.first] = False
        self.hashes = (pair, word)

    def counts(self) -> np.ndarray:
        """How often each key occurs in the chunk's training texts."""
        n = np.bincount(self.word[self.learns], minlength=len(self.keys))
        return n + np.bincount(self.pair[self.learns], minlength=len(self.keys))

    def triples(self, shared: np.ndarray) -> None:
        """The keys of triples whose pairs both occur in other chunks too (`asked`, with their
        places), and the chunk's own counts of the others (`own` for each token)."""
        pair, word = self.hashes
        at = np.flatnonzero(self.inner)
        key = mix(mix(pair[at - 1] + _C3) + word[at] * _C1)
        outside = shared[self.pair[at]] & shared[self.pair[at - 1]]
        self.asked_at, self.own_at = at[outside], at[~outside]
        self.asked, self.asked_place = np.unique(key[outside], return_inverse=True)
        alone, place = np.unique(key[~outside], return_inverse=True)
        self.own = np.bincount(place[self.learns[self.own_at]], minlength=len(alone))[place]

    def triple_counts(self) -> np.ndarray:
        return np.bincount(self.asked_place[self.learns[self.asked_at]], minlength=len(self.asked))


def frequencies(t: Tokens, rows: list[dict], without_dev: bool) -> tuple[np.ndarray, ...]:
    """For every token: counts of the word, the context, the pair, the pair before and the
    triple over all training texts, or over those that are not held out for the weights."""
    n, held, shared = told([r for r in rows if r["order"] == 2], len(t.keys))
    t.triples(shared)
    n3, held3, _ = told([r for r in rows if r["order"] == 3], len(t.asked))
    own = t.own
    if without_dev:
        n, n3 = n - held, n3 - held3
        own = np.zeros_like(own) if t.dev else own
    c1, cv, c2 = n[t.word], n[t.before], n[t.pair]
    cuv, c3 = cv.copy(), c2.copy()
    inner = np.flatnonzero(t.inner)
    cuv[inner] = c2[inner - 1]
    c3[t.asked_at] = n3[t.asked_place]
    c3[t.own_at] = own
    return c1, cv, c2, cuv, c3


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def learn_weights(table: DataFrame, found: DataFrame, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the bigram, unigram and uniform part by bucket, and of the trigram part by
    bucket, by expectation-maximisation over the tokens held out for it; n: tokens of the
    other training texts. A round brings four sums for each pair of buckets to the driver."""

    def shares(key, left: pa.Table, right: pa.Table) -> pa.Table:
        counts = np.stack(frequencies(Tokens(left.to_pylist()[0]), right.to_pylist(), True))
        (c1, cv, c2, cuv, c3), weight = np.unique(counts, axis=1, return_counts=True)
        ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
        return pa.table({"b3": pa.array(bucket(cuv), pa.int32()), "b2": pa.array(bucket(cv), pa.int32()), "p3": ratio(c3, cuv), "p2": ratio(c2, cv), "p1": c1 / max(n, 1), "w": pa.array(weight, pa.int64())})

    left = table.where("dev")
    right = found.join(left.select("unit"), "unit", "left_semi")
    probs = cut(left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(shares, "b3 int, b2 int, p3 double, p2 double, p1 double, w long"), "lm-heldout")
    low, high = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1)), np.full(BUCKETS, 0.5)
    high[0] = 0.0  # an unseen context has no triples
    for _ in range(ROUNDS):
        of = lambda values, b: F.element_at(F.array(*map(F.lit, values.tolist())), F.col(b) + 1)
        part = [(1 - of(high, "b3")) * of(low[:, k], "b2") * p for k, p in enumerate((F.col("p2"), F.col("p1"), F.lit(1.0 / (v + 1))))]
        part.append(of(high, "b3") * F.col("p3"))
        whole = part[0] + part[1] + part[2] + part[3]
        sums = probs.groupBy("b3", "b2").agg(*[F.sum(F.col("w") * x / whole).alias(f"s{k}") for k, x in enumerate(part)]).collect()
        s2, s3 = np.zeros((BUCKETS, 3)), np.zeros((BUCKETS, 2))
        for r in sums:
            s2[r.b2] += [r.s0, r.s1, r.s2]
            s3[r.b3] += [r.s0 + r.s1 + r.s2, r.s3]
        for b in range(BUCKETS):  # a bucket that no held-out context falls into is as the one below
            s = s2[b] + [0.0, 0.0, 1e-3]
            low[b] = s / s.sum() if s2[b].any() else low[b - 1] if b else low[b]
            high[b] = 0.0 if b == 0 else s3[b][1] / s3[b].sum() if s3[b].any() else high[b - 1] if b > 1 else high[b]
    low[0] = [0.0, low[0][0] + low[0][1], low[0][2]]  # an unseen context has no pairs
    return low, high


def count_keys(table: DataFrame, tokens: int) -> DataFrame:
    """The answers for words and pairs, with the unit's kind."""
    fan, depth = levels(2 * tokens)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t = Tokens(batch.slice(i, 1).to_pylist()[0])
                yield ask(t.unit, t.dev, t.keys, t.counts(), fan)
                del t
            release()

    return answers(table.mapInArrow(run, ASKS), 2 * tokens, fan, depth)


def count_triples(table: DataFrame, found: DataFrame, tokens: int) -> DataFrame:
    """The answers for the triples that a chunk cannot count by itself."""
    fan, depth = levels(tokens)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t, rows = Tokens(left.to_pylist()[0]), right.to_pylist()
        t.triples(told(rows, len(t.keys))[2])
        out = pa.Table.from_batches([ask(t.unit, t.dev, t.asked, t.triple_counts(), fan)])
        del t, rows
        release()
        return out

    asks = table.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(run, ASKS)
    return answers(asks, tokens, fan, depth)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with shuffles_freed(docs.sparkSession):
        return _score(docs)


def _score(docs: DataFrame) -> DataFrame:
    table = cut(chunks(docs), "lm-chunks")
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "n_dev")]).first()
    n = sums.n_train
    pairs = cut(count_keys(table, sums.n_tokens), "lm-pairs")
    triples = cut(count_triples(table, pairs, sums.n_tokens), "lm-triples")
    v = pairs.agg(F.coalesce(F.sum("flagged"), F.lit(0)).alias("v")).first().v
    found = pairs.withColumn("order", F.lit(2)).unionByName(triples.withColumn("order", F.lit(3))).drop("flagged")
    low, high = learn_weights(table, found, n - sums.n_dev, v)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t = Tokens(left.to_pylist()[0])
        c1, cv, c2, cuv, c3 = frequencies(t, right.to_pylist(), False)
        w, h = low[bucket(cv)], high[bucket(cuv)]
        p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
        p = h * c3 / np.maximum(cuv, 1) + (1 - h) * p
        base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
        sums = [np.add.reduceat(x, t.first) for x in ((c1 > 0).astype(np.int64), base, np.log10(p))]
        out = pa.table({"doc_id": pa.array(t.doc_ids, pa.int64()), "n_tokens": pa.array(t.sizes, pa.int64()), "n_known": sums[0], "base_score": sums[1], "score": sums[2]})
        del t, w, h, p, base, c1, cv, c2, cuv, c3
        release()
        return out

    scored = table.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = cut(scored, "lm-scores")
    for used in (table, pairs, triples):
        drop_dir(used)
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
