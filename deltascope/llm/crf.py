"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad, given features of the line and of its neighbours and the state
of the line before. It is trained by gradient ascent on the exact conditional likelihood of
line labels: the document's, but for lines that look by themselves surely of the other kind. A document's score is the length-weighted
mean of its lines' forward-backward marginals, put on the scale of a probability by a
logistic fit on the training documents.

Training takes at most TRAIN_DOCS labelled documents (those whose ids hash lowest, one text
for an id) of at most TRAIN_LINES lines each and TRAIN_TOTAL together, so that the driver's share is bounded; every text
is scored whole, however long. Nulls are empty texts;
an empty text is one empty line and gets a score like any other; repeated rows are scored
alike; of texts that share a doc_id the one of the lowest hash is learned from; equal scores
are left equal; `keep_good` keeps all columns, whatever their names, and each row by its own
text, and all rows where there is no model; an empty table gives no rows; without labels of both kinds the score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, drop_dir, spans_of
from .textarrays import Texts, slices

#: Bounds of the sample that is learned from: labelled documents, lines of one of them, and
#: lines of all of them.
TRAIN_DOCS, TRAIN_LINES, TRAIN_TOTAL = 3000, 5000, 200_000
STEPS = 120
#: How sure a line must look by itself to have another label than its document.
SURE = 0.9
FOLDS, HELD_OUT = 3, 1


def _table(*ranges) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for r in ranges:
        t[list(r)] = True
    return t


_UPPER, _LOWER, _DIGIT = _table(range(65, 91)), _table(range(97, 123)), _table(range(48, 58))
_SYMBOL, _STOP, _COMMA, _BANG, _BAR = _table(b"#*$%&<>=_^~"), _table(b".?"), _table(b",;:"), _table(b"!"), _table(b"|")
_WIDE, _TAIL = _table(range(128, 256)), _table(range(128, 192))


def line_features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with its neighbours, the text of each line, its length."""
    starts, ends, of, hashes = t.lines()
    words = t.word_hashes()
    first, last = np.searchsorted(t.starts, starts), np.searchsorted(t.starts, ends)
    n_words = last - first
    per_word = 1.0 / np.maximum(n_words, 1)

    def count(mask):
        s = spans_of(mask)
        return s[ends] - s[starts]

    raw = t.raw
    chars = count(~_TAIL[raw])
    per_char = 1.0 / np.maximum(chars, 1)
    upper, lower = count(_UPPER[raw]), count(_LOWER[raw])
    # words equal to the one before, and to the one two before
    same = np.zeros((2, len(words) + 1), dtype=np.int64)
    for k in (1, 2):
        if len(words) > k:
            np.cumsum(words[k:] == words[:-k], out=same[k - 1, k + 1 :])
    again = [np.maximum(same[k - 1][last] - same[k - 1][np.minimum(first + k, last)], 0) for k in (1, 2)]
    # distinct words of each line
    line_of = np.repeat(np.arange(len(starts)), n_words)
    inside = words[first[0] : last[-1]] if len(first) else words
    order = np.lexsort((inside, line_of))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (inside[order][1:] != inside[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][new], minlength=len(starts))
    # copies of a line within its text
    order = np.lexsort((hashes, of))
    eq = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    copy = np.zeros(len(starts), dtype=bool)
    copy[order[1:]] |= eq
    copy[order[:-1]] |= eq
    copy &= n_words > 0
    full = ends > starts
    opening = np.where(full, raw[np.minimum(starts, max(len(raw) - 1, 0))], 0) if len(raw) else np.zeros(len(starts), np.uint8)
    closing = np.where(full, raw[np.maximum(ends - 1, 0)], 0) if len(raw) else np.zeros(len(starts), np.uint8)
    own = np.stack(
        [
            np.log1p(n_words),
            np.minimum((chars - count(t.space)) * per_word, 20),
            np.minimum(count(_SYMBOL[raw]) * per_word, 3),
            upper / np.maximum(upper + lower, 1),
            count(_DIGIT[raw]) * per_char,
            np.minimum(count(_BANG[raw]) * per_word, 3),
            np.minimum(count(_BAR[raw]) * per_word, 2),
            np.minimum(count(_STOP[raw]) * per_word, 1),
            np.minimum(count(_COMMA[raw]) * per_word, 1),
            distinct * per_word,
            again[0] * per_word,
            again[1] * per_word,
            copy,
            _UPPER[opening] | _WIDE[opening],
            _STOP[closing],
            n_words == 0,
            np.log1p(n_words) * distinct * per_word,
        ],
        axis=1,
    ).astype(np.float64)
    edge = np.zeros(len(starts), dtype=bool)
    edge[np.searchsorted(of, np.arange(t.n))] = True
    before = np.where(edge[:, None], 0.0, np.roll(own, 1, axis=0))
    final = np.roll(edge, -1)
    after = np.where(final[:, None], 0.0, np.roll(own, -1, axis=0))
    return np.concatenate([own, before, after, edge[:, None], final[:, None]], axis=1), of, np.maximum(chars, 1)


@dataclass
class Chain:
    """Lines of many texts laid out so that step k handles the k-th lines of all."""

    rows: np.ndarray  # line number, by (step, text)
    edges: np.ndarray  # first place of each step

    @staticmethod
    def of(text_of_line: np.ndarray) -> Chain:
        sizes = np.bincount(text_of_line) if len(text_of_line) else np.zeros(0, np.int64)
        sizes = sizes[sizes > 0]
        begin = spans_of(sizes)[:-1]
        by_size = np.argsort(-sizes, kind="stable")
        steps, live = [], len(sizes)
        sorted_sizes, sorted_begin = sizes[by_size], begin[by_size]
        for k in range(int(sizes.max(initial=0))):
            while live and sorted_sizes[live - 1] <= k:
                live -= 1
            steps.append(sorted_begin[:live] + k)
        return Chain(np.concatenate(steps) if steps else np.zeros(0, np.int64), spans_of(np.array([len(s) for s in steps])))


def _through(x: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log-odds of the next state from those of the state before; move[i, j] is the
    score of a step from state i to state j."""
    return np.logaddexp(x + move[1, 1], move[0, 1]) - np.logaddexp(x + move[1, 0], move[0, 0])


def forward_backward(chain: Chain, scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of every line; their sum's sigmoid is the marginal."""
    e, edges = scores[chain.rows], chain.edges
    a, b = e.copy(), np.zeros_like(e)
    for k in range(1, len(edges) - 1):
        x, y = edges[k], edges[k + 1]
        a[x:y] += _through(a[edges[k - 1] : edges[k - 1] + y - x], move)
    for k in range(len(edges) - 2, 0, -1):
        x, y = edges[k], edges[k + 1]
        b[edges[k - 1] : edges[k - 1] + y - x] = _through(e[x:y] + b[x:y], move.T)
    out = np.empty((2, len(scores)))
    out[:, chain.rows] = a, b
    return out[0], out[1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, features: np.ndarray, text_of_line: np.ndarray) -> np.ndarray:
        scores = (features - self.mean) / self.scale @ self.weights + self.bias
        a, b = forward_backward(Chain.of(text_of_line), scores, self.move)
        return sigmoid(a + b)

    def raw(self, features: np.ndarray, text_of_line: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
        p = self.marginals(features, text_of_line)
        return np.bincount(text_of_line, p * lengths, n) / np.bincount(text_of_line, lengths, n)

    def score(self, t: Texts) -> np.ndarray:
        features, of, lengths = line_features(t)
        return sigmoid(self.slope * logit(self.raw(features, of, lengths, t.n)) + self.shift)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def ascend(x: np.ndarray, chain: Chain, joins: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, steps: int, penalty: float, linked: bool) -> np.ndarray:
    """Weights, bias and (if linked) the four steps between states of greatest conditional
    likelihood of the line labels y, by Adam."""
    theta = np.zeros(x.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, move = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        e = x @ w + bias
        a, b = forward_backward(chain, e, move) if linked else (e, np.zeros_like(e))
        grad = np.zeros_like(theta)
        residual = (y - sigmoid(a + b)) * weight
        grad[:-5], grad[-5] = residual @ x / n, residual.sum() / n
        if linked:
            left, right = a[joins], e[joins + 1] + b[joins + 1]
            pair = np.stack([np.zeros_like(left) + move[0, 0], right + move[0, 1], left + move[1, 0], left + right + move[1, 1]], axis=1)
            pair = np.exp(pair - pair.max(axis=1, keepdims=True))
            pair /= pair.sum(axis=1, keepdims=True)
            seen = np.zeros_like(pair)
            seen[np.arange(len(joins)), (2 * y[joins] + y[joins + 1]).astype(int)] = 1
            grad[-4:] = (weight[joins, None] * (seen - pair)).sum(axis=0) / n
        grad -= penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def line_labels(p: np.ndarray, text_of_line: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of lines from those of their documents: a line that looks by itself surely
    (SURE) of the other kind has that label. A bad document keeps its worst line bad, and a
    good one is good in most of its length, else all its lines bear its label."""
    y = labels[text_of_line].astype(np.float64)
    other = np.where(y > 0, p < 1 - SURE, p > SURE)
    n = len(labels)
    worst = np.full(n, np.inf)
    np.minimum.at(worst, text_of_line, p)
    other &= (y > 0) | (p > worst[text_of_line])
    turned = np.bincount(text_of_line, lengths * other, n) / np.bincount(text_of_line, lengths, n)
    other &= (y == 0) | (turned[text_of_line] < 0.5)
    return np.where(other, 1 - y, y)


def train(features: np.ndarray, text_of_line: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, penalty: float = 1e-3) -> Model:
    """Lines first bear their document's label, and are told apart one by one; then lines
    that are surely of the other kind change their label, and the chain is trained on these,
    so that its steps learn where good and bad lines meet in a document."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = (features - mean) / scale
    chain = Chain.of(text_of_line)
    joins = np.flatnonzero(text_of_line[1:] == text_of_line[:-1])
    # a document counts once, however many lines it has
    weight = 1.0 / np.bincount(text_of_line)[text_of_line]
    n = len(labels)
    own = labels[text_of_line].astype(np.float64)
    theta = ascend(x, chain, joins, own, weight, n, steps, penalty, False)
    y = line_labels(sigmoid(x @ theta[:-5] + theta[-5]), text_of_line, lengths, labels)
    theta = ascend(x, chain, joins, y, weight, n, steps, penalty, True)
    model = Model(mean, scale, theta[:-5].copy(), float(theta[-5]), theta[-4:].reshape(2, 2).copy())
    # logistic fit of the labels on the aggregate, by Newton steps
    z = np.stack([logit(model.raw(features, text_of_line, lengths, n)), np.ones(n)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(z @ c)
        h = z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        c += np.linalg.solve(h, z.T @ (labels - p) - 1e-3 * (c - [1.0, 0.0]))
    model.slope, model.shift = max(float(c[0]), 1e-3), float(c[1])
    return model


def training_lines(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS):
    """Line features of the labelled documents outside the held-out fold, at most `limit`
    documents; a document with several labels counts as good if one says so."""
    few = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    few = few.groupBy("doc_id").agg(F.max("quality").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches):
        for batch in batches:
            for lo, hi, t in slices(batch["text"]):
                features, of, lengths = line_features(t)
                edges = np.searchsorted(of, np.arange(t.n + 1))
                fits = pa.array(np.diff(edges) <= TRAIN_LINES)
                rows = [features[a:b].astype("<f4").tobytes() for a, b in zip(edges, edges[1:])]
                sizes = [lengths[a:b].astype("<i8").tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["_label"].slice(lo, hi - lo), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "label", "features", "sizes"]).filter(fits)

    picked = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # `limit` rows of ids
    picked = picked.groupBy("doc_id").agg(F.max("_label").cast("int").alias("_label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = cut(picked.mapInArrow(run, "doc_id long, label int, features binary, sizes binary"), "crf-lines")
    # of the documents in the order of their hashes as many as fit together: a row of two numbers each
    upto = F.sum("lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept = found.select("doc_id", (F.length("sizes") / 8).cast("long").alias("lines")).withColumn("upto", upto).where(F.col("upto") <= TRAIN_TOTAL)
    out = found.join(F.broadcast(kept.select("doc_id")), "doc_id").toPandas().sort_values(["doc_id", "features"], kind="stable")
    drop_dir(found)
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model | None:
    got = training_lines(docs, labels, limit)
    y = (got["label"].to_numpy() > 0).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    sizes = [np.frombuffer(s, dtype="<i8") for s in got["sizes"]]
    n = np.array([len(s) for s in sizes])
    lengths = np.concatenate(sizes)
    features = np.frombuffer(b"".join(got["features"]), dtype="<f4").reshape(len(lengths), -1).astype(np.float64)
    return train(features, np.repeat(np.arange(len(n)), n), lengths, y)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels, limit)

    def run(batches):
        for batch in batches:
            for lo, hi, t in slices(batch["text"]):
                score = model.score(t) if model else np.full(t.n, 0.5)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = TRAIN_DOCS) -> DataFrame:
    """The documents whose score reaches the threshold, all columns."""
    schema = docs.schema
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, limit)
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            for lo, hi, t in slices(batch["text"]):
                keep = np.flatnonzero(model.score(t) >= threshold)
                yield batch.slice(lo, hi - lo).take(pa.array(keep))

    return docs.mapInArrow(run, schema)
