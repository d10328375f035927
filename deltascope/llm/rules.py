"""Quality rules as a short-circuit cascade.

The fixed counts come for every text. The further rules run one after another, each
only over the texts that no earlier one rejected; their order is by rejections per
second, both measured on a sample. The verdict does not depend on the order.

Nulls count as empty texts; an empty text has no words and fails the base rules; an
empty table gives no rows; repeated rows are judged alike, one result row each. A text is
judged whole by one task, whatever its length. Rules that reject equally fast are in the
order of their names. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather_runs, spans_of
from .textarrays import Texts, mix, repeated, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Texts that the order of the rules is estimated from.
SAMPLE = 400
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def base(t: Texts) -> dict[str, np.ndarray]:
    """The fixed counts of each text, and what the rules reuse."""
    hashes = t.word_hashes()
    out = {"hashes": hashes, "n_words": np.diff(t.words)}
    out["word_chars"] = t.count(~t.space & ((t.raw & 0xC0) != 0x80))
    out["n_symbols"] = t.count(_SYMBOL[t.raw])
    starts, ends, of, lines = t.lines()
    worded = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    of, keys = of[worded], lines[worded]
    order = np.lexsort((keys, of))
    same = (of[order][1:] == of[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    out["n_lines"] = np.bincount(of, minlength=t.n)
    out["n_dup_lines"] = np.bincount(of[order][1:][same], minlength=t.n)
    word_text = np.repeat(np.arange(t.n), out["n_words"])
    n = len(hashes) - WINDOW + 1
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    if n > 0:
        key = np.zeros(n, dtype=np.uint64)
        for j in range(WINDOW):
            key += hashes[j : j + n] * _MULTIPLIERS[j]
        inside = np.flatnonzero(word_text[:n] == word_text[WINDOW - 1 :])
        key = key[inside] ^ mix(word_text[inside].astype(np.uint64) + np.uint64(1))
        twice = inside[repeated(key)]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = np.diff(spans_of(np.cumsum(covered)[:-1] > 0)[t.words])
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    return out


def _bytes_of(t: Texts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(t.offsets)[rows]
    return t.raw[gather_runs(t.offsets[:-1][rows], sizes)], spans_of(sizes)


def symbol_rule(t, b, rows):
    """More than one symbol for ten words."""
    return b["n_symbols"][rows] > 0.1 * b["n_words"][rows]


def word_length_rule(t, b, rows):
    """Mean word length out of 2.5 to 12 characters."""
    mean = b["word_chars"][rows] / np.maximum(b["n_words"][rows], 1)
    return (mean < 2.5) | (mean > 12)


def line_rule(t, b, rows):
    """More than a third of the lines are copies of earlier ones."""
    return 3 * b["n_dup_lines"][rows] > b["n_lines"][rows]


def upper_rule(t, b, rows):
    """More than a third of the ASCII letters are capitals."""
    raw, edges = _bytes_of(t, rows)
    up, low = (np.diff(spans_of(m[raw])[edges]) for m in (_UPPER, _LOWER))
    return 3 * up > up + low


def shout_rule(t, b, rows):
    """More than one exclamation mark for five words."""
    raw, edges = _bytes_of(t, rows)
    return 5 * np.diff(spans_of(raw == 33)[edges]) > b["n_words"][rows]


def top_word_rule(t, b, rows):
    """One word is more than a quarter of all."""
    n = b["n_words"][rows]
    words = b["hashes"][gather_runs(t.words[:-1][rows], n)]
    of = np.repeat(np.arange(len(rows)), n)
    order = np.lexsort((words, of))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    at = np.flatnonzero(first)
    top = np.zeros(len(rows), dtype=np.int64)
    np.maximum.at(top, of[order][at], np.diff(at, append=len(order)))
    return 4 * top > n


RULES = {"symbols": symbol_rule, "word_length": word_length_rule, "lines": line_rule, "capitals": upper_rule, "shouting": shout_rule, "top_word": top_word_rule}


def measure(docs: DataFrame, rules: dict = RULES, sample: int = SAMPLE) -> list[tuple[str, int, int, float]]:
    """For each rule: texts seen, rejected and seconds, over the sample (the texts whose
    ids hash lowest). The ids are picked first, so no task gathers texts; they are at most
    `sample` rows, which bounds what is broadcast."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").limit(sample)

    def run(batches):
        found = {k: [0, 0, 0.0] for k in rules}
        for batch in batches:
            for _, _, t in slices(batch["text"]):
                b = base(t)
                rows = np.flatnonzero(~b["base_failed"])
                for k, rule in rules.items():
                    began = time.perf_counter()
                    rejected = rule(t, b, rows)
                    s = found[k]
                    s[0], s[1], s[2] = s[0] + len(rows), s[1] + int(rejected.sum()), s[2] + time.perf_counter() - began
        yield pa.RecordBatch.from_pylist([{"rule": k, "seen": s[0], "rejected": s[1], "seconds": s[2]} for k, s in found.items()])

    return [tuple(r) for r in few.mapInArrow(run, "rule string, seen long, rejected long, seconds double").collect()]


def order_rules(measured: list[tuple[str, int, int, float]], rules: dict = RULES) -> list[str]:
    """Most rejections per second first; a rejection and a microsecond more than
    measured keep rules that rejected nothing comparable."""
    gain = dict.fromkeys(rules, (0.0, 0))
    totals: dict[str, list[float]] = {}
    for name, seen, rejected, seconds in measured:
        t = totals.setdefault(name, [0, 0, 0.0])
        t[0], t[1], t[2] = t[0] + seen, t[1] + rejected, t[2] + seconds
    for name, (seen, rejected, seconds) in totals.items():
        gain[name] = ((rejected + 0.5) / (seconds + 1e-6), seen)
    return sorted(rules, key=lambda k: (-gain[k][0], k))


def cascade(t: Texts, b: dict, order: list[str], rules: dict = RULES) -> np.ndarray:
    """Mask of the texts that pass the base and all rules."""
    rows = np.flatnonzero(~b["base_failed"])
    for name in order:
        if not len(rows):
            break
        rows = rows[~rules[name](t, b, rows)]
    kept = np.zeros(t.n, dtype=bool)
    kept[rows] = True
    return kept


def judge(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = order_rules(measure(docs, rules), rules)

    def run(batches):
        for batch in batches:
            for lo, hi, t in slices(batch["text"]):
                b = base(t)
                kept = cascade(t, b, order, rules)
                cols = [pa.array(b[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *cols, pa.array(b["base_failed"]), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.mapInArrow(run, RESULT)


ORACLE = r"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (select rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
w as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as i from l),
runs as (select rid, i, word, list(word) over (partition by rid order by i rows between current row and 7 following) as run from w),
twice as (select rid, run from runs where len(run) = 8 group by rid, run having count(*) > 1),
marked as (select r.rid, r.i, case when t.rid is not null then 1 end as hit from runs r left join twice t on r.rid = t.rid and r.run = t.run),
covered as (select rid, count(*) filter (c = 1) as n_repeat_words from (select rid, max(hit) over (partition by rid order by i rows between 7 preceding and current row) as c from marked) group by rid),
tops as (select rid, max(n) as top from (select rid, word, count(*) as n from w group by rid, word) group by rid),
ls as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
b as (select d.doc_id, len(l.ws) as n_words, coalesce(list_sum(list_transform(l.ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(top, 0) as top,
  length(regexp_replace(d.text, '[^A-Z]', '', 'g')) as up, length(regexp_replace(d.text, '[^a-z]', '', 'g')) as low, length(d.text) - length(replace(d.text, '!', '')) as bangs
  from d join l using (rid) left join ls using (rid) left join covered using (rid) left join tops using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or n_symbols > 0.1::double * n_words or word_chars::double / greatest(n_words, 1) < 2.5::double or word_chars::double / greatest(n_words, 1) > 12::double
    or 3 * n_dup_lines > n_lines or 3 * up > up + low or 5 * bangs > n_words or 4 * top > n_words) as kept from b"""
