"""Token ids of whole documents with a public tokenizer file.

The tokenizer drops white space, and no token crosses a space, a line feed, or the
step from a letter to one of the marks of TAIL. A text is cut there; each distinct
piece is encoded by the library once and remembered by a 64-bit hash of its bytes.
The ids of a document are those of its pieces in order, and an end id. Tests
compare with plain encoding.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather_runs, spans_of

#: Pieces that a worker remembers; beyond it the memory starts afresh.
MEMORY = 700_000
#: Bytes of text that are cut and looked up at a time.
SLICE = 2 << 20
TAIL = b".,;:!?#$%&*"
#: How byte-level tokenizers spell bytes that are no printable Latin-1 characters:
#: the n-th of them as character 256 + n.
BYTE_CHARS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}

SEPARATOR, LETTER, MARK, OTHER = range(4)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[10, 32]], _CLASS[97:123], _CLASS[list(TAIL)] = SEPARATOR, LETTER, MARK
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[[10, 32]] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def id_kind(size: int) -> np.dtype:
    """The type of the ids of a vocabulary of this size, little-endian."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: ids take 16 bits, or 32 if the vocabulary needs them
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self.powers = np.cumprod(np.full(64, _STEP, dtype=np.uint64))
        self.reset()

    def reset(self) -> None:
        #: hash of a piece -> row of starts and lengths, a run of the pool
        self.index: dict[int, int] = {}
        self.starts = np.zeros(1 << 16, dtype=np.int32)
        self.lengths = np.zeros(1 << 16, dtype=np.int32)
        self.pool = np.zeros(1 << 18, dtype=self.kind)
        self.used = 0

    def learn(self, hashes: list[int], pieces: list[str]) -> None:
        """Remember new pieces: plain letter runs straight by the model, in the
        spelling of the byte level; others by the whole tokenizer."""
        tokenize = self.tokenizer.model.tokenize
        found, rest = [], []
        for k, p in enumerate(pieces):
            if p.isascii() and p.islower() and p.isalpha():
                found.append([t.id for t in tokenize(p)])
            elif p.isalpha() and is_latin(p) and p.lower().isalpha():
                found.append([t.id for t in tokenize(p.lower().encode().decode("latin-1").translate(BYTE_CHARS))])
            else:
                found.append(None)
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            found[k] = e.ids
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.array([i for x in found for i in x], dtype=np.int64)
        n = len(self.index)
        while len(self.starts) < n + len(pieces):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.starts[n : n + len(pieces)] = self.used + spans_of(lengths)[:-1]
        self.lengths[n : n + len(pieces)] = lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(hashes, range(n, n + len(pieces))))

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts (null: empty), each text followed by
        `end`, and how many ids each has."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        ids, totals, a = [], [], 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
            x, n = self.encode_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end)
            ids.append(x)
            totals.append(n)
            a = b
        return (np.concatenate(ids), np.concatenate(totals)) if ids else (np.zeros(0, self.kind), np.zeros(0, np.int64))

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if len(self.index) > MEMORY:
            self.reset()
        if b"<|" in raw.tobytes():  # marks of special tokens are spelt in lower case only: leave case to the tokenizer
            text = raw
        else:
            text = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
        kind = _CLASS[text]
        first = np.zeros(len(text) + 1, dtype=bool)
        first[offsets] = True
        before = np.empty_like(kind)
        before[1:], before[:1] = kind[:-1], SEPARATOR
        opens = (kind != SEPARATOR) & ((before == SEPARATOR) | ((kind == MARK) & (before == LETTER)) | first[:-1])
        starts = np.flatnonzero(opens)
        if not len(starts):
            return np.full(n, end, dtype=self.kind), np.ones(n, dtype=np.int64)
        sizes = np.diff(starts, append=len(text))
        place = np.arange(len(text) - starts[0], dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), sizes)
        while len(self.powers) <= place.max(initial=0):
            self.powers = np.cumprod(np.full(2 * len(self.powers), _STEP, dtype=np.uint64))
        values = _BYTE[text[starts[0] :]] * self.powers[place]
        hashes = np.add.reduceat(values, starts - starts[0])
        unique, at, codes = np.unique(hashes, return_index=True, return_inverse=True)
        unique = unique.tolist()
        fresh = [k for k, h in enumerate(unique) if h not in self.index]
        if fresh:
            whole = text.tobytes()
            begin = starts[at[fresh]]
            stop = begin + sizes[at[fresh]]
            self.learn([unique[k] for k in fresh], [whole[x:y].rstrip(b" \n").decode() for x, y in zip(begin.tolist(), stop.tolist())])
        rows = np.fromiter(map(self.index.__getitem__, unique), dtype=np.int32, count=len(unique))[codes]
        lengths = self.lengths[rows]
        found = self.pool[gather_runs(self.starts[rows], lengths)]
        # ids before each text's first piece: there the end ids go between
        upto = spans_of(lengths)[np.searchsorted(starts, offsets)]
        counts = np.diff(upto) + 1
        out = np.full(len(found) + n, end, dtype=self.kind)
        out[np.arange(len(found)) + np.repeat(np.arange(n), counts - 1)] = found
        return out, counts


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
