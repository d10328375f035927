"""Secrets in whole texts: an Aho-Corasick automaton finds keywords, regular expressions
run anchored at its hits only, and tokens with an embedded checksum must pass it.

Kinds: assign, access and hex are always reported as matched; github and npm tokens
carry the CRC-32 of their first thirty places, in base 62, as the last six; a jwt must
have a header that decodes to JSON with "alg"; a pem is a private key from its BEGIN line
to its END line over all lines between, or, where the next dashed line is no such END, over
the lines of base 64 and headers that follow BEGIN.

Nulls are empty texts; an empty text has no spans; a text is scanned whole, however long;
each row of repeated rows is scanned by itself; spans that begin at the same place are
listed in the order of KINDS; an empty table gives no rows. `find` and `digests` read only
doc_id and text; `redact` keeps all columns whatever their names, and changes text and, if
there is one, n_chars.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Fixed values of the contract, in the order that ties are listed in.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
GITHUB = re.compile("gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile("npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile("-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile("-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Lines of a key whose END is missing.
PEM_BODY = re.compile(r"(?:\s+(?:[A-Za-z-]+:\x20[^\n]*|[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/])))*(?:\s+[A-Za-z0-9+/]{2,}={1,2}(?![A-Za-z0-9+/=]))?")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Characters of text that are scanned at a time.
SLICE = 1 << 20


def checksum_holds(token: str) -> bool:
    """The last six places are the CRC-32 of the thirty before, in base 62."""
    body, n = token[-36:], 0
    for c in body[30:]:
        n = 62 * n + BASE62.index(c)
    return zlib.crc32(body[:30].encode()) == n


def header_holds(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def automaton():
    a = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")), ("npm", ("npm_",)), ("jwt", ("eyj",)), ("pem", ("-----begin",))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def key_end(text: str, begin: int, stop: int) -> int:
    """Where a private key ends whose BEGIN line ends at `begin`."""
    dashes = text.find("-----", begin, stop)
    end = PEM_END.match(text, dashes, stop) if dashes >= 0 else None
    return end.end() if end else PEM_BODY.match(text, begin, stop).end()


def matches(text: str, kind: str, at: int, stop: int) -> tuple[int, bool]:
    """The regular expression of a keyword's kind, anchored at the hit, within its text: the
    end of its match (-1 if none), and whether that is a secret."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "pem": PEM}[kind]
    m = pattern.match(text, at, stop)
    if not m:
        return -1, False
    if kind == "assign":
        return m.end(), len(m[2]) >= LEAST["assign"]
    if kind == "access":
        return m.end(), len(m[0]) >= LEAST["access"]
    if kind == "jwt":
        return m.end(), header_holds(m[1])
    if kind == "pem":
        return key_end(text, m.end(), stop), True
    return m.end(), (at == 0 or not text[at - 1].isalnum()) and checksum_holds(m[0])


def hex_runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of 0-9 and a-f that are long enough."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    hit = np.zeros(len(points) + 2, dtype=np.int8)
    hit[1:-1] = ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 102))
    step = np.diff(hit)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = b - a >= LEAST["hex"]
    return a[long], b[long]


def scan(texts: list[str], a) -> list[list[tuple[int, int, int]]]:
    """Spans (start, place of the kind in KINDS, end) of each text, in order. The texts
    are scanned joined by line feeds; a match ends at its text's end at the latest."""
    joined = "\n".join(texts)
    lower = joined.encode().lower().decode()  # A-Z only, so places stay
    found = []
    ends = dict.fromkeys(KINDS, 0)
    hits = [(end + 1 - n, kind) for end, (kind, n) in a.iter(lower)]
    hits.sort()
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    stops = (starts[np.searchsorted(starts, [at for at, _ in hits], side="right")] - 1).tolist()
    for (at, kind), stop in zip(hits, stops):
        if at >= ends[kind]:  # matches of a kind do not overlap
            end, good = matches(joined, kind, at, stop)
            if end >= 0 and (good or kind in LEAST):
                ends[kind] = end
            if good:
                found.append((at, KINDS.index(kind), end))
    x, y = hex_runs(joined)
    found += zip(x.tolist(), [KINDS.index("hex")] * len(x), y.tolist())
    found.sort()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (s, k, e), i in zip(found, (np.searchsorted(starts, [f[0] for f in found], side="right") - 1).tolist()):
        base = int(starts[i])
        out[i].append((s - base, k, e - base))
    return out


def _column_scans(batches):
    a = automaton()
    for batch in batches:
        for part, found in texts(batch, chars=SLICE):
            yield part, found, scan(found, a)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row for each document with its spans as an array of (kind, start, end)."""

    def run(batches):
        for part, _, spans in _column_scans(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def run(batches):
        for part, _, spans in _column_scans(batches):
            own = [[s for s in x if s[1] < 3] for x in spans]
            cols = [pa.array([sum(s[1] == k for s in x) for x in own], pa.int64()) for k in range(3)]
            sha = [hashlib.sha256(joined(x).encode()).hexdigest() for x in own]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *cols, pa.array(sha, pa.string()), pa.array([joined(x) for x in spans], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones as one) replaced by [SECRET]."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked; all rows and columns stay. If there is a
    column n_chars, it follows the new text. A null text stays null."""
    schema = docs.schema

    def run(batches):
        for part, found, spans in _column_scans(batches):
            new = [masked(t, x) if x else t for t, x in zip(found, spans)]
            values = {"text": [None if z else t for t, z in zip(new, part["text"].is_null().to_pylist())]}
            if "n_chars" in schema.names:
                values["n_chars"] = [len(t) if x else n for t, x, n in zip(new, spans, part["n_chars"].to_pylist())]
            for name, column in values.items():
                k = part.schema.get_field_index(name)
                part = part.set_column(k, part.schema.field(k), pa.array(column, part.schema.field(k).type))
            yield part

    return docs.mapInArrow(run, schema)
