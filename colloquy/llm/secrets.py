"""Secret scans: Aho-Corasick keywords first, anchored regular expressions only at their hits, embedded checksums last.

Kinds with a keyword (``assign``, ``access`` and the checked token formats) cost one automaton pass over the text; only at a hit is an
expression tried, anchored there.  ``hex`` has no keyword: a run of 24 or more hexadecimal digits is looked for directly.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, recounted, texts

BASE = ("assign", "access", "hex")
CHECKED = ("github", "npm", "jwt", "pem")
KINDS = BASE + CHECKED

_LOWER = {c: c + 32 for c in range(65, 91)}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHECKSUMMED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----\s([A-Za-z0-9+/=\s]++)-----END \1-----")

#: Keyword in lower case -> the expression to try where it begins.
_KEYWORDS = {k: "assign" for k in ("password", "passwd", "secret", "token", "apikey", "api_key")}
_KEYWORDS |= {"akia": "access", "eyj": "jwt", "-----begin ": "pem", "npm_": "npm"}
_KEYWORDS |= {f"gh{c}_": "github" for c in "pousr"}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits, as GitHub and npm tokens carry it."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out.rjust(6, "0")


def _json_object(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _der_length(body: str) -> bool:
    """Whether base-64 ``body`` is one DER sequence of exactly the length that it states."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    n = raw[1] & 0x7F if raw[1] & 0x80 else 0
    return len(raw) == 2 + n + (int.from_bytes(raw[2 : 2 + n], "big") if n else raw[1])


def _at(kind: str, text: str, start: int) -> tuple[int, bool] | None:
    """(end, whether it counts) of the match of ``kind`` that begins at ``start``."""
    if kind == "assign":
        m = _ASSIGN.match(text, start)
        return m and (m.end(), len(m[2]) >= 6)
    if kind == "access":
        m = _ACCESS.match(text, start)
        return m and (m.end(), m.end() - start >= 20)
    if kind == "jwt":
        m = _JWT.match(text, start)
        # where a run is no first part from here, it is none from any later place in it
        return (m.end(), _json_object(m[1]) and _json_object(m[2])) if m else (_JWT_RUN.match(text, start).end(), False)
    if kind == "pem":
        m = _PEM.match(text, start)
        return m and (m.end(), _der_length(m[2]))
    m = _CHECKSUMMED.match(text, start)
    return m and (m.end(), checksum(m[1]) == m[2])


def find_secrets(text: str | None, automaton: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret in code points, by start and then kind in the order of ``KINDS``; null and empty text have none.

    Within a kind matches are leftmost and do not overlap; one that fails its check is dropped and still uses up its text.
    """
    if not text:
        return []
    automaton = automaton or _automaton()
    found = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    free = dict.fromkeys(KINDS, 0)
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer would shift what follows
        lower = text.translate(_LOWER)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in automaton.iter(lower))
    for start, kind in hits:
        if start >= free[kind] and (match := _at(kind, text, start)):
            free[kind] = match[0]
            if match[1]:
                found.append((start, match[0], kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = "spans array<struct<start:long,end:long,kind:string>>"


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text, any other columns); see :func:`find_secrets`.

    Null ids are kept, repeated rows stay repeated, no row gives no row.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for at, part in texts(batch):
                spans = [[dict(zip(("start", "end", "kind"), s)) for s in find_secrets(t, automaton)] for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, f"doc_id long, {SPANS}")


def digest(spans: DataFrame) -> DataFrame:
    """Counts, hash and listing of the ``spans`` of each row."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def span_hash(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each secret replaced by its kind in brackets; spans that touch or overlap become one, named for the first."""
    if not spans:
        return text
    out, at, hold = [], 0, spans[0]
    for start, end, kind in [*spans[1:], (len(text) + 1, len(text) + 1, "")]:
        if start < hold[1]:
            hold = (hold[0], max(end, hold[1]), hold[2])
            continue
        out += [text[at : hold[0]], f"[{hold[2].upper()}]"]
        at, hold = hold[1], (start, end, kind)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; every row, column and clean text stays as it is.

    ``n_chars``, where there is such a column, counts the new text.  Null and empty texts and null ids stay, repeated rows stay repeated, no row gives
    no row.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            where = batch.schema.get_field_index("text")
            out = [redact(t, find_secrets(t, automaton)) for _, part in texts(batch) for t in part]
            yield batch.set_column(where, batch.schema.field(where), pa.array(out, batch.schema.field(where).type))

    return recounted(map_arrow(docs, scan, docs.schema))
