"""Secret scans: patterns, then structural confirmation of encoded candidates.

Base kinds are plain patterns.  Encoded candidates (base64, base64url or hex) are decoded and their
structure parsed before they are reported: DER keys by nested lengths, key files by their armour and
body, signed tokens by their JSON headers.  Keys are looked for wherever their first bytes occur, also
inside a run, and are read on over line breaks (real or escaped) and indentation; the length that
they state tells where they end.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import returning_memory
from pyspark.sql.types import StringType

# The base patterns (fixed values of the result's contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Only texts with one of these can hold an assignment.
_HINT = re.compile(r"[:=]")
# What may part the lines of one encoded value.
_BREAK = r"(?:[ \t]*(?:\r?\n|\\+r\\+n|\\+n)[ \t]*)+"
_LINES64, _LINES16 = (re.compile(rf"({c}+)(?:{_BREAK}(?={c}))?") for c in ("[A-Za-z0-9+/_-]", "[0-9a-fA-F]"))
# First characters of a DER sequence, or of the magic of OpenSSH key files.
_START64 = re.compile(r"M(?=[A-H]|I[E-T])|b3BlbnNzaC1rZXktdjEA")
_START16 = re.compile(r"30(?=(?:[0-7].|81..|82.{4}|83.{6}|84.{8})0201)|6f70656e7373682d6b65792d763100", re.IGNORECASE)
_OPENSSH = b"openssh-key-v1\x00"
_LEAST64, _LEAST16 = 32, 64  # characters
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
_ESCAPED = re.compile(r"\\+r\\+n|\\+n|\r\n?")
_HEADERS = re.compile(rf"(?:{_BREAK}[A-Za-z-]+: [^\r\n\\]*)*(?:{_BREAK}|[ \t]*)")
KINDS = ["assign", "access", "hex", "der", "token", "armour"]


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at `at`, or None when its length is not well formed."""
    if at + 2 > len(data):
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            return None
        size = int.from_bytes(data[at:at + width], "big")
        if size < 128 or (width > 1 and data[at] == 0):
            return None
        at += width
    return (tag, at, at + size) if at + size <= len(data) else None


def is_key_encoding(data: bytes) -> bool:
    """A DER sequence that fills the data, begins with a version and holds whole elements; or a key file magic."""
    if data.startswith(_OPENSSH):
        return True
    outer = _element(data, 0)
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    tags, at = [], outer[1]
    while at < outer[2]:
        inner = _element(data[:outer[2]], at)
        if inner is None:
            return False
        tags.append((inner[0], inner[1], inner[2]))
        at = inner[2]
    if len(tags) < 3 or tags[0][0] != 0x02 or tags[0][2] - tags[0][1] != 1:
        return False  # private keys begin with a one-byte version
    kinds = [t[0] for t in tags]
    wrapped = kinds[1] == 0x30 and kinds[2] == 0x04  # algorithm, then the key as octets
    numbers = len(kinds) >= 6 and all(k == 0x02 for k in kinds[:6])  # RSA and DSA integers
    curve = kinds[1] == 0x04  # a curve's scalar
    return wrapped or numbers or curve


def _stated_size(data: bytes) -> int | None:
    """Bytes of the key that begins `data` by its own lengths; None if they cannot be read."""
    if data.startswith(_OPENSSH):
        at = len(_OPENSSH)
        for field in range(3):  # cipher, key derivation and its options
            at += 4 + int.from_bytes(data[at:at + 4], "big")
        keys = int.from_bytes(data[at:at + 4], "big")
        at += 4
        for field in range(min(keys, 64) + 1):  # public keys, then the private part
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at:at + 4], "big")
        return at
    if len(data) < 2 or data[0] != 0x30:
        return None
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    if width > 4 or (data[1] & 0x80 and not width) or len(data) < 2 + width:
        return None
    return 2 + width + (int.from_bytes(data[2:2 + width], "big") if width else data[1])


def _taken(lines: re.Pattern, text: str, start: int, limit: int | None = None) -> tuple[str, int]:
    """Up to `limit` characters of the value from `start` on, breaks left out, and where they end in the text."""
    parts, have, at, end = [], 0, start, start
    while (limit is None or have < limit) and (m := lines.match(text, at)):
        part = m[1] if limit is None else m[1][:limit - have]
        parts.append(part)
        have, at, end = have + len(part), m.end(), m.start() + len(part)
    return "".join(parts), end


def _bytes_of(chars: str, base: int) -> bytes:
    if base == 16:
        return bytes.fromhex(chars[:len(chars) // 2 * 2])
    return _decoded(chars if len(chars) % 4 != 1 else chars[:-1]) or b""


def _keys(text: str, starts: re.Pattern, lines: re.Pattern, base: int) -> list[tuple[int, int]]:
    """(start, end) of whole private keys in base 64 or 16."""
    found, past = [], 0
    for m in starts.finditer(text):
        if m.start() < past:
            continue
        magic = len(m[0]) > 2
        head, _ = _taken(lines, text, m.start(), None if magic else 24)
        data = _bytes_of(head, base)
        if not magic and (b"\x02\x01" not in data[2:8]):
            continue
        size = _stated_size(data)
        if magic and (size is None or size > len(data)):  # cut short: still part of a key
            chars, end = lines.match(text, m.start())[1], lines.match(text, m.start()).end(1)
        elif size is None:
            continue
        else:
            need = 2 * size if base == 16 else -(-4 * size // 3)
            chars, end = _taken(lines, text, m.start(), need)
            if len(chars) < need:
                continue
        if len(chars) < (_LEAST16 if base == 16 else _LEAST64) - 2 or not is_key_encoding(_bytes_of(chars, base)):
            continue
        if base == 64:
            end += len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))
        found.append((m.start(), end))
        past = end
    return found


def _armoured(text: str) -> list[tuple[int, int]]:
    """(start, end) of key files by their armour; without an END line, up to the end of the body."""
    found = []
    marks = list(ARMOUR.finditer(text))
    for i, m in enumerate(marks):
        until = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        close = f"-----END {m[1]}-----"
        at = text.find(close, m.end(), until)
        if at >= 0:
            plain = _ESCAPED.sub("\n", text[m.end():at])
            end = at + len(close)
            body = "".join(line for line in plain.split("\n") if ":" not in line).replace(" ", "").replace("\t", "")
        else:
            start = _HEADERS.match(text, m.end()).end()
            plain = text[m.end():start]
            body, end = _taken(_LINES64, text, start)
            head = _bytes_of(body[:4096], 64)
            size = _stated_size(head)
            if size is not None and -(-4 * size // 3) <= len(body):
                body, end = _taken(_LINES64, text, start, -(-4 * size // 3))
            end += len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))
        data = _decoded(body)
        # An encrypted body has no structure to hold it against, except that it decodes.
        if data and ("ENCRYPTED" in m[1] or "ENCRYPTED" in plain or is_key_encoding(data)):
            found.append((m.start(), end))
    return found


def is_signed_token(run: str) -> bool:
    """Three base64url parts whose first is a JSON object naming an algorithm, the second a JSON object."""
    parts = run.split(".")
    try:
        head, body = (json.loads(_decoded(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):  # RecursionError: JSON nested too deeply to be a token's header
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the pattern kinds."""
    found = []
    if _HINT.search(text):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of encoded candidates whose structure holds."""
    found = []
    found += [(3, *span) for span in _keys(text, _START64, _LINES64, 64) + _keys(text, _START16, _LINES16, 16)]
    if "eyJ" in text:
        found += [(4, m.start(), m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        found += [(5, *span) for span in _armoured(text)]
    return found


def scan_text(text: str) -> tuple[list, list]:
    """Base spans and all spans, each sorted by start, then kind."""
    base = sorted(base_spans(text), key=lambda s: (s[1], s[0], s[2]))
    return base, sorted({*base, *confirmed_spans(text)}, key=lambda s: (s[1], s[0], s[2]))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Spans are code points, end exclusive.  A null text counts as empty; texts without a finding have
    zero counts, an empty `spans` and the digest of the empty string.  Rows are judged one by one, so
    repeated rows give equal results; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for value in batch.column(1):
                base, spans = scan_text(value.as_py() or "")
                for k in range(3):
                    out[k].append(sum(s[0] == k for s in base))
                out[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[4].append(_joined(spans))
                out[5].append(len(spans))
            arrays = [pa.array(o, pa.int64()) for o in out[:3]] + [pa.array(o, pa.string()) for o in out[3:5]] + [pa.array(out[5], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """Every span replaced by `mark`; overlapping spans are replaced together."""
    out, at = [], 0
    for _, start, end in scan_text(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with secrets replaced in `text` (and `n_chars`, if there, counted anew); nulls stay."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.array([None if t is None else redact_text(t, mark) for t in batch.column(at).to_pylist()], pa.string())
            columns = [c.cast(pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if not isinstance(docs.schema["text"].dataType, StringType):
        raise TypeError("text must be a string column")
    clean = docs.mapInArrow(returning_memory(run), docs.schema)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean
