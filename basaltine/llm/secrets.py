"""Secret scan: patterns, then structural confirmation of encoded material.

Three base patterns give spans by themselves. The method adds spans of base64
or hex runs that decode to something with the structure of a secret:

* ``key``: a DER private key (PKCS#1, SEC1, PKCS#8 with the key inside it, or
  encrypted PKCS#8) whose nested lengths fill the decoded bytes exactly at every
  level, or an OpenSSH key file whose length-prefixed fields do; alone in a run,
  in a run wrapped over lines as far as its outer length tells, or between PEM
  lines (then with those lines; line ends may be written as ``\\n``). A PEM key
  with ``Proc-Type`` and ``DEK-Info`` lines has an initial vector and a body of
  whole cipher blocks;
* ``jwt``: a token of three dot-separated base64url parts whose header decodes
  to a JSON object that names an algorithm and whose payload is a JSON object.

Offsets are code points, ends exclusive. Null text is empty; a text without
findings has zero counts, the digest of the empty string and empty spans. Rows
are judged each for itself, whatever their doc_id; texts may have any length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import text_of
from .tokens import sha256_hex

KINDS = ("assign", "access", "hex", "key", "jwt")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.DOTALL)
_NEXT_LINE = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*([A-Za-z0-9+/]+={0,2})")
_DEK = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)")
# Object identifiers of password-based encryption begin so.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Zero-width, so that a refused match takes no part from a later one.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=(e[A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*))")
#: Where a key may start in a run: a DER sequence or the OpenSSH magic in base64 or hex, first or after a separator.
_START = re.compile(r"(?:(?<![A-Za-z0-9])|^)(?:M|b3BlbnNzaC1rZXktdjEA|30|6[fF])")


def _decode64(run: str) -> bytes | None:
    body = run.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _peek(text: str, at: int, end: int, byte: int, n: int) -> bytes:
    """n bytes from the given one on of the base64 from ``at`` to ``end``."""
    a = at + byte // 3 * 4
    return (_decode64(text[a : min(end, a + (n + 4) // 3 * 4 + 4)]) or b"")[byte % 3 :][:n]


def _key_at(text: str, at: int, bare: int, end: int, hex_from: int) -> bool:
    """Whether the run from ``at`` to ``end`` (``bare`` without padding, hex digits alone from ``hex_from`` on) is a private key. Its outer lengths are tested before anything is copied."""
    if text[at] in "36":
        # Only what holds hex digits to its end can be hex, and a start follows a separator: one at most for each run.
        if at < hex_from or (end - at) % 2:
            return False
        return is_private_key(bytes.fromhex(text[at:end]))
    size = (bare - at) * 3 // 4
    if text[at] == "M":
        head = _peek(text, at, bare, 0, 6)
        top = _tlv(head, 0, 1 << 40)
        told = top[2] if top and len(head) == 6 else -1
    else:
        told = 15
        for k in range(5):
            told += 4 * (k == 3)
            told += 4 + int.from_bytes(_peek(text, at, bare, told, 4), "big") if told + 4 <= size else size + 1
    return told == size and is_private_key(_decode64(text[at:end]) or b"")


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of a DER element that fits before end."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        size, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        x = _tlv(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def _nested(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The elements from at to end, if they fill it and all constructed ones are filled in turn."""
    parts = _children(data, at, end) if depth < 16 else None
    if parts is None or any(tag & 0x20 and _nested(data, a, e, depth + 1) is None for tag, a, e in parts):
        return None
    return parts


def _fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill the bytes."""
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def _is_openssh(data: bytes) -> bool:
    at, fields = 15, []
    for k in range(5):  # cipher, key derivation and its options; then the number of keys, a public and the private part
        at += 4 * (k == 3)
        size = int.from_bytes(data[at : at + 4], "big")
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    public = _fields(fields[3])
    plain = fields[0] != b"none" or fields[4][:4] == fields[4][4:8] != b""
    return at == len(data) and bool(public) and public[0].isascii() and len(public) > 1 and plain


def _is_der_key(data: bytes, at: int, end: int, inside: bool = False) -> bool:
    """Whether at..end holds one private key: PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8."""
    top = _tlv(data, at, end)
    if top is None or top[0] != 0x30 or top[2] != end:
        return False
    parts = _nested(data, top[1], end)
    if not parts:
        return False
    tags, (_, a, e) = [p[0] for p in parts], parts[0]
    if tags == [0x30, 0x04] and not inside:
        scheme = _children(data, a, e) or [(0, 0, 0)]
        size = parts[1][2] - parts[1][1]
        return scheme[0][0] == 0x06 and data[scheme[0][1] : scheme[0][2]].startswith(_PBE) and size >= 16 and size % 8 == 0
    if tags[0] != 0x02 or e - a != 1:
        return False
    if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True
    if tags[1:2] == [0x04] and data[a] == 1:
        return True
    if tags[1:3] == [0x30, 0x04] and not inside:
        scheme, (_, x, y) = _children(data, parts[1][1], parts[1][2]), parts[2]
        key = _tlv(data, x, y)
        plain = key is not None and key[2] == y and key[0] in (0x02, 0x04)  # a number, or the bytes of a curve's key
        return bool(scheme) and scheme[0][0] == 0x06 and (plain or _is_der_key(data, x, y, True))
    return False


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a DER or OpenSSH private key, lengths and all."""
    return _is_openssh(data) if data.startswith(b"openssh-key-v1\0") else _is_der_key(data, 0, len(data))


def _is_pem_key(body: str) -> bool:
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    data = _decode64("".join(x for x in lines if ":" not in x))
    if not data:
        return False
    dek = _DEK.search(body)
    if dek is None:
        return is_private_key(data)
    block = len(dek[2]) // 2
    return block in (8, 16) and len(data) % block == 0 and "ENCRYPTED" in body


class _Lines:
    """Lines of base64 that follow one another, with their running lengths: where a wrapped key must end is looked up, not walked to."""

    def __init__(self, text: str):
        self.text, self.at, self.ends, self.total, self.chain = text, {}, [], [0], []
        for m in _NEXT_LINE.finditer(text):
            joined = self.ends and self.ends[-1] == m.start()
            self.at[m.start()] = len(self.ends)
            self.chain.append(self.chain[-1] + (not joined) if self.chain else 0)
            self.ends.append(m.end())
            self.total.append(self.total[-1] + len(m[1].rstrip("=")))

    def wrapped(self, start: int, end: int) -> int | None:
        """The end of a key whose run from start to end goes on in the next lines, by its outer length."""
        head = _decode64(self.text[start : start + 8]) or b""
        top = _tlv(head, 0, 1 << 40) if len(head) == 6 and head[0] == 0x30 else None
        first = self.at.get(end)
        if top is None or first is None:
            return None
        missing = (top[2] * 4 + 2) // 3 - (end - start)
        last = bisect_left(self.total, self.total[first] + missing) - 1
        if missing <= 0 or last >= len(self.ends) or self.total[last + 1] != self.total[first] + missing or self.chain[last] != self.chain[first]:
            return None
        body = self.text[start:end] + "".join(m[1] for m in _NEXT_LINE.finditer(self.text, end, self.ends[last]))
        return self.ends[last] if is_private_key(_decode64(body) or b"") else None


def is_signed_token(header: str, payload: str) -> bool:
    for part, names in ((header, True), (payload, False)):
        raw = _decode64(part)
        if raw is None or raw[:1] != b"{":
            return False
        try:
            x = json.loads(raw)
        except (ValueError, RecursionError):
            return False
        if not isinstance(x, dict) or names and not isinstance(x.get("alg"), str):
            return False
    return True


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted, of all findings; kind indexes KINDS."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    framed = [(m.start(), m.end()) for m in _PEM.finditer(text) if _is_pem_key(m[2])] if "-----BEGIN " in text else []
    out += [(a, 3, e) for a, e in framed]
    opened, closed, lines = [a for a, _ in framed], [e for _, e in framed], None
    for m in _RUN.finditer(text):
        run, begin, end = m[0], m.start(), m.end()
        bare, hex_from = begin + len(run.rstrip("=")), begin + len(run.rstrip(string.hexdigits))
        for x in _START.finditer(text, begin, end - 15):
            start = x.start()
            k = bisect_right(opened, start) - 1
            if k >= 0 and start < closed[k]:
                continue
            if _key_at(text, start, bare, end, hex_from):
                found = end
            elif text[start] == "M" and text[end : end + 1] in ("\r", "\n", "\\"):
                lines = lines or _Lines(text)
                found = lines.wrapped(start, end)
            else:
                continue
            if found:
                out.append((start, 3, found))
                break
    if ".ey" in text or "ey" in text and "." in text:
        out += [(m.start(), 4, m.end(3)) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, digests, spans = ([], [], []), [], []
        for text in b.column(1).to_pylist():
            found = scan(text)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in found))
            said = [f"{KINDS[k]}:{a}:{e}" for a, k, e in found]
            digests.append(sha256_hex(",".join(s for s, x in zip(said, found, strict=True) if x[1] < 3).encode()))
            spans.append(",".join(said))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    return text_of(docs).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
