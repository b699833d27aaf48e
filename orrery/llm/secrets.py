"""Secret scans: fixed shapes, and structural confirmation of encoded keys and tokens.

Base secrets are assignments, access key ids and long hexadecimal runs of the fixed patterns below. Besides, candidates in base64
or hexadecimal are decoded and reported only if their structure holds: `token` (three base64url parts whose header is a JSON object that names an algorithm,
whose claims are a JSON object and whose signature decodes), `pem` (a private key block whose body is DER, an OpenSSH key, or enciphered as its headers say), `der` (a bare run that
decodes to a private key in DER, by its version, object identifier, octet string or integers, with nested lengths that all fit) and `openssh` (a bare run that decodes to an OpenSSH key).
Public keys, certificates and signatures are not secrets. Runs of base64 or base64url of 40 characters at least may follow anything but a letter or digit and go on over line breaks, those of
hexadecimal digits have 64 of them at least; a run that decodes to a block or a token is one.

A null or empty text has no spans; positions are code points, the end exclusive. Whole texts are scanned, row by row: repeated rows and rows with null
doc_id keep a row each. Empty tables give empty results. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import slices

#: The base patterns.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token", "pem", "der", "openssh")

#: A JSON object begins with a brace or white space, so its base64url with one of CDIe.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([CDIe][A-Za-z0-9_-]{7,})\.([CDIe][A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:\s*[A-Za-z-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,}\s")
#: Runs of base64 or base64url over one or more lines, and where a key may start in one: at a sequence, an OpenSSH key or an encoded block, after anything but a letter or digit.
_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_START = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P][A-Za-z0-9+/_-]{6}|b3BlbnNzaC1rZXktdjE|LS0tLS1)|[A-Za-z0-9+/_-]{40}")
_SIGN = re.compile(r"[+/_-](?=M[A-P]|b3Bl|LS0t)")
_LEAST = 40
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
_MAGIC = b"openssh-key-v1\x00"


def _json(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(header: str, claims: str, signature: str) -> bool:
    head = _json(header)
    if head is None or not isinstance(head.get("alg"), str) or _json(claims) is None:
        return False
    return len(signature) % 4 != 1 and len(signature) >= 16


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end]; None if a length doesn't fit."""
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


#: Tags of a private key's parts: integer, octet string, object identifier, sequence.
_INTEGER, _OCTETS, _IDENTIFIER, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def der_key(data: bytes) -> bool:
    """Whether data is a private key: one DER sequence of a known make, with lengths that fit at every level."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return False
    inner = der_items(data, *top[0][1:])
    if not inner or not _private(data, inner):
        return False
    open_ = [x for x in inner if x[0] in (_SEQUENCE, 0x31, 0xA0, 0xA1)]
    while open_:
        below = der_items(data, *open_.pop()[1:])
        if below is None:
            return False
        open_ += [x for x in below if x[0] in (_SEQUENCE, 0x31, 0xA0, 0xA1)]
    return True


def _private(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """By its parts: a version and integers (RSA, DSA), version 1 and an octet string (EC), a version, an algorithm and an octet string, or an algorithm and what it enciphers."""
    tags = [x[0] for x in parts]

    def named(part: tuple[int, int, int]) -> bool:
        below = der_items(data, *part[1:])
        return bool(below) and below[0][0] == _IDENTIFIER and below[0][2] > below[0][1]

    if tags == [_SEQUENCE, _OCTETS]:
        return named(parts[0])
    version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if tags[0] == _INTEGER and parts[0][2] - parts[0][1] == 1 else -1
    if version not in (0, 1):
        return False
    if len(tags) >= 6 and set(tags[:6]) == {_INTEGER}:
        return parts[1][2] - parts[1][1] >= 32
    if tags[1:2] == [_OCTETS]:
        return version == 1 and parts[1][2] - parts[1][1] >= 16
    return tags[1:3] == [_SEQUENCE, _OCTETS] and named(parts[1])


def openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH key: its magic, then cipher, kdf and options with lengths that fit, and a count of keys."""
    if not data.startswith(_MAGIC):
        return False
    at = len(_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def _decoded(text: str) -> bytes | None:
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _pem_end(data: bytes) -> int:
    """The end of the first sound key block in data; 0 if there is none."""
    if b"-----BEGIN" not in data:
        return 0
    return next((m.end() for m in _PEM.finditer(data.decode("latin-1")) if _block(m)), 0)


def _block(m: re.Match) -> bool:
    """Whether a block's body is a private key, or enciphered by the algorithm that its headers name."""
    body = _decoded("".join(m[3].split()).rstrip("="))
    if body and "ENCRYPTED" in m[2]:
        return bool(_CIPHER.search(m[2])) and len(body) % 8 == 0
    return bool(body) and (der_key(body) or openssh_key(body))


def hex_key(digits: str) -> int | None:
    """The kind of what a hexadecimal run holds: a key, a block or a token; None if neither."""
    data = bytes.fromhex(digits[: len(digits) // 2 * 2])
    if len(digits) % 2 == 0 and der_key(data):
        return 5
    if data.startswith(_MAGIC) and openssh_key(data):
        return 6
    if _pem_end(data):
        return 4
    found = _TOKEN.fullmatch(data.decode("latin-1").strip()) if b"." in data else None
    return 3 if found and signed_token(*found.groups()) else None


def _openssh_end(data: bytes) -> int:
    """The end of an OpenSSH key by its own lengths; 0 if they don't fit."""
    at = len(_MAGIC)
    for k in range(4 + 16):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data):
            return 0
        if k == 3:  # the count of public keys; the private ones are one field after them
            left = n + 1
            at += 4
            continue
        at += 4 + n
        if k > 3 and k - 3 == left:
            return at if at <= len(data) else 0
    return 0


def encoded_keys(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the keys in base64 or base64url, on one line or several: what a run decodes to decides, and its own lengths tell its end."""
    found, run, tried, done = [], None, False, 0
    first = _START.search(text)
    while first:
        start, known = first.start(), first[0].startswith(("M", "b3BlbnNzaC1rZXktdjE", "LS0tLS1"))
        if run is None or start >= run.end():
            run, tried = _RUN.match(text, start), False
            lines = [(m.start(), m.end()) for m in _LINE.finditer(text, start, run.end())]
            joined = "".join(text[a:b] for a, b in lines)
            begins, at = [a for a, _ in lines], [0]
            for a, b in lines:
                at.append(at[-1] + b - a)
            ends = {n: b for n, (_, b) in zip(at[1:], lines, strict=True)}
        k = bisect_right(begins, start) - 1
        s = at[k] + start - lines[k][0]
        end = kind = 0
        if start >= done and len(joined) - s >= _LEAST:
            head = _decoded(joined[s : s + 8]) if known else None
            if head and head[0] == 0x30:
                size = 2 + head[1] if head[1] < 0x80 else 2 + (head[1] & 0x7F) + int.from_bytes(head[2 : 2 + (head[1] & 0x7F)], "big") if 0x81 <= head[1] <= 0x84 else 0
                n = -(-size * 4 // 3)
                if n >= _LEAST and s + n in ends and der_key(_decoded(joined[s : s + n]) or b""):
                    end, kind = ends[s + n], 5
            elif head and joined.startswith("b3BlbnNzaC1rZXktdjE", s):
                whole = _decoded(joined[s : len(joined) - (len(joined) - s) % 4]) or b""
                n = s + -(-_openssh_end(whole + (_decoded(joined[len(joined) - (len(joined) - s) % 4 :]) or b"")) * 4 // 3)
                if n > s and n in ends:
                    end, kind = ends[n], 6
                elif openssh_key(_decoded(joined[s : at[k + 1]]) or b""):
                    end, kind = lines[k][1], 6
            if not end and (joined.startswith("LS0tLS1", s) or not (known or tried)):
                tried = tried or not known
                last = len(joined) - (1 if (len(joined) - s) % 4 == 1 else 0)
                if n := _pem_end(_decoded(joined[s:last]) or b""):
                    n = s + -(-n * 4 // 3)
                    end, kind = next(b for m, b in ends.items() if m >= n), 4
        if end:
            while end < len(text) and text[end] == "=" and text[end - 2 : end] != "==":
                end += 1
            found.append((start, kind, end))
            done = end
        first = _START.search(text, max(done, start + (1 if known else _skip(text, start))))
    return found


def _skip(text: str, start: int) -> int:
    """Up to the next place in a run at which a key may start, or past its line."""
    line = _LINE.match(text, start)
    sign = _SIGN.search(text, start, line.end())
    return sign.end() - start if sign else line.end() - start


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base secrets, and of all, each in order."""
    low = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        low += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = []
    if "." in text:
        more += [(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if signed_token(*m.groups())]
    if "-----BEGIN" in text:
        more += [(m.start(), 4, m.end()) for m in _PEM.finditer(text) if _block(m)]
    blocks = [(a, b) for a, k, b in more if k == 4]
    more += [x for x in encoded_keys(text) if not any(a <= x[0] < b for a, b in blocks)]
    more += [(m.start(), k, m.end()) for m in _HEX_RUN.finditer(text) if (k := hex_key(m[0])) is not None]
    return sorted(low), sorted(low + more)


SHAPE = "array<struct<start: int, kind: string, end: int>>"


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end) for every row of docs."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def of(batches):
        for batch in slices(batches, 1):
            found = [scan(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in x[i]] for x in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, f"doc_id long, base {SHAPE}, spans {SHAPE}")
