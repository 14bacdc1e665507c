"""Secrets by fixed patterns, and keys and tokens confirmed by their structure.

Pattern spans (assignments, access key ids, long hex runs) are found first and
always stay. Then every base64, base64url or hex run that is long enough to hold
a key is decoded and parsed, and reported only if the bytes prove what they are:

* `jwt`: three dot-joined parts whose first decodes to a JSON object with an
  `alg`, and whose second decodes to a JSON object (a signed token), or an
  encrypted token of five parts with `enc`;
* `der`: one DER SEQUENCE whose nested lengths all close exactly at their
  parents' ends and that holds an INTEGER, BIT STRING or OCTET STRING;
* `ssh`: length-prefixed fields of an SSH key, or the `openssh-key-v1` container whose
  nested lengths close at its end around such keys;
* `pem`: an armoured block whose body decodes to one of the two above.

Whole texts are read in one pass without a shuffle. Defined cases: null and empty
texts have no spans; repeated rows are judged one by one; an empty table gives an
empty result; other columns pass through `redact`. Offsets are code points, ends
exclusive.
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

from . import _bytes as B
from ._common import arrow_map, extended, own_names, prepare

KINDS = ("assign", "access", "hex")
#: Fixed values of the contract: names before an assignment, and the least lengths.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: The shortest runs that can hold a key.
LEAST_BASE64, LEAST_KEY_BYTES, MAX_DEPTH = 40, 24, 16

_SIGN = re.compile(r"[:=]")
_VALUE = re.compile(r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Dotted parts from one on that can hold the shortest header, {"alg":""}.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{14,}+(?:\.[A-Za-z0-9_-]*+){2,}+")
_ANY_HEX = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
#: First bytes of the private container.
_CONTAINER = b"openssh-key-v1\0"


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, by start, then kind."""
    if not text:
        return []
    out, free = [], 0
    for sign in _SIGN.finditer(text):
        p = sign.start()
        end = p
        while end > 0 and text[end - 1] == " ":
            end -= 1
        if end > 0 and text[end - 1] in "\"'":
            end -= 1
        tail = text[max(0, end - 8) : end]
        if not tail.isascii():
            tail = tail.encode("ascii", "replace").decode()
        name = next((n for n in NAMES if tail.lower().endswith(n)), None)
        if name is None or end - len(name) < free:
            continue
        if value := _VALUE.match(text, p + 1):
            free = value.end()
            if value.end(1) - value.start(1) >= LEAST["assign"]:
                out.append((end - len(name), 0, free))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _decoded(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run."""
    run = run.rstrip("=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of one DER element within data[at:end]."""
    if at + 2 > end or data[at] & 0x1F == 0x1F:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80 or (n > 1 and size >> 8 * (n - 1) == 0):
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE over all bytes, every nested length closing exactly, with key material inside."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or len(data) < LEAST_KEY_BYTES:
        return False
    stack, material, parts = [(top[1], top[2], 1)], 0, 0
    while stack:
        at, end, depth = stack.pop()
        while at < end:
            element = _tlv(data, at, end)
            if element is None or depth > MAX_DEPTH:
                return False
            tag, begin, stop = element
            parts += 1
            if tag == 0x02 and begin == stop:
                return False
            if tag in (0x02, 0x03, 0x04) and stop - begin >= 16:
                material += 1
            if tag & 0x20:
                stack.append((begin, stop, depth + 1))
            at = stop
    return material > 0 and parts > 1


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields to the last byte, the first an SSH key type; or the private container around such keys."""
    if data.startswith(_CONTAINER):
        # Cipher, key derivation and its options, the number of keys, each public key, and the private part.
        fields, at = _fields(data, len(_CONTAINER), 3)
        if len(fields) < 3 or not fields[0] or not fields[1] or at + 4 > len(data):
            return False
        keys = int.from_bytes(data[at : at + 4], "big")
        if not 1 <= keys <= len(data):
            return False
        parts, end = _fields(data, at + 4, keys + 1)
        return len(parts) == keys + 1 and end == len(data) and all(map(_is_key, parts[:-1])) and len(parts[-1]) >= LEAST_KEY_BYTES
    return _is_key(data)


def _is_key(data: bytes) -> bool:
    fields, at = _fields(data, 0)
    return at == len(data) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def _fields(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int]:
    """Length-prefixed fields from a place on, and where the last whole one ends."""
    fields: list[bytes] = []
    while len(fields) != most and at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            break
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def is_signed_token(run: str) -> bool:
    """A JSON header that names its algorithm, and a JSON or encrypted body."""
    parts = run.split(".")
    try:
        head = json.loads(_decoded(parts[0]) or b"")
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        if len(parts) == 5:
            return isinstance(head.get("enc"), str)
        return len(parts) == 3 and isinstance(json.loads(_decoded(parts[1]) or b""), dict)
    except (ValueError, RecursionError):
        return False


def structured_spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, structure, end) of what its own bytes confirm."""
    if not text:
        return []
    out = []
    for m in _JWT.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 3 <= len(parts):
            runs = [".".join(parts[i : i + n]) for n in (5, 3) if i + n <= len(parts)] if len(parts[i]) >= 14 else []
            run = next((r for r in runs if is_signed_token(r)), None)
            if run is not None:
                out.append((at, "jwt", at + len(run)))
            taken = 1 if run is None else run.count(".") + 1
            at += sum(len(p) + 1 for p in parts[i : i + taken])
            i += taken
    if "-----BEGIN " in text:
        begin = None  # an armoured block holds no other marker, so each marker is looked at once
        for m in _PEM.finditer(text):
            if m[1] == "BEGIN":
                begin = m
                continue
            if begin is None or begin[2] != m[2]:
                begin = None
                continue
            lines = [x.strip() for x in text[begin.end() : m.start()].splitlines()]
            data = _decoded("".join(x for x in lines if x and ":" not in x))
            if data and (is_der_key(data) or is_ssh_key(data)):
                out.append((begin.start(), "pem", m.end()))
            begin = None
    begins, ends = [], []  # what is confirmed so far, by rising begins, with the furthest end up to each
    for a, _, b in sorted(out):
        begins.append(a)
        ends.append(max(b, ends[-1]) if ends else b)
    for m in _RUN.finditer(text):
        a, b = m.span()
        k = bisect_right(begins, a)
        if k and b <= ends[k - 1]:
            continue
        run = m[0]
        options = [binascii.unhexlify(run)] if _ANY_HEX.fullmatch(run) else []
        options.append(_decoded(run))
        for data in options:
            if data and is_der_key(data):
                out.append((a, "der", b))
                break
            if data and is_ssh_key(data):
                out.append((a, "ssh", b))
                break
    return sorted(out)


def _find_pass(batches, col: int):
    for batch in batches:
        for a, b in B.slices(batch.column(col), 1_000_000):
            part = batch.slice(a, b - a)
            base, every, confirmed, clean = [], [], [], []
            counts: list[list[int]] = [[], [], []]
            for text in part.column(col).to_pylist():
                own = base_spans(text)
                more = structured_spans(text)
                named = [(s, k, KINDS[k], e) for s, k, e in own]
                base.append(",".join(f"{n}:{s}:{e}" for s, _, n, e in named))
                every.append(",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(named + [(s, 3, n, e) for s, n, e in more])))
                confirmed.append(len(more))
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in own))
                if own or more:
                    out, place = [], 0
                    for s, e in sorted([(s, e) for s, _, e in own] + [(s, e) for s, _, e in more]):
                        if s >= place:
                            out += [text[place:s], "[SECRET]"]
                        place = max(place, e)
                    text = "".join(out) + text[place:]
                clean.append(text)
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(confirmed, pa.int64()), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(f"n_{k}" for k in KINDS), "base", "spans", "n_confirmed", "clean"])


def scan(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Columns of documents as in_0, in_1, ... with counts, base, spans, n_confirmed and the redacted text `clean`."""
    prepare(documents.sparkSession)
    plain, text = own_names(documents, text_col)
    at = plain.columns.index(text)
    added = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string, n_confirmed bigint, clean string"
    return arrow_map(plain, lambda batches: _find_pass(batches, at), extended(plain.schema, added))


def redact(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Documents with every span replaced by [SECRET]."""
    found = scan(documents, text_col=text_col)
    return found.select(*[F.col("clean" if c == text_col else f"in_{i}").alias(c) for i, c in enumerate(documents.columns)])


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns and the number of confirmed structures, one row per document."""
    found = scan(documents.select("doc_id", "text"))
    return found.select(F.col("in_0").alias("doc_id"), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_confirmed")
