"""Secret scans with structural confirmation.

Base spans come from three patterns (an assignment to a secret's name, an access
key id, a long hex run). The structural kinds are candidates in base64 or hex
that are decoded and parsed before they are reported:

* ``der``: bytes that are one ASN.1 SEQUENCE whose nested lengths close exactly
  and which starts like a private key (a small version INTEGER, then an INTEGER, an
  OCTET STRING or an algorithm identifier) or is an encrypted one (the identifier of a
  password-based cipher, then an OCTET STRING); with or without PEM armour;
* ``ssh``: length-prefixed blobs of private keys (``openssh-key-v1``) whose lengths
  close exactly; a public key is no secret;
  base64 of both may be broken into lines, also by a literal ``\\n``; the structure's
  lengths say where a key ends, and its line must end there as well. A key in hex is cut
  by its lengths, whatever hex follows;
* ``token``: three dot-separated base64url parts whose first is a JSON object with
  an ``alg``, and whose second is a JSON object.

Spans are in code points, end exclusive. Defined results: null is an empty text;
text of any length is scanned whole; rows are independent of each other, so ties
and repeated rows need no rule; extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import text as T

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "der", "ssh", "token")
BASE = KINDS[:3]

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")  # a maximal run starts where a run of any length would
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: A line break, or one that is written as an escape (in JSON and environment files).
_BREAK = rb"(?:\r?\n|(?:\\r)?\\n)"
#: Base64 of a SEQUENCE starts with "M", of a key blob with that of the text "openssh-key".
_START = re.compile(rb"(?:(?<![A-Za-z0-9+/])|(?<=\\n))(?=(?:M[A-P]|b3Bl)(?:[A-Za-z0-9+/]|" + _BREAK + rb"){30})")
_LINE = re.compile(_BREAK + rb"?([A-Za-z0-9+/]+)")
_PADDING = re.compile(_BREAK + rb"?={1,2}")
_GOES_ON = re.compile(rb"[A-Za-z0-9+/]")
MIN_CHARS = 32
_HEX_DER = re.compile(rb"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
#: Identifiers of password-based ciphers (fixed values), as they begin.
_PASSWORD_BASED = (bytes.fromhex("06092a864886f70d0105"), bytes.fromhex("060a2a864886f70d010c01"))

#: Markers that must occur for a pattern to match at all.
_NAMES = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)


def der_bounds(data: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the content of the ASN.1 value at ``at``, by its header."""
    if at + 2 > len(data):
        return None
    size, start = data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or start + width > len(data) or data[start] == 0:
            return None
        size = int.from_bytes(data[start:start + width], "big")
        start += width
        if size < 0x80:
            return None
    return start, start + size


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """The same; None if the value isn't whole in ``data``."""
    found = der_bounds(data, at)
    return found if found and found[1] <= len(data) else None


def is_private_der(data: bytes) -> bool:
    """One SEQUENCE that fills ``data``, of values that fill it, beginning like a private key."""
    whole = der_length(data, 0)
    if not data or data[0] != 0x30 or whole is None or whole[1] != len(data):
        return False
    at, tags, version, cipher = whole[0], [], None, False
    while at < len(data):
        inner = der_length(data, at)
        if inner is None:
            return False
        if not tags and data[at] == 0x02:
            version = data[inner[0]:inner[1]]
        if not tags and data[at] == 0x30:
            cipher = data.startswith(_PASSWORD_BASED, inner[0])
        if data[at] == 0x30 and not _closes(data, *inner):
            return False
        tags.append(data[at])
        at = inner[1]
    plain = version in (b"\x00", b"\x01") and len(tags) >= 2 and tags[1] in (0x02, 0x04, 0x30)
    return plain or cipher and tags == [0x30, 0x04]


def _closes(data: bytes, at: int, end: int) -> bool:
    while at < end:
        inner = der_length(data[:end], at)
        if inner is None:
            return False
        at = inner[1]
    return at == end


def _openssh_end(take) -> int | None:
    """Length in bytes of the blob of private keys that begins ``take``'s bytes."""
    at = 15
    for _ in range(3):
        if len(data := take(at + 4)) < at + 4:
            return None
        at += 4 + int.from_bytes(data[at:], "big")
    # Cipher, its key derivation and options are followed by the number of keys, these and the private part.
    if len(data := take(at + 4)) < at + 4 or not 0 < (keys := int.from_bytes(data[at:], "big")) < 1 << 16:
        return None
    at += 4
    for _ in range(keys + 1):
        if len(data := take(at + 4)) < at + 4:
            return None
        at += 4 + int.from_bytes(data[at:], "big")
    return at if len(take(at)) == at else None


def is_signed_token(header: bytes, payload: bytes) -> bool:
    try:
        parts = [json.loads(base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4))) for p in (header, payload)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


class _Run:
    """Base64 over one or more lines from ``start`` on, decoded as far as it is asked for."""

    def __init__(self, data: bytes, start: int):
        self.data, self.start, self.at = data, start, start
        self.packed, self.lines, self.open = bytearray(), [], True

    def take(self, size: int) -> bytes:
        """The first ``size`` bytes, or what there is; nothing is decoded for more than the text can hold."""
        chars = -(-size * 4 // 3)
        if chars > len(self.data) - self.start:
            return b""
        while self.open and len(self.packed) < chars:
            line = _LINE.match(self.data, self.at)
            self.open = line is not None
            if line:
                self.lines.append((len(self.packed), line.start(1)))
                self.packed += line[1]
                self.at = line.end()
        whole = bytes(self.packed[:chars])
        # One character more than a multiple of four holds no byte.
        whole = whole[:-1] if len(whole) % 4 == 1 else whole
        return base64.b64decode(whole + b"=" * (-len(whole) % 4))[:size]

    def end(self, size: int) -> int | None:
        """Where the first ``size`` bytes end, if their last line or its padding does; they must have been taken."""
        chars = -(-size * 4 // 3)
        first, start = self.lines[bisect.bisect_left(self.lines, (chars,)) - 1]
        end = start + chars - first
        if end - self.start < MIN_CHARS or _GOES_ON.match(self.data, end):
            return None
        padding = _PADDING.match(self.data, end)
        return padding.end() if padding else end


def _key_at(data: bytes, start: int) -> tuple[int, str] | None:
    """End and kind of the key whose base64 begins at ``start``; its own lengths say where it ends."""
    run = _Run(data, start)
    if data[start:start + 1] == b"M":
        size = _der_size(run.take)
        if size is None or not is_private_der(run.take(size)):
            return None
        end = run.end(size)
        return end and (end, "der")
    if run.take(15) != b"openssh-key-v1\0" or not (size := _openssh_end(run.take)):
        return None
    end = run.end(size)
    return end and (end, "ssh")


def _der_size(take) -> int | None:
    """Length in bytes of a SEQUENCE that may be a private key.

    The headers of its values are followed to its end, so what doesn't close is
    given up at its first odd header and not decoded further.
    """
    head = take(24)
    if len(head) < 24 or head[0] != 0x30 or (whole := der_bounds(head, 0)) is None:
        return None
    at, size = whole
    inner = der_bounds(head, at)
    plain = head[at:at + 2] == b"\x02\x01" and head[at + 2:at + 3] in (b"\0", b"\1")
    if not plain and not (head[at] == 0x30 and inner and head.startswith(tuple(p[:24 - inner[0]] for p in _PASSWORD_BASED), inner[0])):
        return None
    while at < size:
        if (inner := der_bounds(take(min(at + 6, size)), at)) is None:
            return None
        at = inner[1]
    return size if at == size else None


def _hex_key(run: bytes) -> int | None:
    """Digits of the private key that a run of hex digits begins with."""
    def take(size: int) -> bytes:
        return bytes.fromhex(run[:2 * size].decode()) if 2 * size <= len(run) else b""
    size = _der_size(take)
    return 2 * size if size and is_private_der(take(size)) else None


def scan(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of UTF-8, by start and then kind."""
    spans = []
    if _NAMES.search(data):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(data) if len(m[1]) >= 8]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(data) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(data)]
    reach = 0
    for m in _START.finditer(data):
        if m.start() >= reach and (key := _key_at(data, m.start())):
            reach = key[0]
            spans.append((m.start(), *key))
    spans += [(m.start(), m.start() + size, "der") for m in _HEX_DER.finditer(data) if (size := _hex_key(m[0]))]
    spans += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(data) if is_signed_token(m[1], m[2])]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _in_code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans start and end on ASCII characters, so code points before them are counted piecewise."""
    at = points = 0
    found = {}
    for edge in sorted({e for start, end, _ in spans for e in (start, end)}):
        points += len(data[at:edge].decode())
        at = edge
        found[edge] = points
    return [(found[start], found[end], kind) for start, end, kind in spans]


def _texts(batch: pa.RecordBatch):
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _scanner(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in batches:
        found = [_in_code_points(data, scan(data)) for data in _texts(batch)]
        spans = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in row] for row in found], kind)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (array of start, end, kind) of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return T.map_batches(
        docs.select("doc_id", "text"), _scanner,
        f"doc_id {id_type}, spans array<struct<start: bigint, end: bigint, kind: string>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts by base kind, a hash of the base spans, and all spans as one string."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return secrets(docs).select("doc_id", *(number(kind) for kind in KINDS),
                                F.sha2(written(base), 256).alias("base_sha256"),
                                written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by its kind in brackets; an integer ``n_chars`` follows the text.

    Overlapping spans are replaced together under the kind of the first. Null stays null.
    """
    schema = docs.schema

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            changed = {}
            for i, data in enumerate(_texts(batch)):
                if spans := scan(data):
                    changed[i] = _without(data, spans).decode()
            if changed:
                texts = column.to_pylist()
                for i, new in changed.items():
                    texts[i] = new
                columns = {n: batch.column(n) for n in batch.schema.names}
                columns["text"] = pa.array(texts, column.type)
                if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                    sizes = columns["n_chars"].to_pylist()
                    for i, new in changed.items():
                        sizes[i] = len(new)
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
            yield batch

    return T.map_batches(docs, run, schema)


def _without(data: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    out, at, reach = [], 0, -1
    for start, end, kind in spans:
        if start >= reach:
            out += [data[at:max(start, at)], f"[{kind}]".encode()]
        at = reach = max(reach, end)
    return b"".join([*out, data[at:]])


def base_sha256(spans: list[tuple[int, int, str]]) -> str:
    """The digest's hash for (start, end, kind) spans of base kinds, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
