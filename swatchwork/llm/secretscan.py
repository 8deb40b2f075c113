"""Secret scans that confirm by structure: what looks like base64 or hex is decoded, and only a key or token that parses is reported.

Besides three plain patterns, whose matches always stay, two kinds of spans are added. ``private_key``: DER (PKCS#1, SEC 1,
PKCS#8, encrypted PKCS#8, DSA) whose nested lengths fit exactly, or an OpenSSH key whose length-prefixed fields do, in hex or
base64, bare or in PEM armour, in one line or several. ``signed_token``: three base64url parts with a JSON header that names
an algorithm and a signature as long as it asks for, or the five parts of an encrypted token.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch

KINDS = ["assign", "access", "hex", "private_key", "signed_token"]
BASE = KINDS[:3]
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,structure:string>>"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Bytes of base64 with either alphabet; a shorter run than this holds neither a base span nor a key or token.
_CODE = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
LEAST_RUN = 20
_RUN, _PAD = re.compile(rb"[A-Za-z0-9+/_-]+"), re.compile(rb"={1,2}")
_BREAK = re.compile(rb"""(?:[\x20\t"'+,]{0,8}(?:\r?\n|\\r\\n|\\n)[\x20\t"'>]{0,40})""")
#: How a DER sequence or an OpenSSH key begins in base64 and in hex.
_BEGINS = re.compile(rb"M[A-P][A-Za-z0-9+/_-]{10}|b3BlbnNzaC1rZXktdjEA")
_HEX_BEGINS = re.compile(rb"30(?:81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6}|[0-7][0-9a-f])(?:02010[01]|30)|6f70656e7373682d6b65792d763100", re.I)
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]+")
_MAGIC = b"openssh-key-v1\0"
_ARMOUR = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:\s|\\r|\\n)*\Z"), re.compile(rb"(?:\s|\\r|\\n)*-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_ARMOUR_CHARS = 90
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
#: Bytes of a signature by algorithm (RFC 7518, RFC 8037); RSA has as many as its modulus.
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA_SIGNATURE = 128
#: The content octets of object identifiers.
OIDS = {
    bytes.fromhex("2a864886f70d010101"): "rsa",
    bytes.fromhex("2a8648ce3d0201"): "ec",
    bytes.fromhex("2a8648ce380401"): "dsa",
    bytes.fromhex("2b656e"): "x25519",
    bytes.fromhex("2b656f"): "x448",
    bytes.fromhex("2b6570"): "ed25519",
    bytes.fromhex("2b6571"): "ed448",
}
_PBE = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")
_CURVE_BYTES = {"x25519": 32, "ed25519": 32, "x448": 56, "ed448": 57}
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def item(data: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the DER item at ``at``; None if its length isn't minimal or passes ``stop``."""
    if at + 2 > stop:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > stop:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or size >> 8 * (n - 1) == 0:
            return None
        at += n
    return (tag, at, at + size) if at + size <= stop else None


def items(data: bytes, at: int, stop: int) -> list[tuple[int, int, int]] | None:
    """All items from ``at`` on, if they fill the bytes up to ``stop`` exactly."""
    found = []
    while at < stop:
        if (x := item(data, at, stop)) is None:
            return None
        found.append(x)
        at = x[2]
    return found


def whole_size(head: bytes) -> int | None:
    """Bytes of the sequence whose first bytes are given, from its own length."""
    if (x := item(head, 0, 1 << 62)) is None or x[0] != SEQUENCE:
        return None
    return x[2]


def der_key(data: bytes) -> str | None:
    """Which private key the bytes are, all of them, or None."""
    if (top := item(data, 0, len(data))) is None or top[0] != SEQUENCE or top[2] != len(data) or not (parts := items(data, *top[1:])):
        return None
    tags = [t for t, *_ in parts]
    value = lambda k: data[parts[k][1] : parts[k][2]]
    if tags[0] == INTEGER and value(0) in (b"\0", b"\1"):
        integers = all(t == INTEGER and b > a for t, a, b in parts[:9])
        if len(tags) in (9, 10) and integers and tags[9:] in ([], [SEQUENCE]):
            return "rsa"
        if len(tags) == 6 and integers:
            return "dsa"
        if tags[1:2] == [OCTETS] and value(0) == b"\1" and 14 <= len(value(1)) <= 72 and set(tags[2:]) <= {0xA0, 0xA1} and all(items(data, a, b) for _, a, b in parts[2:]):
            return "ec"
        if tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            kind = items(data, *parts[1][1:])
            if not kind or kind[0][0] != OID:
                return None
            name = OIDS.get(data[kind[0][1] : kind[0][2]], "other")
            inner = value(2)
            if name in ("rsa", "ec"):
                return f"pkcs8 {name}" if der_key(inner) == name else None
            held = item(inner, 0, len(inner))
            if held is None or held[2] != len(inner):
                return None
            if name in _CURVE_BYTES:
                return f"pkcs8 {name}" if held[0] == OCTETS and held[2] - held[1] == _CURVE_BYTES[name] else None
            return f"pkcs8 {name}"
    if tags == [SEQUENCE, OCTETS]:
        kind = items(data, *parts[0][1:])
        if kind and kind[0][0] == OID and data[kind[0][1] : kind[0][2]].startswith(_PBE) and len(value(1)) >= 16:
            return "encrypted pkcs8"
    return None


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    size = int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : at + 4 + size], at + 4 + size) if at + 4 + size <= len(data) and at + 4 <= len(data) else None


def openssh_key(data: bytes) -> tuple[str, int] | None:
    """The kind of OpenSSH key that the bytes begin with, and how many bytes it has; every length-prefixed field must fit."""
    if not data.startswith(_MAGIC):
        return None
    at, fields = len(_MAGIC), []
    for _ in range(3):  # cipher, key derivation, its options
        if (x := _field(data, at)) is None:
            return None
        fields.append(x[0])
        at = x[1]
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return None
    for _ in range(count):
        if (x := _field(data, at)) is None or (name := _field(x[0], 0)) is None or not re.fullmatch(rb"[a-z0-9@.-]+", name[0]):
            return None
        at = x[1]
    if (secret := _field(data, at)) is None or len(secret[0]) < 8:
        return None
    if fields[0] == b"none":
        own = _field(secret[0], 8)
        if secret[0][:4] != secret[0][4:8] or own is None or own[0] != name[0]:
            return None
    return f"openssh {name[0].decode()}" + ("" if fields[0] == b"none" else " encrypted"), secret[1]


def _decoded(code: bytes) -> bytes | None:
    code = code.translate(bytes.maketrans(b"-_", b"+/"))
    try:
        return base64.b64decode(code + b"=" * (-len(code) % 4), validate=True)
    except binascii.Error:
        return None


def _gather(text: bytes, at: int, chars: int | None) -> tuple[bytes, int]:
    """So many base64 characters from ``at`` on (None: all there are), over line breaks; and where they end."""
    found, have = [], 0
    while run := _RUN.match(text, at):
        take = run[0] if chars is None else run[0][: chars - have]
        if chars is None and take.endswith(b"-----"):
            take = take.rstrip(b"-")
        found.append(take)
        have, end = have + len(take), at + len(take)
        if have == chars or not (cut := _BREAK.match(text, end)):
            return b"".join(found), end
        at = cut.end()
    return b"".join(found), end if found else at


def _base64_key(text: bytes, at: int) -> tuple[str, int] | None:
    """The key whose base64 begins at ``at``, and where it ends."""
    if text.startswith(b"b3Bl", at):
        code, end = _gather(text, at, None)
        data = _decoded(code[: len(code) // 4 * 4])
        got = openssh_key(data + (_decoded(code[len(code) // 4 * 4 :]) or b"")) if data else None
        if got is None:
            return None
        exact = -(-got[1] * 4 // 3)
        return got[0], _gather(text, at, exact)[1]
    head = _decoded(text[at : at + 12])
    if head is None or (size := whole_size(head)) is None or head[2 + (head[1] & 0x7F) * (head[1] >= 0x80)] not in (INTEGER, SEQUENCE):
        return None
    code, end = _gather(text, at, -(-size * 4 // 3))
    if len(code) * 3 // 4 < size or (data := _decoded(code)) is None:
        return None
    name = der_key(data[:size])
    return (name, end) if name else None


def _in_armour(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The span with the padding and PEM lines around it, where there are any."""
    if pad := _PAD.match(text, end):
        end = pad.end()
    before = text[max(0, start - _ARMOUR_CHARS) : start]
    if (head := _ARMOUR[0].search(before)) and (tail := _ARMOUR[1].match(text, end)):
        return start - len(before) + head.start(), tail.end()
    return start, end


def keys(text: bytes) -> Iterator[tuple[int, int, str]]:
    """Private keys in base64 or hex: begin, end and what was parsed, none inside another."""
    found, free = [], 0
    at = _BEGINS.search(text)
    while at:
        after = at.start() + 1
        if got := _base64_key(text, at.start()):
            start, end = _in_armour(text, at.start(), got[1])
            found.append((start, end, got[0]))
            after = end
        at = _BEGINS.search(text, after)
    for run in _HEX_RUN.finditer(text):
        if run.end() - run.start() < 2 * LEAST_RUN:
            continue
        at = _HEX_BEGINS.search(run[0])
        while at:
            data = bytes.fromhex(run[0][at.start() : len(run[0]) - (len(run[0]) - at.start()) % 2].decode())
            size = whole_size(data)
            got = openssh_key(data) if data[:1] == b"o" else (name, size) if size and size <= len(data) and (name := der_key(data[:size])) else None
            free = at.start() + (2 * got[1] if got else 1)
            if got:
                found.append((run.start() + at.start(), run.start() + free, got[0]))
            at = _HEX_BEGINS.search(run[0], free)
    last = 0
    for start, end, name in sorted(found):
        if start >= last:
            yield start, end, name
            last = end


def token(code: bytes) -> str | None:
    """What the dotted base64url parts are: a signed or an encrypted token, or None."""
    parts = code.split(b".")
    try:
        header = json.loads(_decoded(parts[0]) or b"")
    except ValueError:
        return None
    if not isinstance(header, dict) or not isinstance(name := header.get("alg"), str):
        return None
    if len(parts) == 5:
        return f"encrypted {name}" if isinstance(header.get("enc"), str) and all(parts[2:]) else None
    if len(parts) != 3 or not parts[1] or (signature := _decoded(parts[2])) is None or _decoded(parts[1]) is None:
        return None
    fits = len(signature) in SIGNATURES[name] if name in SIGNATURES else len(signature) >= (RSA_SIGNATURE if name[:2] in ("RS", "PS") else 16)
    return f"signed {name}" if fits and name.lower() != "none" else None


def tokens(text: bytes) -> Iterator[tuple[int, int, str]]:
    for m in _TOKEN.finditer(text):
        parts = m[0].split(b".")
        for n in (5, 3):
            if len(parts) >= n and (what := token(b".".join(parts[:n]))):
                yield m.start(), m.start() + len(b".".join(parts[:n])), what
                break


def scan(text: bytes) -> list[tuple[int, int, int, str | None]]:
    """Start, place in KINDS, end and structure of all spans of a text, in bytes, in order of start and kind."""
    found: list[tuple[int, int, int, str | None]] = [(a, 3, b, what) for a, b, what in keys(text)]
    found += [(a, 4, b, what) for a, b, what in tokens(text)]
    sure = sorted(found)
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    # a base span is confirmed by the first structure that it meets
    k, base = 0, sorted(base)
    for start, kind, end in base:
        while k < len(sure) and sure[k][2] <= start:
            k += 1
        found.append((start, kind, end, sure[k][3] if k < len(sure) and sure[k][0] < end else None))
    return sorted(found, key=lambda x: (x[0], x[1], x[2]))


def _suspects(piece: textbatch.Piece) -> np.ndarray:
    """Rows of a piece with a word of the plain pattern or a run of base64 characters that is long enough; no other has a span."""
    code = _CODE[piece.data]
    edge = np.flatnonzero(code[1:] != code[:-1]) + 1
    # runs that go on over a row's end only make a row more suspect
    starts, ends = np.concatenate([[0], edge]), np.append(edge, len(code))
    long = (ends - starts >= LEAST_RUN) & (code[starts] if len(code) else False)
    places = [starts[long], ends[long] - 1]
    low = textbatch.LOWER[piece.data].tobytes()
    for word in _WORDS:
        at = low.find(word)
        while at >= 0:
            places.append(np.array([at]))
            at = low.find(word, at + 1)
    rows = np.unique(piece.row_of(np.concatenate(places)))
    # a long run may reach over several short rows
    if len(long) and long.any():
        inside = np.zeros(piece.n + 1, np.int64)
        np.add.at(inside, piece.row_of(starts[long]), 1)
        np.add.at(inside, piece.row_of(ends[long] - 1) + 1, -1)
        rows = np.union1d(rows, np.flatnonzero(np.cumsum(inside[:-1])))
    return rows


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("structure", pa.string())]))
    for batch in batches:
        for piece in textbatch.pieces(batch.column("text")):
            spans: list[list[dict]] = [[] for _ in range(piece.n)]
            for row in _suspects(piece) if len(piece.data) else ():
                data = piece.data[piece.starts[row] : piece.starts[row + 1]]
                if found := scan(data.tobytes()):
                    chars = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                    spans[row] = [{"kind": KINDS[k], "start": int(chars[a]), "end": int(chars[b]), "structure": what} for a, k, b, what in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(piece.first, piece.n).cast(pa.int64()), pa.array(spans, kind)], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans), a row for each row of ``docs`` (doc_id, text), in one pass without a shuffle.

    ``spans`` has kind, start and end (code points, end exclusive) and what was parsed, in order of start, kind and end. The
    plain kinds (assign, access, hex) stay whether or not anything parses in them; ``structure`` is null if nothing does.

    Null and empty texts have no spans. Whole texts of any length are searched. Repeated rows give repeated results, a null
    doc_id stays null, an empty table gives an empty table; other columns are not looked at.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search, SCHEMA)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(common.table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(of(k) for k in BASE), F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"), told("spans").alias("spans"))
