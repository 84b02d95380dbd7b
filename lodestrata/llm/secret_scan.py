"""Secrets in texts: patterns, and encoded keys and tokens that are reported only once their structure is confirmed.

A candidate is a place where base64 or hex could begin one of these, judged by its first characters
alone. It is decoded, across folded lines if need be, and parsed before anything is reported:
* DER private keys (PKCS #1, DSA, SEC 1, PKCS #8 plain and encrypted): tags, minimal lengths and every nested length must add up, and
  the outermost length says where the key ends, whatever follows it in the text;
* OpenSSH private keys: all length-prefixed fields must fill the key exactly;
* signed and encrypted tokens (three or five parts): the header must be a JSON object that names its algorithm, and all parts must decode;
* base64 of a whole armoured key, as configuration files hold it, is decoded and searched once more;
* armoured keys under a passphrase (DEK-Info): the body must be whole cipher blocks.

Texts are read whole where they lie; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds of spans: three by pattern alone, the others by structure. Spans that begin at one place come in this order.
BASE = ("assign", "access", "hex")
CONFIRMED = ("pkcs1", "dsa", "sec1", "pkcs8", "encrypted", "openssh", "jws", "jwe")
#: No key is longer than this when decoded (an RSA key of 16384 bits has some 9300 bytes), so a false start costs no more than this.
MOST_KEY_BYTES = 1 << 16

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_VALUE = 12

#: Where an encoded key or token may begin: SEQUENCE with a length (MA to MI), openssh-key-v1, -----BEGIN, a brace, hex of SEQUENCE, armour.
_START = re.compile(
    r"(?:(?<![A-Za-z0-9])|(?<=\\n))(?:(?P<der>M[A-I](?=[A-Za-z0-9+/_-]{22}))|(?P<ssh>b3BlbnNzaC1rZXktdjEA)|(?P<nested>LS0tLS1CRUdJTi)|(?P<hex>30(?=[0-9A-Fa-f]{30}))"
    r"|(?P<token>(?<![_-])e[yw](?=[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.)))|(?P<armour>-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
_TOKEN = re.compile(r"([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+))?")
#: Pieces of folded base64: characters, or one line end (as such or written as an escape) with indentation.
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+|(?:\r?\n|(?:\\r)?\\n)[ \t]*(?=[A-Za-z0-9+/_-])")
_INDENT = 256
_PADDING = re.compile(r"={0,2}")
_BODY = re.compile(r"((?:[A-Za-z0-9+/]{4}\s*){16,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)(?<!\s)\s*-----END")
_ARMOUR, _SHORT_NAME = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(rb"openssh-key-v1\0\0\0\0[\1-\x40]")
_ARMOUR_END = re.compile(rb"-----END [A-Z ]*-----\n?")
_DEK = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]+\s+")

#: Object identifiers of RSA, EC, X25519, X448, Ed25519 and Ed448 keys, and prefixes of password-based encryption.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """A DER length at a place, and where the content begins; None unless it is written in the shortest way."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    value = int.from_bytes(data[at + 1 : at + 1 + n])
    if not 1 <= n <= 3 or at + 1 + n > len(data) or value < 0x80 or value < 1 << 8 * (n - 1):
        return None
    return value, at + 1 + n


def _children(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill data exactly; None if they do not."""
    found, at = [], 0
    while at < len(data):
        size = _length(data, at + 1)
        if size is None or size[1] + size[0] > len(data):
            return None
        found.append((data[at], data[size[1] : size[1] + size[0]]))
        at = size[1] + size[0]
    return found


def _inside(data: bytes, tag: int = _SEQUENCE) -> list[tuple[int, bytes]] | None:
    """The children of the one element of this tag that data consists of."""
    outer = _children(data)
    return _children(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == tag else None


def key_kind(data: bytes) -> str | None:
    """Which private key these bytes are, if their nested structure is one."""
    parts = _inside(data)
    if not parts:
        return None
    tags = [t for t, _ in parts]
    if tags == [_SEQUENCE, _OCTETS]:
        way = _children(parts[0][1])
        known = way and way[0][0] == _OID and way[0][1].startswith(_PASSWORD_BASED)
        return "encrypted" if known and parts[1][1] and len(parts[1][1]) % 8 == 0 else None
    if tags[0] != _INTEGER or parts[0][1] not in (b"\0", b"\1"):
        return None
    version = parts[0][1][0]
    if set(tags) == {_INTEGER}:
        whole = all(v and not v[0] & 0x80 and (len(v) == 1 or v[0] or v[1] & 0x80) for _, v in parts)
        if whole and len(parts) == 9 and len(parts[1][1]) >= 64 > len(parts[2][1]):
            return "pkcs1"
        return "dsa" if whole and version == 0 and len(parts) == 6 and len(parts[1][1]) >= 64 else None
    if version == 1 and tags[1] == _OCTETS and all(t in (0xA0, 0xA1) for t in tags[2:]):
        nested = [_children(v) for _, v in parts[2:]]
        return "sec1" if 20 <= len(parts[1][1]) <= 72 and all(n and len(n) == 1 for n in nested) else None
    if tags[1:3] == [_SEQUENCE, _OCTETS] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        way, held = _children(parts[1][1]), parts[2][1]
        if not way or way[0][0] != _OID:
            return None
        kind, inner = way[0][1], None
        if kind == _RSA:
            inner = key_kind(held) == "pkcs1"
        elif kind == _EC:
            inner = key_kind(held) == "sec1"
        elif kind in _CURVES:
            one = _children(held)
            inner = bool(one) and len(one) == 1 and one[0][0] == _OCTETS and len(one[0][1]) == _CURVES[kind]
        else:
            inner = bool(_children(held))
        return "pkcs8" if inner else None
    return None


def openssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that data begins with, by its length-prefixed fields; None if it is none."""
    if not data.startswith(b"openssh-key-v1\0"):
        return None
    at = 15

    def take() -> bytes:
        nonlocal at
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            raise ValueError("a field is longer than the key")
        at += 4 + size
        return data[at - size : at]

    try:
        cipher, derivation, _ = take(), take(), take()
        keys = int.from_bytes(data[at : at + 4])
        at += 4
        public = [take() for _ in range(keys)] if 1 <= keys <= 64 else []
        private = take()
    except ValueError:
        return None
    named = all(0 < int.from_bytes(p[:4]) <= len(p) - 4 for p in public)
    return at if cipher and derivation and public and named and private and len(private) % 8 == 0 else None


def _decoded(text: str, at: int, most: int) -> tuple[bytes, list[int]]:
    """Up to `most` bytes of folded base64 from a place on, and the place after each piece with its character count."""
    chars, want, ends = [], -(-most * 4 // 3), []
    have = 0
    while have < want and (piece := _PIECE.match(text, at, at + want - have + _INDENT)):
        at = piece.end()
        if piece[0][0] not in "\r\n\\":
            chars.append(piece[0] if have + len(piece[0]) <= want else piece[0][: want - have])
            have += len(chars[-1])
            ends.append((have, piece.start() + len(chars[-1])))
    joined = "".join(chars).translate({ord("-"): "+", ord("_"): "/"})
    joined = joined[: len(joined) - (len(joined) % 4 == 1)]
    return base64.b64decode(joined + "=" * (-len(joined) % 4))[:most], ends


def _begins_like_a_key(content: bytes) -> bool:
    """Whether a sequence begins with a version or with another sequence; spares decoding the rest of most false starts."""
    return content.startswith((b"\2\1\0", b"\2\1\1", b"\x30"))


def _der_end(text: str, at: int) -> tuple[str, int] | None:
    head, _ = _decoded(text, at, 16)
    size = _length(head, 1) if head[:1] == b"\x30" else None
    if size is None or sum(size) > MOST_KEY_BYTES or not _begins_like_a_key(head[size[1] :]):
        return None
    data, ends = _decoded(text, at, sum(size))
    kind = key_kind(data) if len(data) == sum(size) else None
    return kind and (kind, _PADDING.match(text, ends[-1][1]).end())


def _ends_after(text: str, at: int, most: int) -> int:
    """Where the base64 of so many bytes ends, padding included."""
    return _PADDING.match(text, _decoded(text, at, most)[1][-1][1]).end()


def _ssh_end(text: str, at: int) -> tuple[str, int] | None:
    if not _SHORT_NAME.match(_decoded(text, at, 24)[0]):
        return None
    size = openssh_length(_decoded(text, at, MOST_KEY_BYTES)[0])
    return size and ("openssh", _ends_after(text, at, size))


def _hex_end(text: str, at: int) -> tuple[str, int] | None:
    head = bytes.fromhex(text[at : at + 32])
    size = _length(head, 1)
    if size is None or sum(size) > MOST_KEY_BYTES or not _begins_like_a_key(head[size[1] :]):
        return None
    body = text[at : at + 2 * sum(size)]
    try:
        kind = key_kind(binascii.unhexlify(body))
    except ValueError:
        return None
    return kind and (kind, at + len(body))


def _nested_end(text: str, at: int) -> tuple[str, int] | None:
    if not _ARMOUR.match(_decoded(text, at, 48)[0]):
        return None
    data = _decoded(text, at, 2 * MOST_KEY_BYTES)[0]
    end = _ARMOUR_END.search(data)
    inner = confirmed_spans(data[: end.end()].decode("ascii", "replace"), nested=False) if end else None
    return (inner[0][0], _ends_after(text, at, end.end())) if inner else None


def _armour_end(text: str, at: int) -> tuple[str, int] | None:
    """An armoured key under a passphrase; other armoured keys are found by what they hold."""
    dek = _DEK.match(text, at)
    body = _BODY.match(text, dek.end(), dek.end() + 2 * MOST_KEY_BYTES) if dek else None
    size = body and len(base64.b64decode(body[1]))
    return ("encrypted", body.end(1)) if size and size >= 64 and size % 8 == 0 else None


def _part(text: str) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_", validate=True)
    except ValueError:
        return None


def _object(text: str) -> dict | None:
    try:
        value = json.loads(_part(text) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _token_end(text: str, at: int) -> tuple[str, int] | None:
    found = _TOKEN.match(text, at)
    header = _object(found[1]) if found else None
    algorithm = header and header.get("alg")
    if not algorithm or not isinstance(algorithm, str):
        return None
    if isinstance(header.get("enc"), str):
        parts = [p and _part(p) for p in found.groups()[2:]]
        return ("jwe", found.end()) if all(parts) else None
    signature = _part(found[3])
    if signature is None or (algorithm.lower() == "none") != (signature == b"") or _part(found[2]) is None:
        return None
    if str(header.get("typ", "JWT")).upper() == "JWT" and header.get("b64", True) and _object(found[2]) is None:
        return None
    return "jws", found.end(3)


_ENDS = {"der": _der_end, "ssh": _ssh_end, "hex": _hex_end, "nested": _nested_end, "token": _token_end}


def confirmed_spans(text: str, nested: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of encoded keys and tokens whose structure is confirmed, from left to right without overlaps."""
    found, at = [], 0
    while start := _START.search(text, at):
        way = start.lastgroup
        begin = start.start()
        end = _armour_end(text, start.end()) if way == "armour" else None if way == "nested" and not nested else _ENDS[way](text, begin)
        if end:
            found.append((end[0], begin, end[1]))
        at = end[1] if end else start.end()
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by pattern alone: leftmost matches of each kind, without those that are too short."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _LEAST_VALUE]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


_ORDER = {kind: k for k, kind in enumerate(BASE + CONFIRMED)}


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed; offsets count code points, ends are exclusive."""
    text = text or ""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def spans_column(text: str = "text") -> Column:
    """array<struct<kind, start, end>> of a text column."""

    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch], dtype=object)

    return of(F.col(text))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of every document, also of those without any.

    A null text is an empty one and has no spans. Very long texts are searched whole in time that grows with their length. Repeated rows
    and null doc_ids give a row each; spans of different kinds may overlap and all stay; an empty table gives no rows; other columns
    are not read, whatever their names.
    """
    narrow = docs.select(F.col("doc_id"), F.col("text"))
    return narrow.select("doc_id", spans_column("text").alias("spans"))


def joined(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE], F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count(*CONFIRMED).alias("n_confirmed"),
    )


QUERIES = {"op11_secret_scan": query}
