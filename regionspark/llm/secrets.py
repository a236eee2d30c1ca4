"""Secret scans with structural confirmation.

Base patterns report assignments, access keys and long hex runs. Beyond them, encoded candidates (base64, base64url, hex
of either case, each also wrapped over lines, PEM bodies and three-part tokens) are decoded and parsed before they are
reported; a candidate without armour ends where the lengths that it holds
say, however long, as far as the text goes:

* `der`: a DER sequence whose nested lengths add up exactly and whose content is a private or public key encoding,
* `ssh`: length-prefixed fields of an OpenSSH private or public key, consistent to the last byte,
* `pem`: an armoured block whose body decodes to one of these or to a certificate, or one that its header fields declare
  encrypted, with a cipher, its initial vector, and a body of whole cipher blocks,
* `jwt`: three base64url parts whose header is a JSON object with a known `alg` and whose payload is a JSON object.

Defined cases: null texts are empty and have no spans; equal texts have equal spans; spans that begin together are in the
order of KINDS, and repeated rows are scanned one by one; whole texts are scanned, in about 6 times their bytes of memory;
an empty table gives an empty table; of the kept columns those with the names of the results are left out. Spans are in
code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import kept_schema, map_arrow

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

_GAP = r"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*)"  # a line's end, also as an escape in a quoted string
_PEM = re.compile(
    rf"-----BEGIN ([A-Z0-9 ]{{1,64}})-----{_GAP}?((?:[A-Za-z0-9-]{{1,40}}:[^\n]*\n)*)((?:[A-Za-z0-9+/=\s]|\\[rn])*)-----END \1-----"
)
_CIPHER = re.compile(r"^DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)\s*$", re.M)
# The first byte of the header is a brace or white space before one, so the first letter is one of these.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[eICD][A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# A DER sequence begins with M and one of A to P, a length-prefixed field of less than 64 KB with AAA, a private SSH key
# with its magic word.
_BASE64 = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|AAA|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{14,}")
_HEX_KEY = re.compile(r"(?<![A-Za-z0-9])(?:30|00|6[fF])[:]?[0-9A-Fa-f][0-9A-Fa-f:]{28,}")
_LINE_64 = re.compile(rf"{_GAP}([A-Za-z0-9+/_-]+)")
_LINE_16 = re.compile(rf":?{_GAP}([0-9A-Fa-f:]+)")
_PADDING = re.compile("={0,2}")
_ALGORITHMS = {"none", "EdDSA", "dir", *(a + b for a in ("HS", "RS", "ES", "PS") for b in ("256", "384", "512"))}
# Encoded object identifiers of RSA, EC, Ed25519, X25519 and DSA keys.
_KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2a8648ce380401")}


def _decode(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes) -> int | None:
    """Bytes of the DER value at the head of `data`, of which its tag and length must be there; None if there is none."""
    if len(data) < 2:
        return None
    n, k = data[1], 0
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(data) < 2 + k or not data[2]:
            return None
        n = int.from_bytes(data[2 : 2 + k], "big")
        if n < 0x80:
            return None
    return 2 + k + n


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill `data` exactly; None if a length is indefinite, padded or too long."""
    items, i = [], 0
    while i < len(data):
        size = der_length(data[i : i + 6])
        if size is None or i + size > len(data):
            return None
        head = 2 + (data[i + 1] & 0x7F if data[i + 1] >= 0x80 else 0)
        items.append((data[i], data[i + head : i + size]))
        i += size
    return items


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8, SEC1 and SubjectPublicKeyInfo encodings, also encrypted PKCS#8."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_items(outer[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]

    def algorithm(content: bytes) -> bool:
        inner = der_items(content)
        return bool(inner) and inner[0][0] == 0x06 and inner[0][1] in _KEY_OIDS

    if tags[0] == 0x02 and len(parts) >= 9 and set(tags[:9]) == {0x02} and parts[0][1] in (b"\0", b"\1"):
        return True  # RSA private key
    if tags == [0x02, 0x02] and len(parts[0][1]) >= 64 and len(parts[1][1]) <= 8:
        return True  # RSA public key
    if tags[0] == 0x02 and tags[1:3] == [0x30, 0x04] and algorithm(parts[1][1]):
        return True  # PKCS#8
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\1" and len(parts[1][1]) >= 20:
        return True  # SEC1
    if tags == [0x30, 0x03] and algorithm(parts[0][1]):
        return True  # SubjectPublicKeyInfo
    if tags == [0x30, 0x04]:
        inner = der_items(parts[0][1])
        return bool(inner) and inner[0] == (0x06, bytes.fromhex("2a864886f70d01050d"))  # encrypted PKCS#8
    return False


_SSH_MAGIC = b"openssh-key-v1\0"
# Fields of public keys by type.
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ssh-ed448": 2, b"sk-ssh-ed25519@openssh.com": 3}
_SSH_CURVE = re.compile(rb"(sk-)?ecdsa-sha2-nistp\d{3}(@openssh\.com)?")


def _field(data: bytes, i: int) -> tuple[bytes, int] | None:
    """The length-prefixed field at i, and where it ends."""
    end = i + 4 + int.from_bytes(data[i : i + 4], "big")
    return (data[i + 4 : end], end) if i + 4 <= len(data) and end <= len(data) else None


def ssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH key at the head of `data`: every length-prefixed field ends where the next begins."""
    i, fields, want = 0, [], None
    if data.startswith(_SSH_MAGIC):
        i = len(_SSH_MAGIC)
        for _ in range(3):  # cipher, key derivation, its options
            if (found := _field(data, i)) is None:
                return None
            fields.append(found[0])
            i = found[1]
        keys = int.from_bytes(data[i : i + 4], "big")
        i += 4
        if not fields[0].isascii() or not fields[0] or not 1 <= keys <= (len(data) - i) // 4:  # a key has its length at least
            return None
        for k in range(keys + 1):  # the public keys, then the private ones
            if (found := _field(data, i)) is None or k < keys and ssh_length(found[0]) != len(found[0]):
                return None
            i = found[1]
        return i
    while want is None or len(fields) < want:
        if (found := _field(data, i)) is None:
            return None
        fields.append(found[0])
        i = found[1]
        if want is None:
            curve = _SSH_CURVE.fullmatch(fields[0])
            want = _SSH_FIELDS.get(fields[0]) or (3 + bool(curve[1]) if curve else 0)
            if not want:
                return None
    return i if all(fields) else None


def is_ssh_key(data: bytes) -> bool:
    return bool(data) and ssh_length(data) == len(data)


def is_jwt(text: str) -> bool:
    parts = []
    for piece in text.split(".")[:2]:
        raw = _decode(piece)
        try:
            parts.append(json.loads(raw) if raw else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and parts[0].get("alg") in _ALGORITHMS


def _wanted(head: bytes) -> int | None:
    """Bytes of the key that may begin with `head`: -1 if only the rest can tell, None if none begins."""
    if head[:1] == b"\x30":
        return der_length(head[:6])
    if head.startswith(_SSH_MAGIC):
        return -1
    kind = _field(head, 0)
    return -1 if kind and (kind[0] in _SSH_FIELDS or _SSH_CURVE.fullmatch(kind[0])) else None


def _key_kind(data: bytes) -> tuple[int, int] | None:
    """(kind, bytes) of the key at the head of `data`."""
    if data[:1] == b"\x30":
        n = der_length(data[:6])
        return (5, n) if n and n <= len(data) and is_der_key(data[:n]) else None
    n = ssh_length(data)
    return (6, n) if n else None


def _pieces(text: str, first: re.Match, line: re.Pattern, most: int) -> list[tuple[int, str]]:
    """(where it begins, characters) of a run and of the lines that go on with it, as far as `most` characters."""
    out, at, size = [(first.start(), first[0])], first.end(), len(first[0])
    while size < most and (m := line.match(text, at)):
        out.append((m.start(1), m[1]))
        at, size = m.end(), size + len(m[1])
    return out


def _found(text: str, first: re.Match, line: re.Pattern, per_byte: float, wanted: int, decode) -> tuple[tuple[int, int], list[tuple[int, str]]] | None:
    """The key that begins with a run, and the pieces it was read from, of `per_byte` characters a byte.

    Where the key's size is not known in advance, twice as many characters are read until it ends or the lines do.
    """
    room = len(text) - first.start()
    most = 4096 if wanted < 0 else math.ceil(per_byte * wanted)
    while most <= room or wanted < 0:
        pieces = _pieces(text, first, line, most)
        body = "".join(x for _, x in pieces)
        raw = decode(body)
        if raw and (key := _key_kind(raw)):
            return key, pieces
        if wanted >= 0 or len(body) < most:
            return None
        most *= 2
    return None


def _end(pieces: list[tuple[int, str]], n: int) -> int | None:
    """Where the n-th character of the pieces ends; None if it is not the last one of its piece."""
    for at, piece in pieces:
        if n <= len(piece):
            return at + n if not piece[n:].strip(":") else None
        n -= len(piece)
    return None


def _encoded_keys(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans of keys in base64 and in hex, whole or wrapped over lines."""
    base64_bytes = lambda x: _decode(x[:-1] if len(x) % 4 == 1 else x)
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() < done or (wanted := _wanted(_decode(m[0][: min(len(m[0]) & ~3, 64)]) or b"")) is None:
            continue
        if found := _found(text, m, _LINE_64, 4 / 3, wanted, base64_bytes):
            (kind, size), pieces = found
            if (end := _end(pieces, -(-size * 4 // 3))) is not None:
                done = _PADDING.match(text, end).end()
                yield m.start(), kind, done

    def hex_bytes(x: str) -> bytes:
        x = x.replace(":", "")
        return bytes.fromhex(x[: len(x) & ~1])

    done = 0
    for m in _HEX_KEY.finditer(text):
        if m.start() < done or (wanted := _wanted(hex_bytes(m[0][:128]))) is None:
            continue
        if found := _found(text, m, _LINE_16, 2, wanted, hex_bytes) or _found(text, m, _LINE_16, 3, wanted, hex_bytes):
            (kind, size), pieces = found
            places = [i for i, c in enumerate("".join(x for _, x in pieces)) if c != ":"]
            if (end := _end(pieces, places[2 * size - 1] + 1)) is not None:
                done = end
                yield m.start(), kind, end


def _is_armoured(label: str, fields: str, body: str) -> bool:
    raw = _decode("".join(body.replace("\\r", "").replace("\\n", "").split()))
    if not raw:
        return False
    if "ENCRYPTED" in fields:
        cipher = _CIPHER.search(fields)
        block = len(cipher[2]) // 2 if cipher else 0
        return "Proc-Type:" in fields and block in (8, 16) and len(raw) % block == 0
    return is_der_key(raw) or is_ssh_key(raw) or "CERTIFICATE" in label and bool(der_items(raw))


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every span, sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_jwt(m[0])]
    if "-----BEGIN" in text:
        spans += [(m.start(), 4, m.end()) for m in _PEM.finditer(text) if _is_armoured(*m.groups())]
    spans += _encoded_keys(text)
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_COLUMNS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every document and n_assign, n_access, n_hex, base_sha256 and spans."""
    keep = [k for k in keep if k.lower() not in _COLUMNS]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _COLUMNS]
            for value in batch.column(text):
                spans = scan(value.as_py() or "")
                for k in range(3):
                    rows[k].append(sum(s[1] == k for s in spans))
                rows[3].append(hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest())
                rows[4].append(joined(spans))
            made = [pa.array(r, pa.int64() if i < 3 else pa.string()) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *made], names=[*keep, *_COLUMNS])

    schema = [*([kept_schema(docs, keep)] * bool(keep)), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"]
    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), find, ", ".join(schema))
