"""Operator 3, secret scan with structural confirmation.

Three base patterns report as they stand.  Further candidates (base64 and hex
runs, PEM blocks, signed tokens) report only after decoding confirms their
structure: DER lengths that nest and fill the value exactly and spell a private
key, length-prefixed OpenSSH fields that end with the value, or token headers
that are JSON objects naming an algorithm.

A wrapped key is joined from its lines, in armour or without: line ends may be
escaped, quoted or blanks, and lines may have a prefix (``> ``, ``+``, ``# ``).
The key's own lengths tell where it ends.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import map_pieces, map_texts

#: Kinds in reporting order; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "pem", "key", "hexkey", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEXKEY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Za-z])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_OPENSSH = b"openssh-key-v1\x00"
#: Where base64 of a DER sequence, an OpenSSH key or an armoured key may begin.
_START = re.compile(r"M[A-P][A-Za-z0-9+/]{6}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
_RUN = re.compile(r"[A-Za-z0-9+/]+")
_ESCAPED = {"/": "/", "u002f": "/", "u002b": "+", "%2f": "/", "%2b": "+"}
_CHAR = re.compile(r"\\+(/|u002[bBfF])|(%2[bBfF])")
_END = r"""(?:\r\n|\n|\r|\\+(?:[nr]|u000[aAdD]|x0[aAdD])|%0[aAdD]|<br[ ]*/?>|&\#(?:1[03]|x[aAdD]);)"""
_BREAK = re.compile(_END)
#: From one line of a key to the next: closing quotes and signs, line ends; or blanks; or quotes around a sign.
_NEXT = re.compile(rf"""(?:(?:["'`][ \t]{{0,64}}(?:[+.,;&][ \t]{{0,64}})?|[ \t]{{0,64}})\\?{_END})+|["'`][ \t]{{0,64}}[+.,][ \t]{{0,64}}(?=["'`])|[ \t]{{1,64}}""")
#: A key's lines have as many characters, but for the first and the last one; as many empty lines may stand between; and its length takes as many bytes.
LINE, GAPS, LENGTH_BYTES = 16, 4, 2
_HEAD = re.compile(r"(?:[ \t]*\d{1,6}[ \t]*[:|][ \t]*|[ \t]*\d{1,6}[ \t]+)?[^A-Za-z0-9+/=\n\r\\%&]{0,32}")
_PADDING = re.compile(r"(?:=|\\+u003[dD]|%3[dD]){0,2}")


def unbase64(s: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it isn't."""
    s = "".join(s.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _plain64(s: str) -> bytes | None:
    """Bytes of characters that are standard base64 for certain, without padding."""
    return None if len(s) % 4 == 1 else binascii.a2b_base64(s + "=" * (-len(s) % 4))


def der_items(data: bytes, most: int = 16) -> list[tuple[int, bytes]] | None:
    """The (tag, value) items that fill ``data`` exactly; None if lengths do not fit or there are more than a key has."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or len(out) == most:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            size = int.from_bytes(data[at : at + k], "big")
            if size < 0x80:
                return None
            at += k
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8, by nested lengths and the order of tags."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    body = der_items(top[0][1])
    if not body:
        return False
    tags = [t for t, _ in body]
    if tags[0] == 0x30 and tags[1:] == [0x04]:  # encrypted: algorithm, then octets
        inner = der_items(body[0][1])
        return bool(inner) and inner[0][0] == 0x06
    if tags[0] != 0x02 or len(body[0][1]) != 1 or body[0][1][0] > 1:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # RSA: version and eight numbers
        return len(body[1][1]) >= 32
    if len(tags) == 6 and set(tags) == {0x02}:  # DSA: version and five numbers
        return len(body[1][1]) >= 32
    if len(tags) >= 2 and tags[1] == 0x04:  # EC: version, octets, tagged options
        return 16 <= len(body[1][1]) <= 80 and all(t in (0xA0, 0xA1) and der_items(v) is not None for t, v in body[2:])
    if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8
        inner = der_items(body[1][1])
        return bool(inner) and inner[0][0] == 0x06
    return False


def openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key at the start: cipher, kdf, options, count, public keys and the private part, each with its length."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        value = data[at + 4 : at + 4 + size]
        at += 4 + size
        return value if at <= len(data) else None

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16 or any(field() is None for _ in range(count)):
        return None
    return at if field() is not None else None


def is_openssh(data: bytes) -> bool:
    return openssh_size(data) == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_der(data) or is_openssh(data))


def is_token(head: str, body: str) -> bool:
    """Whether a dotted candidate's first part is a header of a signed or encrypted token."""
    try:
        header = json.loads(unbase64(head) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not header["alg"]:
            return False
        return "enc" in header or isinstance(json.loads(unbase64(body) or b""), dict)
    except (ValueError, RecursionError):
        return False


class _Joined:
    """The base64 characters from ``at`` on, over line ends and line prefixes.

    They are joined as far as someone asks, and once for all keys that may
    begin among them.  A short line is the last one.
    """

    def __init__(self, text: str, at: int, to: int, prefix: str | None = None):
        self.text, self.at, self.to, self.line, self.gaps, self.over = text, at, to, LINE, 0, False
        self.prefix = _BREAK.split(text[max(0, at - 64) : at])[-1] if prefix is None else prefix
        self.chars = bytearray()
        self.begins: list[int] = []  # of each part: its place in the text, its place in chars, and where the text goes on
        self.counts: list[int] = []
        self.ends: list[int] = []

    def _grow(self, n: int | None) -> None:
        text, at = self.text, self.at
        while not self.over and (n is None or len(self.chars) < n):
            begin = at
            if at < self.to and (m := _RUN.match(text, at, self.to)):
                part, at = m[0], m.end()
            elif at < self.to and (m := _CHAR.match(text, at, self.to)):
                part, at = _ESCAPED[(m[1] or m[2]).lower()], m.end()
            elif at < self.to and (self.line >= LINE or self.line == 0 and self.gaps < GAPS) and (m := _NEXT.match(text, at, self.to)):
                at, self.line, self.gaps = m.end(), 0, self.gaps + 1
                if self.prefix and text.startswith(self.prefix, at):
                    at += len(self.prefix)
                at = _HEAD.match(text, at, self.to).end()
                continue
            else:
                self.over = True
                break
            self.begins.append(begin)
            self.counts.append(len(self.chars))
            self.ends.append(at)
            self.chars += part.encode()
            self.line, self.gaps = self.line + len(part), 0
        self.at = at

    def offset(self, at: int) -> int | None:
        """Which of the characters stands at a place of the text; None if none that is joined yet."""
        k = bisect.bisect_right(self.begins, at) - 1
        return self.counts[k] + at - self.begins[k] if k >= 0 and at < self.ends[k] else None

    def take(self, offset: int, need: int | None = None) -> str:
        self._grow(None if need is None else offset + need)
        return self.chars[offset : None if need is None else offset + need].decode()

    def end(self, offset: int) -> int:
        """Where the text goes on after so many characters."""
        k = bisect.bisect_left(self.counts, offset) - 1
        return min(self.ends[k], self.begins[k] + offset - self.counts[k]) if self.ends[k] - self.begins[k] > 1 and self.text[self.begins[k]] not in "\\%" else self.ends[k]


def _size(joined: _Joined, at: int, head: str) -> int | None:
    """Bytes of the key whose base64 may begin with the character ``at``, by its own lengths; None if there is none."""
    if head[0] == "M":
        data = unbase64(head)
        k = data[1] & 0x7F if data[1] >= 0x80 else 0
        if k > LENGTH_BYTES or data[1] == 0x80:
            return None
        inner = data[2 + k :]
        if inner[0] != 0x30 and (inner[0] != 0x02 or inner[1:2] not in (b"", b"\1")):
            return None
        return 2 + k + (int.from_bytes(data[2 : 2 + k], "big") if k else data[1])
    need = 512
    while True:
        chars = joined.take(at, need)
        again = chars.find(head, 1)  # another begin: the key of this one ends before it or is none
        last = again >= 0 or len(chars) < need
        chars = chars[:again] if again >= 0 else chars
        data = _plain64(chars[: len(chars) - (len(chars) % 4 == 1)]) or b""
        if head[0] == "b":
            size = openssh_size(data)
        else:
            m = re.match(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----.*?-----END \1-----", data, re.S)
            size = m.end() if m else None
        if size is not None or last:
            return size
        need *= 4


def _may_nest(data: bytes, size: int) -> bool:
    """False if the items of a DER value, as far as ``data`` shows them, do not nest in its ``size`` bytes."""
    at = 2 + (data[1] & 0x7F if len(data) > 1 and data[1] >= 0x80 else 0)
    while at + 6 <= len(data):
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if not 1 <= k <= 4:
                return False
        at += n
        if tag not in (0x02, 0x04, 0x30, 0xA0, 0xA1) or at > size:
            return False
    return len(data) >= min(size, 8)


def wrapped(text: str, at: int = 0, to: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of whole keys in base64, in one line or several."""
    out, to, done, joined = [], len(text) if to is None else to, at, None
    for m in _START.finditer(text, at, to):
        a = m.start()
        if a < done or a and text[a - 1].isascii() and text[a - 1].isalnum() and not _BREAK.fullmatch(text, max(0, _before(text, a)), a):
            continue
        k = joined.offset(a) if joined is not None else None
        if k is None:
            joined, k = _Joined(text, a, to), 0
        size = _size(joined, k, m[0])
        if size is None:
            continue
        need = -(-size * 4 // 3)
        if m[0][0] == "M" and not _may_nest(_plain64(joined.take(k, min(need, 512))) or b"", size):
            continue
        chars = joined.take(k, need)
        if len(chars) == need and (m[0][0] == "L" or is_key(_plain64(chars))):
            done = min(to, _PADDING.match(text, joined.end(k + need)).end())
            out.append((a, done))
    return out


def _before(text: str, at: int) -> int:
    """Start of an escape that may end at ``at``."""
    k = max(text.rfind(c, max(0, at - 8), at) for c in "\\%")
    return k if k >= 0 else at


def _pem(text: str, a: int, b: int) -> bool:
    """Whether an armour's body, text[a:b], is a whole key."""
    body = text[a:b]
    if "Proc-Type:" in body:  # encrypted the old way: headers, then cipher blocks
        m = _BREAK.search(body, max(body.rfind("DEK-Info:"), body.rfind("Proc-Type:")))
        if m is None:
            return False
        joined = _Joined(text, a + m.start(), b, _BREAK.split(body[: body.index("Proc-Type:")])[-1])
        chars = joined.take(0)
        if not chars or re.search("[A-Za-z0-9]", _BREAK.sub("", text[_PADDING.match(text, joined.end(len(chars))).end() : b])):
            return False
        data = unbase64(chars)
        return bool(data) and len(data) % 8 == 0
    return is_key(unbase64(body)) or bool(wrapped(text, a, b))


def armoured(text: str) -> list[tuple[int, int]]:
    """(start, end) of armoured private keys; a BEGIN without its END, or with another BEGIN before it, is passed over."""
    out, begin = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None and begin[2] == m[2]:
            if _pem(text, begin.end(), m.start()):
                out.append((begin.start(), m.end()))
            begin = None
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind; base kinds leftmost and non-overlapping."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    pem = armoured(text) if "-----BEGIN " in text else []
    out += [("pem", a, b) for a, b in pem]
    keys = []
    for m in _B64.finditer(text):
        data = unbase64(m[0])
        if is_key(data) or data is not None and data.startswith(b"-----BEGIN ") and b"PRIVATE KEY-----" in data[:64]:
            keys.append((m.start(), m.end()))
    known = pem + keys
    keys += [(a, b) for a, b in wrapped(text) if not any(x <= a and b <= y for x, y in known)]
    out += [("key", a, b) for a, b in keys]
    if len(low) >= 64:
        out += [("hexkey", m.start(), m.end()) for m in _HEXKEY.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_token(m[1], m[2])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends) for each row: all spans of the whole text, parallel arrays by position.

    Null text counts as empty and has empty arrays.  Repeated rows are scanned
    each; other columns are ignored.
    """

    def one(text: str):
        spans = find(text)
        return [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(map_texts(one, ["kinds", "starts", "ends"], [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())], ["doc_id"]), f"doc_id {kind}, kinds array<string>, starts array<long>, ends array<long>")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at, hole = [], 0, -1
    for _, a, b in find(text):
        if a < hole:
            hole = max(hole, b)
        else:
            if hole >= 0:
                out.append(mark)
                at = hole
            out.append(text[at:a])
            hole = b
    if hole < 0:
        return text
    return "".join((*out, mark, text[hole:]))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars``, if there, counted anew as a long; null text stays null and has no count."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array([t if t is None else redact(t) for t in piece.column("text").to_pylist()], pa.string())
        new = {"text": text, "n_chars": pa.compute.utf8_length(text).cast(pa.int64())}
        return pa.RecordBatch.from_arrays([new.get(n, piece.column(n)) for n in piece.schema.names], piece.schema.names)

    if "n_chars" in docs.columns:
        docs = docs.select(*(F.lit(None).cast("long").alias(c) if c == "n_chars" else docs[c] for c in docs.columns))
    return docs.mapInArrow(map_pieces(run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``scan``'s rows, with DataFrame functions."""
    items = F.expr("transform(kinds, (k, i) -> concat_ws(':', k, starts[i], ends[i]))")
    base = F.expr("filter(items, x -> substring_index(x, ':', 1) in ('assign', 'access', 'hex'))")
    count = lambda k: F.expr(f"size(filter(kinds, k -> k = '{k}'))").cast("long").alias(f"n_{k}")
    return found.withColumn("items", items).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", "items").alias("spans"))


def digest_of(text: str) -> tuple[int, int, int, str, str]:
    """What ``digest`` gives for one text, in plain Python."""
    spans = find(text)
    base = [s for s in spans if s[0] in KINDS[:3]]
    n = [sum(s[0] == k for s in spans) for k in KINDS[:3]]
    return *n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)
