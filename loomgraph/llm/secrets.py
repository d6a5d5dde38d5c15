"""Secret scans by structural confirmation: what looks like a key is decoded and parsed before it is reported.

Confirmed are: DER keys (nested lengths that fill their parents exactly, with integers) and OpenSSH keys (magic and
length-prefixed fields), in PEM or at the end of any run of base64 or hex, whatever precedes them there; signed tokens (a JSON header that names an algorithm, a JSON payload, and a
signature of the length that the algorithm has), access key ids in base32, tokens that end in a base62 CRC-32, and
assigned hex or base64 strings whose bytes have the length of a key and are varied enough to be one.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.state import table
from loomgraph.llm.text import slices

#: Texts that match neither can hold no candidate.
_MAYBE = r"[0-9A-Za-z+/_-]{20}|-----BEGIN"
KEY_BYTES = {16, 20, 24, 32, 48, 64}
_SIGNATURE = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "RS256": {128, 256, 384, 512}, "RS384": {128, 256, 384, 512}, "RS512": {128, 256, 384, 512}, "PS256": {128, 256, 384, 512}, "PS384": {128, 256, 384, 512}, "PS512": {128, 256, 384, 512}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "EDDSA": {64}, "NONE": {0}}
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_PEM = re.compile(r"-----BEGIN ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----((?:[^-]|-(?!-))*)-----END \1-----")
_JWT = re.compile(r"(?<![\w-])(eyJ[\w-]+)\.([\w-]+)\.([\w-]*)(?![\w-]|\.[\w-])", re.ASCII)
_ACCESS = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z2-7]{16}(?![A-Z0-9])")
_CHECKED = re.compile(r"(?<![0-9A-Za-z])((?:gh[pousr]|npm)_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|auth|credential|(?:api|access|private|secret|encryption|signing)?[_-]?key)[\"']?\s*(?:=|:|=>)\s*[\"']?([0-9a-z+/_-]{22,172}={0,2})(?![0-9a-z+/_=-])")
#: Runs that may end in a key: alphabet, where a key may begin in it (a SEQUENCE or OpenSSH's magic), padding.
_RUNS = [
    (re.compile(r"(?<![0-9A-Za-z+/])[0-9A-Za-z+/]{40,}"), re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXktdjEA")),
    (re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{40,}"), re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXktdjEA")),
    (re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{60,}"), re.compile(r"(?=30|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100)")),
]


def _b64(s: str, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) of the elements that fill data exactly, those within constructed ones checked at any depth."""
    found = []
    todo = [(0, len(data), True)]
    while todo:
        at, end, outer = todo.pop()
        while at < end:
            if at + 2 > end:
                return None
            tag, n, at = data[at], data[at + 1], at + 2
            if n & 128:
                k = n & 127
                if not 1 <= k <= 4 or at + k > end:
                    return None
                n, at = int.from_bytes(data[at : at + k], "big"), at + k
                if n < 128:
                    return None
            if at + n > end:
                return None
            if tag & 32:
                todo.append((at, at + n, False))
            if outer:
                found.append((tag, data[at : at + n]))
            at += n
    return found


def der_key(data: bytes) -> str | None:
    """The kind of private key that data encodes, if it does."""
    top = _der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    inner = _der(top[0][1]) or []
    tags = [t for t, _ in inner]
    if tags[:1] == [2] and inner[0][1] in (b"\0", b"\1"):
        if tags == [2] * 9 or tags == [2] * 9 + [0x30]:
            return "rsa_private_key"
        if tags == [2] * 6:
            return "dsa_private_key"
        if tags[:2] == [2, 4] and len(inner[1][1]) in (24, 28, 32, 48, 66) and inner[0][1] == b"\1":
            return "ec_private_key"
        if tags[:3] == [2, 0x30, 4] and (_der(inner[1][1]) or [(0, b"")])[0][0] == 6:
            return "pkcs8_private_key"
    if tags == [0x30, 4] and (_der(inner[0][1]) or [(0, b"")])[0][0] == 6:
        return "encrypted_private_key"
    return None


def openssh_key(data: bytes) -> str | None:
    if not data.startswith(b"openssh-key-v1\0"):
        return None
    at, fields = 15, []

    def take() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for _ in range(3):
        fields.append(take())
    if None in fields:
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    left = keys + 1 if keys else 0  # the public keys and one part with the private ones
    while left and take() is not None:
        left -= 1
    return "openssh_private_key" if keys and not left and at == len(data) else None


def _fills(head: bytes, size: int) -> bool:
    """Whether head may begin an OpenSSH key or an element that takes size bytes."""
    if head[:1] != b"\x30":
        return int.from_bytes(head[15:19], "big") < size
    n, k = head[1], 0
    if n & 128:
        k = n & 127
        n = int.from_bytes(head[2 : 2 + k], "big")
    return k <= 4 and 2 + k + n == size


def encoded_keys(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, kind, key) of the DER and OpenSSH keys at the ends of runs of base64, its variant for addresses, and hex."""
    for which, (runs, starts) in enumerate(_RUNS):
        for run in runs.finditer(text):
            end, pad = run.end(), 0
            for m in starts.finditer(text, run.start(), end):
                size = end - m.start()
                if which == 2:
                    decode, n = bytes.fromhex, size // 2 if size % 2 == 0 else 0
                else:
                    decode, n = (lambda x: _b64(x, url=which == 1)), size * 3 // 4 if size % 4 != 1 else 0
                    pad = len(re.match("={0,2}", text[end : end + min(2, -size % 4)])[0])
                if n < 30 or not _fills(decode(text[m.start() : m.start() + 40]) or b"\x30\x84", n):
                    continue
                data = decode(text[m.start() : end])
                if data and (kind := der_key(data) or openssh_key(data)):
                    yield m.start(), kind, text[m.start() : end + pad]
                    break


def signed_token(header: str, payload: str, signature: str) -> bool:
    parts = [_b64(x, url=True) for x in (header, payload, signature)]
    if None in parts:
        return False
    try:
        head, body = json.loads(parts[0]), json.loads(parts[1])
    except ValueError:
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return len(parts[2]) in _SIGNATURE.get(head["alg"].upper(), {-1})


def varied(data: bytes) -> bool:
    """Whether the bytes may be random: few repeats, no constant step, not all printable."""
    steps = {(b - a) % 256 for a, b in zip(data, data[1:])}
    return len(set(data)) >= 0.6 * min(len(data), 64) and len(steps) > len(data) // 3 and not all(32 <= x < 127 for x in data)


def _checksum(secret: str, tail: str) -> bool:
    n = binascii.crc32(secret.encode())
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(6, "0") == tail


def find_secrets(text: str) -> list[tuple[str, int, str]]:
    """(kind, start, secret) of each confirmed secret, in order; none within another."""
    found: list[tuple[int, str, str]] = []
    for m in _PEM.finditer(text):
        data = _b64(re.sub(r"(?m)^[A-Za-z-]+:.*$|\s+", "", m[2]))
        if data and (kind := der_key(data) or openssh_key(data)):
            found.append((m.start(), kind, m[0]))
    for m in _JWT.finditer(text):
        if signed_token(*m.groups()):
            found.append((m.start(), "signed_token", m[0]))
    for m in _ACCESS.finditer(text):
        raw = base64.b32decode(m[0][4:])
        if any(raw[:6]) and len(set(raw)) > 4:
            found.append((m.start(), "access_key_id", m[0]))
    for m in _CHECKED.finditer(text):
        if _checksum(m[2], m[3]):
            found.append((m.start(), m[1].rstrip("_") + "_token", m[0]))
    found += encoded_keys(text)
    for m in _ASSIGNED.finditer(text):
        value = m[1]
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            data = bytes.fromhex(value) if len(value) % 2 == 0 else None
            kind = "hex_key"
        else:
            mixed = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]")) == 3
            data = _b64(value, url=bool(re.search("[-_]", value))) if mixed else None
            kind = "base64_key"
        if data and len(data) in KEY_BYTES and varied(data):
            found.append((m.start(1), kind, value))
    out: list[tuple[str, int, str]] = []
    end = -1
    for start, kind, secret in sorted(found, key=lambda x: (x[0], -len(x[2]), x[1] in ("hex_key", "base64_key"), x[1])):
        if start >= end:
            out.append((kind, start, secret))
            end = start + len(secret)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, length, digest) of each confirmed secret of each row.

    start counts characters from 0; digest is the SHA-256 of the secret, which itself is not returned. Of overlapping
    finds the first and longest counts. A value that is assigned to a name such as token or key, but is no encoding of a
    key, is only reported if it decodes to 16, 20, 24, 32, 48 or 64 bytes (KEY_BYTES), the lengths of symmetric keys and
    digests; keys that parse may be as long and as deeply nested as they like. Null and empty texts have no secret;
    long ones are scanned whole; repeated rows are reported each. An empty table has no rows. Ids are integers and may
    be null. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows: list[tuple] = []
            for b in slices(whole, "text"):
                maybe = np.flatnonzero(pc.fill_null(pc.match_substring_regex(b.column("text"), _MAYBE), False).to_numpy(zero_copy_only=False))
                ids, texts = b.column("doc_id"), b.column("text")
                for i in maybe.tolist():
                    doc = ids[i].as_py()
                    rows += [(doc, kind, start, len(s), hashlib.sha256(s.encode()).hexdigest()) for kind, start, s in find_secrets(texts[i].as_py())]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "kind", "start", "length", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, kind string, start int, length int, digest string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
