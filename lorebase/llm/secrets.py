"""Secrets in whole texts: patterns, then candidates that are decoded and parsed before they are reported.

A candidate of the second kind counts only if its structure holds: a key's nested tags and lengths must fill its bytes
exactly, a signed token's header must be JSON that names an algorithm, an OpenSSH container's length fields must fit.

Candidates begin wherever a key's header can begin, also behind other characters of the same alphabet, and end where the
envelope says. Between their characters there may be white space, line ends written as escapes and, in hex, colons, so
that keys wrapped over lines or held in JSON strings are read. An encrypted key is a key; a public key (kind `public`)
and a key within confirmed armour (kind `pem`) are told apart.

Cases: null texts count as empty and have no spans; repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored; a null id stays null. Texts are searched whole. A token header whose JSON nests too
deeply to be parsed is no header; key envelopes may nest to any depth.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import map_texts

#: The base patterns; the least length of what each must have matched.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt", "pem", "public")

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:PRIVATE|PUBLIC) KEY)-----((?:[A-Za-z0-9+/=\s]|\\[rn/])+?)-----END \1-----")
#: Where an envelope of 16 bytes or more, or an OpenSSH container, can begin; characters in a group, and what may stand between.
BEGIN64, TOKEN64 = re.compile(r"M(?=[B-I])|b(?=3BlbnNzaC1rZXktdjEA)"), re.compile(r"([A-Za-z0-9+/_-]+)|\\[rn]|\\(?=/)|\s+")
BEGIN16, TOKEN16 = re.compile(r"3(?=0:?[1-8])|6(?=f70656e7373682d6b65792d763100)", re.I), re.compile(r"([0-9A-Fa-f]+)|\\[rn]|[\s:]+")
BETWEEN = re.compile(r"\\[rn]|\\|\s")
#: Identifiers of password-based encryption (PKCS 5, PKCS 12).
ENCRYPTION = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))

INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
OPENSSH = b"openssh-key-v1\0"


def fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each value between two offsets; None unless they fill it exactly."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                return None
            n, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def identifier(data: bytes, sequence: tuple[int, int, int]) -> bytes:
    """The object identifier that an algorithm's sequence begins with; empty if there is none."""
    parts = fields(data, *sequence[1:])
    return data[parts[0][1] : parts[0][2]] if parts and parts[0][0] == OID else b""


def public_key(data: bytes) -> bool:
    """Whether the bytes are one public key: an algorithm and a string of whole bytes."""
    top = fields(data, 0, len(data))
    parts = fields(data, *top[0][1:]) if top and len(top) == 1 and top[0][0] == SEQUENCE else None
    if not parts or [tag for tag, _, _ in parts] != [SEQUENCE, BITS]:
        return False
    _, start, end = parts[1]
    return bool(identifier(data, parts[0])) and end - start >= 25 and data[start] == 0


def private_key(data: bytes) -> bool:
    """Whether the bytes are one private key: an RSA key, an EC key, one in PKCS 8 envelopes, however many, or an encrypted one.

    Goes from envelope to envelope by offsets, so that depth costs neither stack nor copies.
    """
    start, end = 0, len(data)
    while True:
        top = fields(data, start, end)
        if not top or len(top) != 1 or top[0][0] != SEQUENCE:
            return False
        parts = fields(data, *top[0][1:])
        if parts and [tag for tag, _, _ in parts] == [SEQUENCE, OCTETS]:
            return identifier(data, parts[0]).startswith(ENCRYPTION) and parts[1][2] - parts[1][1] >= 24
        if not parts or parts[0][0] != INTEGER or parts[0][2] - parts[0][1] != 1:
            return False
        tags = [tag for tag, _, _ in parts]
        if tags[:9] == [INTEGER] * 9:
            modulus = parts[1]
            return modulus[2] - modulus[1] >= 64
        if tags[:2] == [INTEGER, OCTETS]:
            return data[parts[0][1]] == 1 and parts[1][2] - parts[1][1] >= 24
        if tags[:3] != [INTEGER, SEQUENCE, OCTETS]:
            return False
        if not identifier(data, parts[1]):
            return False
        start, end = parts[2][1:]
        if data[start : start + 1] == bytes((OCTETS,)):
            return bool(fields(data, start, end))


def openssh_size(data: bytes) -> int | None:
    """Bytes of an OpenSSH container of one key: cipher, derivation, options, count, public and private part."""
    at, count = len(OPENSSH), None
    if not data.startswith(OPENSSH):
        return None
    for k in range(6):
        if at + 4 > len(data):
            return None
        n = struct.unpack_from(">I", data, at)[0]
        at += 4
        if k == 3:
            count = n
        else:
            at += n
            if at > len(data):
                return None
    return at if count == 1 else None


def decoded(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == SEQUENCE:
        return "der" if private_key(data) else "public" if public_key(data) else None
    return "openssh" if openssh_size(data) else None


def gathered(text: str, at: int, need: int | None, token: re.Pattern) -> tuple[str, int] | None:
    """So many characters of the alphabet from a place on, and the place behind them; None if there are fewer. No need: all."""
    parts, have, end = [], 0, at
    while need is None or have < need:
        m = token.match(text, at)
        if not m:
            break
        at = m.end()
        if m[1]:
            parts.append(m[1] if need is None else m[1][: need - have])
            have, end = have + len(parts[-1]), m.start() + len(parts[-1])
    return None if need is not None and have < need else ("".join(parts), end)


def envelope_size(head: bytes) -> int | None:
    """Bytes of the envelope that begins here, if a version number or an algorithm follows."""
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[0] != SEQUENCE or more > 4 or head[1] == 0x80:
        return None
    n, at = (int.from_bytes(head[2 : 2 + more], "big") if more else head[1]), 2 + more
    inner = head[at : at + 6]
    version = inner[:2] == bytes((INTEGER, 1))
    named = inner[0] == SEQUENCE and inner[3 if inner[1] == 0x81 else 4 if inner[1] == 0x82 else 2] == OID
    # An encrypted key's scheme or a public key's algorithm names its identifier at once.
    return at + n if version or named else None


def keys_in(text: str, begin: re.Pattern, token: re.Pattern, bits: int) -> list[tuple[int, int, str]]:
    """Keys in base64 (6 bits a character) or hex (4), each from where it begins to where its envelope ends."""
    read = decoded if bits == 6 else lambda x: bytes.fromhex(x[: len(x) & ~1])
    out, done = [], 0
    for m in begin.finditer(text):
        at = m.start()
        if at < done or not (head := gathered(text, at, 96 // bits, token)):
            continue
        first = read(head[0])
        if m[0] in "b6":
            # The container says piece by piece how long it is.
            found = gathered(text, at, None, token)
            whole = found[0] if bits == 4 or len(found[0]) % 4 != 1 else found[0][:-1]
            size = openssh_size(read(whole))
        else:
            size = envelope_size(first)
        found = gathered(text, at, -(-size * 8 // bits), token) if size else None
        if found and (kind := key_kind(read(found[0])[:size])):
            done = found[1]
            while bits == 6 and text[done : done + 1] == "=" and done - found[1] < 2:
                done += 1
            out.append((at, done, kind))
    return out


def signed_token(header: str) -> bool:
    raw = decoded(header)
    try:
        found = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in SIGNED.finditer(text) if signed_token(m[1])]
    armoured = []
    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            kind = key_kind(decoded(BETWEEN.sub("", m[2])))
            if kind:
                armoured.append((m.start(), m.end(), "public" if kind == "public" else "pem"))
    keys = keys_in(text, BEGIN64, TOKEN64, 6) + keys_in(text, BEGIN16, TOKEN16, 4)
    ends = [end for _, end, _ in armoured]
    for x in keys:
        k = bisect_right(ends, x[0])
        if k == len(ends) or x[0] < armoured[k][0]:
            out.append(x)
    return out + armoured


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_confirmed, base_spans, spans for each whole text."""

    def make():
        def work(texts):
            out = [[], [], [], [], [], []]
            for t in texts:
                base, more = base_spans(t), confirmed_spans(t)
                kinds = [k for _, _, k in base]
                row = [kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), joined(base), joined(base + more)]
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    return map_texts(docs, id_col, text_col, "n_assign long, n_access long, n_hex long, n_confirmed long, base_spans string, spans string", make)
