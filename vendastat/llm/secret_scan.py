"""Secret scan with structural confirmation.

Plain patterns find assignments, access keys and long hexadecimal runs. Beyond these, long runs
of base64 or hexadecimal digits, also over several lines or behind a separator such as ``0x``, are
decoded and reported only if what they hold parses as a private key (DER with nested lengths
that fit exactly, or the OpenSSH format), as are the bodies of armoured keys, with real line breaks
or with escaped ones. Three dotted parts are reported only if they are a signed token: a JSON
header that names an algorithm, a JSON object as payload, and a signature as long as that
algorithm makes it.

A task reads whole texts row by row and keeps nothing between rows.

Defined results: a null text counts as empty and gives no span. Positions are code points, end
exclusive. Repeated rows are scanned each; an empty table gives an empty result. Very long
texts take time in proportion to their length: every END line is looked up, not searched for, and a
run is only decoded as far as the outer length at its beginning says.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
#: In the order in which spans that begin together are listed.
KINDS = (*BASE_KINDS, "pem", "jwt", "b64key", "hexkey")

ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGNED_CHARACTERS = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
BEGIN, END = (re.compile(f"-----{w} ([A-Z0-9 ]{{1,40}})-----") for w in ("BEGIN", "END"))
#: What may stand between both lines of an armoured key; line breaks also as they are escaped in JSON.
ARMOURED = re.compile(r"[A-Za-z0-9+/=:,.\s\\-]*")
ESCAPED_BREAK = re.compile(r"\\+[nr]")
#: Digits that may hold a key, over one line or several, and what parts the lines.
BLOCK = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*+[A-Za-z0-9+/_-]++)*+={0,2}"
)
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*")
#: A key in base64 or hexadecimal digits may begin behind these.
SEPARATOR = re.compile(r"[-_/]|0[xX]")
DOTTED = re.compile(r"[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]*+)++")
HEADER_DIGITS = 10
#: Bytes of a signature, as least and most; fixed by the algorithms.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64),
    "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024),
    "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
    "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
}
OPENSSH = b"openssh-key-v1\0"
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the DER elements that fill ``data`` exactly, else ``None``."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            length = int.from_bytes(data[at : at + size], "big")
            if length < 0x80 or length >> (8 * (size - 1)) == 0:
                return None  # not the shortest form
            at += size
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_algorithm(content: bytes) -> bool:
    inner = elements(content)
    return bool(inner) and inner[0][0] == OID and len(inner[0][1]) >= 3


def is_der_key(data: bytes) -> bool:
    """A private key as PKCS#1, DSA, SEC 1 or PKCS#8, the last also encrypted."""
    if len(data) < 2 or data[0] != SEQUENCE:
        return False
    outer = elements(data)
    if not outer or len(outer) != 1:
        return False
    inner = elements(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == INTEGER and inner[0][1] in (b"\0", b"\1"):
        if all(t == INTEGER for t in tags):
            return len(tags) in (6, 9) and len(inner[1][1]) >= 32
        if tags[1:3] == [SEQUENCE, OCTETS]:
            return is_algorithm(inner[1][1]) and len(inner[2][1]) >= 16
        return tags[1] == OCTETS and 16 <= len(inner[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags == [SEQUENCE, OCTETS] and is_algorithm(inner[0][1]) and len(inner[1][1]) >= 16


def is_openssh_key(data: bytes) -> bool:
    """Cipher, key derivation and its options, number of keys, public keys, private part."""
    if not data.startswith(OPENSSH):
        return False
    at, strings = len(OPENSSH), 0
    keys = None
    while at + 4 <= len(data):
        number = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if strings == 3 and keys is None:
            keys = number
            if not 1 <= keys <= 64:
                return False
            continue
        if at + number > len(data):
            return False
        at += number
        strings += 1
        if keys is not None and strings == 4 + keys:
            return not data[at:].strip(b"\0")
    return False


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def decode64(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding."""
    text = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(text: str) -> dict | None:
    data = decode64(text)
    if not data or data.lstrip()[:1] != b"{":
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_token(header: str, payload: str, signature: str) -> bool:
    head = json_object(header)
    if head is None or not isinstance(head.get("alg"), str):
        return False
    least, most = SIGNATURES.get(head["alg"], (16, 4096))
    signed = decode64(signature) if signature else b""
    return signed is not None and least <= len(signed) <= most and json_object(payload) is not None


def armoured_keys(text: str) -> list[tuple[int, int]]:
    """Keys between BEGIN and END lines of one name; a BEGIN pairs with the first END, if no BEGIN comes before."""
    ends: dict[str, list[re.Match]] = {}
    for m in END.finditer(text):
        ends.setdefault(m[1], []).append(m)
    begins = list(BEGIN.finditer(text))
    out = []
    for m, after in zip(begins, [*begins[1:], None], strict=True):
        same = ends.get(m[1], [])
        at = bisect_left(same, m.end(), key=lambda e: e.start())
        if at == len(same) or after and after.start() < same[at].start():
            continue
        body = text[m.end() : same[at].start()]
        if ARMOURED.fullmatch(body):
            lines = ESCAPED_BREAK.sub("\n", body).splitlines()
            data = decode64("".join(line.strip() for line in lines if ":" not in line))
            if data and is_key(data):
                out.append((m.start(), same[at].end()))
    return out


def der_length(head: bytes | None) -> int:
    """Bytes of the DER sequence that begins with ``head``, by its outer length; 0 if none does."""
    if not head or len(head) < 2 or head[0] != SEQUENCE:
        return 0
    if head[1] < 0x80:
        return 2 + head[1]
    size = head[1] & 0x7F
    return 2 + size + int.from_bytes(head[2 : 2 + size], "big") if 1 <= size <= 4 and len(head) >= 2 + size else 0


def block_keys(text: str, begin: int, end: int) -> list[tuple[str, int, int]]:
    """Keys among the digits of a block, whose lines are read as one.

    A key begins with a line or behind a separator, and ends with a line. How long it is says its
    outer length, so that only what fits is decoded; without such a length, it takes the rest.
    """
    whole = text[begin:end].rstrip("=")
    lines, at = [], 0  # (first digit, place in the text) of each line
    digits: list[str] = []
    for m in [*BREAK.finditer(whole), None]:
        line = whole[at : m.start() if m else len(whole)]
        lines.append((sum(map(len, digits[-1:])) + (lines[-1][0] if lines else 0), begin + at))
        digits.append(line)
        at = m.end() if m else len(whole)
    firsts = [first for first, _ in lines]
    joined = "".join(digits)
    stops = {*firsts[1:], len(joined)}

    def place(digit: int) -> int:
        line = bisect_right(firsts, digit) - 1
        return lines[line][1] + digit - firsts[line]

    def found(kind: str, first: int, stop: int) -> tuple[str, int, int]:
        last = place(stop - 1) + 1
        return kind, place(first), end if stop == len(joined) else last

    out, past, rest_tried = [], 0, False
    for first in sorted({*firsts, *(m.end() for m in SEPARATOR.finditer(joined))}):
        if first < past or first >= len(joined):
            continue
        if head := unhex(joined[first : first + 12]):
            stop = first + 2 * der_length(head)
            if head == OPENSSH[:6] and not rest_tried:
                stop, rest_tried = len(joined), True
            if stop in stops and stop - first >= 64 and (data := unhex(joined[first:stop])) and is_key(data):
                out.append(found("hexkey", first, stop))
                past = stop
                continue
        if joined.startswith("M", first):
            length = der_length(decode64(joined[first : first + 12]))
            stop = first - (-length * 4 // 3) if length else 0
        elif joined.startswith("b3BlbnNzaC1rZXktdjE", first) and not rest_tried:
            stop, rest_tried = len(joined), True
        else:
            continue
        if stop in stops and (data := decode64(joined[first:stop])) and is_key(data):
            out.append(found("b64key", first, stop))
            past = stop
    return out


def unhex(digits: str) -> bytes | None:
    try:
        return bytes.fromhex(digits)
    except ValueError:
        return None


def tokens(text: str, begin: int, end: int) -> list[tuple[str, int, int]]:
    """Signed tokens among dotted parts; three in a row are one."""
    parts = text[begin:end].split(".")
    starts = list(accumulate((len(p) + 1 for p in parts), initial=begin))
    out, at = [], 0
    while at + 2 < len(parts):
        header = parts[at]
        begins_object = len(header) >= HEADER_DIGITS and (decode64(header[:8]) or b"").lstrip().startswith(b"{")
        if begins_object and is_token(*parts[at : at + 3]):
            out.append(("jwt", starts[at], starts[at + 2] + len(parts[at + 2])))
            at += 3
        else:
            at += 1
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED_CHARACTERS]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    armoured = armoured_keys(text) if "-----BEGIN" in text else []
    out += [("pem", *span) for span in armoured]
    begins = [a for a, _ in armoured]
    for m in BLOCK.finditer(text):
        before = bisect_right(begins, m.start()) - 1
        if before < 0 or m.start() >= armoured[before][1]:
            out += block_keys(text, *m.span())
    if "." in text:
        for m in DOTTED.finditer(text):
            if m.end() - m.start() >= HEADER_DIGITS:
                out += tokens(text, *m.span())
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``spans``, an array of (kind, start, end) in order."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans(text)] for text in batch.pop("text")
            ]
            batch["spans"] = found
            yield batch

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
