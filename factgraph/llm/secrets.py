"""Secret scans: patterns, and structural confirmation of encoded candidates before they are reported.

A long base64 or hex run counts as a key only if it decodes to a known structure: a DER key whose nested lengths
agree, an OpenSSH private key, or a signed token whose header and claims are JSON. Base64 lines divided by line
ends, escaped ones too, are one candidate; its span goes from the first to the last of the lines that hold the key.
"""

import base64
import binascii
import bisect
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps

# The base patterns, their kinds in order, and the least length of what each must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
OPENSSH = b"openssh-key-v1\x00"
KINDS = ("assign", "access", "hex", "token", "key")
HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Base64 lines from one that may begin a DER sequence or an OpenSSH key.
LINES = re.compile(r"(?:M[A-P]|b3BlbnNz)[A-Za-z0-9+/_-]{2,}(?:[ \t]*(?:\r\n?|\n|(?:\\+r)?\\+n)[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\+r)?\\+n)[ \t]*")
HEX_KEY = re.compile(r"[0-9A-Fa-f]{80,}")
BASE64 = np.zeros(256, bool)
BASE64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.")] = True
HEXES = np.zeros(256, bool)
HEXES[list(b"0123456789abcdef")] = True
ANY_HEXES = HEXES.copy()
ANY_HEXES[list(b"ABCDEF")] = True


def has_run(member: np.ndarray, least: int) -> bool:
    """Whether `least` neighbouring values are all true."""
    held = 1
    while held < least and len(member):
        step = min(held, least - held)
        member = member[:-step] & member[step:]
        held += step
    return bool(member.any())


def unpadded(run: str) -> bytes | None:
    try:
        text = run.rstrip("=").replace("-", "+").replace("_", "/")
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER items that fill data exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at:at + n], "big")
            at += n
            if size < 128:
                return None
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def nested(data: bytes) -> bool:
    """Whether the lengths of all constructed items agree, to the innermost."""
    waiting = [data]
    while waiting:
        items = der_items(waiting.pop())
        if items is None:
            return False
        waiting += [content for tag, content in items if tag & 0x20]
    return True


def openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key at the start of data, all fields checked, or None."""
    def number(at):
        return int.from_bytes(data[at:at + 4], "big") if at + 4 <= len(data) else len(data)

    at, fields = len(OPENSSH), []
    for _ in range(3):  # cipher, key derivation and its options
        fields.append(data[at + 4:at + 4 + number(at)])
        at += 4 + number(at)
    count, at = number(at), at + 4
    if not fields[0] or not fields[1] or not 1 <= count <= len(data) - at:
        return None
    for _ in range(count):
        if at >= len(data) or number(at) < 4:
            return None
        at += 4 + number(at)
    size, at = number(at), at + 4
    if at + size > len(data) or size < 8 or size % 8:
        return None
    if fields[0] == b"none" and data[at:at + 4] != data[at + 4:at + 8]:
        return None
    return at + size


def der_size(data: bytes) -> int | None:
    """Bytes of the DER item that starts data, by its own length; data may hold its head only."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    n = data[1] & 127 if data[1] & 128 else 0
    if n > 4 or data[1] == 128 or len(data) < 2 + n:
        return None
    return 2 + n + (int.from_bytes(data[2:2 + n], "big") if n else data[1])


def wrapped_keys(text: str) -> list[tuple[int, int]]:
    """Spans of base64 keys that begin and end with a line; the key's own length says which line is its last."""
    found = []
    for m in LINES.finditer(text):
        spans, at = [], m.start()
        while line := LINE.match(text, at, m.end()):
            spans.append(line.span())
            at = gap.end() if (gap := BREAK.match(text, line.end(), m.end())) else m.end()
        chars = [0]
        for a, b in spans:
            chars.append(chars[-1] + b - a)
        k = 0
        if m.start() and LINE.match(text[m.start() - 1]) and text[m.start() - 2:m.start()] != "\\n":
            k = 1  # the match begins within a word
        while k < len(spans):
            start, stop = spans[k][0], len(spans)
            head = text[start:min(spans[k][1], start + 8)]
            if head.startswith("b3BlbnNz"):
                whole = "".join(text[a:b] for a, b in spans[k:])
                data = unpadded(whole[:len(whole) - (len(whole) % 4 == 1)])
                size = openssh_size(data) if data and data.startswith(OPENSSH) else None
            else:
                data = unpadded(head[:len(head) // 4 * 4]) if head[0] == "M" else None
                size = der_size(data) if data else None
            need = -(-size * 4 // 3) if size else 0
            last = bisect.bisect_left(chars, chars[k] + need)
            if need >= 40 and last <= stop and chars[last] == chars[k] + need:
                data = unpadded("".join(text[a:b] for a, b in spans[k:last]))
                if data and key_structure(data):
                    found.append((start, m.end() if last == stop else spans[last - 1][1]))
                    k = last
                    continue
            k += 1
    return found


def key_structure(data: bytes) -> bool:
    """A DER sequence that holds a key, or an OpenSSH private key."""
    if data.startswith(OPENSSH):
        return openssh_size(data) == len(data)
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30 or not nested(data):
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    names = der_items(inner[0][1]) if tags[0] == 0x30 else der_items(inner[1][1]) if tags[1] == 0x30 else None
    if tags[0] == 0x02 and tags[1] == 0x30:  # PKCS #8: version, algorithm, key
        return len(tags) >= 3 and tags[2] == 0x04 and bool(names) and names[0][0] == 0x06
    if tags[0] == 0x30 and tags[1] in (0x03, 0x04):  # a public key, or an encrypted private one: algorithm, key
        return len(tags) == 2 and bool(names) and names[0][0] == 0x06
    return all(t == 0x02 for t in tags) and len(tags) >= 8 or tags[:2] == [0x02, 0x04]  # RSA; EC


def hex_key_structure(run: str) -> bool:
    return len(run) % 2 == 0 and key_structure(bytes.fromhex(run))


def signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        header, claims = json.loads(unpadded(head) or b""), json.loads(unpadded(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def find_secrets(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret in code points, base kinds first, each kind in order of start."""
    found, low = [], raw.lower()
    bytes_ = np.frombuffer(raw, np.uint8)
    coded = has_run(BASE64[bytes_], 36)
    hexed = has_run(HEXES[bytes_], 16)
    hex_key = has_run(ANY_HEXES[bytes_], 80)
    assigned = any(x in low for x in HINTS)
    signed = b"eyJ" in raw
    wrapped = b"M" in raw or b"b3BlbnNz" in raw
    if not (coded or hexed or hex_key or assigned or signed or wrapped or b"AKIA" in raw):
        return found
    text = raw.decode(errors="replace")
    if assigned:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    keys = set()
    if hexed:
        runs = [m for m in HEX.finditer(text) if m.end() - m.start() >= 16]
        found += [("hex", *m.span()) for m in runs]
        keys |= {m.span() for m in runs if len(m[0]) >= 80 and hex_key_structure(m[0])}
    if hex_key:
        keys |= {m.span() for m in HEX_KEY.finditer(text) if hex_key_structure(m[0])}
    if signed:
        found += [("token", *m.span()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    if coded:
        keys |= {m.span() for m in RUN.finditer(text) if (data := unpadded(m[0])) and key_structure(data)}
    if wrapped:
        keys |= set(wrapped_keys(text))
    found += [("key", *x) for x in sorted(keys)]
    return found


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) for every whole text; a null text is empty and has none.

    Kinds: assign, access and hex by pattern; token and key by confirmed structure. Repeated rows and null keys
    stay; other columns are ignored. A very long text is a step of its own, scanned in linear time; bytes that are
    not UTF-8 count as U+FFFD.
    """
    def run(batches):
        for batch, texts in steps(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x)] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], names=[key, "spans"])

    rows = docs.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def joined_spans(spans: str, kinds: tuple[str, ...], by_kind: bool):
    """Column of kind:start:end of the spans by start, then kind as listed (or by kind first), comma-joined."""
    place = "array_position(array({}), x.kind)".format(", ".join(repr(k) for k in kinds))
    order = f"'o', {place}, 's', x.start" if by_kind else f"'s', x.start, 'o', {place}"
    return F.expr(f"""array_join(transform(array_sort(transform({spans}, x -> named_struct(
        {order}, 'e', x.end, 'v', concat_ws(':', x.kind, x.start, x.end)))), x -> x.v), ',')""")


def op10(docs: DataFrame) -> DataFrame:
    base = KINDS[:3]
    own = "filter(spans, x -> x.kind in ({}))".format(", ".join(repr(k) for k in base))
    return secret_scan(docs).select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in base],
        F.sha2(joined_spans(own, KINDS, False).cast("binary"), 256).alias("base_sha256"),
        joined_spans("spans", KINDS, False).alias("spans"))


def masked(docs: DataFrame, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs with every secret of each text replaced by mask, overlapping ones by one; other columns are as before.

    A null text stays null; repeated rows are masked each; secrets are those of secret_scan().
    """
    def clean(batches):
        at = None
        for batch, texts in steps(batches, text):
            at = batch.schema.get_field_index(text) if at is None else at
            out = []
            for x, whole in zip(batch.column(at), texts):
                spans = find_secrets(whole) if x.is_valid else []
                if not spans:
                    out.append(x.as_py())
                    continue
                string, parts, end = whole.decode(errors="replace"), [], 0
                for a, b in sorted((a, b) for _, a, b in spans):
                    if a >= end:
                        parts += [string[end:a], mask]
                    end = max(end, b)
                out.append("".join(parts) + string[end:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
