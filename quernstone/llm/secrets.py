"""Secret scans: patterns propose, structure confirms.

Base kinds are reported wherever their pattern matches: ``assign`` (a named value of 6 or more characters), ``access``
(an access key id of 20 or more characters) and ``hex`` (24 or more hex digits). Further kinds are reported only when
the decoded bytes have the structure of a secret:

``der``  base64 or hex that decodes to an ASN.1 SEQUENCE whose nested lengths fill it exactly and which starts like a
         private key (version INTEGER 0-3, then a key's fields); armour lines and line breaks may stand around or in it. In base64
         the outer length says at which line's end the key ends, whatever follows. Lines may be indented, and their breaks
         written as the characters \\n, as in JSON
``jwt``  three base64url parts of which the first decodes to a JSON object with an ``alg`` and the second to JSON
``ssh``  base64 that decodes to the openssh-key-v1 header, followed by length-prefixed fields inside the data

Base64 of armoured key text or of a signed token is decoded and searched in turn, one level down; its span has the kind of what it holds.

Null and empty texts have no spans. Spans are in code points, the end exclusive. Rows are scanned one by one, so copies,
ties and further columns change nothing; one text of any length is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "der", "jwt", "ssh")
MASK = "[REDACTED]"
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ANY_NAME = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])((?:ey|ew)[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_B64_START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-P]|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{14}")
_B64_LINE, _LINE_END, _PADDING = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*"), re.compile(r"={0,2}")
_B64_ARMOUR = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))LS0tLS1CRUdJTi[A-Za-z0-9+/_-]{14}")
_B64_TOKEN = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))ZX(?:lK|lB|dv|dL|dp)[A-Za-z0-9+/_-]{20,}")
_ARMOUR_END = re.compile(r"\s*-----END [A-Z0-9 ]+-----\s*")
_NO_BASE64 = re.compile(r"\\[rn]|[\s=]+")
_HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}(?![0-9A-Fa-f])")


def _decoded(text: str) -> bytes | None:
    raw = _NO_BASE64.sub("", text).translate({45: 43, 95: 47})
    try:
        return base64.b64decode(raw[: len(raw) - (len(raw) % 4 == 1)] + "=" * (-len(raw) % 4))
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the element at ``at``, or None if its length doesn't fit."""
    if at + 2 > end:
        return None
    size, start = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (data[at], start, start + size) if start + size <= end else None


def is_private_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data, filled in turn by its elements, with a key's version and fields."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    tags, sizes, at = [], [], top[1]
    while at < top[2]:
        part = _tlv(data, at, top[2])
        if part is None:
            return False
        tags.append(part[0])
        sizes.append(part[2] - part[1])
        if part[0] == 0x30 and (inner := part[1]) < part[2]:
            while inner < part[2]:
                sub = _tlv(data, inner, part[2])
                if sub is None:
                    return False
                inner = sub[2]
        at = part[2]
    if len(tags) < 2 or tags[0] != 0x02 or sizes[0] != 1:
        return False
    version = data[_tlv(data, top[1], top[2])[1]]
    if version > 3:
        return False
    if tags[1] == 0x02:  # the integers of an RSA or DSA key
        return len(tags) >= 5 and all(t == 0x02 for t in tags[1:6])
    if tags[1] == 0x30:  # algorithm, then the wrapped key
        return len(tags) >= 3 and tags[2] == 0x04
    return tags[1] == 0x04 and sizes[1] >= 16  # the scalar of a curve's key


def is_ssh_key(data: bytes) -> bool:
    """The header, then four fields whose lengths stay inside the data."""
    return ssh_size(data) is not None


def ssh_size(data: bytes) -> int | None:
    """The size of the key that starts the data, that of the data if the key is cut off behind its first four fields, or None."""
    head = b"openssh-key-v1\x00"
    if not data.startswith(head):
        return None
    at, cipher = len(head), b""
    for field in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        if field == 0:
            cipher = data[at + 4 : at + 4 + size]
        at += 4 + size
        if at + 4 > len(data):
            return None
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= 16:
        return None
    at += 4
    for _ in range(keys + 1):  # the public keys, then the private ones
        if at + 4 > len(data):
            return len(data)
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    at += 16 * (cipher in (b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com"))  # a tag follows
    return min(at, len(data))


def is_signed_token(head: str, body: str) -> bool:
    try:
        header, claims = json.loads(_decoded(head) or b""), json.loads(_decoded(body) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


class _Run:
    """Base64 lines that follow one another: where each begins and ends, and how many characters stand in front of it."""

    def __init__(self, text: str, start: int):
        self.text, self.begins, self.ends, self.before, chars = text, [], [], [], 0
        while line := _B64_LINE.match(text, start):
            self.begins.append(line.start())
            self.ends.append(line.end())
            self.before.append(chars)
            chars += line.end() - line.start()
            if not (onward := _LINE_END.match(text, line.end())):
                break
            start = onward.end()
        self.chars, self.end = chars, self.ends[-1]

    def place(self, at: int) -> int:
        """How many characters stand in front of a place in the run."""
        i = bisect.bisect_right(self.begins, at) - 1
        return self.before[i] + at - self.begins[i]

    def after(self, chars: int) -> int:
        """Where so many characters of the run end."""
        i = bisect.bisect_left(self.before, chars) - 1
        return self.begins[i] + chars - self.before[i]


def _chars(size: int) -> int:
    """The base64 characters of so many bytes, without padding."""
    return -(-size * 4 // 3)


def _key_at(run: _Run, start: int) -> tuple[int, str] | None:
    """Where the key that starts here ends, and its kind: its own lengths say how many lines of the run it takes."""
    at, text = run.place(start), run.text
    left = run.chars - at
    head = _decoded(text[start : run.after(at + min(left, 32))]) or b""
    if head[:1] == b"\x30" and len(head) > 1:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
        if n > 4 or head[1] == 0x80 or head[2 + n : 3 + n] != b"\x02" or _chars(size) > left:
            return None
        end = run.after(at + _chars(size))
        if rest := _B64_LINE.match(text, end):  # a key ends with its line; one character more holds no byte
            if size % 3 or rest.end() - end > 1:
                return None
        kind = "der" if is_private_key((_decoded(text[start:end]) or b"")[:size]) else None
    elif head.startswith(b"openssh-key-v1\x00"):
        if (size := ssh_size(_decoded(text[start : run.end]) or b"")) is None:
            return None
        end, kind = run.after(at + min(left, _chars(size))), "ssh"
    else:
        return None
    if rest := _B64_LINE.match(text, end):
        end = rest.end()
    return (_PADDING.match(text, end).end(), kind) if kind else None


def key_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64. The search goes on at the end of a key, where the next may begin, or behind the start of what is none."""
    run, found = None, _B64_START.search(text)
    while found:
        start = found.start()
        if run is None or start >= run.end:
            run = _Run(text, start)
        key = _key_at(run, start)
        if key:
            yield start, *key
        found = _B64_START.search(text, key[0] if key else start + 1)


def _inner(start: int, run: _Run, stop: int, found: tuple[int, int, str] | None, data: str) -> tuple[int, int, str] | None:
    """The span of base64 whose decoded text holds a secret: from its start to the line end behind the secret and its last armour line."""
    if found is None:
        return None
    last = _ARMOUR_END.match(data, found[1])
    end = min(stop, run.after(run.place(start) + min(run.chars - run.place(start), _chars(last.end() if last else found[1]))))
    if rest := _B64_LINE.match(run.text, end):
        end = rest.end()
    return start, _PADDING.match(run.text, end).end(), found[2]


def nested_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Armoured keys and signed tokens in base64. What is decoded for one start ends where the next begins, so that all are read once."""
    heads = [m.start() for m in _B64_ARMOUR.finditer(text)] if "LS0tLS1CRUdJTi" in text else []
    run = None
    for i, start in enumerate(heads):
        if run is None or start >= run.end:
            run = _Run(text, start)
        stop = min(run.end, heads[i + 1]) if i + 1 < len(heads) else run.end
        data = (_decoded(text[start:stop]) or b"").decode("latin-1")
        if span := _inner(start, run, stop, next(key_spans(data), None), data):
            yield span
    for m in _B64_TOKEN.finditer(text):
        data = (_decoded(m[0]) or b"").decode("latin-1")
        token = _JWT.match(data)
        if token and is_signed_token(token[1], token[2]):
            yield m.start(), _PADDING.match(text, m.end()).end(), "jwt"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if _ANY_NAME.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _JWT.finditer(text):
        if is_signed_token(m[1], m[2]):
            out.append((m.start(), m.end(), "jwt"))
    out += key_spans(text)
    out += nested_spans(text)
    for m in _HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "der"))
    return out


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start and then in the order of KINDS."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if text else []


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at, stop = [], 0, -1
    for start, end, _ in found:
        if start >= max(stop, 0) and (stop < 0 or start >= stop):
            out += [text[at:start], MASK]
            at = stop = end
        elif end > stop:
            at = stop = end
    return "".join([*out, text[at:]])


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""

    def run(batches):
        for batch in common.slices(batches):
            counts, digests, texts = [], [], []
            for text in batch.column("text").to_pylist():
                found = spans(text)
                base = [s for s in found if s[2] in KINDS[:3]]
                counts.append([sum(s[2] == k for s in base) for k in KINDS[:3]])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(found))
            columns = {f"n_{k}": pa.array([c[i] for c in counts], pa.int64()) for i, k in enumerate(KINDS[:3])}
            yield common.batch_of(doc_id=batch.column("doc_id"), **columns, base_sha256=pa.array(digests, pa.string()), spans=pa.array(texts, pa.string()))

    return common.ids_back(common.texts_of(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, every column and row kept, with the secrets in ``text`` masked and ``n_chars`` counted anew where that column exists."""
    schema, counted = docs.schema, "n_chars" in docs.columns

    def run(batches):
        for batch in common.slices(batches):
            texts = [redacted(t, f) if (f := spans(t)) else t for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(schema["n_chars"].dataType), F.col("n_chars"))) if counted else out


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
