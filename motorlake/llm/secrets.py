"""Secret scans: patterns find candidates, the structure of what they decode to confirms them."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from motorlake.llm.arrow import mapper, texts

#: The patterns of the three base kinds and the order of all kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_LONGEST = max(map(len, SSH_NAMES))
SSH_MARK = b"openssh-key-v1\0"

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE))-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{48,80}\r?\n[\x20\t]*)+[A-Za-z0-9+/]{1,80}={0,2}(?![A-Za-z0-9+/=])")
#: Three dotted parts; a lookahead, so that parts before a header don't use it up.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*))")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:0[xX])?([0-9A-Fa-f]{48,})(?![0-9A-Fa-f])")
#: How base64 of a SEQUENCE, of an algorithm name with its length, and of the private key marker begins; behind a separator inside a run, only these are tried.
STARTS = re.compile(r"(?:^|(?<=[/_-]))(?=M[A-P]|AAAA|b3BlbnNzaC1rZXktdjE)")
CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*[0-9A-Fa-f]{16,32}\s*$", re.MULTILINE)

Span = tuple[int, int, str]


def unbase64(text: str) -> bytes | None:
    """Either alphabet, with or without padding; None if it doesn't decode."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the items that fill ``data`` exactly; None if lengths don't fit."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the data, of two items or more whose nested SEQUENCEs fill theirs, with an INTEGER or object identifier inside."""
    top = der_items(data)
    if top is None or len(top) != 1 or top[0][0] != 0x30:
        return False
    todo, leaves, first = [top[0][1]], set(), True
    while todo:
        items = der_items(todo.pop())
        if items is None or first and len(items) < 2:
            return False
        first = False
        for tag, body in items:
            if tag in (0x30, 0x31):
                todo.append(body)
            else:
                leaves.add(tag)
    return bool(leaves & {0x02, 0x06})


def _fills(data: bytes, at: int, known: dict[int, bool]) -> bool:
    """Whether strings with their lengths in front fill ``data`` from ``at`` on; ``known`` keeps what is found for each place, so that no place is looked at twice."""
    way = []
    while at not in known:
        if at == len(data):
            known[at] = True
            break
        way.append(at)
        at += 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1
        if at > len(data):
            known[at] = False
    found = known[at]
    known.update(dict.fromkeys(way, found))
    return found


def is_ssh_key(data: bytes, at: int = 0, known: dict[int, bool] | None = None) -> bool:
    """Whether there is, from ``at`` on, the private key marker, or a known algorithm name in strings whose lengths fill the data."""
    if data.startswith(SSH_MARK, at):
        return True
    size = int.from_bytes(data[at : at + 4], "big")
    return data[at + 4 : at + 4 + size] in SSH_NAMES and _fills(data, at, {} if known is None else known) if size <= SSH_LONGEST else False


def is_signed_token(text: str) -> bool:
    """A header that is a JSON object with an algorithm, and a payload that is a JSON object."""
    parts = []
    for part in text.split(".")[:2]:
        try:
            value = json.loads(unbase64(part) or b"")
        except (ValueError, RecursionError):
            return False
        parts.append(value)
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        found += [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def is_pem(body: str) -> bool:
    """What stands between the armour lines: a key or certificate, or data ciphered as its headers say. Line ends may be escaped, as in JSON."""
    lines = body.replace("\\r", "\n").replace("\\n", "\n").split("\n")
    heads = [line for line in lines if ":" in line]
    data = unbase64("".join("".join(line.split()) for line in lines if ":" not in line))
    if not data:
        return False
    if any(line.strip().startswith("Proc-Type") and "ENCRYPTED" in line for line in heads):
        return len(data) % 8 == 0 and any(CIPHER.search(line.strip()) for line in heads)
    return is_der_key(data) or is_ssh_key(data)


def _kind(data: bytes | None) -> str | None:
    return None if not data else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _ends_with(head: bytes, size: int) -> bool:
    """Whether a SEQUENCE with this head is ``size`` bytes long."""
    if head[:1] != b"\x30" or len(head) < 6:
        return False
    own, n = head[1], head[1] & 0x7F
    total = 2 + own if own < 0x80 else 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else 0
    return total == size


def _inside(run: str) -> tuple[int, str] | None:
    """(start, kind) of the first key that begins behind a separator in a run of base64 and ends with it.

    The run is decoded once for each of the four places that a start can have in a group
    of four characters, and starts are places in these bytes.
    """
    decoded: dict[int, bytes | None] = {}
    known: dict[int, dict[int, bool]] = {}
    for m in STARTS.finditer(run):
        start = m.start()
        phase = start % 4
        if not start:
            continue
        if phase not in decoded:
            decoded[phase], known[phase] = unbase64(run[phase:]), {}
        data, at = decoded[phase], (start - phase) // 4 * 3
        if not data:
            continue
        if is_ssh_key(data, at, known[phase]):
            return start, "ssh"
        if _ends_with(data[at : at + 6], len(data) - at) and is_der_key(data[at:]):
            return start, "der"
    return None


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded structure is that of a key or signed token; of those inside another one, only the outer."""
    found: list[Span] = []
    if "-----BEGIN " in text:
        found += [(*m.span(), "pem") for m in PEM.finditer(text) if is_pem(m[2])]
    if max(map(len, text.split()), default=0) < 18:
        return found
    found += [(*m.span(1), "jwt") for m in SIGNED.finditer(text) if is_signed_token(m[1])]
    for m in WRAPPED.finditer(text):
        if kind := _kind(unbase64("".join(m[0].split()))):
            found.append((*m.span(), kind))
    for m in RUN.finditer(text):
        if kind := _kind(unbase64(m[0])):
            found.append((*m.span(), kind))
        elif inner := _inside(m[0]):
            found.append((m.start() + inner[0], m.end(), inner[1]))
    for m in LONG_HEX.finditer(text):
        if len(m[1]) % 2 == 0 and (kind := _kind(bytes.fromhex(m[1]))):
            found.append((*m.span(), kind))
    outer: list[Span] = []
    for span in sorted(set(found), key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if not any(a <= span[0] and span[1] <= b for a, b, _ in outer):
            outer.append(span)
    return outer


def in_order(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_confirmed (long), base_spans, spans (string).

    Spans are kind:start:end in code points, end exclusive, by start, then in the order
    of KINDS. The kinds pem, jwt, der and ssh are candidates confirmed by structure;
    base spans stay whether confirmed or not. Null text is empty and has no spans; whole
    texts are searched, however long. Every row gives a row, repeated ones too; other
    columns aren't read, so they can't clash; an empty table gives no rows.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts(batch):
            base, more = base_spans(text), confirmed_spans(text)
            kinds = [k for _, _, k in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), in_order(base), in_order(base + more)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_spans", "spans"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(mapper(step), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_spans string, spans string")

