import base64
import json
import re
import time

import pytest

from motorlake.llm.secrets import KINDS, base_spans, confirmed_spans, der_items, in_order, scan_secrets


def der(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")) + body


KEY = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x05, b"")) + der(0x04, b"k" * 200))


def b64url(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


TOKEN = f"{b64url(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{b64url(json.dumps({'sub': 'someone'}).encode())}.{b64url(b's' * 32)}"
SSH = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"p" * 32))).decode()


def kinds(text):
    return [k for _, _, k in confirmed_spans(text)]


def test_structures_are_confirmed():
    assert kinds(f"x {TOKEN} y") == ["jwt"]
    assert kinds(base64.b64encode(KEY).decode()) == ["der"]
    assert kinds(KEY.hex()) == ["der"]
    assert kinds(f"ssh-ed25519 {SSH} me@host") == ["ssh"]
    body = base64.b64encode(KEY).decode()
    assert kinds("-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", body)) + "\n-----END PRIVATE KEY-----") == ["pem"]


@pytest.mark.parametrize("text", ["", "a" * 60, base64.b64encode(b"just some words that are not a key at all").decode(), base64.b64encode(KEY[:-1]).decode(), f"{b64url(b'[1]')}aaaaaa.bbbbbbbb.c", "0123456789abcdef" * 4, "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----"])
def test_lookalikes_are_not(text):
    assert kinds(text) == []


def test_der_lengths():
    assert der_items(KEY) is not None and der_items(KEY[:-1]) is None and der_items(b"\x30") is None and der_items(b"\x30\x80") is None


def brute(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((*m.span(), "assign"))
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        found += [(*m.span(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return in_order(found)


@pytest.mark.parametrize("text", ["PassWord = 'hunter22'", "token:abc", "api_key='abcdef' apikey=1234567", "AKIA" + "A1" * 8, "AKIA123", "é secret = deadbeefdeadbeefdeadbeef", "toKen=abcdefg", "x" * 100_000])
def test_base(text):
    assert in_order(base_spans(text)) == brute(text)


def test_rows(documents, corpus):
    rows = documents([(1, None), (2, ""), (3, f"token = {'ab' * 20} {TOKEN}"), (3, f"token = {'ab' * 20} {TOKEN}"), (None, "x")])
    got = sorted((r["doc_id"] or 0, r["n_assign"], r["n_hex"], r["n_confirmed"]) for r in scan_secrets(rows).collect())
    assert got == [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 1, 1), (3, 1, 1, 1)]
    assert scan_secrets(rows.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in scan_secrets(corpus).collect():
        assert r["base_spans"] == brute(texts[r["doc_id"]] or "")
        assert set(r["base_spans"].split(",")) <= set(r["spans"].split(","))
    assert KINDS[:3] == ("assign", "access", "hex")


BODY = base64.b64encode(KEY).decode()
CIPHERED = base64.b64encode(b"c" * 64).decode()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"key": "-----BEGIN PRIVATE KEY-----\\n' + "\\n".join(re.findall(".{1,64}", BODY)) + '\\n-----END PRIVATE KEY-----"}', ["pem"]),
        (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0A' * 16}\n\n{CIPHERED}\n-----END RSA PRIVATE KEY-----", ["pem"]),
        (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{CIPHERED}\n-----END RSA PRIVATE KEY-----", []),
        ("key:\n" + "\n".join(re.findall(".{1,64}", BODY)) + "\nend", ["der"]),
        (f"0x{KEY.hex()}", ["der"]),
        (f"key_{KEY.hex()}", ["der"]),
        (f"/etc/keys/{BODY}", ["der"]),
        (f"name-of-it_{BODY}", ["der"]),
        (f"bearer.something.{TOKEN}", ["jwt"]),
        (f"{TOKEN} and {TOKEN}", ["jwt", "jwt"]),
        ("M" * 200_000 + " " + "/MA" * 50_000, []),
        ("a." * 100_000, []),
    ],
)
def test_keys_as_they_are_found(text, want):
    assert kinds(text) == want


def test_clashing_columns(documents):
    rows = documents([(1, "token = abcdefgh")]).selectExpr("*", "'own' as spans", "'own' as n_assign")
    assert [(r["n_assign"], r["spans"]) for r in scan_secrets(rows).collect()] == [(1, "assign:0:16")]


def ssh_key(name=b"ssh-rsa"):
    parts = (name, b"\1\0\1", bytes(range(60)))
    return base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in parts)).decode()


@pytest.mark.parametrize("before", ["x/", "ab/", "abc-", "abcd_", "AAAA/AAAA/", "AAAAB3NzaC1yc2E/"])
def test_keys_behind_every_place_of_a_group(before):
    text = f"{before}{ssh_key()} end"
    assert [text[a:b] for a, b, k in confirmed_spans(text) if k == "ssh"] == [ssh_key()]


@pytest.mark.parametrize("run", ["AAAA/" * 200_000, "AAAAB3NzaC1yc2E/" * 60_000, "AAAAAAAA-" * 100_000])
def test_long_runs_of_starts_take_linear_time(run):
    began = time.perf_counter()
    assert confirmed_spans(run) == []
    assert time.perf_counter() - began < 15
