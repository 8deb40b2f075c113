"""Secret scans: base spans against plain patterns over strings, and keys and tokens that are built here and planted."""

import base64
import hashlib
import json
import random
import re

import pytest

from swatchwork.llm import secretscan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secretscan.KINDS[k], a, b) for a, k, b in sorted(found)]


r = random.Random(12)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(bits):
    return der(2, b"\0" + (r.getrandbits(bits) | 1 << bits - 1).to_bytes(bits // 8, "big"))


def rsa(bits=1024):
    return der(0x30, der(2, b"\0"), number(bits), der(2, b"\1\0\1"), number(bits), *(number(bits // 2) for _ in range(5)))


def ec():
    return der(0x30, der(2, b"\1"), der(4, r.randbytes(32)), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))), der(0xA1, der(3, b"\0\4" + r.randbytes(64))))


def pkcs8(oid, inner):
    return der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex(oid)), der(5)), der(4, inner))


def public():
    return der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d010101")), der(5)), der(3, b"\0" + der(0x30, number(1024), der(2, b"\1\0\1"))))


def field(x):
    return len(x).to_bytes(4, "big") + x


def openssh(cipher=b"none", check=None):
    pub = field(b"ssh-ed25519") + field(r.randbytes(32))
    own = field(b"ssh-ed25519") + field(r.randbytes(32)) + field(r.randbytes(64)) + field(b"me@host")
    a = r.randbytes(4)
    return b"openssh-key-v1\0" + field(cipher) + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(pub) + field(a + (check or a) + own)


def url(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).rstrip(b"=").decode()


def jwt(alg="HS256", size=32, **more):
    return f"{url({'alg': alg, 'typ': 'JWT'} | more)}.{url({'sub': 'né', 'n': 7})}.{url(r.randbytes(size))}"


def plain(x):
    return base64.b64encode(x).decode()


def lines(x, cut="\n", n=64):
    code = plain(x)
    return cut.join(code[k : k + n] for k in range(0, len(code), n))


def armoured(x, kind="RSA ", cut="\n"):
    return f"-----BEGIN {kind}PRIVATE KEY-----{cut}{lines(x, cut)}{cut}-----END {kind}PRIVATE KEY-----"


KEYS = [
    (plain(rsa()), "rsa"),
    (armoured(rsa()), "rsa"),
    (armoured(rsa(2048), cut="\\n"), "rsa"),
    (armoured(pkcs8("2a864886f70d010101", rsa()), ""), "pkcs8 rsa"),
    (lines(ec()), "ec"),
    (url(ec()), "ec"),
    (plain(pkcs8("2a8648ce3d0201", ec())), "pkcs8 ec"),
    (plain(pkcs8("2b6570", der(4, r.randbytes(32)))), "pkcs8 ed25519"),
    (rsa().hex(), "rsa"),
    (ec().hex().upper(), "ec"),
    (armoured(openssh(), "OPENSSH "), "openssh ssh-ed25519"),
    (openssh(b"aes256-ctr", b"abcd").hex(), "openssh ssh-ed25519 encrypted"),
    (plain(der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(4, b"x" * 20))), der(4, r.randbytes(64)))), "encrypted pkcs8"),
]
TOKENS = [(jwt(), "signed HS256"), (jwt("RS256", 256), "signed RS256"), (jwt("ES256", 64, kid="ß"), "signed ES256"), (jwt("odd", 20), "signed odd"), (f"{url({'alg': 'dir', 'enc': 'A128GCM'})}..{url(b'iv' * 6)}.{url(b'text')}.{url(b'tag' * 5)}", "encrypted dir")]
NOT = [
    plain(public()),
    plain(rsa()[:-9]),
    plain(rsa()[:40] + b"\0" * 300),
    plain(pkcs8("2b6570", der(4, r.randbytes(31)))),
    plain(openssh(check=b"none")),
    plain(r.randbytes(900)),
    rsa().hex()[:-20],
    jwt("HS256", 31),
    jwt("none", 32),
    "eyJub3RhbGciOjF9.eyJhIjoxfQ." + url(r.randbytes(32)),
    "eyJ.eyJ.eyJ",
    "the password is well kept; tokens: none",
    "MII" * 40,
]
BASES = [
    "Token = 'abcdef' PASSWD:\"a.b-c=\" api_key=12345 APIKEY : x/y+z_1 secret=token=abcdef",
    "toKen=ſecretſ ſecret=abcdefgh paſsword=abcdefgh",
    "AKIA" + "B7" * 8 + " AKIAshort xAKIA" + "Q" * 30 + " AKIA" + "1" * 15,
    "é" * 9 + "deadbeef" * 3 + " " + "0123456789abcdef" * 2 + "G" + "f" * 24,
    "token" + " " * 3000 + "x secret" + " " * 90 + "= " + "z" * 6,
]


def test_confirmed_by_structure():
    for text, want in KEYS:
        for around in ("{}", "key: {}\nnext", "é “{}” ", 'const k = "{}";'):
            whole = around.format(text)
            found = [x for x in secretscan.scan(whole.encode()) if x[1] == 3]
            assert [x[3] for x in found] == [want], (whole, found)
            assert whole.encode()[found[0][0] : found[0][2]].decode() == text
    for text, want in TOKENS:
        whole = f"Ä Bearer {text}, more"
        assert [(whole.encode()[a:b].decode(), what) for a, k, b, what in secretscan.scan(whole.encode()) if k > 2] == [(text, want)]
    for text in NOT:
        assert not [x for x in secretscan.scan(f"a {text} b".encode()) if x[1] > 2], text
    two = f"{armoured(rsa())}\n{armoured(ec(), 'EC ')}\ntoken={TOKENS[0][0]}"
    assert [(secretscan.KINDS[k], what) for _, k, _, what in secretscan.scan(two.encode())] == [("private_key", "rsa"), ("private_key", "ec"), ("assign", "signed HS256"), ("signed_token", "signed HS256")]


@pytest.fixture(scope="module")
def rows():
    pieces = [x for x, _ in KEYS + TOKENS] + NOT + BASES + ["word", "über", "\n"] * 40
    texts = [None, "", " ", *pieces, *(" ".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(80)), "abc" * 30_000 + " token=abcdefg " + plain(rsa())]
    for _ in range(200):  # anything goes
        texts.append("".join(r.choice(["token", "=", ":", " ", '"', "'", "AKIA", "Secret", "apikey", "0a", "f", "Z9", "é", "-", ".", "MII", "3082"]) for _ in range(r.randint(1, 60))))
    return [(k * 3, t, "x") for k, t in enumerate(texts)] + [(0, BASES[0], "y"), (None, BASES[1], None)]


def test_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    got = secretscan.secret_spans(docs).collect()
    only = lambda x: [(s.kind, s.start, s.end) for s in x.spans if s.kind in secretscan.BASE]
    assert sorted(((x.doc_id, only(x)) for x in got), key=str) == sorted(((k, base_spans(t)) for k, t, _ in rows), key=str)
    assert secretscan.secret_spans(docs.limit(0)).count() == 0


def test_contract(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secretscan.op11_secret_scan(spark, str(tmp_path)).collect()
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    count = lambda spans, kind: sum(k == kind for k, *_ in spans)
    want = []
    for k, t, _ in rows:
        base = base_spans(t)
        want.append((k, *(count(base, x) for x in secretscan.BASE), hashlib.sha256(line(base).encode()).hexdigest()))
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    by = {x.doc_id: x.spans for x in got}
    for k, t, _ in rows[3 : 3 + len(KEYS)]:
        assert f"private_key:0:{len(t)}" in by[k]
