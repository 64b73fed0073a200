import hashlib
import itertools
import math
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidpath.llm import secret_scan as scan
from tests.llm.conftest import ROWS

KEY = "AKIA" + "ABCDEFGH01234567"
TEXTS = [t for _, t, *_ in ROWS] + [
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', f"é {KEY} ü password: hunter22", "password: token: abcdef", "API_KEY='x.y/z+w==' apikey:abc", "ſecret = abcdefgh", "toKen=abcdefgh",
    "AKIAABC AKIA" + "Z" * 30, "deadbeef" * 3 + "g" + "0" * 23, "secret=token=abcdef", "PASSWD\"  :  'longer-than-six'", "the password is Tr0ub4dor&3xyzzyQ", "pwd qwertyuiop", "token: 12345", "漢字 secret: 漢字abcdef",
]


def brute(text):
    text = text or ""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    out = [("assign", *m.span()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], scan.KINDS.index(s[0])))


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    base, found = scan.scan(text or "")
    assert base == brute(text)
    assert set(base) <= set(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "api", "_", "KEY", "token", "=", ":", " ", '"', "'", "AKIA", "ABC123XYZ9", "0af", "deadbeefdeadbeefdeadbeef", "é", "漢", "\n", "x", "12345678"]), max_size=25).map("".join))
def test_base_of_mixtures(text):
    assert scan.scan(text)[0] == brute(text)


def exhaustive(value):
    each = scan.char_cost(value)
    known = {}
    for a, b, cost, _ in scan.segments(value):
        known[a, b] = min(cost, known.get((a, b), math.inf))
    best = math.inf
    for n in range(len(value)):
        for cuts in itertools.combinations(range(1, len(value)), n):
            ends = [0, *cuts, len(value)]
            total = sum(min(known.get(s, math.inf), each * (s[1] - s[0])) for s in zip(ends, ends[1:])) + n * scan.JOINT
            best = min(best, total)
    return best


@pytest.mark.parametrize("value", ["password", "Dragon1999", "aaaaaaaa", "qwertyx", "x7#kQz", "abcabcabc", "20240131z", "monkey!!!"])
def test_cost_is_the_least(value):
    cost, cut = scan.guess_cost(value)
    assert cost == pytest.approx(exhaustive(value))
    assert [a for a, _, _ in cut] == [0, *[b for _, b, _ in cut[:-1]]] and cut[-1][1] == len(value)


def test_strength():
    weak = ("password123", "changeme", "qwertyuiop", "aaaaaaaaaaaaaaa", "hunter1999", "example")
    strong = ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "x9$Kq2!vLm#8", "ghp_16C7e42F292c6912E7710c838347Ae178B4a")
    assert all(scan.guess_cost(v)[0] < scan.THRESHOLD for v in weak)
    assert all(scan.guess_cost(v)[0] >= scan.THRESHOLD for v in strong)
    assert scan.guess_cost("")[0] == 0.0 and scan.guess_cost("x" * 20_000)[0] < 8


def test_context_values_are_added():
    assert ("guess", 4, 16) in scan.scan("pwd=x9$Kq2!vLm#8")[1]
    assert not any(k == "guess" for k, _, _ in scan.scan("password: changeme")[1])


def test_documents(spark, docs, no_docs):
    got = scan.scan_documents(docs).collect()
    assert len(got) == len(ROWS)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for r in scan.scan_documents(df).collect():
        base = brute(TEXTS[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert scan.scan_documents(no_docs).count() == 0


@pytest.mark.parametrize(
    "before, value",
    [
        ("Authorization: Bearer ", "eyJhbGciOiJIUzI1NiJ9.x7Kq"), ("Authorization: Basic ", "dXNlcjpzM2NyI3QhWHk5"), ("login password: ", "s3cr#t!Xy9&zz"),
        ("password:\t", "s3cr#t!Xy9&zz"), ("pwd=\n", "s3cr#t!Xy9&zz"), ("secret=token=", "s3cr#t!Xy9&zz"), ("token is\t", "s3cr#t!Xy9&zz"), ("mypassword=", "s3cr#t!Xy9&zz"), ("userPass=", "s3cr#t!Xy9&zz"),
    ],
)
def test_contexts(before, value):
    text = f"say {before}{value} end"
    at = text.index(value)
    assert ("guess", at, at + len(value)) in scan.scan(text)[1]


@pytest.mark.parametrize("text", ["the secret ingredient of it", "a token contribution to", "a compass x9$Kq2!vLm#8", "the secret\nnegotiations went", "password requirements are"])
def test_prose_has_no_values(text):
    assert not scan.scan(text)[1]


def test_values_within_values():
    text = "u?password=s3cr#t!Xy9zz&token=Kq2!vLm#8x9$"
    assert [text[a:b] for k, a, b in scan.scan(text)[1] if k == "guess"] == ["s3cr#t!Xy9zz&token=Kq2!vLm#8x9$", "Kq2!vLm#8x9$"]
    chain = "password=x&" * 5_000
    assert sum(b - a for a, b in scan.context_values(chain.encode())) <= 2 * len(chain)


PROSE = """The password is required before login. A secret agreement between the two governments was signed. The token gesture pleased
nobody. Please keep the password somewhere safe. Bearer certificates were common. The secret: practice every morning. They pass through
customs. Password requirements: uppercase letters, numbers, symbols. The api key rotates automatically. login: available tomorrow.
A private key should never be published. Her secret garden remained undisturbed. Credentials: please contact support. The
passphrase is something memorable. auth: disabled. token = required. password: <your-password>. secret = changeme123. pwd: password1.
access key: example. passcode is twelve34. The authorization process continues. password=****************. token: none."""


def test_precision_and_recall_on_planted_values():
    """Random values planted behind contexts that the fixed patterns don't read, among ordinary sentences."""
    rnd = random.Random(11)
    letters, more = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "!#$%&*+?@^~"
    make = [lambda: "".join(rnd.choices(letters, k=rnd.randrange(10, 33))), lambda: "".join(rnd.choices(more, k=rnd.randrange(9, 25))), lambda: "eyJ" + "".join(rnd.choices(letters + "-_", k=40)) + "." + "".join(rnd.choices(letters, k=12))]
    before = ["Authorization: Bearer ", "Authorization: Basic ", "pwd=", "pass: ", "passphrase is ", "login ", "credentials: ", "private key\n", "access_key => ", "auth:\t", "bearer "]
    sentences = PROSE.split(".")
    found = planted = hit = 0
    for _ in range(400):
        value, context = rnd.choice(make)(), rnd.choice(before)
        text = rnd.choice(sentences) + ". " + context + value + " " + rnd.choice(sentences) + "."
        at = text.index(value)
        got = [(a, b) for k, a, b in scan.scan(text)[1] if k == "guess"]
        planted += 1
        hit += (at, at + len(value)) in got
        found += len(got)
    assert hit >= 0.97 * planted and hit >= 0.97 * found
