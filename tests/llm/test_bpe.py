import base64
import hashlib
import random
import struct

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from braidpath.llm import bpe
from tests.llm.conftest import LONG, ROWS

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

PATH = bpe.rank_file()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(tokenizers.PATTERN)


def ids(text):
    raw = bpe.encoder(PATH).encode([text])[0]
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'stremdl019.,!aA\u00a0\u3000\x85\x1c"))))
def test_pieces_and_ids_equal_the_library(text):
    assert bpe.split_pieces(text) == PATTERN.findall(text)
    assert ids(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "'s", "x's 's ''s don't I'LL we'll", "a" * 5000, "the" * 3000, " \n\n  x", "<|endoftext|>", LONG])
def test_known_traps(text):
    assert bpe.split_pieces(text) == PATTERN.findall(text)
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_late_pairs_are_encoded_one_by_one(tmp_path):
    """A rank file in which a token ranks before its parts: one pass in rank order would go wrong."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cab", b"abab", b"bca", b"ca", b"aba"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    library = tiktoken.Encoding("odd", pat_str=tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    ranks, rnd = bpe.Ranks(str(path)), random.Random(5)
    pieces = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(500)]
    assert ranks.replay([p.encode() for p in pieces]) == [library.encode_ordinary(p) for p in pieces]


def test_documents(docs, no_docs):
    got = bpe.encode_documents(docs, PATH).collect()
    assert len(got) == len(ROWS)
    texts = {i: t or "" for i, t, *_ in ROWS}
    for r in got:
        text = texts[r["doc_id"]]
        want = LIBRARY.encode_ordinary(text)
        assert (r["n_tokens"], r["ids"]) == (len(want), want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_ids(bpe.encode_documents(docs, PATH), PATH).collect()}
    assert back == {i: t.encode() for i, t in texts.items()}
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 3)
    own = bpe.Encoder(bpe.Ranks(PATH))
    for k in range(5):
        text = f"alpha beta gamma{k} delta{k} {'y' * 100}"
        raw = own.encode([text])[0]
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == LIBRARY.encode_ordinary(text)
    assert all(len(p) <= bpe.KNOWN_LENGTH for p in own.known) and len(own.known) < 20
