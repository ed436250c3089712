import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from terravane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = bpe.load_ranks(f)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_the_library(spark, docs, library):
    rng = random.Random(4)
    letters = "aeiou etaoin éüß漢字かな☃😀\n\t .,;!'0123456789ABC"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(400)))) for i in range(200)] + [(None, None), (900, ""), (901, "a" * 3000), (902, "x y " * 30_000), (903, "<|endoftext|>")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = []
    for i, t in rows:
        ids = library[1].encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in bpe.digests(docs(rows), PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(got) == sorted(want)


def test_round_trip_and_streaming(spark, docs, library):
    rows = [(1, "Ünïcode ☃ text 😀"), (2, ""), (3, None)]
    back = bpe.decode(bpe.encode(docs(rows), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {1: rows[0][1], 2: "", 3: ""}
    machine = bpe.Transducer(library[0])
    for word in (" internationalisation", "aaaaaaaaab", "漢字かな交じり文"):
        assert list(machine.stream(word.encode())) == machine.encode(word.encode())
    assert "".join(bpe.decode_stream(library[1].encode_ordinary("😀é"), machine.bytes)) == "😀é"
    assert "".join(bpe.decode_stream([library[0][b"\xc3"]], machine.bytes)) == "\ufffd"
    assert bpe.digests(docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_tables_are_made_again_beyond_their_bound(library):
    small = bpe.Transducer(library[0], max_known=5)
    rng = random.Random(9)
    for _ in range(200):
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 14))).encode() for _ in range(rng.randrange(1, 9))]
        assert [x.tolist() for x in small.encode_all(words)] == [library[1]._core_bpe.encode_single_piece(w) for w in words]


def test_cache_of_matches_is_made_again_beyond_its_bound(library):
    small, rng = bpe.Codec(library[0], public_tokenizers.PATTERN, max_pieces=20), random.Random(10)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(6)) for _ in range(rng.randrange(30))) for _ in range(40)]
    assert [ids for ids, _, _ in small.digests(texts)] == [library[1].encode_ordinary(t) for t in texts]


def test_long_texts_and_matches_come_in_portions(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    codec = bpe.Codec(library[0], public_tokenizers.PATTERN)
    texts = ["x y " * 500, None, "", "é" * 700, " " * 400, "ab" * 300 + " 1 é\n" * 90, "one two"]
    for (ids, joined, decoded), t in zip(codec.digests(texts), texts, strict=True):
        assert ids == library[1].encode_ordinary(t or "")
        assert joined == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and decoded == hashlib.sha256((t or "").encode()).hexdigest()


def test_stream_holds_back_no_more_than_live_hypotheses_need(library):
    """What is given out after a byte is what all continuations of the match begin with, as far as the library shows it."""
    machine, rng = bpe.Transducer(library[0]), random.Random(11)
    for _ in range(60):
        word = " " + "".join(rng.choice(["th", "e", "ing", "o", "n", "ä"]) for _ in range(12))
        fed, given = [], []
        source = (fed.append(b) or b for b in word.encode())
        for token in machine.stream(source):
            given.append(token)
            done = sum(len(machine.bytes[t]) for t in given)
            assert bytes(fed)[:done] == b"".join(machine.bytes[t] for t in given) and len(fed) - done <= 64
        assert given == machine.encode(word.encode()) or word.encode() in library[0]
