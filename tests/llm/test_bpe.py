"""The streaming encoder and decoder against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aabcinthré éÉÀ'slltdm  \n\t\x85\x1c\u200b\xa0Σςσ0９1½漢字か\u3099\u0301İıßẞǅ🙂\u200d<|>_ -!"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.Vocabulary(open(PATH, encoding="utf-8").read()))


def check(enc, library, text):
    ids = [i for part in enc.encode(text) for i in part]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want, text[:80]
    dec = bpe.Decoder(enc.v)
    assert dec.push(ids[:5]) + dec.push(ids[5:]) + dec.finish() == library.decode(want, skip_special_tokens=False)


def test_random_texts(enc, library):
    r = random.Random(7)
    for k in range(3000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 60)))
        if k % 2:
            enc.prepare([text])
        check(enc, library, text)


def test_special_strings_and_cases(enc, library):
    for text in ["", " ", "<|startoftext|>x<|endoftext|> <|endoftext|>", "a<|endoftext|>é", "<|startoftext|", "I'Ll don'T ΑΣ. 'S"]:
        check(enc, library, text)


def test_long_pieces_stream(enc, library):
    r = random.Random(3)
    for _ in range(40):
        letters = "inthanreares"[: r.randint(2, 12)]
        check(enc, library, "".join(r.choice(letters) for _ in range(r.randint(600, 3000))))
    for c in "aine!=é漢":
        check(enc, library, c * 4000)
    check(enc, library, "x" * 70000 + " " + "the " * 40000)


def test_window_is_bounded(enc):
    assert 0 < enc.v.lookahead < 1000
    raw = b"inthan" * 5000
    assert len(list(enc.stream(raw))) < len(raw)


def test_improper_merges_are_refused():
    with pytest.raises(ValueError):
        bpe.lookahead([("ab", "c"), ("a", "b")])


def test_incremental_decoder_joins_bytes(library):
    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    j = json.loads(spec)
    j["pre_tokenizer"] = {"type": "Split", "pattern": {"Regex": r"\S+|\s+"}}
    j["decoder"] = {"type": "ByteLevel"}
    v = bpe.Vocabulary(json.dumps(j))
    sym = bpe.byte_symbols()
    dec, out = bpe.Decoder(v), ""
    for b in "né 漢🙂".encode():
        out += dec.push([v.ids[sym[b]]])
    assert out + dec.finish() == "né 漢🙂"


def test_operator_rows(spark, library):
    rows = [(1, "Hello wörld <|endoftext|>", "x"), (2, None, "y"), (2, "", None), (None, "twice", "z"), (None, "twice", "z"), (7, "ab " * 50000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    enc = bpe.encode(docs, PATH)
    assert {(r.doc_id, r.n_tokens) for r in enc.collect()} == {(w[0], w[1]) for w in want}
    assert {r.doc_id: r.text for r in bpe.decode(enc, PATH).collect()}[1] == library.decode(library.encode(rows[0][1], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []
