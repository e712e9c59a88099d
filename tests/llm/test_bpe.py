from hashlib import sha256

import pytest

from weftgraph.llm import bpe
from weftgraph.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def path():
    return vocabulary_path()


def check(frame, rows, path):
    tokenizer = bpe.library(path)
    want = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), sha256(data).hexdigest(), sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(frame, path).collect())) == sorted(want)


def test_like_the_library(docs, small, table, path):
    check(docs, [(r[0], r[1]) for r in small], path)
    check(table, [tuple(r) for r in table.select("doc_id", "text").collect()], path)


def test_splitter(path):
    tokenizer = bpe.library(path)
    marks = ["'s", "'", "  ", "\n\n x", " ", "​", "́", "١٢", "ǅ", "ﬁ", "\x1c", "\x85", "<|endoftext|>", "<|endoftext|", "I'LL'll", "한글", "�"]
    for a in marks:
        for b in marks:
            text = f"x{a}{b} y{b}"
            whole = tokenizer.encode(text, add_special_tokens=False).ids
            assert b"".join(bpe.encode_words(bpe.words_of(text, tokenizer), tokenizer)) == b"".join(i.to_bytes(4, "little") for i in whole)


def test_missing_words_are_encoded_on_the_spot(path):
    memo = bpe.Memo(bpe.library(path))
    assert memo[" hello"] == bpe.encode_words([" hello"], bpe.library(path))[0]


def test_round_trip_and_columns(docs, small, nothing, path):
    got = bpe.decode(bpe.encode(docs, path, "doc_id", "keys"), path)
    assert got.columns == ["doc_id", "keys", "ids", "decoded"]
    assert sorted((r.doc_id, r.decoded) for r in got.collect()) == sorted((r[0], r[1] or "") for r in small)
    assert bpe.digests(nothing, path).count() == 0
