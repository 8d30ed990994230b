"""Token ids against the public library, and exact round trips."""

import os
import random

import numpy as np
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.session import read_table

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_RANKS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.DEFAULT_RANKS, "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def lists(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


PARTS = ["a", " ", "  ", "\n", "\t", "\r\n", "é", "1", "²", "'s", "'LL", "中", "文", "😀", "𝑎", " ", "　", ".", "-", "abc", " the", "\x1c", "\x85", "ing", "aaaa", "​", "½", "Ⅷ", "<|endoftext|>", "́", "ß", "ﬁ"]


def test_random_texts(vocabulary, reference):
    r = random.Random(7)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 30))) for _ in range(5000)]
    encoder = bpe.Encoder(vocabulary)
    got = [x for k in range(0, len(texts), 700) for x in lists(*encoder.encode(texts[k : k + 700]))]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert bpe.Encoder(vocabulary).encode(texts, count_only=True)[1].tolist() == [len(x) for x in got]


def test_long_pre_tokens(vocabulary, reference):
    texts = ["a" * 200_000, "ab" * 50_000, " " * 9_000 + "x", "中" * 20_000, "\n \n" * 500, "x" * 33 + " ", "abcdefghij" * 3_000]
    got = lists(*bpe.Encoder(vocabulary).encode(texts))
    assert all(b"".join(reference.decode_single_token_bytes(i) for i in ids) == t.encode() for ids, t in zip(got, texts))
    assert [got[k] for k in (0, 1)] == [vocabulary.encode_one(t.encode()) for t in texts[:2]]
    assert got[3:] == [reference.encode_ordinary(t) for t in texts[3:]] and got[2] == reference.encode_ordinary(texts[2])


def test_one_merge_at_a_time_is_the_same(vocabulary, reference):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh ", k=r.randint(1, 40))).encode() for _ in range(2000)]
    ids, counts = vocabulary.encode_all(words)
    assert lists(ids, counts) == [vocabulary.encode_one(w) for w in words]


def test_ranks_that_were_not_trained_by_merging():
    """Here a merge makes pairs of lower rank than its own, so order within a bucket matters."""
    import base64

    words = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bc", b"cab", b"ca", b"abab", b"aa", b"aaa", b"cc"]
    text = b"\n".join(base64.b64encode(w) + b" " + str(k).encode() for k, w in enumerate(words))
    v = bpe.Vocabulary(text)
    own = tiktoken.Encoding("low", pat_str="[a-z]+", mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(5)
    texts = ["".join(r.choices("abc", k=r.randint(1, 60))) for _ in range(3000)]
    got = lists(*v.encode_all([t.encode() for t in texts]))
    want = [own.encode_ordinary(t) if t.encode() not in v.ranks else v.encode_one(t.encode()) for t in texts]
    assert got == want


def test_memory_is_bounded_and_forgetting_changes_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(vocabulary)
    for k in range(5):
        texts = [f"word{k} other{k * 7} x{j}" for j in range(30)]
        assert lists(*encoder.encode(texts)) == [reference.encode_ordinary(t) for t in texts]


def test_queue():
    q, r = bpe.RankQueue(50_256), random.Random(1)
    want = sorted(r.sample(range(50_256), 500))
    for x in r.sample(want, len(want)):
        q.push(x, x)
    found = []
    while (x := q.first()) >= 0:
        found += q.take(x)
    assert found == want


def test_whole_table(spark, small, reference):
    docs = read_table(spark, small, "documents")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs).collect()}
    assert got == {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in docs.collect()}


def test_unusual_tables(spark, reference):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "a", 0), (3, "b" * 70_000 + " end", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in bpe.encode_documents(rows).collect()), key=lambda r: r[0])
    assert got[0] == (0, reference.encode_ordinary("a")) and got[1] == (1, []) and got[2] == got[3] == (2, [])
    assert b"".join(reference.decode_single_token_bytes(i) for i in got[4][1]) == b"b" * 70_000 + b" end"
    assert bpe.encode_documents(rows.limit(0)).count() == 0


def test_vocabulary_through_a_file_system(spark, tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\n" * 3)
    assert bpe.read_ranks(spark, f"file://{tmp_path}/v") == bpe.read_ranks(spark, f"{tmp_path}/v") == b"YQ== 0\n" * 3
