"""Byte-level BPE against the public library, the perfect hash, and edge cases."""

import hashlib
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from itemforge.llm import byte_bpe
from itemforge.llm.common import table
from itemforge.llm.queries import QUERIES
from tests.conftest import rows_of
from tests.llm.test_operators import ODD, ODD_IDS, SF, frame

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def words_of():
    return byte_bpe.vocabulary(PATH, public.PATTERN)


def ids_of(texts, words_of):
    flat, sizes = byte_bpe.encode_texts(texts, words_of)
    out, at = [], 0
    for k in sizes.tolist():
        out.append(flat[at : at + k].tolist())
        at += k
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_the_hash_is_perfect_and_minimal(n):
    keys = [hashlib.md5(str(i).encode()).digest()[: 4 + i % 9] + str(i).encode() for i in range(n)]
    found = byte_bpe.PerfectHash(keys)
    assert found.places(keys).tolist() == list(range(n)) and sorted(found.key_at.tolist()) == list(range(n))
    assert all(-1 <= k < n for k in found.places([b"", b"other", b"\xff" * 40]).tolist())


def test_every_code_point_equals_the_library(library, words_of):
    """Every assigned one: what a later version of Unicode adds is a letter only for the library that knows that version."""
    points = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(f"a{c} {c}1{c}{c}" for c in points[i : i + 5000]) for i in range(0, len(points), 5000)]
    assert ids_of(texts, words_of) == [library.encode_ordinary(t) for t in texts]


def test_random_texts_equal_the_library(library, words_of, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WORDS_AT_ONCE", 40)
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 300)
    monkeypatch.setattr(byte_bpe, "WORDS_KNOWN", 30)
    r = random.Random(3)
    parts = ["the", " word", "Straße", " é", " ", "  ", "\n\n", "\t ", "'s", "'LL", "12345", "…!?", "漢字かな", "😀", "x" * 70, "abab" * 30, "\x00", "\x1c"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(400)]
    found = ids_of(texts, words_of)
    assert found == [library.encode_ordinary(t) for t in texts]
    flat, sizes = byte_bpe.encode_texts(texts, words_of)
    assert [d.decode() for d in words_of.decode(flat, sizes)] == texts
    for wrong in (-1, 10**6):
        with pytest.raises(KeyError):
            words_of.decode(np.array([wrong]), np.array([1]))


def test_long_words_take_time_in_proportion(library, words_of):
    text = "ab" * 100_000 + " " * 50_000
    assert ids_of([text], words_of)[0] == library.encode_ordinary(text)


def test_query_equals_the_library(spark, library):
    rows = QUERIES["op13_byte_bpe"](spark, SF)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for r in table(spark, SF, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        wanted.append((r.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode())))
    assert rows_of(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(wanted, key=repr)


def test_edge_cases(spark, library):
    docs = frame(spark, ODD, ODD_IDS).withColumn("ids", F.array(F.lit(1)))
    rows = byte_bpe.encode(docs, PATH, public.PATTERN, decoded=True)
    assert rows.columns == ["doc_id", "ids", "decoded"]
    found = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in rows.collect()), key=repr)
    assert found == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(ODD_IDS, ODD, strict=True)), key=repr)
    back = byte_bpe.decode(rows.select("doc_id", "ids"), PATH, public.PATTERN)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back.collect()), key=repr) == sorted(((i, d) for i, _, d in found), key=repr)
    assert byte_bpe.encode(frame(spark, []), PATH, public.PATTERN).count() == 0


def test_missing_ranks_are_an_error(spark, tmp_path):
    (tmp_path / "none.tiktoken").write_bytes(b"")
    with pytest.raises(ValueError):
        byte_bpe.encode(frame(spark, ["a"]), str(tmp_path / "none.tiktoken"), public.PATTERN)
