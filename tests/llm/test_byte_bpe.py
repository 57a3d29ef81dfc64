import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from stayline.llm import byte_bpe
from stayline.llm.common import small_batches

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = [
    "a", "b", "the", "er", "é", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "!", "#", "###", "한국", "🙂",
    "ing", "tion", "\x00", " \n ", "aaaa",
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chars, size, heap", [(1, 2, 4), (2, 4, 6), (5, 8, 256), (4096, 24, 256)])
def test_trees_of_any_leaf_against_the_library(library, monkeypatch, chars, size, heap):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", chars)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", size)
    monkeypatch.setattr(byte_bpe, "HEAP_BYTES", heap)
    own, rng = byte_bpe.ByteBpe(PATH, P.PATTERN), random.Random(chars)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdetionrs") for _ in range(1500)), "ab" * 3000, "a" * 2001, " " * 900 + "x"]
    for text in texts:
        assert own.matches(text) == own.pattern.findall(text)
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_edge_rows(spark, library):
    small_batches(spark)
    rows = [(1, "", 1), (2, None, 2), (None, "x y", 3), (3, "same same", 4), (3, "same same", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = sorted(map(tuple, byte_bpe.round_trip(docs, PATH, P.PATTERN).collect()), key=str)
    wanted = []
    for doc_id, text, _ in rows:
        ids = array("I", library.encode_ordinary(text or ""))
        digests = [hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), (text or "").encode())]
        wanted.append((doc_id, len(ids), *digests))
    assert found == sorted(wanted, key=str)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.data) for r in decoded) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query_against_the_library(spark, folder, library):
    from stayline.llm.queries import op6_byte_bpe

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = {}
    for doc_id, text in docs:
        ids = array("I", library.encode_ordinary(text))
        wanted[doc_id] = (len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), text.encode())))
    assert {r[0]: tuple(r)[1:] for r in op6_byte_bpe(spark, folder).collect()} == wanted
