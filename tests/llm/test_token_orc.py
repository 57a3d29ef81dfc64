import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from stayline.llm import token_orc
from stayline.llm.common import small_batches
from stayline.llm.wordpiece import WhiteSpaceEncoder, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aB cé É's.,!#1２ \n\t́̈ﬁİK̊Å\xa0\x1c 한ᄒ<|endoftext|>🙂ſ’'"


@pytest.fixture(scope="module")
def library():
    return WhiteSpaceEncoder(PATH)


def test_parts_make_the_whole(library):
    own, rng = encoder(PATH), random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.whole(text), text


def test_added_tokens_as_by_the_library_alone():
    plain, own, rng = Tokenizer.from_file(PATH), encoder(PATH), random.Random(1)
    assert np.frombuffer(own.encode(b"end <|endoftext|> next"), "<u4").tolist() == [806, 49407, 1131]
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|", "|>", "É", "́", "end", "it's", "12", "..", " ", "\n", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        wanted = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == own.whole(text) == wanted, text


def expected(rows, library):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*library.whole(text or ""), 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    return out


def test_edge_rows_order_and_lookup(spark, tmp_path, library):
    small_batches(spark)
    rows = [(i, f"text number {i} " * (i % 7), "x") for i in range(300)] + [(None, "no id", ""), (-5, None, ""), (1000, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(6)
    folder = str(tmp_path / "orc")
    token_orc.write(docs, folder, PATH, 1, stripe_bytes=1 << 16, index_rows=1000)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    wanted = expected([r[:2] for r in order], library)
    found = sorted((tuple(r) for r in token_orc.digests(spark, folder).collect()), key=lambda r: r[1])
    assert found == wanted
    one = token_orc.lookup(spark, folder, [77]).collect()[0]
    assert (one.doc_id, one.start, one.n_tokens) == next(w[:3] for w in wanted if w[0] == 77)
    assert one.ids == [*library.whole(rows[77][1]), 1]
    plan = token_orc.lookup(spark, folder, [77])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)]" in plan
    for path in (tmp_path / "orc").glob("*.orc"):
        ids = orc.ORCFile(path).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_repeated_rows_and_no_rows(spark, tmp_path):
    small_batches(spark)
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    token_orc.write(docs, str(tmp_path / "a"), PATH, 1)
    found = sorted(tuple(r)[1:3] for r in token_orc.digests(spark, str(tmp_path / "a")).collect())
    assert [s for s, _ in found] == list(np.cumsum([0, *[n for _, n in found[:-1]]])) and len(found) == 3
    token_orc.write(docs.limit(0), str(tmp_path / "b"), PATH, 1)
    assert token_orc.digests(spark, str(tmp_path / "b")).count() == 0


def test_query(spark, folder, library):
    from stayline.llm.queries import op1_token_orc

    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, op1_token_orc(spark, folder).collect())) == expected(docs, library)


def test_a_batch_asks_for_a_part_once_and_keeps_what_is_in_use(library, monkeypatch):
    texts = [f"Common word, {chr(97 + i % 26) * (i % 9 + 1)}! É{chr(224 + i % 30)}ß. <|endoftext|>x'{i}" for i in range(400)]
    texts += [None, "", " \t", " ,a.. .b) .", "ﬁ, K̊. é́x; \x1c\xa0y", "word", "word"]
    wanted = [library.whole(t or "") for t in texts]
    raw = [t if t is None else t.encode() for t in texts]
    own, asked, calls = WhiteSpaceEncoder(PATH), [], []
    for name in ("_ask", "_spell"):
        monkeypatch.setattr(own, name, lambda *a, f=getattr(own, name): (calls.append(f), asked.extend(a[0]), f(*a)))
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(raw)] == wanted
    assert len(calls) == 2 and len(asked) == len(set(asked)) and b"word" in asked
    # a full store becomes the store before, which still serves what turns up again
    monkeypatch.setattr("stayline.llm.wordpiece.KEPT", 3)
    asked.clear()
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(raw)] == wanted
    assert not asked
    own.encode_all([b"aa bb cc dd"])
    own.encode_all([b"dd ee"])
    assert b"word" not in own.ids and asked.count(b"dd") <= 1


def test_plain_letters_as_by_the_library(library):
    rng, own = random.Random(2), WhiteSpaceEncoder(PATH)
    letters = "abcdefghijklmnopqrstuvwxyzABCÀÁÇÉÑÖÜßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ×÷ªºµŸſ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 10]) + rng.choice([",", "...", " ", ""]) for i in range(0, 3000, 10)]
    found = own.encode_all([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.whole(t) for t in texts]
