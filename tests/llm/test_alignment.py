import hashlib
import os
import random
from collections import Counter

import pytest

from stayline.llm import alignment
from stayline.llm.common import small_batches
from stayline.llm.queries import BYTE_VOCABULARY, PIECES

SCHEMA = "doc_id long, text string, chunk int, links string"


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECES)


def token_bytes(libraries, text):
    a, b = libraries
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    code = {}
    for byte in range(256):  # what the byte-level decoder makes of a single byte's character
        printable = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255
        code[chr(byte if printable else 256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255) for x in range(byte)))] = byte
    of_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = []
    for i in ids_b:
        p = b.id_to_piece(i)
        of_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    return ids_a, of_a, ids_b, of_b


def plain(libraries, texts):
    links, rows = [], []
    for text in texts:
        own, groups = [], []
        if text:
            ids_a, of_a, ids_b, of_b = token_bytes(libraries, text)
            if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
                ids_a, ids_b = [], []
            ends = []
            for ids, parts in ((ids_a, of_a), (ids_b, of_b)):
                at, found = 0, {}
                for n, (i, p) in enumerate(zip(ids, parts, strict=False)):
                    at += len(p)
                    found[at] = (n, i)
                ends.append(found)
            last_a = last_b = 0
            for end in sorted(ends[0].keys() & ends[1].keys()):
                (n, i), (m, j) = ends[0][end], ends[1][end]
                own.append((i, j))
                groups.append(",".join(map(str, ids_a[last_a : n + 1])) + "|" + ",".join(map(str, ids_b[last_b : m + 1])))
                last_a, last_b = n + 1, m + 1
        else:
            ids_a = ids_b = []
        links.append(own)
        rows.append((len(ids_a), len(ids_b), len(groups), len(own), ";".join(groups)))
    count = Counter(pair for own in links for pair in own)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (*row[:4], sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), row[4])
        for row, own in zip(rows, links, strict=True)
    ]


TEXTS = [
    None, "", " ", "  ", "x", " x", "  x", "a  b", "a \n b", "a\n\n b ", "tab\t x", "<|endoftext|> end", "a<|endoftext|>", "<s> </s> <unk>",
    "<0x41> byte", "▁mark", "a ▁ b", "naïve café — “quoted”", "日本語 テキスト", "🙂 smile 🙂🙂", " nbsp　wide", "a\u0085 b\x1c c",
    "don't they'll we've", "123 4567 89", "é combining", "\x00 nul \x7f", "under_score  __ ", "ﬁ ligature ①", "a" * 3000, " " * 70 + "end",
]


def test_against_whole_texts(spark, libraries):
    small_batches(spark, 7)
    rng = random.Random(6)
    bits = [" ", " ", "  ", "\n", "\t", "the", "The", "ing", "é", "ß", "’s", "'ll", "12", "…", "<|endoftext|>", "日", "🙂", "▁", ".", "(x)", "\xa0"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["and again the same text", "and again the same text"]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for chunk in (50, 1 << 20):
        found = sorted(alignment.aligned(df, BYTE_VOCABULARY, PIECES, chunk=chunk).collect())
        assert [tuple(r)[1:] for r in found] == [(*row[:6], row[6]) for row in plain(libraries, texts)]


def test_null_ids_bad_bytes_and_an_empty_table(spark, libraries):
    rows = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    bad = rows.selectExpr("doc_id", "cast(unhex('61FF20C3') as string) as text")
    found = alignment.aligned(rows.union(bad).union(rows), BYTE_VOCABULARY, PIECES).collect()
    assert sorted(tuple(r)[1:] for r in found) == sorted(plain(libraries, ["a b", "a b", "a� �"]))
    assert alignment.aligned(rows.filter("false"), BYTE_VOCABULARY, PIECES).count() == 0


def test_query_against_whole_texts(spark, folder, libraries):
    from stayline.llm.queries import op11_alignment

    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    wanted = plain(libraries, [d.text for d in docs])
    for found, row in zip(sorted(op11_alignment(spark, folder).collect()), wanted, strict=True):
        digest = hashlib.sha256(row[6].encode()).hexdigest() if row[6] else ""
        assert tuple(found)[1:] == (*row[:6], digest)
