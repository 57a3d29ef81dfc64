import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stayline.llm import ngram_lm
from stayline.llm.common import small_batches

SCHEMA = "doc_id long, text string, order int, chunk string"


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def plain(rows, held):
    """(held_out, n_tokens, n_known, N, base, score) of rows (doc_id, text), by the formula, word after word."""
    counts, n = Counter(), 0
    for doc_id, text in rows:
        if not held(doc_id):
            own = ["<", *tokens(text)]
            n += len(own) - 1
            counts.update(tuple(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1))
    v = sum(len(g) == 1 for g in counts) - (("<",) in counts)

    def p(history, word):
        if not history:
            return (counts[(word,)] + 1) / (n + v + 1)
        prior = ngram_lm.PRIORS[len(history)]
        return (counts[(*history, word)] + prior * p(history[1:], word)) / (counts[history] + prior)

    out = []
    for doc_id, text in rows:
        own = ["<", *tokens(text)]
        score = sum(math.log10(p(tuple(own[max(0, i - 2) : i]), own[i])) for i in range(1, len(own)))
        base = sum(math.log10((counts[(w,)] + 1) / (n + v + 1)) for w in own[1:])
        out.append((held(doc_id), len(own) - 1, sum(counts[(w,)] > 0 for w in own[1:]), n, base, score))
    return out


def same(found, wanted):
    assert [tuple(r)[1:5] for r in found] == [w[:4] for w in wanted]
    for r, w in zip(found, wanted, strict=True):
        assert tuple(r)[5:] == pytest.approx(w[4:], rel=1e-9)


def random_rows():
    rng = random.Random(2)
    words = ["a", "A", "b", "Ä", "ä", "c.", "x\x1cy", "\xa0", "d"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t "]) for _ in range(rng.randint(0, 30))) for _ in range(90)]
    return list(enumerate([*texts, None, "", "only here", "a b", "a b", "new words in one " * 400]))


def test_against_the_formula(spark):
    small_batches(spark, 7)
    rows = random_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    for chunk, bucket in ((20, 50), (1 << 20, 1 << 20)):
        found = ngram_lm.scores(df, F.col("doc_id") % 4 == 1, chunk, bucket).collect()
        same(sorted(found), plain(rows, lambda i: i % 4 == 1))


def test_probabilities_add_up():
    rows = random_rows()[:40]
    counts = Counter(w for _, t in rows for w in tokens(t))
    for text in ("a b", "zzz a", "c."):
        history = tokens(text)[:-1]
        words = [w for w in counts if w is not None]
        total = 0.0
        base = plain([*rows, (-1, " ".join(history))], lambda i: i == -1)[-1]
        without_end = base[5] - _last(rows, history)
        for word in [*words, "never-seen"]:
            longer = plain([*rows, (-1, " ".join([*history, word]))], lambda i: i == -1)[-1]
            total += 10 ** (longer[5] - _last(rows, [*history, word]) - without_end)
        assert total + 10 ** _last(rows, history) == pytest.approx(1)


def _last(rows, words):
    """log10 probability of the end after ``words``, as the difference of two texts' scores by the formula."""
    counts, n = Counter(), 0
    for _, text in rows:
        own = ["<", *tokens(text)]
        n += len(own) - 1
        counts.update(tuple(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1))
    v = sum(len(g) == 1 for g in counts) - 1
    value, history = (counts[(None,)] + 1) / (n + v + 1), ["<", *words]
    for k in (1, 2):
        if len(history) >= k:
            h = tuple(history[-k:])
            value = (counts[(*h, None)] + ngram_lm.PRIORS[k] * value) / (counts[h] + ngram_lm.PRIORS[k])
    return math.log10(value)


def test_nothing_to_learn_from_and_an_empty_table(spark):
    rows = [(None, "a b"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = sorted(ngram_lm.scores(df, F.lit(True)).collect(), key=lambda r: -r.n_tokens)
    same(found, plain(rows, lambda i: True))
    assert ngram_lm.scores(df.filter("false"), F.lit(False)).count() == 0


def test_query_against_the_formula(spark, folder):
    from stayline.llm.queries import op12_ngram_lm

    rows = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    found = sorted(op12_ngram_lm(spark, folder).collect())
    wanted = plain(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    same(found, wanted)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
