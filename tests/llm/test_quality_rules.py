import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.llm import quality_rules as q
from stayline.llm.queries import OP10_SQL

def sentence(i):
    return " ".join(f"{w}{i}" for w in "the quick brown fox jumps over some lazy dogs".split()) + ". "


def prose(n):
    return "\n".join(map(sentence, range(n)))


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


TEXTS = [
    None, "", " \n\t ", "a b", "a b c", "a b c a b c", "x " * 200, prose(12), prose(12) + "\n" + prose(12), "é ü 🙂 " * 30,
    prose(3) + "\nsame line.\nsame line.\n same line.", "#*$ %&| <> " * 30, "a\x0bb\x0cc\rd\x1ce \xa0 " * 20,
]


def test_base_against_plain_python(spark):
    rows = [(i if i else None, t, "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = {r.doc_id: r for r in q.judged(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = found[i if i else None]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base(text), text
        assert not (r.base_failed and r.kept)
    assert q.judged(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, stays",
    [
        ("A short one.", True), ("a heading without an end", False), ("Home | News | Sport | About | Contact | More | Terms | Jobs |", False),
        ("All rights reserved. 2024 by the authors of this very long line indeed.", False), ("BUY!! NOW!! IT!! IS!! SO!! GOOD!! YES!! OK!!", False),
        ("one### two*** three$$$ four%%% five&&& six### seven*** eight$$$.", False), ("He said: “stop!”", True),
        ("a line of eight words or more needs none", True),
    ],
)
def test_lines(spark, line, stays):
    row = q.judged(spark.createDataFrame([(1, prose(10) + "\n" + line)], "doc_id long, text string")).first()
    assert row.kept and row.clean_text.split("\n")[-1] == (line if stays else sentence(9))


def test_documents_that_lose_too_much_go(spark):
    menu = "\n".join(f"Home{i} | News{i} | Sport{i} | About{i} | Contact{i}" for i in range(40))
    docs = spark.createDataFrame([(1, prose(12)), (2, prose(6) + "\n" + menu)], "doc_id long, text string")
    assert [(r.doc_id, r.kept) for r in q.judged(docs).filter("kept").collect()] == [(1, True)]
    plan = q.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


FILLER = " ".join(f"plain{i}" for i in range(298))
PHRASED = [
    ("We design in the open and spread more aoneshare onealy.", True), ("The market share this year grew as much as it did in all the years before.", True),
    ("désign in, signé in, sign inó, read morе.", True), (FILLER + " read more", True), ("Read more " + FILLER, True),
    (FILLER[: FILLER.index("plain11")] + " read more.", True), (FILLER[: FILLER.index("plain10")] + "read more.", False),
    ("\t(Read more…)", False), ("“Click here”\x0b for it.", False), ("one two three/sign in/ four.", False), ("Skip to main content.", False),
    ("Log in, sign up, read more. " * 30, False), ("sign in sign up " * 30, False), ("x" * 5000 + " read more " + "y" * 5000, False),
    (("read more " + "w " * 12) * 400, True), ("read\xa0more is no phrase.", True), ("Share this👉 now.", False),
    ("Alle Rechte vorbehalten.", False), ("Datenschutzerklärung, hier.", False), ("Jetzt Anmelden!", False), ("Die Datenschutzerklärungen alle.", True),
    ("Tous droits réservés.", False), ("TOUS DROITS RÉSERVÉS.", False), ("Lire la suite…", False), ("Lire la suitée ensuite.", True),
    ("POLÍTICA DE PRIVACIDAD.", False), ("Haga clic aquí.", False), ("Leer más.", False), ("Leer másа.", True), ("Weiterlesend kam der Zug an.", True),
]


def by_sql(texts):
    """What OP10_SQL keeps of ``texts``, by their place."""
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    connection = duckdb.connect()
    connection.register("documents", documents)
    return dict(connection.sql(f"SELECT doc_id, kept FROM ({OP10_SQL})").fetchall())


def test_phrases_fail_lines_that_they_make_up(spark):
    rows = [(i, prose(10) + "\n" + line) for i, (line, _) in enumerate(PHRASED)]
    found = {r.doc_id: r.clean_text for r in q.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c == rows[i][1] for i, c in found.items()} == {i: stays for i, (_, stays) in enumerate(PHRASED)}
    # alone with 60 words that stay or go, the line decides; the SQL must say the same
    texts = [prose(8) + "\n" + "\n".join(f"{line} {i}." if len(line) < 99 else line for i in range(40)) for line, _ in PHRASED]
    texts.append(FILLER + " read more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in q.judged(docs).collect()}
    assert kept == by_sql(texts) and kept[len(PHRASED)]


def test_lines_without_a_suspect_hold_no_separator_and_no_phrase(spark):
    phrases = [p.replace(" ?", " ").replace("(?:main )?", "") for p in re.split(r"\|(?![^(]*\))", q.PHRASE_LIST)]
    phrases = [re.sub(r"\(\?:(.)[^)]*\)|\[(.).\]", r"\1\2", p) for p in phrases] + ["POLÍTICA DE COOKIES", "login", "|", "::", ">>", "/"]
    assert all(re.search(q.PHRASES, p) for p in phrases[:-4])
    around = ["", " ", "a", "é", "_", "7", "-", "“", "\xa0", "👉", "。", "\x0b", "a ", " a", "(", "|"]
    lines = [a + p + b for p in phrases for a in around for b in around]
    patterns = [F.col("x").rlike(getattr(q, name)).alias(name) for name in ("SUSPECT", "SEPARATOR", "BOILERPLATE")]
    found = spark.createDataFrame([(x,) for x in lines], "x string").select("x", *patterns).collect()
    assert any(r.BOILERPLATE for r in found) and any(r.SEPARATOR for r in found) and not all(r.SUSPECT for r in found)
    assert [r.x for r in found if (r.SEPARATOR or r.BOILERPLATE) and not r.SUSPECT] == []


@pytest.mark.parametrize("end", ["。", "！", "？", "。」", "！』）", "｡", "؟", "۔", "।", "።", "។", "။", "։", "…", ".\"", "？  "])
def test_lines_of_other_scripts_are_closed_by_their_own_marks(spark, end):
    lines = [f"这是第{i}行文字，没有空格" for i in range(60)]
    texts = ["\n".join(x + end for x in lines), "\n".join(x + "，" for x in lines), "\n".join(lines)]
    found = {r.doc_id: r for r in q.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: r.kept for i, r in found.items()} == by_sql(texts) == {0: True, 1: False, 2: False}
    assert found[0].clean_text == texts[0]
