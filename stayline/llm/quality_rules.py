"""Quality rules, lines first: bad lines go, then texts that lose too much of themselves.

A line fails if it is short and lacks closing punctuation, if it shouts or is full of symbols
(punctuation), if separators and stock phrases together come to more than ``MAX_SEPARATORS_PERCENT`` of
its words (navigation), or if it holds a stock phrase and few other words (boilerplate).  A text is rejected if the base rules fail (too few words, or too many inside repeated runs
of three words), or if the lines that stay hold too few of its words.

Built-in expressions only, each text in its own row, no shuffle.  Repeated runs are found by sorting a
text's 64-bit hashes of three words with their places, so a long text costs n log n.

Defined cases: a null, empty or wordless text has no words and fails the base rules; its cleaned text is
empty.  Lines without a word are dropped and count as nothing.  Repeated rows keep all their rows; a null
id changes nothing; other columns are kept, but for those named like the ones added; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Of a text's words, so many must be in lines that stay.
MIN_KEPT_PERCENT = 60
#: A line of fewer words must end in closing punctuation.
SHORT_LINE = 8
#: In a line, at most so many symbols, repeated exclamation or question marks, or separators and
#: stock phrases, to a hundred words.
MAX_SYMBOLS_PERCENT = 20
MAX_SHOUTS_PERCENT = 20
MAX_SEPARATORS_PERCENT = 20

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Closing marks of Latin and other scripts: Greek, Armenian, Hebrew, Arabic, Syriac, Indic, Tibetan, Burmese, Georgian,
#: Ethiopic, Khmer, Mongolian, and ideographic or full-width ones; then quotes and brackets that may follow them.
ENDS = (
    r".!?:;…\x{37E}\x{387}\x{55C}\x{55E}\x{589}\x{5C3}\x{61B}\x{61D}-\x{61F}\x{6D4}\x{700}-\x{702}\x{964}\x{965}"
    r"\x{DF4}\x{E5A}\x{E5B}\x{F0D}-\x{F11}\x{104A}\x{104B}\x{10FB}\x{1362}-\x{1368}\x{17D4}-\x{17D6}\x{1803}\x{1809}"
    r"\x{203C}\x{2047}-\x{2049}\x{3002}\x{FE52}\x{FE54}-\x{FE57}\x{FF01}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}\x{FF61}"
)
QUOTES = (
    r"""\"'”’»)\]"""
    r"\x{3009}\x{300B}\x{300D}\x{300F}\x{3011}\x{3015}\x{3017}\x{3019}\x{301B}\x{301E}\x{301F}"
    r"\x{FE42}\x{FE44}\x{FF02}\x{FF07}\x{FF09}\x{FF3D}\x{FF5D}\x{FF63}"
)
CLOSED = rf"[{ENDS}][{QUOTES}]*[\x20\x09-\x0D]*\z"
SHOUT = r"[!?][!?]+"
#: Stock phrases of English, German, French and Spanish pages; ASCII letters count in either case.
PHRASE_LIST = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|click here|read more"
    "|sign in|sign up|log ?in|subscribe now|subscribe to|enable javascript|skip to (?:main )?content|share this|share on"
    "|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|datenschutzhinweise|datenschutzrichtlinie|hier klicken|mehr lesen"
    "|weiterlesen|jetzt anmelden|jetzt abonnieren|jetzt registrieren|javascript aktivieren|zum inhalt springen"
    "|tous droits r(?:é|É|e)serv(?:é|É|e)s|politique de confidentialit(?:é|É|e)|mentions l(?:é|É|e)gales|cliquez ici"
    "|lire la suite|en savoir plus|se connecter|abonnez-vous|activer javascript|aller au contenu"
    "|todos los derechos reservados|pol(?:í|Í|i)tica de privacidad|pol(?:í|Í|i)tica de cookies|aviso legal"
    "|haga clic aqu(?:í|Í|i)|leer m(?:á|Á|a)s|iniciar sesi(?:ó|Ó|o)n|suscr(?:í|Í|i)base|activar javascript|ir al contenido"
)


def _either_case(pattern: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


PHRASES = _either_case(f"(?:{PHRASE_LIST})")
#: What but a space may stand next to a phrase: ends of words, spelled out, as Java and DuckDB differ on \b beside letters like é.
EDGE = (
    r"\x00-\x08\x0E-\x1F!-/:-@\[-^`{-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{2BFF}"
    r"\x{3000}-\x{3004}\x{3008}-\x{303F}\x{FE0F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{1F000}-\x{1FAFF}"
)
#: Counted as separators: marks between the items of a menu, and stock phrases (of two with one space between, the first).
SEPARATOR = (
    r"(^|[\x20\x09-\x0D])(\||>|>>|»|•|·|/|::)(\z|[\x20\x09-\x0D])"
    rf"|(?:^|[\x20\x09-\x0D{EDGE}]){PHRASES}(?:\z|[\x20\x09-\x0D{EDGE}])"
)
#: A line of a stock phrase and at most so many other words is boilerplate.
MAX_OTHER_WORDS = 10


def _short_with_phrase(others: int) -> str:
    """A line that holds a stock phrase and at most ``others`` words besides."""
    space, inner = r"[\x20\x09-\x0D]", rf"{WORD}*"
    phrase = rf"(?:{inner}[{EDGE}])?{PHRASES}(?:[{EDGE}]{inner})?"
    out = ""
    for after in range(others + 1):  # words after the phrase; the others may stand before it
        here = rf"{phrase}(?:{space}+{WORD}+){{0,{after}}}{space}*\z"
        out = rf"(?:{here}|{WORD}+{space}+{out})" if after else here
    return rf"\A{space}*{out}"


BOILERPLATE = _short_with_phrase(MAX_OTHER_WORDS)


def _suspect() -> str:
    """What every match of SEPARATOR or BOILERPLATE holds: a mark, or a phrase that no ASCII letter or digit precedes.

    One cheap scan: the first three characters are asked for before the phrases, and those by first letter.
    """
    phrases = re.split(r"\|(?![^(]*\))", PHRASE_LIST)
    starts = "".join(f"[{''.join(sorted({c for p in phrases for c in (p[k], p[k].upper())}))}]" for k in range(3))
    rest: dict[str, list[str]] = {}
    for phrase in phrases:
        rest.setdefault(phrase[0], []).append(phrase[1:])
    found = "|".join(f"{first}(?:{'|'.join(ends)})" for first, ends in rest.items())
    return rf"[|>»•·/]|::|(?={starts})(?<![A-Za-z0-9_])(?:{_either_case(found)})"


SUSPECT = _suspect()
ADDED = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "kept",
    "clean_text",
]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _count(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, in one scan."""
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it.

    A column that ``body`` merely referred to would be put in its place wherever the optimiser moves a
    filter, also inside loops over a text's words.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(words: Column) -> Column:
    """Words inside runs of three that come twice or more."""

    def hashed(i: Column) -> Column:
        run = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.struct(run.alias("h"), i.alias("i"))

    def places(runs: Column) -> Column:
        def place(run: Column, k: Column) -> Column:
            same = (run["h"] == F.get(runs, k - 1)["h"]) | (run["h"] == F.get(runs, k + 1)["h"])
            return F.when(same, run["i"])

        return F.sort_array(F.array_compact(F.transform(runs, place)))

    def covered(starts: Column) -> Column:
        def step(total: Column, k: Column) -> Column:
            return total + F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1))

        steps = F.aggregate(F.sequence(F.lit(1), F.size(starts) - 1), F.lit(0), step)
        return F.when(F.size(starts) > 1, steps + 3).otherwise(0)

    runs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), hashed))
    return F.when(F.size(words) > 3, _bound(runs, lambda r: _bound(places(r), covered))).otherwise(0)


def _line_stays(line: Column, n: Column) -> Column:
    punctuation = (
        ((n >= SHORT_LINE) | line.rlike(CLOSED))
        & (100 * F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", "")) <= MAX_SYMBOLS_PERCENT * n)
        & (100 * _count(line, SHOUT) <= MAX_SHOUTS_PERCENT * n)
    )
    navigation = 100 * _count(line, SEPARATOR) <= MAX_SEPARATORS_PERCENT * n
    return punctuation & (~line.rlike(SUSPECT) | (navigation & ~line.rlike(BOILERPLATE)))


def _verdict(text: Column) -> Column:
    """A struct of what ``judged`` adds."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        counted = F.transform(lines, lambda x: F.struct(x.alias("line"), F.size(_words(x)).alias("n")))
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.filter(counted, lambda x: _line_stays(x["line"], x["n"])).alias("stay"),
        )

    def of_both(words: Column, lines: Column) -> Column:
        n = words["n_words"]
        failed = (n < MIN_WORDS) | (100 * words["n_repeat_words"] > MAX_REPEATED_PERCENT * n)
        n_kept = F.aggregate(lines["stay"], F.lit(0), lambda total, x: total + x["n"]).cast("long")
        return F.struct(
            n.alias("n_words"),
            words["word_chars"].alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            words["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            n_kept.alias("n_kept_words"),
            (~failed & (100 * n_kept >= MIN_KEPT_PERCENT * n)).alias("kept"),
            F.array_join(F.transform(lines["stay"], lambda x: x["line"]), "\n").alias("clean_text"),
        )

    words = _bound(_words(text), of_words)
    lines = _bound(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines)
    return _bound(words, lambda w: _bound(lines, lambda x: of_both(w, x)))


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``ADDED``; ``clean_text`` has the lines that stay."""
    columns = [c for c in docs.columns if c not in ADDED]
    plain = [f"c{i}" for i in range(len(columns))]
    own = [F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)]
    # a generator: no filter is moved below it, so a text is judged once
    rows = docs.select(*own, F.inline(F.array(_verdict(F.coalesce("text", F.lit(""))))))
    return rows.select(*[F.col(p).alias(c) for c, p in zip(columns, plain, strict=True)], *ADDED)
