"""Token ids of whole texts by a vocabulary that drops white space, as the tokenizers library gives them.

Such a vocabulary's tokens never reach over white space, nor from letters into punctuation, and case makes
no difference, so a text's ids are those of its white-space-separated parts one after another, and those
of a part are its letters' and its closing marks'.  The vocabulary's added tokens, such as '<|endoftext|>', are
one id each where a text spells them exactly, as by the library's default, and cut the text.  A batch of texts is
coded by its distinct parts, whose ids are then dealt out.  Every worker keeps the ids of the parts it has seen; new
parts go to the library together, as one text, those of plain letters straight to its byte-pair model.
"""

from __future__ import annotations

import os
import re
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts after which a worker's store (about 100 bytes each) becomes the store before, which is then forgotten.
KEPT = 300_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Marks that close a part; an apostrophe may open a token with letters and is not among them.
MARKS = b".,;:!?)#$%&*|"
#: Letters that neither join nor part: a part of them is one word to the library's model, letter by letter.
PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


@lru_cache(maxsize=2)
def encoder(path: str) -> WhiteSpaceEncoder:
    """One encoder per worker and vocabulary."""
    return WhiteSpaceEncoder(path)


def _halves(parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
    """Two rows for every part: what is left of it without marks that close it after a letter, and these marks."""
    _, bounds, data = parts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[: len(parts) + 1]
    start, end = bounds[:-1], bounds[1:]
    body = start + pc.binary_length(pc.ascii_rtrim(parts, characters=MARKS.decode())).to_numpy()
    last = np.frombuffer(data, np.uint8)[np.maximum(body - 1, 0)]
    cut = np.where((body > start) & (last >= 97) & (last <= 122), body, end)
    bounds = np.append(np.column_stack([start, cut]).ravel(), bounds[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(parts), [None, pa.py_buffer(bounds), data])


class WhiteSpaceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        added = {t.content.encode(): i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cuts = re.compile(b"(" + b"|".join(longest_first) + b")")
        # parts come without added tokens, but lower-casing may spell one: to the library that is plain text
        self.library.encode_special_tokens = True
        # what the library hands to its model for a letter
        self.letters = {c: self._split(chr(c)) for c in range(0xC0, 0x100) if PLAIN.fullmatch(chr(c))}
        self.ids: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _split(self, letter: str) -> str:
        ((spelt, _),) = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(letter))
        return spelt

    @cached_property
    def default(self):
        """The library as it comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> list[int]:
        """The library's own ids of a whole text."""
        return self.default.encode(text, add_special_tokens=False).ids

    def _ask(self, parts: list[bytes]) -> None:
        """Have the library encode new parts."""
        words = [p.decode() for p in parts]
        ends = np.cumsum([len(w) + 1 for w in words])
        found = self.library.encode("\n".join(words), add_special_tokens=False)
        owner = np.searchsorted(ends, [start for start, _ in found.offsets], side="right")
        cuts = np.searchsorted(owner, np.arange(len(parts) + 1)) * 4
        flat = np.array(found.ids, "<u4").tobytes()
        for part, a, b in zip(parts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.ids[part] = flat[a:b]

    def _spell(self, parts: list[bytes], words: list[str]) -> None:
        """Have the library's byte-pair model encode new parts of plain letters."""
        tokenize = self.library.model.tokenize
        found = [[t.id for t in tokenize(word if word.isascii() else word.translate(self.letters))] for word in words]
        cuts = np.cumsum([0, *map(len, found)]) * 4
        flat = np.array(list(chain.from_iterable(found)), "<u4").tobytes()
        for part, a, b in zip(parts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.ids[part] = flat[a:b]

    def _learn(self, parts: list[bytes]) -> None:
        """Have the ids of all parts in ``ids``: kept, kept from before, or new."""
        if len(self.ids) > KEPT:
            self.before, self.ids = self.ids, {}
        plain, words, other = [], [], []
        for part in parts:
            if part in self.ids:
                continue
            if part in self.before:
                self.ids[part] = self.before[part]
            elif PLAIN.fullmatch(word := part.decode()):
                plain.append(part)
                words.append(word)
            else:
                other.append(part)
        for i in range(0, len(plain), 2000):
            self._spell(plain[i : i + 2000], words[i : i + 2000])
        for i in range(0, len(other), 2000):
            self._ask(other[i : i + 2000])

    def encode(self, text: bytes | None) -> bytes:
        """``encode_all`` of one text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; none for null."""
        cut = {i: self.cuts.split(t) for i, t in enumerate(texts) if t and any(token in t for token in self.added)}
        plain = [b"" if i in cut else t or b"" for i, t in enumerate(texts)]
        # every second piece of a cut text is an added token
        found = self._encode(plain + [p for pieces in cut.values() for p in pieces[::2]])
        rest = iter(found[len(texts) :])
        for i, pieces in cut.items():
            found[i] = b"".join(self.added[p] if k % 2 else next(rest) for k, p in enumerate(pieces))
        return found[: len(texts)]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts, or pieces of them, without added tokens: of every distinct part once, then dealt out."""
        if not any(t.strip() for t in texts):
            return [b""] * len(texts)
        lower = pa.array([t.translate(LOWER) for t in texts], pa.large_binary())
        parts = pc.ascii_split_whitespace(lower.view(pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        halves = _halves(coded.dictionary).dictionary_encode()
        distinct = halves.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct)
        found = [self.ids[half] for half in distinct]
        ends = np.cumsum([0, *map(len, found)]) // 4
        lists = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(found), "<u4")).take(halves.indices)
        dealt = pa.LargeListArray.from_arrays(lists.offsets[::2], lists.values).take(coded.indices)
        stream = dealt.values.to_numpy().tobytes()
        cuts = (dealt.offsets.to_numpy()[parts.offsets.to_numpy()] * 4).tolist()
        return [stream[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
