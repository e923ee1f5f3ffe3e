"""Pre-tokens of whole batches of texts by array operations, equal to those of the tokenizers library.

Characters are classed (letter, number, blank, other) through a table; token starts follow from where the
class changes, and a few corrections. Texts with characters whose class has changed between versions of
Unicode, or with special tokens, go through the library's own normaliser and pre-tokeniser instead.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, BLANK, UNSURE = range(5)
#: Characters of a segment; longer texts are cut where a single space stands between others.
SEGMENT = 1 << 20

#: White_Space of Unicode.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CUT = re.compile(r"\S \S")


@lru_cache(1)
def _classes() -> np.ndarray:
    old = unicodedata.ucd_3_2_0
    table = np.full(1 << 16, UNSURE, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if kind != "Cn" and kind != "Cs" and kind[0] == old.category(chr(c))[0]:
            table[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    table[_BLANKS] = BLANK
    return table


def segments(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > SEGMENT:
        cut = _CUT.search(text, at + SEGMENT)
        if not cut:
            break
        out.append(text[at : cut.start() + 1])
        at = cut.start() + 1
    return [*out, text[at:]]


@lru_cache(1)
def _byte_letters() -> str:
    """The letter that byte-level vocabularies have for each byte: itself if printable, else the next from U+0100."""
    out, n = [], 256
    for b in range(256):
        plain = 33 <= b < 127 or 161 <= b < 256 and b != 173
        out.append(chr(b) if plain else chr(n))
        n += not plain
    return "".join(out)


@lru_cache(2)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokenizer:
    """words: the pattern keeps runs of letters, single numbers and runs of others, of lower-cased text;
    else each token may take one space before it, and blanks are tokens too."""

    def __init__(self, path: str, words: bool):
        self.path, self.words = path, words
        self.tokenizer = load(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def ids(self, tokens: list[str]) -> list[list[int]]:
        """The vocabulary's ids of each pre-token, by the library's model alone: the rest of its work is done."""
        letters, pieces = _byte_letters(), self.tokenizer.model.tokenize
        space = letters[32]

        def lettered(t: str) -> str:
            if t.isascii() and t.isalnum():
                return t
            if t.isascii() and t[1:].isalnum() and t[0] == " ":
                return space + t[1:]
            return t.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)

        out = [[p.id for p in pieces(lettered(t))] for t in tokens]
        if self.special:
            for i, t in enumerate(tokens):
                if t[:1] == "<" and self.special.fullmatch(t):
                    out[i] = [self.tokenizer.token_to_id(t)]
        return out

    def _slow(self, text: str) -> list[str]:
        out = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(part)
            elif part:
                if self.tokenizer.normalizer is not None:
                    part = self.tokenizer.normalizer.normalize_str(part)
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _normal(self, text: str) -> str | None:
        """None: leave the text to the library."""
        if self.special and "<" in text and self.special.search(text):
            return None
        if not self.words:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text or "İ" in text:
                return None
        return text.lower()

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of all texts as one array, and each one's text; texts keep their order inside, not among each other."""
        parts, owner, slow = [], [], []
        for i, text in enumerate(texts):
            normal = self._normal(text)
            if normal is None:
                slow.append(i)
            else:
                for part in segments(normal):
                    if part:
                        parts.append(part)
                        owner.append(i)
        arrays, owners = [], []
        at, size = 0, 0
        for end, part in enumerate(parts, 1):  # some segments at a time, for the sake of memory
            size += len(part)
            if size >= SEGMENT or end == len(parts):
                made, own, unsure = self._arrays(parts[at:end], np.array(owner[at:end]))
                if unsure:
                    slow += unsure
                    keep = ~np.isin(own, unsure)
                    made, own = made.filter(pa.array(keep)), own[keep]
                arrays.append(made)
                owners.append(own)
                at, size = end, 0
        if slow:
            again = sorted(set(slow))
            arrays = [a.filter(pa.array(~np.isin(o, again))) for a, o in zip(arrays, owners, strict=True)]
            owners = [o[~np.isin(o, again)] for o in owners]
            for i in again:
                found = self._slow(texts[i])
                arrays.append(pa.array(found, pa.large_string()))
                owners.append(np.full(len(found), i))
        if not arrays:
            return pa.array([], pa.large_string()), np.zeros(0, np.int64)
        return pa.concat_arrays(arrays), np.concatenate(owners)

    def _arrays(self, parts: list[str], owner: np.ndarray) -> tuple[pa.Array, np.ndarray, list[int]]:
        data = "".join(parts)
        c = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = data.encode("utf-8", "surrogatepass")
        first = np.r_[0, np.cumsum([len(p) for p in parts])]
        top = np.zeros(len(c) + 1, bool)
        top[first] = True
        kind = _classes()[np.minimum(c, 0xFFFF)]
        kind[c > 0xFFFF] = UNSURE
        unsure = np.flatnonzero(kind == UNSURE)
        bad = sorted({int(owner[i]) for i in np.searchsorted(first, unsure, side="right") - 1}) if len(unsure) else []
        start = np.ones(len(c) + 1, bool)
        start[1:-1] = kind[1:] != kind[:-1]
        start |= top
        if self.words:
            start[:-1] |= kind == NUMBER
        else:
            after = np.flatnonzero(start[1:-1] & ~top[1:-1] & (kind[:-1] == BLANK)) + 1
            start[after - 1] = True
            start[after[c[after - 1] == 32]] = False
        quote = np.flatnonzero((c[:-1] == 39) & start[:-2] & start[1:-1] & ~top[1:-1] & (kind[1:] == LETTER)) if len(c) > 1 else []
        for q in quote:
            tail = data[q + 1 : q + 3]
            n = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") and not top[q + 2] else 0
            if n:
                start[q + 1] = False
                start[q + n] |= q + n < len(c) and kind[q + n] == LETTER
        at = np.flatnonzero(start)
        place = at if len(raw) == len(c) else np.r_[0, np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c > 0xFFFF))][at]
        offsets = pa.py_buffer(np.ascontiguousarray(place, np.int64))
        found = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, offsets, pa.py_buffer(raw)])
        own = owner[np.searchsorted(first, at[:-1], side="right") - 1]
        if self.words:
            keep = kind[at[:-1]] != BLANK
            return found.filter(pa.array(keep)), own[keep], bad
        return found, own, bad


def coded(tokens: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the tokens, and the distinct tokens that they number."""
    made = tokens.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False), made.dictionary.to_pylist()
