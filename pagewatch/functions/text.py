"""Text functions (F16, F17, F36, X5) and fuzzy hashes."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WORD = r"[\p{L}\p{N}]+"


def every_word(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def is_counted(word: Column) -> Column:
    """Whether a word counts: numbers and single ASCII letters don't."""
    start = F.substring(word, 1, 1)
    return ~F.when(F.length(word) == 1, start.between("0", "9") | start.between("a", "z")).otherwise(start.between("0", "9") & word.rlike("^[0-9]+$"))


def words(text: Column) -> Column:
    """Lower-cased words that count."""
    return F.filter(every_word(text), is_counted)


@F.pandas_udf(StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """F16: NFKC; each line's blanks collapse, empty lines go."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        lines = (" ".join(line.split()) for line in unicodedata.normalize("NFKC", value).split("\n"))
        return "\n".join(line for line in lines if line)

    return text.map(one)


def casings(word: Column) -> Column:
    """all spellings of a word in upper and lower case (2 to the power of its letters)."""
    count = F.pow(F.lit(2), F.length(word)).cast("int")
    letters = F.split(F.lower(word), "")
    bit = lambda n, i: F.floor(n / F.pow(F.lit(2), i)) % 2 == 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.array_join(F.transform(letters, lambda c, i: F.when(bit(n, i), F.upper(c)).otherwise(c)), ""))


def hack_level(text: Column) -> Column:
    """3 hacked by, 2 hacked, 1 hack, else 0; any case, spaces left out."""
    bare = F.lower(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(bare.contains("hackedby"), 3).when(bare.contains("hacked"), 2).when(bare.contains("hack"), 1).otherwise(0)


def hack_output(level: Column) -> Column:
    """The result of level 1, the alerts of higher ones."""
    return F.when(level == 1, "page_hack_word_Lv1").when(level >= 2, F.concat(F.lit("hack_word_Lv"), level))


DIFF = ArrayType(StructType([StructField("kind", StringType()), StructField("old", ArrayType(StringType())), StructField("new", ArrayType(StringType()))]))


def trimmed(old: str, new: str) -> tuple[str, str]:
    """What differs of two lines, between their common beginning and end."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    return old[a : len(old) - b], new[a : len(new) - b]


def _rising(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in the order of their first numbers, a longest run whose second numbers rise too (patience sorting)."""
    tops, piles, before = [], [], []
    for i, (_, b) in enumerate(found):
        pile = bisect_left(tops, b)
        before.append(piles[pile - 1] if pile else -1)
        tops[pile : pile + 1], piles[pile : pile + 1] = [b], [i]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(found[at])
        at = before[at]
    return out[::-1]


def _gaps(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Patience diff: ranges of old and new lines that differ, in order.

    Equal lines at both ends go; of the rest, lines that stand once on either side and in the same order are anchors, between which
    it begins again. Where there are none, all differs. Each round takes time in proportion to the lines that it looks at.
    """
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        if a == b or c == d:
            if a < b or c < d:
                out.append((a, b, c, d))
            continue
        once = [{line: at for line, at in places.items() if at >= 0} for places in (_once(old, a, b), _once(new, c, d))]
        anchors = _rising([(at, once[1][line]) for line, at in once[0].items() if line in once[1]])
        if not anchors:
            out.append((a, b, c, d))
            continue
        starts = [(a, c), *((x + 1, y + 1) for x, y in anchors)]
        todo += [(p, x, q, y) for (p, q), (x, y) in zip(starts, [*anchors, (b, d)], strict=True)][::-1]
    return out


def _once(lines: list[str], first: int, end: int) -> dict[str, int]:
    """Where each line stands, in order; -1 if more than once."""
    out: dict[str, int] = {}
    for at in range(first, end):
        out[lines[at]] = -1 if lines[at] in out else at
    return out


def line_changes(old: list[str], new: list[str], trim: bool = False) -> list[tuple[str, list[str], list[str]]]:
    """(modified | delete | add, old lines, new lines) by a patience diff; lines beyond those paired are deleted or added."""
    out = []
    for a, b, c, d in _gaps(old, new):
        both = min(b - a, d - c)
        if both:
            pairs = [trimmed(x, y) if trim else (x, y) for x, y in zip(old[a : a + both], new[c : c + both], strict=True)]
            out.append(("modified", [x for x, _ in pairs], [y for _, y in pairs]))
        if a + both < b:
            out.append(("delete", old[a + both : b], []))
        if c + both < d:
            out.append(("add", [], new[c + both : d]))
    return out


@F.pandas_udf(DIFF)
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """line_changes of two texts; null counts as empty."""

    def lines(value: str | None) -> list[str]:
        return value.split("\n") if value else []

    return pd.Series([[{"kind": k, "old": a, "new": b} for k, a, b in line_changes(lines(x), lines(y))] for x, y in zip(old, new, strict=True)])


_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PIECES, _LEAST, _WINDOW = 64, 3, 7
#: The low six bits of FNV's start and prime; they depend on nothing above them.
_START, _PRIME = 0x28021967 & 63, 0x01000193 & 63
#: Pieces that are hashed in step, below which they go one by one.
_FEW = 16


def _rolled(data: np.ndarray) -> np.ndarray:
    """Kornblum's rolling hash after each byte, from sums and shifts over the last _WINDOW bytes."""
    wide = np.r_[np.zeros(_WINDOW - 1, np.uint32), data.astype(np.uint32)]
    last = [wide[_WINDOW - 1 - j : len(wide) - j] for j in range(_WINDOW)]
    total, shifted = np.zeros(len(data), np.uint32), np.zeros(len(data), np.uint32)
    for j, byte in enumerate(last):
        total += (_WINDOW + 1 - j) * byte  # the sum, and the sum weighted by age
        shifted ^= byte << np.uint32(5 * j)
    return total + shifted


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Six bits of FNV of each piece, all pieces a byte at a time, the longer ones first."""
    order = np.argsort(starts - ends, kind="stable")
    starts, sizes = starts[order], (ends - starts)[order]
    state, low = np.full(len(starts), _START, np.uint8), data & 63
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    step = 0
    for step, n in enumerate(active.tolist()):
        if n < _FEW:
            break
        state[:n] = (state[:n] * np.uint8(_PRIME) & 63) ^ low[starts[:n] + step]
    else:
        step = len(active)
    for i in range(int(active[step]) if step < len(active) else 0):
        own = int(state[i])
        for byte in low[starts[i] + step : starts[i] + sizes[i]].tolist():
            own = (own * _PRIME & 63) ^ byte
        state[i] = own
    out = np.empty(len(starts), np.uint8)
    out[order] = state
    return out


def fuzzy_hashes(texts: list[bytes]) -> list[str]:
    """Context-triggered piecewise hashes (Kornblum 2006) of many texts: block size and the pieces at it and at its double."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    begin, plan, starts, ends = 0, [], [], []
    for text in texts:
        own = whole[begin : begin + len(text)]
        rolled, size = _rolled(own), _LEAST
        while size * _PIECES < len(own):
            size *= 2
        while True:
            cuts = np.flatnonzero(rolled % np.uint32(size) == size - 1)[: _PIECES - 1]
            if size == _LEAST or len(cuts) + 1 >= _PIECES // 2:
                break
            size //= 2
        double = np.flatnonzero(rolled % np.uint32(2 * size) == 2 * size - 1)[: _PIECES // 2 - 1]
        for some in (cuts, double):
            starts.append(begin + np.r_[0, some + 1])
            ends.append(begin + np.r_[some + 1, len(own)])
        plan.append((size, len(cuts) + 1, len(double) + 1))
        begin += len(text)
    if not texts:
        return []
    chars = np.frombuffer(_BASE64.encode(), np.uint8)[_piece_hashes(whole, np.concatenate(starts), np.concatenate(ends))].tobytes().decode()
    out, at = [], 0
    for size, one, two in plan:
        out.append(f"{size}:{chars[at : at + one]}:{chars[at + one : at + one + two]}")
        at += one + two
    return out


def fuzzy_hash_of(data: bytes) -> str:
    return fuzzy_hashes([data])[0]


def _common(a: str, b: str) -> int:
    """Length of a longest common subsequence, a character of b at a time over all of a as bits (Hyyro 2004)."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    open_ = whole
    for x in b:
        here = open_ & places.get(x, 0)
        open_ = (open_ + here | open_ - here) & whole
    return len(a) - open_.bit_count()


def _edit_score(a: str, b: str, size: int) -> int:
    if not any(a[i : i + _WINDOW] in b for i in range(len(a) - _WINDOW + 1)):
        return 0
    apart = len(a) + len(b) - 2 * _common(a, b)  # what an exchange counts twice, and an insertion or deletion once
    score = 100 - 100 * (apart * _PIECES // (len(a) + len(b))) // _PIECES
    return max(0, min(score, size // _LEAST * min(len(a), len(b))))


class Pieces:
    """Pieces of fuzzy hashes, of which many pairs are scored at once: a bit for each character, as in _common."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.size = pieces, np.array([len(p) for p in pieces], np.int64)
        codes = np.full(256, _PIECES, np.uint8)
        codes[np.frombuffer(_BASE64.encode(), np.uint8)] = np.arange(_PIECES)
        raw = [p.encode() for p in pieces]
        self.codes = codes[np.frombuffer(b"".join(p[:_PIECES].ljust(_PIECES, b"=") for p in raw), np.uint8)].reshape(-1, _PIECES)
        self.is_odd = (self.size > _PIECES) | ((self.codes < _PIECES).sum(1) < self.size)  # which no fuzzy hash has
        self.places = np.zeros((len(pieces), _PIECES + 1), np.uint64)
        rows = np.arange(len(pieces))
        for i in range(_PIECES):
            self.places[rows, self.codes[:, i]] |= np.uint64(1 << i)
        self.places[:, _PIECES] = 0

    def scores(self, a: np.ndarray, b: np.ndarray, block: np.ndarray, least: int) -> np.ndarray:
        """_edit_score of the pieces with these numbers, which share a run; less than `least` may be 0."""

        def score(apart, m, n, size):
            most = 100 - 100 * (apart * _PIECES // (m + n)) // _PIECES
            return np.clip(most, 0, size // _LEAST * np.minimum(m, n))

        m, n, out = self.size[a], self.size[b], np.zeros(len(a), np.int64)
        odd = self.is_odd[a] | self.is_odd[b]
        for i in np.flatnonzero(odd):
            out[i] = _edit_score(self.pieces[a[i]], self.pieces[b[i]], int(block[i]))
        near = np.flatnonzero(~odd & (score(np.abs(m - n), m, n, block) >= least))
        if not len(near):
            return out
        a, b, m, n = a[near], b[near], m[near], n[near]
        whole = np.uint64(2**64 - 1) >> (_PIECES - m).astype(np.uint64)
        open_, flat, row = whole.copy(), self.places.ravel(), a * (_PIECES + 1)
        for column in np.ascontiguousarray(self.codes.T)[: int(n.max())]:
            here = open_ & flat[row + column[b]]
            open_ = open_ + here | open_ - here
        common = m - np.bitwise_count(open_ & whole).astype(np.int64)
        out[near] = score(m + n - 2 * common, m, n, block[near])
        return out


def fuzzy_score_of(a: str, b: str) -> int:
    """0 to 100; signatures of block sizes that aren't neighbours have nothing in common."""
    if a == b:
        return 100
    (m, a1, a2), (n, b1, b2) = ((int(s), x, y) for s, x, y in (t.split(":") for t in (a, b)))
    if m == n:
        return max(_edit_score(a1, b1, m), _edit_score(a2, b2, 2 * m))
    if m == 2 * n:
        return _edit_score(a1, b2, m)
    return _edit_score(a2, b1, n) if n == 2 * m else 0


@F.pandas_udf(StringType())
def fuzzy_hash(data: pd.Series) -> pd.Series:
    """of text in UTF-8; null stays null."""
    made = iter(fuzzy_hashes([v.encode() for v in data if v is not None]))
    return pd.Series([None if v is None else next(made) for v in data], dtype="object")


@F.pandas_udf(IntegerType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else fuzzy_score_of(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
