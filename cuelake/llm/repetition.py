"""Repetition inside a transcript: compression bands, then an exact share.

The texts of a transcript, in order, are compressed with zstandard: whole, and in fixed chunks. How much text without
repeats compresses depends on its wording, and repeats in other letters or with slips hardly compress, so no ratio is a safe
reason to leave a text out. All are checked exactly: sentences said before, wherever cues are cut and slips of characters
aside, and phrases repeated back to back. The ratios choose the way: in a plain text most sentences share no part with any
other, so these are found first, all at once, and spared the history; in a repetitive one that would be in vain. Both ways
give the same counts. A long transcript is cut into blocks of its order; blocks are compressed and checked in their own
tasks, and what a block can't decide alone, whether a sentence was said in an earlier block, is decided by an aggregate and
a join over sentence keys.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cuelake.functions.text import is_blank
from cuelake.llm import glyphs
from cuelake.llm.events import slips, unspaced_same
from cuelake.session import keep
from cuelake.sources.tables import table

#: Order values that one block spans, and bytes of a compression chunk.
BLOCK, CHUNK = 4096, 4096
LEVEL = 3
#: From this ratio a text is repetitive: there, seeking company takes as long as it saves. No count depends on it.
REPETITIVE = 4.5
#: Bands; all are checked exactly.
CHECKED = ("plain", "repetitive", "long")
#: Share of the characters from which a transcript is reported.
SHARE = 1 / 3
#: Least size of a sentence: words, or characters in scripts without word spaces; longest phrase of a loop.
LEAST_WORDS, LEAST_CHARS, PERIOD = 4, 8, 12

_SPLIT = regex.compile(r"[.!?…]+[\"”»)\]]*\s+|[。！？।؟．｡…]+[\"”»」』）]*\s*")
_MARKS = ".,!?…\"'“”„«»()[]{}:;–—-♪¿¡、。，！？：；・"
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_LETTERS = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_THAI = regex.compile(r"\p{Thai}")


def band(ratio: float, densest: float) -> str:
    """'plain' or 'repetitive': the way of the exact check that is likely to be the shorter one."""
    return "plain" if max(ratio, densest) < REPETITIVE else "repetitive"


def ratios(raw: bytes) -> tuple[float, float]:
    """Compression ratio of the whole text and of its densest fixed chunk."""
    c = zstandard.ZstdCompressor(level=LEVEL)
    whole = len(raw) / max(1, len(c.compress(raw)))
    if len(raw) <= CHUNK:
        return whole, whole
    return whole, max(len(raw[i : i + CHUNK]) / len(c.compress(raw[i : i + CHUNK])) for i in range(0, len(raw) - CHUNK // 2, CHUNK))


#: Where one cue ends and the next begins, in a joined text; a private character that no font prints.
_CUE = "\ue000"
#: Cues of which nothing is left in print.
_EMPTY = regex.compile(f"{_CUE}(?: {_CUE})+")
#: A sentence of more words than this wasn't closed where it ended; its cues are taken for sentences.
UNCLOSED = 60


def units(shown: str, unspaced: bool) -> list[tuple[list[str], list[int]]]:
    """Sentences of a joined text as token lists (words, or characters), with the places where cues begin inside them.

    In Thai a space closes a sentence.
    """
    out = []
    for p in _SPLIT.split(shown):
        for q in p.replace(f" {_CUE} ", _CUE).split(" ") if unspaced and _THAI.search(p) else [p]:
            tokens: list[str] = []
            cuts: list[int] = []
            for piece in q.split(_CUE):
                if tokens:
                    cuts.append(len(tokens))
                if unspaced and _UNSPACED.search(piece):
                    tokens += _LETTERS.sub("", piece)
                else:
                    tokens += [w for x in piece.split() if (w := x.strip(_MARKS))]
            if tokens:
                out.append((tokens, [c for c in cuts if 0 < c < len(tokens)]))
    return out


def by_chars(words: tuple[str, ...]) -> bool:
    """A sentence of characters that is compared as one string."""
    return len(words) > 12 and max(map(len, words)) == 1


def _keep(n: int) -> int:
    """Characters that stay whole at an end of a sentence of ``n``: they grow with it by steps."""
    return 8 if n < 20 else 12 if n < 32 else 18


def kept_under(whole: tuple[str, ...], chars: bool) -> list[tuple]:
    """Keys under which a sentence is kept: its halves, and its thirds, one of which two slips leave whole."""
    n = len(whole)
    if chars:
        return [(0, 0, whole[: _keep(n)]), (1, 0, whole[-_keep(n) :])]
    return [(0, n, whole[: n // 2]), (1, n, whole[-(n // 2) :]), *_thirds(whole)]


def _thirds(whole: tuple[str, ...]) -> list[tuple]:
    n = len(whole)
    i, j = n // 3, 2 * n // 3
    return [(2, n, whole[:i]), (3, n, whole[i:j]), (4, n, whole[j:])]


def sought_under(whole: tuple[str, ...], chars: bool) -> list[tuple]:
    """Keys under which a sentence like this one may have been kept: of its own length or its neighbours'."""
    n = len(whole)
    if chars:  # lengths near a step look at both sides of it
        return [k for w in {_keep(n - 4), _keep(n + 4)} for k in ((0, 0, whole[:w]), (1, 0, whole[-w:]))]
    keys = [k for m in (n - 1, n + 1) for k in ((0, m, whole[: m // 2]), (1, m, whole[-(m // 2) :]))]
    return _thirds(whole)[::-1] + keys


class History:
    """Sentences said so far in one block, found again by a third of their words, or a half where a word was put in: slips and insertions leave one whole.

    A bucket holds sentences of one length with the same part; a sentence looks up its own length and its neighbours'.
    """

    def __init__(self) -> None:
        self.exact: set[tuple[str, ...]] = set()
        self.ends: dict[tuple, list[tuple[str, ...]]] = {}

    def said(self, words: list[str], remember: bool = True) -> bool:
        whole = tuple(words)
        if whole in self.exact:
            return True
        chars = by_chars(whole)
        found = self._meets(whole, chars)
        if remember:
            self.exact.add(whole)
            for k in kept_under(whole, chars):
                self.ends.setdefault(k, []).append(whole)
        return found

    def _meets(self, whole: tuple[str, ...], chars: bool) -> bool:
        get = self.ends.get
        for key in sought_under(whole, chars):
            for other in get(key, ()):
                if alike(whole, other, chars, key[0] in (0, 2)):
                    return True
        return False


_slips = lru_cache(1 << 16)(slips)


def alike(a: tuple[str, ...], b: tuple[str, ...], chars: bool, backward: bool = False) -> bool:
    """Equal but for slips of characters, in two words at most, or for one word put in (a few characters at an end).

    ``backward``: the first words are known to be equal, so the comparison starts at the last ones.
    """
    if chars:
        if abs(len(a) - len(b)) > 4:
            return False
        x, y = sorted(("".join(a), "".join(b)), key=len)
        if 0 < len(y) - len(x) <= 4 and (y.endswith(x) or y.startswith(x)):
            extra = y[: len(y) - len(x)] if y.endswith(x) else y[len(x) :]
            return not any(c.isdigit() for c in extra)
        return unspaced_same(x, y)
    if backward:
        a, b = a[::-1], b[::-1]
    if len(a) != len(b):
        short, long = (a, b) if len(a) < len(b) else (b, a)
        i = 0
        while i < len(short) and short[i] == long[i]:
            i += 1
        return short[i:] == long[i + 1 :] and not long[i].isdigit()
    left = 2
    for x, y in zip(a, b):
        if x != y:
            # a word whose both ends differ is another word; so is another number
            if not left or (x[0] != y[0] and x[-1] != y[-1]) or x.isdigit() or y.isdigit() or _slips(x, y) > 2:
                return False
            left -= 1
    return True


def in_company(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which stretches of numbered words share a key of ``kept_under`` or ``sought_under`` with another one.

    One without company is met by no other in a ``History``. Numbers stand for the keys; should two be equal by chance, a
    stretch has company in vain.
    """
    size = len(code)
    step = np.full(size + 1, _STEP, np.uint64)
    step[0] = 1
    step = np.multiply.accumulate(step)
    words = code.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(_STEP)
    words = (words ^ words >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    summed = np.zeros(size + 1, np.uint64)
    np.cumsum(words * step[:size], out=summed[1:])
    n = end - begin
    i, j = begin + n // 3, begin + 2 * n // 3
    parts = [(2, 0, begin, i), (3, 0, i, j), (4, 0, j, end)]
    parts += [k for m in (0, -1, 1) for k in ((0, m, begin, begin + (n + m) // 2), (1, m, end - (n + m) // 2, end))]
    first, last = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    kind = np.concatenate([(n + m) * 8 + k for k, m, _, _ in parts]).astype(np.uint64)
    keys = (summed[last] - summed[first]) * step[size - first] + kind * np.uint64(0x94D049BB133111EB)
    order = np.argsort(keys)
    same = np.flatnonzero(np.diff(keys[order]) == 0)
    met = np.zeros(len(keys), bool)
    met[order[same]] = met[order[same + 1]] = True
    return met.reshape(len(parts), -1).any(0)


def numbered(tokens: list[str]) -> np.ndarray:
    """Equal tokens as equal numbers."""
    number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    return np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))


def loops(code: np.ndarray, period: int = PERIOD) -> np.ndarray:
    """Which tokens repeat the phrase right before them: beyond the first of two or more copies (three for one word)."""
    marked = np.zeros(len(code), bool)
    for p in range(1, min(period, len(code) // 2) + 1):
        same = code[p:] == code[:-p]
        if same.tobytes().find(b"\x01" * max(p, 2)) < 0:
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        for k in np.flatnonzero(end - begin >= max(p, 2)):
            marked[begin[k] + p : end[k] + p] = True
    return marked


def _printed(texts: list[str]) -> str:
    """All texts as they look in print, joined: what ``glyphs.printed`` does, at once; cue marks keep texts apart."""
    shown = glyphs.INVISIBLE.sub("", f" {_CUE} ".join(texts))
    if not unicodedata.is_normalized("NFKC", shown):
        shown = unicodedata.normalize("NFKC", shown)
    return glyphs.HYPHENS.sub("-", _EMPTY.sub(_CUE, " ".join(shown.split()))).strip(f" {_CUE}")


#: Tokens of plain texts whose company is sought at once.
TOGETHER = 1 << 15


class Said:
    """A text cut into sentences, its tokens in a row and as numbers."""

    def __init__(self, texts: list[str], kind: str) -> None:
        shown = _printed(texts).casefold()
        if glyphs._FOREIGN.search(shown):
            shown = shown.translate(glyphs.TO_LATIN)
        self.unspaced = bool(_UNSPACED.search(shown))
        self.sentences = units(shown, self.unspaced)
        self.flat = [t for s, _ in self.sentences for t in s]
        self.code = numbered(self.flat)
        #: Places of sentences, and of cues in them, that have company; None: not sought. Sentences of characters meet by other keys.
        self.company: set[tuple[int, int]] | None = set() if kind == "plain" and not self.unspaced else None


def share(texts: list[str], kind: str = "repetitive") -> tuple[int, int, list[tuple[int, tuple]]]:
    """(characters, repeated characters, undecided): undecided are (characters, exact words) of sentences new to this block.

    ``kind``: in a 'plain' text, sentences without company are neither sought in the history nor kept there.
    """
    return next(shares([(texts, kind)]))


def shares(several: Iterable[tuple[list[str], str]]) -> Iterator[tuple[int, int, list[tuple[int, tuple]]]]:
    """``share`` of each of several (texts, kind)."""
    group: list[Said] = []
    size = 0
    for texts, kind in several:
        group.append(Said(texts, kind))
        size += len(group[-1].flat)
        if size >= TOGETHER:
            _meet(group)
            yield from map(_count, group)
            group, size = [], 0
    _meet(group)
    yield from map(_count, group)


def _meet(group: list[Said]) -> None:
    """Sets the company of the plain texts of a group; words of different texts are different."""
    at, words, codes, owner, begin, end = 0, 0, [], [], [], []
    plain = [x for x in group if x.flat and x.company is not None]
    for x in plain:
        first, place = len(begin), at
        for s, cuts in x.sentences:
            begin.append(place)
            if cuts:
                begin += [place, *(place + c for c in cuts)]
                end += [place + len(s), *(place + c for c in cuts)]
            place += len(s)
            end.append(place)
        owner += [(x, at)] * (len(begin) - first)
        codes.append(x.code + words)
        at, words = place, words + int(x.code.max()) + 1
    if plain:
        for k in np.flatnonzero(in_company(np.concatenate(codes), np.array(begin), np.array(end))).tolist():
            x, at = owner[k]
            x.company.add((begin[k] - at, end[k] - at))


def _count(text: Said) -> tuple[int, int, list[tuple[int, tuple]]]:
    flat, company = text.flat, text.company
    if not flat:
        return 0, 0, []
    marked = loops(text.code, 30 if text.unspaced else PERIOD)
    looped = np.r_[0, np.cumsum(marked)].tolist() if marked.any() else None
    history, at, total, repeated, undecided = History(), 0, 0, 0, []

    def said(words: list[str], begin: int, remember: bool = True) -> bool:
        if company is not None and (begin, begin + len(words)) not in company and not by_chars(words):
            return False
        return history.said(words, remember)

    for s, cuts in text.sentences:
        n = sum(map(len, s))
        total += n
        begin, at = at, at + len(s)
        inside = looped[at] - looped[begin] if looped else 0
        in_loop = sum(len(t) for t, m in zip(s, marked[begin:at]) if m) if inside else 0
        if inside > 0.3 * len(s) or not _long_enough(s, n, text.unspaced):
            repeated += in_loop
            continue
        unclosed = len(s) > UNCLOSED and len(cuts) > 1
        if not unclosed and said(s, begin):
            repeated += n
            continue
        again = in_loop
        if cuts:
            # a sentence that lost its closing mark runs into the next cue: its cues may have been said as sentences
            bounds = [0, *cuts, len(s)]
            for i, j in zip(bounds, bounds[1:]):
                size = sum(map(len, s[i:j]))
                if _long_enough(s[i:j], size, text.unspaced):
                    if said(s[i:j], begin + i, remember=unclosed):
                        again += size
                    elif unclosed:
                        undecided.append((size, tuple(s[i:j])))
        repeated += min(again, n)
        if not unclosed and again == in_loop:
            undecided.append((n, tuple(s)))
    return total, repeated, undecided


def _long_enough(words: list[str], size: int, unspaced_text: bool) -> bool:
    return size >= LEAST_CHARS if unspaced_text and size == len(words) else len(words) >= LEAST_WORDS


_SEP = "\x1f"
#: A bucket of at most this many sentences is compared pair by pair; a larger one is split by finer keys first.
LIGHT = 64
#: Parts into which the words of a sentence are cut for its first keys; two slips leave all but two of them whole.
PARTS = 5
_MOST = (1 << 64) - 1
#: An odd number and its inverse: powers of it tell the places of words apart in a key.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _digest(words: tuple[str, ...]) -> bytes:
    return hashlib.blake2b(_SEP.join(words).encode("utf-8", "replace"), digest_size=16).digest()


@lru_cache(1 << 17)
def _number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _signed(key: int, salt: int) -> int:
    key = ((key ^ (salt + 1) * 0xBF58476D1CE4E5B9) * 0x94D049BB133111EB) & _MOST
    key ^= key >> 31
    return key - (1 << 64) if key >> 63 else key


class Terms:
    """The words of a sentence as numbers that depend on their places; a key is the sum of those that must be equal.

    Words of digits never differ between like sentences, so every key holds them.
    """

    def __init__(self, words: tuple[str, ...], salt: int) -> None:
        step, terms = 1, []
        for w in words:
            terms.append(_number(w) * step & _MOST)
            step = step * _STEP & _MOST
        self.words, self.terms, self.salt = words, terms, salt
        self.whole = sum(terms) + len(words) * _BACK & _MOST
        self.free = [i for i, w in enumerate(words) if not w.isdigit()]

    def parts(self) -> list[list[int]]:
        k = min(PARTS, len(self.free))
        return [self.free[len(self.free) * i // k : len(self.free) * (i + 1) // k] for i in range(k)]

    def finer(self, marks: set[int], letters: bool) -> list[tuple[int, int]]:
        """(key, mark): all but two words, which stand in two parts that a mark names.

        ``letters``: marks are pairs of words, and a key holds an end of both words too, as a slip leaves one end of a word.
        """
        out = []
        for i, j in self._pairs(marks, letters):
            mark = i * 1024 + j
            key = self.whole - self.terms[i] - (self.terms[j] if j > i else 0)
            if not letters:
                out.append((_signed(key, self.salt + 100 + mark), mark))
                continue
            for x, end_i in enumerate((0, -1)):
                for y, end_j in enumerate((0, -1)):
                    ends = _number(self.words[i][end_i]) * 3 + _number(self.words[j][end_j]) * 5
                    out.append((_signed(key + ends, self.salt + (100 + mark) * 8 + 2 * x + y), mark))
        return out

    def _pairs(self, marks: set[int], letters: bool) -> set[tuple[int, int]]:
        if letters:
            return {divmod(m, 1024) for m in marks}
        parts = self.parts()
        found = set()
        for m in marks:
            both = sorted(set(parts[m // PARTS] + parts[m % PARTS]))
            found |= {(a, b) for k, a in enumerate(both) for b in both[k + 1 :]} or {(a, a) for a in both}
        return found


class Batch:
    """The terms of many sentences of words at once; keys are those that ``Terms`` would give."""

    def __init__(self, ids: list[int], tids: list[int], blks: list[int], sentences: list[tuple[str, ...]]) -> None:
        flat = [w for words in sentences for w in words]
        self.n = np.fromiter(map(len, sentences), np.int64, len(sentences))
        self.owner = np.repeat(np.arange(len(sentences)), self.n)
        self.first = np.cumsum(self.n) - self.n
        step = np.full(int(self.n.max(initial=0)) + 1, _STEP, np.uint64)
        step[0] = 1
        self.terms = np.fromiter(map(_number, flat), np.uint64, len(flat)) * np.multiply.accumulate(step)[np.arange(len(flat)) - self.first[self.owner]]
        self.free = ~np.fromiter(map(str.isdigit, flat), bool, len(flat))
        self.ids, self.blks, self.salt = np.array(ids, np.int64), np.array(blks, np.int64), np.array(tids, np.int64).astype(np.uint64)
        self.total = np.add.reduceat(self.terms, self.first) if len(flat) else np.empty(0, np.uint64)
        self.back = np.uint64(_BACK)

    def rows(self, keys: np.ndarray, of: np.ndarray, salt: np.ndarray, last: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        k = (keys ^ (salt + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
        k ^= k >> np.uint64(31)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[of]), pa.array(self.blks[of]), pa.array(k.view(np.int64)), last], schema=schema)

    def by_parts(self) -> pa.RecordBatch:
        """All of each sentence but two of its parts; the mark names the two."""
        count = np.bincount(self.owner[self.free], minlength=len(self.n))
        parts = np.minimum(PARTS, count)
        owner = self.owner[self.free]
        place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        sums = np.zeros((len(self.n), PARTS), np.uint64)
        np.add.at(sums, (owner, (parts[owner] * (place + 1) - 1) // count[owner]), self.terms[self.free])
        whole = self.total + self.n.astype(np.uint64) * self.back
        keys, of, marks = [], [], []
        for i in range(PARTS):
            for j in range(i, PARTS):
                has = np.flatnonzero(parts == 1) if i == j == 0 else np.flatnonzero(parts > j) if j > i else np.empty(0, np.int64)
                keys.append(whole[has] - sums[has, i] - (sums[has, j] if j > i else np.uint64(0)))
                of.append(has)
                marks.append(np.full(len(has), i * PARTS + j, np.int32))
        of, marks = np.concatenate(of), np.concatenate(marks)
        return self.rows(np.concatenate(keys), of, self.salt[of] + marks.astype(np.uint64), pa.array(marks), _KEYS)

    def put_in(self) -> pa.RecordBatch:
        """Each sentence's own key, and its keys without one word each, numbers aside."""
        summed = np.cumsum(self.terms, dtype=np.uint64)
        before = summed - self.terms - (summed - self.terms)[self.first][self.owner] if len(self.terms) else self.terms
        after = self.total[self.owner] - before - self.terms
        n = self.n.astype(np.uint64)
        less = (before + after * self.back + (n[self.owner] - np.uint64(1)) * self.back)[self.free]
        of = np.r_[np.arange(len(self.n)), self.owner[self.free]]
        whole = np.r_[np.ones(len(self.n), bool), np.zeros(len(less), bool)]
        return self.rows(np.r_[self.total + n * self.back, less], of, self.salt[of], pa.array(whole), _PUT_IN)


def _char_keys(words: tuple[str, ...], salt: int) -> list[tuple[int, int]]:
    """Keys of a sentence of characters: its ends, in the widths of sentences up to four characters longer or shorter."""
    text, n = "".join(words), len(words)
    return [(_signed(_number(f"{side}{text[:w] if side else text[-w:]}"), salt), -1) for w in {_keep(n - 4), _keep(n), _keep(n + 4)} for side in (0, 1)]


#: (sentence id, block, key, mark) of a level of keys, and (key, sentence id, block, whole) of keys for a word put in.
_KEYS = pa.schema([("id", pa.int64()), ("blk", pa.int64()), ("key", pa.int64()), ("mark", pa.int32())])
_PUT_IN = pa.schema([("id", pa.int64()), ("blk", pa.int64()), ("key", pa.int64()), ("whole", pa.bool_())])
KEYS, PUT_IN = "id bigint, blk bigint, key bigint, mark int", "id bigint, blk bigint, key bigint, whole boolean"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _level(level: int):
    """Keys of sentences (id, transcript_id, blk, w, marks): 0 by parts, 1 by pairs of words, 2 by their ends too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, worded = [], []
            for i, tid, blk, w, marks in zip(*(c.to_pylist() for c in b.columns)):
                words = tuple(w.split(_SEP))
                if by_chars(words):
                    rows += [(i, blk, k, m) for k, m in _char_keys(words, tid)]
                elif level:
                    rows += [(i, blk, k, m) for k, m in Terms(words, tid).finer(set(marks), level == 2)]
                else:
                    worded.append((i, tid, blk, words))
            yield _batch(rows, _KEYS)
            if worded:
                yield Batch(*map(list, zip(*worded))).by_parts()

    return run


def _put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sentence's own key, and its keys without one word each."""
    for b in batches:
        split = ((i, tid, blk, tuple(w.split(_SEP))) for i, tid, blk, w in zip(*(b.column(k).to_pylist() for k in range(4))))
        worded = [x for x in split if not by_chars(x[3])]
        if worded:
            yield Batch(*map(list, zip(*worded))).put_in()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets of (block, id, sentence): the sentences that are like one of an earlier block."""
    for b in batches:
        found = set()
        for bucket in b.column(0).to_pylist():
            said: list[tuple[int, tuple[str, ...], bool]] = []
            for m in sorted(bucket, key=lambda m: (m["blk"], m["id"])):
                words = tuple(m["w"].split(_SEP))
                chars = by_chars(words)
                if any(k < m["blk"] and chars == c and alike(words, o, chars) for k, o, c in said):
                    found.add(m["id"])
                said.append((m["blk"], words, chars))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["id"])


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = ((tuple(x.split(_SEP)), tuple(y.split(_SEP))) for x, y in zip(a, b))
    return pd.Series([by_chars(x) == by_chars(y) and alike(x, y, by_chars(x)) for x, y in pairs], dtype=bool)


def said_like_before(sentences: DataFrame, light: int = LIGHT) -> DataFrame:
    """(id): sentences (id, transcript_id, blk, w) that are like one of an earlier block of their transcript.

    Like sentences of one length share a key: all of a sentence but two of its five parts. Buckets of one key with at most
    ``light`` sentences are compared pair by pair. Larger ones, which stock phrases make, are split by finer keys: all but
    two words, and then an end of each of the two words besides. Only buckets that stay large after that are joined with
    themselves. A word put in is found by an equi-join of sentences with sentences less a word, of which at most one
    side of a key has more than one row.
    """
    texts = keep(sentences.select("id", "transcript_id", "blk", "w").repartition("id"))
    found = []
    at = texts.withColumn("marks", F.array().cast("array<int>"))
    for level in (0, 1, 2):
        keys = at.select("id", "transcript_id", "blk", "w", "marks").mapInArrow(_level(level), KEYS)
        bucket = Window.partitionBy("key")
        sized = keys.select("*", F.count(F.lit(1)).over(bucket).alias("size"), F.min("blk").over(bucket).alias("lo"), F.max("blk").over(bucket).alias("hi"))
        met = keep(sized.where("lo < hi").drop("lo", "hi"))  # read for small and for large buckets
        small = met.where(F.col("size") <= light).select("id", "key").join(texts.select("id", "blk", "w"), "id")
        buckets = small.groupBy("key").agg(F.collect_list(F.struct("blk", "id", "w")).alias("bucket"))
        found.append(buckets.select("bucket").mapInArrow(_compare, "id bigint"))
        large = met.where(F.col("size") > light)
        ends = {0: large.where("mark < 0"), 2: large}.get(level)  # characters have no finer keys
        if ends is not None:
            side = ends.select("id", "key", "blk").join(texts.select("id", "w"), "id")
            before = side.select("key", F.col("blk").alias("blk_before"), F.col("w").alias("before"))
            found.append(side.join(before, "key").where("blk_before < blk").where(_alike("w", "before")).select("id"))
        at = large.where("mark >= 0").groupBy("id").agg(F.collect_set("mark").alias("marks")).join(texts, "id")
    put_in = keep(texts.mapInArrow(_put_in, PUT_IN))
    whole = put_in.where("whole").select("key", F.col("id").alias("id_w"), F.col("blk").alias("blk_w"))
    pairs = put_in.where("not whole").select("key", "id", "blk").join(whole, "key").where("blk <> blk_w").select("id", "id_w", (F.col("blk_w") < F.col("blk")).alias("longer_later"))
    pairs = pairs.join(texts.select("id", "w"), "id").join(texts.select(F.col("id").alias("id_w"), F.col("w").alias("w_w")), "id_w").where(_alike("w", "w_w"))
    found.append(pairs.select(F.when(F.col("longer_later"), F.col("id")).otherwise(F.col("id_w")).alias("id")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a transcript: its compression, and where that is repetitive, its exact counts."""
    for b in batches:
        out: list[tuple] = []
        measured: list[tuple] = []

        def banded() -> Iterator[tuple[list[str], str]]:
            for tid, blk, texts, several in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = "\n".join(texts).encode("utf-8", "replace")
                whole, densest = ratios(raw)
                kind = band(whole, densest)
                measured.append((several, (tid, blk, len(raw), whole, densest, kind)))
                yield texts, kind

        for k, (total, repeated, undecided) in enumerate(shares(banded())):
            several, row = measured[k]
            new = [{"n": n, "k": _digest(w), "w": _SEP.join(w)} for n, w in undecided] if several else []
            out.append((*row, total, repeated, new))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


_ARROW = pa.schema(
    [("transcript_id", pa.int64()), ("blk", pa.int64()), ("bytes", pa.int64()), ("ratio", pa.float64()), ("densest", pa.float64()), ("band", pa.string()),
     ("chars", pa.int64()), ("repeated", pa.int64()), ("undecided", pa.list_(pa.struct([("n", pa.int64()), ("k", pa.binary()), ("w", pa.string())])))]
)
SCHEMA = "transcript_id bigint, blk bigint, bytes bigint, ratio double, densest double, band string, chars bigint, repeated bigint, undecided array<struct<n: bigint, k: binary, w: string>>"


def repetition(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """(transcript_id, bytes, ratio, band, chars, repeated, share): one row per transcript with text.

    ``segments``: (transcript_id, ordinal, segment_id, text). Rows with a repeated segment_id count once; blank texts and
    rows without ids count for nothing; null ordinals are put first, in blocks by their ids. ``share`` is exact. The band of a transcript of several
    blocks is 'repetitive' or 'long'. A sentence of one block that an earlier block said, slips aside, is found by
    equi-joins on the sentence and on its keys, so no task ever sees more than one block. A sentence cut by the border of
    two blocks counts as two.
    """
    rows = segments.where(~is_blank(F.col("text")) & F.col("transcript_id").isNotNull() & F.col("segment_id").isNotNull())
    place = F.when(F.col("ordinal").isNull(), F.expr(f"-4503599627370496L + segment_id div {block}")).otherwise(F.floor(F.col("ordinal") / block))
    rows = rows.select("transcript_id", place.alias("blk"), F.coalesce("ordinal", F.lit(-1)).alias("o"), "segment_id", "text")
    # a block is bounded by its span of the order; copies of a row fall together in the set
    gathered = F.collect_set(F.struct("o", "segment_id", "text")).alias("rows")
    # most transcripts are one block, number 0; only the others hand on what they said
    later = rows.where("blk <> 0")
    several = later.select("transcript_id").distinct().withColumn("several", F.lit(True))
    zeroth = rows.where("blk = 0").groupBy("transcript_id").agg(gathered).withColumn("blk", F.lit(0).cast("bigint")).join(several, "transcript_id", "left")
    blocks = zeroth.unionByName(later.groupBy("transcript_id", "blk").agg(gathered).withColumn("several", F.lit(True)))
    texts = blocks.select("transcript_id", "blk", F.transform(F.array_sort("rows"), lambda r: r["text"]).alias("texts"), "several")
    seen = keep(texts.mapInArrow(_inspect, SCHEMA))  # inspected once, read again for transcripts of several blocks
    # sentences that are new to a block but were said in an earlier one
    new = seen.where(F.size("undecided") > 0).select("transcript_id", "blk", F.explode("undecided").alias("u")).select("transcript_id", "blk", "u.n", "u.k", "u.w")
    # a block has each of its new sentences once; all but the first block's are repeats
    first = keep(new.groupBy("transcript_id", "k").agg(F.sum("n").alias("all"), F.max(F.struct((-F.col("blk")).alias("b"), "n", "w")).alias("first")))
    # what is first said in a block may still be like a sentence of an earlier one
    said = first.select(F.xxhash64("transcript_id", "k").alias("id"), "transcript_id", (-F.col("first.b")).alias("blk"), "first.n", "first.w")
    near = said.select("id", "transcript_id", "n").join(said_like_before(said), "id", "left_semi")
    repeats = first.select("transcript_id", (F.col("all") - F.col("first.n")).alias("n")).unionByName(near.select("transcript_id", "n"))
    across = repeats.groupBy("transcript_id").agg(F.sum("n").alias("across"))
    total = seen.groupBy("transcript_id").agg(
        F.sum("bytes").alias("bytes"), (F.sum("bytes") / F.sum(F.col("bytes") / F.col("ratio"))).alias("ratio"), F.max("densest").alias("densest"),
        F.max(F.col("band") == "repetitive").alias("any"), (F.count(F.lit(1)) > 1).alias("long"), F.sum("chars").alias("chars"), F.sum("repeated").alias("repeated"),
    )
    kind = F.when(F.col("any"), "repetitive").when(F.col("long"), "long").otherwise("plain").alias("band")
    joined = total.join(across, "transcript_id", "left").withColumn("repeated", F.col("repeated") + F.coalesce("across", F.lit(0)))
    return joined.select("transcript_id", "bytes", "ratio", "densest", kind, "chars", "repeated", (F.col("repeated") / F.greatest("chars", F.lit(1))).alias("share"))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Transcripts of which a third or more repeats what they said before."""
    segments = table(spark, directory, "segments").select("transcript_id", "ordinal", "segment_id", "text")
    return repetition(segments).where(F.col("share") >= SHARE).select("transcript_id")
