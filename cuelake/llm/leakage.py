"""Evaluation texts in training documents by greedy string tiling.

The items are tokenised once, with an index of their own words and of all their short token runs. A document meets the
items of which it has own words, and of those it meets the places where it shares token runs (seeds); places of one item
that lie close together are a passage. A passage is tiled: running Karp-Rabin finds the longest common runs of unmarked
tokens, they are marked from the longest on, never overlapping, and the search goes on with shorter runs. What the tiles
cover in any order is the coverage, so reordered passages count. For passages in the item's order the heaviest chain of
tiles is kept and what stands between two of its tiles is aligned word by word, so that slips of characters, insertions
and exchanged words don't end a passage.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import glyphs
from cuelake.llm.events import slips
from cuelake.session import spread
from cuelake.sources.tables import table

#: Tokens of a seed, and of the shortest tile.
SEED, TILE = 3, 2
#: Share of an item's characters that a document must hold, and of the item's names and numbers in the part it holds.
COVERED, OWN = 0.5, 0.5
#: Least product of the two: who holds just half of an item must hold two thirds of its own words there, else it is the
#: same phrasing with other facts.
EVIDENCE = 1 / 3
#: Share of an item's tokens that must stand in seeds of a passage for it to be tiled: far below COVERED.
SEEDED = 0.15
#: Share of an item's own words that must stand in the document for its seeds to be looked at: far below OWN x COVERED.
PRESENT = 0.15
#: Characters of items that one task holds at once; more items are sought block by block.
MOST_ITEM_CHARS = 50_000_000
#: Base and modulus (a Mersenne prime) of the rolling hash.
_BASE, _PRIME = 1_000_003, (1 << 61) - 1

_TIMES = regex.compile(
    r"^\s*\d+\s*$(?=\s*^\s*\d{1,2}:\d\d)|\[?\s*\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?\s*(?:-->|-|–)\s*\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?\s*\]?|<[^<>]{1,60}>", regex.M
)
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|\p{N}+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{N}])[\p{L}\p{M}])+|[\p{L}\p{M}\p{N}]+")
#: Line ends inside text of scripts without spaces.
_BROKEN = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}，。、])\s+(?=[\p{Han}\p{Hiragana}\p{Katakana}\p{N}])|(?<=[\p{Han}\p{Hiragana}\p{Katakana}]\p{N}{1,6})\s+(?=[\p{N}\p{Han}])")
_LOOKALIKE = regex.compile(r"[Ͱ-ϿЀ-ԯ]")


#: What the plain pattern of words can't part: marks, numbers that aren't decimal, scripts without word spaces.
_SPECIAL = regex.compile(r"[\p{M}\p{No}\p{Nl}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_PLAIN = re.compile(r"\d+|[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Words, numbers and single characters of scripts without spaces, as they look in print and without cue times."""
    shown = text.replace("\r", "\n")
    if ":" in shown or "<" in shown:
        shown = _TIMES.sub(" ", shown)
    if not shown.isascii():
        shown = glyphs.INVISIBLE.sub("", shown)
        if not unicodedata.is_normalized("NFKC", shown):
            shown = unicodedata.normalize("NFKC", shown)
        if _LOOKALIKE.search(shown):
            around = glyphs.dominant(shown)
            if around and max(around, key=lambda s: around[s]) == "L":
                shown = shown.translate(glyphs.TO_LATIN)
            elif glyphs.may_mix(shown):
                shown = glyphs.WORDS.sub(lambda m: glyphs.proposals(m[0], around) or m[0], shown)
        if _SPECIAL.search(shown):
            return _TOKEN.findall(_BROKEN.sub("", shown.casefold()))
    elif any(c < " " for c in set(shown)):
        shown = glyphs.INVISIBLE.sub("", shown)
    return _PLAIN.findall(shown.casefold())


def karp_rabin(a: list[int], b: list[int], free_a: bytearray, free_b: bytearray, s: int) -> list[tuple[int, int, int]]:
    """All maximal common runs (place in a, place in b, length) of at least ``s`` free tokens, by running hashes.

    Only the start of a run is reported, not every window of it. Negative tokens of ``b`` match nothing.
    """
    top = pow(_BASE, s - 1, _PRIME)
    windows: dict[int, list[int]] = {}
    h = run = 0
    for i, x in enumerate(a):
        if not free_a[i]:
            h = run = 0
            continue
        if run >= s:
            h -= a[i - s] * top
        h = (h * _BASE + x) % _PRIME
        run += 1
        if run >= s:
            windows.setdefault(h, []).append(i - s + 1)
    found = []
    h = run = 0
    for j, x in enumerate(b):
        if x < 0 or not free_b[j]:
            h = run = 0
            continue
        if run >= s:
            h -= b[j - s] * top
        h = (h * _BASE + x) % _PRIME
        run += 1
        if run < s or h not in windows:
            continue
        q = j - s + 1
        for p in windows[h]:
            if p and q and free_a[p - 1] and free_b[q - 1] and a[p - 1] == b[q - 1]:
                continue  # inside a run that began before
            if a[p : p + s] != b[q : q + s]:
                continue
            n = s
            while p + n < len(a) and q + n < len(b) and free_a[p + n] and free_b[q + n] and a[p + n] == b[q + n]:
                n += 1
            found.append((p, q, n))
    return found


def tiles(a: list[int], b: list[int], least: int = TILE, longest: int = 16) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping common runs (place in a, place in b, length), longest first.

    The length searched for halves from round to round and jumps up where a run turns out much longer. Of equal runs the
    first in ``a``, then in ``b``, is marked. Memory is linear in the texts and the runs of one round. ``longest``: the
    length that is searched for first.
    """
    free_a, free_b = bytearray(b"\x01") * len(a), bytearray(b"\x01") * len(b)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(longest, len(a), len(b)))
    while True:
        found = karp_rabin(a, b, free_a, free_b, s)
        most = max((n for _, _, n in found), default=0)
        if most > 2 * s:
            s = most
            found = [f for f in found if f[2] >= s]
        again = False
        for p, q, n in sorted(found, key=lambda f: (-f[2], f[0], f[1])):
            if free_a.find(0, p, p + n) < 0 and free_b.find(0, q, q + n) < 0:
                free_a[p : p + n] = free_b[q : q + n] = bytes(n)
                out.append((p, q, n))
            else:
                again = True  # what is left of this run may still be long enough
        if again and most > s:
            continue
        if s == least:
            if not again:
                return out
            continue
        s = max(least, s // 2)


def in_order(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The heaviest chain of tiles that keeps the item's order, by a tree of maxima over places in the document."""
    found = sorted(found)
    rank = {q: k + 1 for k, q in enumerate(sorted(q for _, q, _ in found))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(found) + 1)
    back: list[int] = []
    best = (0, -1)
    for k, (_, q, n) in enumerate(found):
        i, before = rank[q] - 1, (0, -1)
        while i > 0:
            before = max(before, tree[i])
            i &= i - 1
        back.append(before[1])
        here = (before[0] + n, k)
        best = max(best, here)
        i = rank[q]
        while i < len(tree):
            tree[i] = max(tree[i], here)
            i += i & -i
    chain, k = [], best[1]
    while k >= 0:
        chain.append(found[k])
        k = back[k]
    return chain[::-1]


@lru_cache(1 << 18)
def same_word(w: str, d: str) -> bool:
    """Equal, or a word of four letters or more that differs by slips of characters, not at both ends; numbers must be equal."""
    return w == d or (len(w) > 3 and (w[0] == d[0] or w[-1] == d[-1]) and not w[0].isdigit() and abs(len(w) - len(d)) < 3 and slips(w, d) < 3)


def by_ends(words: Iterable[str]) -> dict[tuple[int, str], list[str]]:
    """Words by their first and by their last character: a slip leaves one of them."""
    out: dict[tuple[int, str], list[str]] = {}
    for d in words:
        if len(d) > 1:
            out.setdefault((0, d[0]), []).append(d)
            out.setdefault((1, d[-1]), []).append(d)
    return out


def like(w: str, ended: dict[tuple[int, str], list[str]]) -> set[str]:
    """The words that are ``w`` but for slips."""
    n = len(w)
    return {d for k in ((0, w[0]), (1, w[-1])) for d in ended.get(k, ()) if -3 < n - len(d) < 3 and same_word(w, d)}


def aligned(words: list[str], others: list[str]) -> list[int]:
    """Places of ``words`` in the longest common subsequence with ``others``, slips aside."""
    where: dict[str, list[int]] = {}
    for j, d in enumerate(others):
        where.setdefault(d, []).append(j)
    ended = by_ends(where)
    ends: list[int] = []  # of chains of each length, the least end in others
    chains: list[tuple[int, tuple | None]] = []
    for k, w in enumerate(words):
        if len(w) > 3:
            met = sorted((j for d in like(w, ended) | {w} for j in where.get(d, ())), reverse=True)
        else:
            met = where.get(w, [])[::-1]
        for j in met:
            n = bisect_left(ends, j)
            link = (k, chains[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[n]:
                ends[n], chains[n] = j, link
    out, link = [], chains[-1] if chains else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


class Items:
    """The tokenised items, their seeds, and what is their own."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept = [(i, t) for i, text in items if text and (t := tokens(text))]
        self.ids = [i for i, _ in kept]
        self.token: dict[str, int] = {}
        self.texts = [t for _, t in kept]
        self.codes = [[self.token.setdefault(t, len(self.token)) for t in ts] for ts in self.texts]
        having = np.zeros(len(self.token), np.int64)
        for c in self.codes:
            having[list(set(c))] += 1
        many = max(2, len(kept) // 50)
        self.own = [np.array([t[0].isdigit() or (having[c] <= many and len(t) > 1) for t, c in zip(ts, cs)], bool) for ts, cs in zip(self.texts, self.codes)]
        self.size = [np.array([len(t) for t in ts]) for ts in self.texts]
        self.seeds = [np.unique(runs(np.array(c, np.int64), min(SEED, len(c)))) for c in self.codes]
        rare = [np.unique(np.array(c, np.int64)[o]) for c, o in zip(self.codes, self.own)]
        self.own_runs = [_own_in_runs(c, o, x) for c, o, x in zip(self.codes, self.own, self.seeds)]
        # postings of seeds: items by seed
        of_seed = np.repeat(np.arange(len(kept)), [len(x) for x in self.seeds])
        hashes = np.concatenate([*self.seeds, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.seed_items = of_seed[order]
        self.seed_keys, first = np.unique(hashes[order], return_index=True)
        self.seed_offsets = np.r_[first, len(hashes)]
        self.seed_lengths = sorted({min(SEED, len(c)) for c in self.codes})
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.places = [np.flatnonzero(o).tolist() for o in self.own]
        self.wanted = np.array([max(1, int(PRESENT * len(r))) if len(r) else 0 for r in rare], np.int64)
        self.least_own = [_least_own(o, z) for o, z in zip(self.own, self.size)]
        # postings of own words: items by code
        codes = np.concatenate([*rare, np.empty(0, np.int64)])
        of = np.repeat(np.arange(len(kept)), [len(r) for r in rare])
        order = np.argsort(codes, kind="stable")
        self.posted = of[order]
        self.offsets = np.searchsorted(codes[order], np.arange(len(self.token) + 1))

    def met(self, present: np.ndarray) -> list[int]:
        """Items of whose own words enough are among the codes ``present``; items without own words always are."""
        first, n = self.offsets[present], self.offsets[present + 1] - self.offsets[present]
        places = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.flatnonzero(np.bincount(self.posted[places], minlength=len(self.ids)) >= self.wanted)

    def seeded(self, met: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Those of the items ``met`` that have enough of their seeds among the runs ``hashed``; short items stay.

        Postings of common seeds are only read where that is less than looking the items' own seeds up.
        """
        keys = np.unique(hashed)
        at = np.minimum(np.searchsorted(self.seed_keys, keys), len(self.seed_keys) - 1)
        at = at[self.seed_keys[at] == keys]
        first, n = self.seed_offsets[at], self.seed_offsets[at + 1] - self.seed_offsets[at]
        if n.sum() > 8 * len(met) * max(1, len(keys)):
            return met
        places = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        count = np.bincount(self.seed_items[places], minlength=len(self.ids))[met]
        return met[(count >= SEEDED * self.lengths[met]) | (self.lengths[met] < SEED)]


def _least_own(own: np.ndarray, size: np.ndarray) -> int:
    """Fewest own words of any stretch of the item that is COVERED of it: fewer than OWN of these can't be a case."""
    total, counted = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(own)]
    ends = np.searchsorted(total, total[:-1] + COVERED * total[-1] - 1e-9)
    ok = ends <= len(size)
    return int((counted[ends[ok]] - counted[:-1][ok]).min()) if ok.any() else 0


def _own_in_runs(codes: list[int], own: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """How many own words each seed of an item holds."""
    n = min(SEED, len(codes))
    count = np.convolve(own.astype(np.int64), np.ones(n, np.int64), "valid")
    out = np.zeros(len(seeds), np.int64)
    np.maximum.at(out, np.searchsorted(seeds, runs(np.array(codes, np.int64), n)), count)
    return out


def runs(codes: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all runs of ``n`` tokens; 0 where a token is unknown."""
    if len(codes) < n or not n:
        return np.empty(0, np.uint64)
    h, bad = np.zeros(len(codes) - n + 1, np.uint64), np.zeros(len(codes) - n + 1, bool)
    for k in range(n):
        part = codes[k : k + len(h)]
        h = (h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)) ^ (h >> np.uint64(29))
        bad |= part < 0
    h[bad] = 0
    return h


def dense(held: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretch of an item in which what is held outweighs half of what isn't by most: stray words far from it are none
    of the passage."""
    total = np.r_[0.0, np.cumsum(np.where(held, size, -size / 2))]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    out = np.zeros(len(held), bool)
    out[start:end] = True
    return out


def judge(items: Items, n: int, words: list[str], codes: list[int], longest: int = 16) -> tuple[float, float, float, float]:
    """(covered, covered_own, ordered, own) of item ``n`` in a passage: the share of the item in tiles of any order, the
    share held in the item's order with words between tiles aligned, and the share of its own words within either."""
    item, texts, size = items.codes[n], items.texts[n], items.size[n]
    found = tiles(item, codes, min(TILE, len(item)), longest)
    tiled, held = np.zeros(len(item), bool), np.zeros(len(item), bool)
    for p, _, l in found:
        tiled[p : p + l] = True
    chain = in_order(found)
    for p, _, l in chain:
        held[p : p + l] = True
    stops = [(0, 0, 0), *chain, (len(item), len(codes), 0)]
    for k, ((p, q, l), (p2, q2, _)) in enumerate(zip(stops, stops[1:])):
        i, j, stop_i, stop_j = p + l, q + l, p2, q2
        if k == 0:  # before the first tile and behind the last one a passage is as long as the item
            j = max(0, stop_j - (stop_i - i) - 4)
        if k == len(chain):
            stop_j = min(stop_j, j + (stop_i - i) + 4)
        if chain and i < stop_i and j < stop_j:
            held[[i + x for x in aligned(texts[i:stop_i], words[j:stop_j])]] = True
    total = size.sum()

    def own_share(part: np.ndarray) -> float:
        place = np.flatnonzero(part)
        if not len(place):
            return 0.0
        own = items.own[n][place[0] : place[-1] + 1]
        return float((part[place[0] : place[-1] + 1] & own).sum() / own.sum()) if own.any() else 1.0

    held &= dense(held, size)
    tiled |= held
    return float(size[tiled].sum() / total), own_share(tiled), float(size[held].sum() / total), own_share(held)


def passages(places: np.ndarray, weight: np.ndarray, room: int) -> list[int]:
    """Seeds at which passages of ``room`` tokens begin: the heaviest first, then the next heaviest that begins at least
    half a passage away from all before it, until every seed is near one."""
    total = np.r_[0, np.cumsum(weight)]
    held = total[np.searchsorted(places, places + room, "right")] - total[:-1]
    order = np.lexsort((places, -held))
    near = np.zeros(len(places), bool)
    out = []
    for k in order.tolist():
        if not near[k]:
            out.append(int(places[k]))
            near |= np.abs(places - places[k]) < room // 2
            if near.all():
                break
    return out


def is_case(held: float, own_held: float, covered: float = COVERED, own: float = OWN) -> bool:
    return held >= covered and own_held >= own and held * own_held >= EVIDENCE * (covered / COVERED) * (own / OWN)


def leaks(items: Items, text: str | None, pruned: bool = True) -> list[tuple[int, float, float, float, float]]:
    """(item number, covered, covered_own, ordered, own) of the items that a document may hold: of each item its best passage.

    The caller applies thresholds. Without ``pruned`` every passage with a seed of any item is tiled.
    """
    if not text or not items.ids:
        return []
    words = tokens(text)
    get = items.token.get
    codes = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
    present = np.unique(codes[codes >= 0])
    if not len(present):
        return []
    hashed = {n: runs(codes, n) for n in items.seed_lengths}
    candidates = np.arange(len(items.ids))
    if pruned and len(candidates := items.met(present)):
        candidates = items.seeded(candidates, hashed[SEED]) if SEED in hashed else candidates
    out = []
    for n in candidates.tolist():
        length = len(items.codes[n])
        h = hashed[min(SEED, length)]
        seeds = items.seeds[n]
        at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
        places = np.flatnonzero((seeds[at] == h) & (h > 0))
        if not len(places) or (pruned and len(places) < SEEDED * length):
            continue
        room = int(length * 1.6) + 12
        best: tuple[float, ...] | None = None
        own = items.own_runs[n][at[places]]
        starts = passages(places, np.ones(len(places), np.int64), room)
        if own.any():
            starts += passages(places, own, room)
        for start in sorted(set(starts)):
            inside = places[(places >= start) & (places <= start + room)]
            if pruned and len(np.unique(h[inside])) < SEEDED * length:
                continue
            lo, hi = max(0, start - length // 2 - 4), min(len(words), start + room + 4)
            part = codes[lo:hi].tolist()
            if pruned and not _owns_enough(items, n, words[lo:hi], part):
                continue
            # a common run is as many neighbouring seeds, and what the last one holds besides
            along = np.diff(np.r_[-1, np.flatnonzero(np.diff(inside) != 1), len(inside) - 1]).max()
            r = judge(items, n, words[lo:hi], part, int(along) + SEED - 1)
            best = max(best or r, r, key=lambda x: (x[3] >= OWN, x[2], x[0]))
        if best:
            out.append((n, *best))
    return out


def _owns_enough(items: Items, n: int, words: list[str], codes: list[int]) -> bool:
    """As many of the item's own words stand in the passage, slips aside, as any case has."""
    need = OWN * items.least_own[n]
    there, texts, item = set(codes), items.texts[n], items.codes[n]
    own = items.places[n]
    count = sum(item[k] in there for k in own)
    if count >= need:
        return True
    left = [texts[k] for k in own if item[k] not in there and len(texts[k]) > 3 and not texts[k][0].isdigit()]
    if count + len(left) < need:
        return False
    ended = by_ends(set(words))
    return count + sum(bool(like(w, ended)) for w in left) >= need


def blocks_of_items(items: DataFrame, most: int = MOST_ITEM_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), distinct and in order, in lists of at most ``most`` characters (or one item)."""
    block, chars = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and chars + len(r.text) > most:
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    if block:
        yield block


def leaked_items(documents: DataFrame, items: list[tuple[int, str]], covered: float = COVERED, own: float = OWN, ordered: bool = True) -> DataFrame:
    """(doc_id, item_id, covered, covered_own, ordered, own): documents that hold at least the given shares of an item,
    and of the two together what EVIDENCE asks for.

    ``ordered``: the share must be held in the item's order, else tiles of any order count. Each document is read
    once, whole, and moved only if there are too few input splits for all cores; every copy is judged. Null, empty and blank texts hold nothing. ``items`` travel with
    the task, so a caller with very many passes them in blocks (``blocks_of_items``); more than MOST_ITEM_CHARS characters
    in several items at once are an error.
    """
    if len(items) > 1 and sum(len(t or "") for _, t in items) > MOST_ITEM_CHARS:
        raise ValueError("too many items to send to every task; pass them in several calls")
    shared = documents.sparkSession.sparkContext.broadcast(Items(sorted(items)))
    place = 3 if ordered else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows = [(d, known.ids[r[0]], *r[1:]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in leaks(known, t) if is_case(r[place], r[place + 1], covered, own)]
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "covered", "covered_own", "ordered", "own"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, item_id bigint, covered double, covered_own double, ordered double, own double")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that hold evaluation items in their order, over all documents and all items."""
    documents = table(spark, directory, "documents")
    found = documents.where(F.lit(False)).select("doc_id", F.lit(0).cast("bigint").alias("item_id"))
    for block in blocks_of_items(table(spark, directory, "eval_items")):
        found = found.unionByName(leaked_items(documents, block).select("doc_id", "item_id"))
    return found.distinct()
