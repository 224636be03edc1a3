"""What characters look like: compatibility forms, invisible characters, look-alike letters of other scripts."""

from __future__ import annotations

import unicodedata
from collections import Counter

import regex

# Letters of the Cyrillic and Greek scripts and the Latin letter each looks like in print.
CYRILLIC_LATIN = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХУІЈЅԌԚԜ", "aeopcyxijsdhlqwABEKMHOPCTXYIJSGQW"))
GREEK_LATIN = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovABEZHIKMNOPTYXcj"))

#: (script, script) -> letter -> look-alike in the second script.
PEERS: dict[tuple[str, str], dict[str, str]] = {("C", "L"): CYRILLIC_LATIN, ("G", "L"): GREEK_LATIN}
PEERS[("L", "C")] = {v: k for k, v in CYRILLIC_LATIN.items()}
PEERS[("L", "G")] = {v: k for k, v in GREEK_LATIN.items()}
PEERS[("C", "G")] = {c: PEERS[("L", "G")][x] for c, x in CYRILLIC_LATIN.items() if x in PEERS[("L", "G")]}
PEERS[("G", "C")] = {g: PEERS[("L", "C")][x] for g, x in GREEK_LATIN.items() if x in PEERS[("L", "C")]}

TO_LATIN = str.maketrans({**CYRILLIC_LATIN, **GREEK_LATIN})

INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}\p{Cc}--[\t-\r\x1c-\x1f\x85]]+", regex.V1)
SPACES = regex.compile(r"[\s\p{Z}\x1c-\x1f\x85]+")
HYPHENS = regex.compile("[‐‑]")
PLAIN = regex.compile(r"[!-~]+(?: [!-~]+)*")
#: Words of letters, marks and digits.
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def printed(text: str) -> str:
    """The text as it looks in print: compatibility forms composed, invisible characters gone, white space as one space."""
    if PLAIN.fullmatch(text):
        return text
    shown = INVISIBLE.sub("", text)
    if not unicodedata.is_normalized("NFKC", shown):
        shown = unicodedata.normalize("NFKC", shown)
    return HYPHENS.sub("-", SPACES.sub(" ", shown)).strip()


def script(ch: str) -> str:
    """L, C, G for Latin, Cyrillic and Greek letters, else empty."""
    o = ord(ch)
    if o < 0x80:
        return "L" if ch.isalpha() else ""
    if 0xC0 <= o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L" if ch.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if ch.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "C"
    return ""


_FOREIGN = regex.compile(r"[Ͱ-ϿЀ-ԯ]")
_LATIN = regex.compile(r"[A-Za-z\u00c0-\u024f]")
_GREEK, _CYRILLIC = regex.compile(r"[\u0370-\u03ff]"), regex.compile(r"[\u0400-\u052f]")


def may_mix(text: str) -> bool:
    """False for texts that can't hold a look-alike of another script: a cheap exact test."""
    if not _FOREIGN.search(text):
        return False
    return bool(_LATIN.search(text)) or bool(_GREEK.search(text) and _CYRILLIC.search(text))


def own_letters(token: str) -> dict[str, int]:
    """Letters per script that have no look-alike in any other script present."""
    scripts = [script(c) for c in token]
    present = {s for s in scripts if s}
    count: dict[str, int] = {}
    for c, s in zip(token, scripts):
        if s and not any(c in PEERS.get((s, o), ()) for o in present - {s}):
            count[s] = count.get(s, 0) + 1
    return count


def substitute(token: str, target: str) -> str | None:
    """The token with every letter in script ``target``; None where a letter has no look-alike there."""
    out = []
    for c in token:
        s = script(c)
        if s and s != target:
            c = PEERS.get((s, target), {}).get(c)
            if c is None:
                return None
        out.append(c)
    return "".join(out)


def proposals(token: str, around: dict[str, int]) -> str | None:
    """The token in its dominant script, or None if nothing is to be repaired.

    The dominant script is that of the letters which have no look-alike in the other scripts of the token; without such
    letters it is the dominant script of the text ``around``.
    """
    present = {s for s in map(script, token) if s}
    if not present or (len(present) == 1 and (not around or around.get(next(iter(present)), 0) == max(around.values()))):
        return None
    own = own_letters(token) if len(present) > 1 else {}
    for target in ([max(own, key=lambda s: (own[s], s))] if own else sorted(around, key=lambda s: (-around[s], s))):
        if {target} == present:
            return None
        if (fixed := substitute(token, target)) is not None:
            return fixed
    return None


def dominant(text: str) -> dict[str, int]:
    """Letters per script over a text that only that script has; ties of look-alikes count for nothing."""
    count: dict[str, int] = {}
    for c, n in Counter(text).items():
        if (s := script(c)) and not any(c in PEERS[(s, o)] for o in "LCG" if o != s):
            count[s] = count.get(s, 0) + n
    return count
