"""Sentence units across languages and scripts by a pushdown automaton.

The automaton walks over the marks of a text (terminators, quotes, brackets), keeps the open quotes and brackets on a
stack and the levels of lists on another, looks abbreviations up in tries read backwards from their point, and emits code-point offsets. Inside an open
quote or bracket nothing ends; when the outermost one closes after a terminator, what stands before and after decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import is_blank
from cuelake.sources.tables import current_transcripts, distinct_by, table

# Abbreviations that end no sentence (titles, references, measures), lower case, without the last point.
NEVER = """dr prof mr mrs ms st sr sra srta mme mlle m mm fig figs no nos vs approx e.g i.e cf vol ch pp p ed eds gen col capt lt sgt rev hon
nr abb bzw ca evtl ggf inkl sog vgl bsp str z d h u b s hr fr tel mio mrd art pág págs pag aprox p.ex ex núm num fig dra env réf chap vols
см рис стр г гг ул д т е напр проф им акад тыс млн млрд руб др डॉ श्री प्रो د أ ดร นพ พญ ผศ รศ ศ""".split()
# Abbreviations that end a sentence where a capital letter follows.
SOMETIMES = "etc a.m p.m al usw u.s.w jr inc ltd co corp bros т.д т.п др usf u.a u.ä cía ltda s.a q.e.d".split()
# Words before a German ordinal, and month names.
ORDINAL_BEFORE = set("am vom zum im der den dem des die das beim bis seit ab ihr ihre sein seine".split())
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "〈": "〉", "《": "》", "«": "»", "“": "”", "„": "“", "‚": "‘", "‹": "›", "»": "«"}
BRACKETS = set("([{（［【")
CLOSE = set(OPEN.values()) | {'"'}
HARD = set("!?。！？｡؟۔।॥‼⁇⁈⁉")
DOTS = set(".．…")
MARK = regex.compile(r"[.．…!?。！？｡؟۔।॥‼⁇⁈⁉()\[\]{}（）［］【】「」『』〈〉《》«»“”„‚‘‹›\"]|(?<=[\p{Thai}\p{M}\d])\s+(?=\p{Thai}|\p{N}|[\"“«(])|(?<=[\p{Thai}\p{M}])\s+(?=\S)")
STOPS = regex.compile(r"[.．…!?。！？｡؟۔।॥‼⁇⁈⁉]+(?:\s+[.!?]+(?=\s|$))?")
SPACE = regex.compile(r"[\s\p{Z}\x1c-\x1f\x85]+")
TOKEN_BEFORE = regex.compile(r"(?:[\p{L}\p{M}]\s?\.\s?)*[\p{L}\p{M}\p{N}]+$")
THAI = regex.compile(r"\p{Thai}")
WORD = regex.compile(r"\w{1,40}")
NEXT = regex.compile(r"[\s\p{Z}]*[\"“„«»‚‘‹›「『(\[（¿¡'’]*(\S)?")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node["end"] = True
    return root


_NEVER, _SOMETIMES = _trie(NEVER), _trie(SOMETIMES)


def _abbreviated(trie: dict, text: str, at: int) -> bool:
    """A word of the trie ends before ``at`` and begins at a word's start; spaces after inner points are skipped."""
    node, i = trie, at - 1
    found = False
    while i >= 0:
        c = text[i].lower()
        if c not in node:
            if c.isspace() and i and text[i - 1] == "." and "." in node:
                i -= 1
                continue
            break
        node = node[c]
        if node.get("end") and (i == 0 or not (text[i - 1].isalnum() or regex.match(r"\p{M}", text[i - 1]))):
            found = True
        i -= 1
    return found


def _pairs(text: str) -> dict[int, int]:
    """Opening position -> closing position of the quotes and brackets that are closed."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # how often the stack waits for a mark
    pairs: dict[int, int] = {}

    def push(mark: str, i: int) -> None:
        stack.append((mark, i))
        waiting[mark] = waiting.get(mark, 0) + 1

    def pop() -> tuple[str, int]:
        mark, i = stack.pop()
        waiting[mark] -= 1
        return mark, i

    for m in MARK.finditer(text):
        c, i = m[0], m.start()
        if stack and c == stack[-1][0]:
            pairs[pop()[1]] = i
        elif c in OPEN and c != '"':
            push(OPEN[c], i)
        elif waiting.get(c):
            while stack[-1][0] != c:
                pop()
            pairs[pop()[1]] = i
        elif c == '"':
            push('"', i)
    return pairs


_ROMAN = regex.compile(r"[ivx]{1,6}")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10}


def _list_values(token: str) -> list[tuple[str, int, int]]:
    """(kind, level, place) that a list marker may have: numbers, dotted numbers, letters, Roman numerals."""
    parts = token.split(".")
    if all(p.isdigit() and p.isascii() for p in parts):
        return [("number", len(parts), int(parts[-1][:9]))]
    found = []
    if len(token) == 1 and "a" <= token <= "z":
        found.append(("letter", 1, ord(token) - 96))
    if _ROMAN.fullmatch(token):
        values = [_ROMAN_VALUES[c] for c in token]
        found.append(("roman", 1, sum(v if v >= max(values[k:]) else -v for k, v in enumerate(values))))
    return found


class Lists:
    """The levels of lists that are open: each with its kind and the place of its last item."""

    def __init__(self) -> None:
        self.levels: list[tuple[str, int, int]] = []

    def item(self, token: str) -> bool:
        """Whether the token, which begins a line or unit and ends in a point, marks an item; then its level is on top.

        Letters and Roman numerals mark the first item of a new level or the next of an open one; plain and dotted numbers
        always mark one.
        """
        values = _list_values(token)
        for kind, depth, place in values:
            for k in range(len(self.levels) - 1, -1, -1):
                if self.levels[k][:2] == (kind, depth) and (place == self.levels[k][2] + 1 or kind == "number"):
                    self.levels[k:] = [(kind, depth, place)]
                    return True
        for kind, depth, place in values:
            if place == 1 or kind == "number":
                self.levels.append((kind, depth, place))
                return True
        return False


    def fits(self, token: str) -> bool:
        """Whether the token would mark the next item of an open level, or the first one of a level below."""
        return any(place == 1 or (kind, depth, place - 1) in self.levels for kind, depth, place in _list_values(token))


#: A list marker after a sentence.
ITEM = regex.compile(r"\s+([a-z]{1,6}|\d{1,3}(?:\.\d{1,3})*)\.\s")
#: Longest list marker.
_MARKER = 12


def _last_char(text: str, start: int, end: int) -> str:
    """The last character of text[start:end] that is no white space, or an empty string."""
    while end > start:
        end -= 1
        if not text[end].isspace():
            return text[end]
    return ""


def _marker_before(text: str, start: int, i: int) -> str:
    """The token before ``i`` if it begins the unit or a line, else empty."""
    begin = max(start, text.rfind("\n", max(start, i - _MARKER - 1), i) + 1)
    token = text[begin:i].strip() if i - begin <= _MARKER else ""
    return token if token and not any(map(str.isspace, token)) else ""


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets [start, end) of the sentence units of a text, in code points; none for null and blank texts."""
    if not text or not (first := regex.search(r"[^\s\p{Z}\x1c-\x1f\x85]", text)):
        return []
    pairs = _pairs(text)
    found: list[tuple[int, int]] = []
    start, n = first.start(), len(text)
    thai = bool(THAI.search(text))
    lists = Lists()
    until = 0  # marks before this are inside what was dealt with

    def close(end: int) -> None:
        nonlocal start, until
        found.append((start, end))
        m = SPACE.match(text, end)
        start = until = m.end() if m else end

    for m in MARK.finditer(text):
        i = m.start()
        if i < until or i < start:
            continue
        c = m[0]
        if c[0].isspace() or c[0] == "　":
            if thai and _thai_around(text, i, m.end()):
                close(i)
            continue
        if c in pairs_open(c) and i in pairs:
            j = pairs[i]
            until = j + 1
            inner = _last_char(text, i + 1, j)
            closed = inner in HARD or inner in DOTS
            head = _last_char(text, start, i)
            if c in BRACKETS:
                if not head and closed:
                    close(j + 1)
                continue
            if closed and _quote_ends(text, j + 1, head):
                stop = j + 1
                while stop < n and text[stop] in CLOSE and stop not in pairs:
                    stop += 1
                close(stop)
            continue
        if c not in HARD and c not in DOTS:
            continue
        stop = STOPS.match(text, i).end()
        run = text[i:stop]
        end = stop
        while end < n and text[end] in CLOSE and end not in pairs and text[end] != "„":
            end += 1
        if run == "." and end == stop and (token := _marker_before(text, start, i)) and stop < n and text[stop].isspace() and lists.item(token):
            until = stop  # a list marker belongs to what follows it
        elif (lists.levels and (item := ITEM.match(text, end)) and lists.fits(item[1])) or _ends(text, i, run, stop, end, start):
            close(end)
        else:
            until = stop
    if start < n and (rest := text[start:].rstrip()) and (rest := regex.sub(r"[\s\p{Z}\x1c-\x1f\x85]+$", "", rest)):
        found.append((start, start + len(rest)))
    return found


def pairs_open(c: str) -> str:
    return c if c in OPEN or c == '"' else ""


def _thai_around(text: str, i: int, j: int) -> bool:
    """A space within Thai: a line break alone is none, and a space next to other scripts isn't Thai's."""
    if " " not in text[i:j] and "　" not in text[i:j] and "\xa0" not in text[i:j]:
        return False
    return bool(regex.search(r"\p{Thai}[\p{M}\d.,]*$", text[max(0, i - 12) : i])) and bool(regex.match(r"[\"“«(]*[\d.,]*\p{Thai}", text[j : j + 12])) or (
        bool(regex.search(r"\p{Thai}\p{M}*$", text[max(0, i - 4) : i])) and j < len(text)
    ) or (bool(regex.search(r"\p{Thai}[\p{M}]*\d[\d.,]*$", text[max(0, i - 14) : i])) and j < len(text))


def _quote_ends(text: str, at: int, head: str) -> bool:
    """A sentence closes with the quote that closes before ``at``; ``head`` is the last character of what introduces it."""
    m = NEXT.match(text, at)
    follow = m[1] if m else None
    if follow is None:
        return True
    gap = text[at : m.start(1)]
    if follow in ",;:—–-，、；：،." or follow in HARD:
        return False
    if follow.isupper() or follow.isdigit() and gap:
        return True
    if follow.islower():
        return False
    # scripts without case: introduced by a colon or comma it closes the sentence, else the clause goes on
    return bool(head) and head in ":：,，、"


def _word_before(text: str, start: int, end: int) -> str:
    """The word before ``end``, if white space parts them."""
    i = end
    while i > start and text[i - 1].isspace():
        i -= 1
    if i == end:
        return ""
    j = i
    while j > max(start, i - 40) and (text[j - 1].isalnum() or text[j - 1] == "_"):
        j -= 1
    return text[j:i]


def _ends(text: str, i: int, run: str, stop: int, end: int, start: int) -> bool:
    m = NEXT.match(text, end)
    follow = m[1] if m else None
    if follow is None:
        return True
    gap = end < len(text) and (text[end].isspace() or text[end] == "　")
    hard = any(c in HARD for c in run)
    if not hard:
        if "…" in run or run.count(".") + run.count("．") > 1:
            return follow.isupper()
        before = text[i - 1] if i else " "
        if run == "．":
            return not (before.isdigit() and follow.isdigit() and not gap)
        token = TOKEN_BEFORE.search(text, max(start, i - 40), i)
        word = token[0] if token else ""
        if not gap:
            if end > stop:
                return follow.isupper() or not follow.islower()
            if follow.isdigit() or follow in ".,;:!?/@_-" or not (follow.isalpha() or follow in "\"“„«「(¿¡"):
                return False
            if _abbreviated(_NEVER, text, i) or _abbreviated(_SOMETIMES, text, i):
                return False
            if follow.islower():
                return False
            if follow.isupper():
                return len(word) > 1 and (before.islower() or before.isdigit() or not before.isalnum()) or len(word) > 3
            return before.isalpha() and not before.isascii() or bool(regex.match(r"\p{M}", before))
        if _abbreviated(_SOMETIMES, text, i):
            return follow.isupper()
        if _abbreviated(_NEVER, text, i):
            return False
        if len(word) == 1 and word.isalpha() and word.isupper():
            return False  # an initial
        if word.isdigit() and len(word) <= 2 and follow.isupper():
            nxt = WORD.match(text, m.start(1))
            if (nxt and nxt[0].lower() in MONTHS) or _word_before(text, start, i - len(word)).lower() in ORDINAL_BEFORE:
                return False
        if follow.islower():
            return False
        return True
    if not gap and end == stop:
        if run[-1] in "!?" and (follow.islower() or follow.isdigit() or follow in "=&/"):
            return False
        if follow in ",，、;":
            return False
    if gap and run[-1] in "!?" and follow in ",;—–":
        return False
    return True


SCHEMA = "segment_id bigint, start_char int, end_char int"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, starts, ends = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for s, e in sentences(text):
                ids.append(i)
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["segment_id", "start_char", "end_char"])


def sentence_units(texts: DataFrame) -> DataFrame:
    """(segment_id, start_char, end_char) of ``texts`` (segment_id, text); narrow: no row is moved.

    Null, empty and blank texts have no unit; very long texts are walked mark by mark in one pass; repeated rows give
    repeated units.
    """
    return texts.select("segment_id", "text").mapInArrow(_emit, SCHEMA)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """The sentences of all segments of transcripts with method 'local-captions'."""
    t = current_transcripts(spark, directory).where("method = 'local-captions'").select("transcript_id")
    s = table(spark, directory, "segments").where(~is_blank(F.col("text"))).join(t, "transcript_id", "left_semi")
    return sentence_units(distinct_by(s, "segment_id", "text"))
