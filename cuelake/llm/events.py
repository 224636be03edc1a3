"""Runs of equal or nearly equal consecutive events.

Every event is compared with its predecessor by a lag window; changes are flagged, flags are summed into run numbers and
runs are aggregated. A sequence is cut into blocks of its order so that no task holds a long sequence: the last event of
a block is handed to the next one, and run numbers continue by a prefix sum over the (few) blocks.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cuelake.functions.text import is_blank
from cuelake.llm import glyphs
from cuelake.session import keep
from cuelake.sources.tables import table

#: Order values (ordinals) that one block spans.
BLOCK = 4096

# Characters that recognisers take for each other, as one representative.
CONFUSED = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "8": "b", "e": "c"})
#: What texts without words may differ in.
_SIGNS = glyphs.regex.compile(r"[\p{P}\s\p{Z}]+")


@lru_cache(4096)
def words_of(text: str) -> list[str]:
    shown = glyphs.printed(text).casefold()
    if glyphs._FOREIGN.search(shown):
        shown = shown.translate(glyphs.TO_LATIN)
    return glyphs.WORDS.findall(shown)


def spaceless(word: str) -> bool:
    """Scripts that are written without spaces between words: Han, kana, Thai."""
    return any("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "฀" <= c <= "๿" for c in word)


def distance(a: str, b: str, most: int) -> int:
    """Edits with transpositions of neighbours, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    p, q, i = len(a), len(b), 0
    while p and q and a[p - 1] == b[q - 1]:
        p, q = p - 1, q - 1
    while i < p and i < q and a[i] == b[i]:
        i += 1
    a, b = a[i:p], b[i:q]
    if len(a) <= 1 and len(b) <= 1 or not a or not b:
        return min(max(len(a), len(b)), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, two = row, [i], before
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        before = last
        if min(row) > most and min(before) > most:
            return most + 1
    return row[-1]


def slips(a: str, b: str) -> int:
    """Slips of single characters that make one word the other; a large number for another word or number."""
    if a == b:
        return 0
    if a.isdigit() or b.isdigit():
        return 99
    x, y = a.translate(CONFUSED).replace("rn", "m"), b.translate(CONFUSED).replace("rn", "m")
    if x == y:
        return 1
    longest = max(len(a), len(b))
    if longest <= 2:
        return 1 if len(a) != len(b) and (a in b or b in a) and longest == 2 and a[:1] == b[:1] else 99
    d = distance(x, y, 2)
    return d if d <= (1 if longest <= 4 else 2) else 99


def unspaced_same(a: str, b: str) -> bool:
    """Texts without word spaces: equal but for a few stray characters, none next to another, and equal numbers."""
    if a == b:
        return True
    if sum(c.isdigit() for c in a) != sum(c.isdigit() for c in b) or [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return False
    most = 2 + min(len(a), len(b)) // 20
    if abs(len(a) - len(b)) > most or max(len(a), len(b)) < 4:
        return False
    # walk along the common parts; each difference may take one character on either side, or two swapped ones
    i = j = used = 0
    run = 4
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j, run = i + 1, j + 1, run + 1
            continue
        used += 1
        if used > most or (run < 2 and used > 1):
            return False
        run = 0
        ahead = 3
        options = []
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2)):
            p, q = a[i + di : i + di + ahead], b[j + dj : j + dj + ahead]
            if i + di > len(a) or j + dj > len(b) or ((di, dj) == (2, 2) and a[i : i + 2] != b[j : j + 2][::-1]):
                continue
            n = 0
            while n < min(len(p), len(q)) and p[n] == q[n]:
                n += 1
            rest = n == len(p) == len(q)
            options.append((n + 10 * rest, -di - dj, di, dj))
        if not options:
            return False
        _, _, di, dj = max(options)
        i, j = i + di, j + dj
    return True


def nearly_same(a: str, b: str) -> bool:
    """Equal words and numbers but for letter case, punctuation, spacing, look-alikes and stray slips of characters."""
    if a == b:
        return True
    x, y = words_of(a), words_of(b)
    if x == y:
        return bool(x) or _SIGNS.sub("", glyphs.printed(a)) == _SIGNS.sub("", glyphs.printed(b))
    if not x or not y:
        return False
    if any(map(spaceless, x)) and any(map(spaceless, y)):
        numbers = [w for w in glyphs.regex.findall(r"\p{N}+", " ".join(x))], [w for w in glyphs.regex.findall(r"\p{N}+", " ".join(y))]
        return numbers[0] == numbers[1] and unspaced_same("".join(x), "".join(y))
    if abs(len(x) - len(y)) > 2 + len(x) // 10:
        return False
    budget = 2 + min(len(x), len(y)) // 4
    i = j = 0
    while i < len(x) and j < len(y):
        s = slips(x[i], y[j])
        if s <= budget and s < 99:
            budget -= s
            i, j = i + 1, j + 1
        elif i + 1 < len(x) and not x[i + 1].isdigit() and not x[i].isdigit() and x[i] + x[i + 1] == y[j]:
            i, j = i + 2, j + 1
        elif j + 1 < len(y) and not y[j + 1].isdigit() and not y[j].isdigit() and y[j] + y[j + 1] == x[i]:
            i, j = i + 1, j + 2
        else:
            return False
    return i == len(x) and j == len(y)


@F.pandas_udf(BooleanType())
def _nearly(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else nearly_same(p, q) for p, q in zip(a, b)], dtype=object)


def collapse_runs(rows: DataFrame, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """(stream, key, first_id, last_id, n, start_seconds, end_seconds, text): every run as one event; text is its first.

    ``rows``: (stream, key, ord, id, text, start_seconds, end_seconds). Blank texts are skipped and break no run; rows
    without key, order or id belong to no sequence. Rows with a repeated id count once. Equal orders are put by id. Null
    times are skipped; the duration of a run is its end less its start, null if no time is known.
    """
    kept = rows.where(~is_blank(F.col("text")) & F.col("key").isNotNull() & F.col("ord").isNotNull() & F.col("id").isNotNull())
    kept = kept.select("stream", "key", "ord", "id", "text", "start_seconds", "end_seconds", F.floor(F.col("ord") / block).alias("blk"))
    blocks = kept.repartition("stream", "key", "blk")
    here = Window.partitionBy("stream", "key", "blk").orderBy("ord", "id")
    over = Window.partitionBy("stream", "key").orderBy("blk")
    once = blocks.withColumn("same_id", F.lag("id").over(here) == F.col("id")).where("same_id is null or not same_id").drop("same_id")
    # the last text of the block before reaches over the border
    edges = once.withColumn("next", F.lead("id").over(here)).where("next is null").select("stream", "key", "blk", F.lag("text").over(over).alias("handed"))
    lagged = once.withColumn("before", F.lag("text").over(here)).join(edges.where("handed is not null"), ["stream", "key", "blk"], "left")
    lagged = lagged.withColumn("before", F.coalesce("before", F.when(F.lag("id").over(here).isNull(), F.col("handed")))).drop("handed")
    a, b = F.col("before"), F.col("text")
    # lengths tell nothing before the printed forms are known: marks, invisible characters and decomposed letters count too
    near = a != b
    judged = lagged.withColumn("near", _nearly(F.when(near, a), F.when(near, b)))
    flagged = judged.withColumn("change", F.when((a == b) | F.coalesce("near", F.lit(False)), 0).otherwise(1))
    local = flagged.withColumn("run", F.sum("change").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.struct("ord", "id"), F.struct("ord", "id")
    pieces = local.groupBy("stream", "key", "blk", "run").agg(
        F.min(first).alias("first"), F.max(last).alias("last"), F.count(F.lit(1)).alias("n"),
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.min_by("text", first).alias("text"),
    )
    ends = Window.partitionBy("stream", "key", "blk")
    # the first piece of a block may continue the run before (its number is 0), the last may go on in the next block
    pieces = pieces.withColumn("border", (F.col("run") == 0) | (F.col("run") == F.max("run").over(ends)))
    if not with_text:
        pieces = pieces.drop("text")
    pieces = keep(pieces)  # judged once, read twice
    inner = pieces.where("not border")
    at_border = Window.partitionBy("stream", "key").orderBy("blk", "run").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.where("border").withColumn("number", F.sum((F.col("run") != 0).cast("int")).over(at_border))
    joined = numbered.groupBy("stream", "key", "number").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"),
        *([F.min_by("text", "first").alias("text")] if with_text else []),
    )
    columns = ["stream", "key", "first", "last", "n", "start_seconds", "end_seconds", *(["text"] if with_text else [])]
    whole = inner.select(*columns).unionByName(joined.select(*columns))
    return whole.select("stream", "key", F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"), *columns[4:])


def event_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Segments per transcript and frame observations (below the overlay zone) per source, as one table of events."""
    segments = table(spark, directory, "segments").select(
        F.lit("segments").alias("stream"), F.col("transcript_id").alias("key"), F.col("ordinal").alias("ord"), F.col("segment_id").alias("id"), "text", "start_seconds", "end_seconds"
    )
    frames = table(spark, directory, "observations").where("y <= 0.76").select(
        F.lit("observations").alias("stream"), F.col("source_key").alias("key"), F.col("frame_ordinal").alias("ord"), F.col("observation_id").alias("id"), "text",
        F.col("timestamp_seconds").alias("start_seconds"), F.col("timestamp_seconds").alias("end_seconds"),
    )
    return segments.unionByName(frames)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """(stream, first_id, last_id): maximal runs of two or more."""
    return collapse_runs(event_rows(spark, directory), with_text=False).where("n >= 2").select("stream", "first_id", "last_id")
