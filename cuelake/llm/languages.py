"""Languages of transcripts and of their segments by prediction by partial matching.

Each language has a variable-order byte context tree with escape probabilities (method C), fitted once on a bounded sample
and then frozen. The code length of a text under a language is the exact sum of its bytes' code lengths; the shortest code
wins. Scoring is vectorised over an Arrow batch: the distinct byte contexts of the batch are looked up once, all
languages at a time, and the lengths are summed over words, clauses and segments.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions.text import is_blank
from cuelake.llm import glyphs
from cuelake.llm.language_seeds import SEEDS
from cuelake.session import keep
from cuelake.sources.tables import current_transcripts, table

LANGUAGES = sorted(SEEDS)
#: Bytes of context plus the predicted byte.
LONGEST = 5
#: Fitting sample, the bound: transcripts per label, segments per transcript, bytes per segment.
FIT_TRANSCRIPTS, FIT_SEGMENTS, FIT_BYTES = 120, 12, 1000
#: Bits by which a clause's language must beat every other, and those that a change of language inside a clause must save.
MARGIN_BITS, SWITCH_BITS = 25.0, 30.0
#: Least size of a clause: words, or characters where no spaces part the words.
LEAST_WORDS, LEAST_CHARS = 5, 10

# Marks that are alike for the models, and digits, each as one representative.
_ALIKE = {".": "．｡।॥…", ",": "，、;:；：", "?": "？؟", "!": "！", '"': "«»“”„「」『』", "0": "123456789"}
_FOLD = np.arange(0x10000, dtype=np.uint32)
for _to, _from in _ALIKE.items():
    _FOLD[[ord(c) for c in _from]] = ord(_to)
_FOLD[ord("。")] = ord(".")
_FOLD[ord("\u2028")] = _FOLD[ord("\u2029")] = 32
_MARKER = regex.compile(r"[(\[（【♪][^)\]）】♪\n]{0,24}[)\]）】♪]")
_HIDDEN = regex.compile(r"[[\p{Cf}\p{Default_Ignorable_Code_Point}\p{Cc}]--[\t-\r\x1c-\x1f\x85]]+", regex.V1)
_ROOM = regex.compile(r"[^\S\n ]+|  +")


def prepared_batch(texts: list[str | None]) -> list[str]:
    """Texts as the models see them: printed form in its own script, lower case, digits alike, markers left out.

    All texts go through each step together, one per line.
    """
    joined = "\n".join(" ".join(t.splitlines()) if t else "" for t in texts)
    if not joined.isascii():
        joined = _HIDDEN.sub("", joined)
        if not unicodedata.is_normalized("NFKC", joined):
            joined = unicodedata.normalize("NFKC", joined)
    lines = _ROOM.sub(" ", _MARKER.sub(lambda m: m[0] if m[0].count(" ") > 2 else " ", joined)).split("\n")
    for i, line in enumerate(lines):
        if glyphs._FOREIGN.search(line) and glyphs.may_mix(line):
            around = glyphs.dominant(line)
            lines[i] = glyphs.WORDS.sub(lambda m: (len({glyphs.script(c) for c in m[0]} - {""}) > 1 and glyphs.proposals(m[0], around)) or m[0], line)
    points = np.frombuffer("\n".join(lines).lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(points < 0x10000, _FOLD[np.minimum(points, 0xFFFF)], points)
    out = [line.strip() for line in points.tobytes().decode("utf-32-le").split("\n")]
    assert len(out) == len(texts)
    return out


def prepared(text: str | None) -> str:
    return prepared_batch([text])[0]


class ContextTrees:
    """Frozen context trees of all languages, as sorted arrays of contexts and of continued contexts."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        n = len(LANGUAGES)
        self.keys, self.bits, self.contexts, self.escapes = [None], [None], [None], [None]
        each = [k[k & np.uint64(255) != 10] for k in (keys_of([t for t in texts.get(l, []) if t])[0] for l in LANGUAGES)]
        for m in range(1, LONGEST + 1):
            mask = np.uint64((1 << (8 * m)) - 1)
            counted = [np.unique(k & mask, return_counts=True) for k in each]
            keys = np.unique(np.concatenate([k for k, _ in counted]))
            count = np.zeros((len(keys), n))
            for i, (k, c) in enumerate(counted):
                count[np.searchsorted(keys, k), i] = c
            context = keys >> np.uint64(8)
            # keys are sorted by their high bytes first only if the context is the high part: it is
            contexts, first = np.unique(context, return_index=True)
            total = np.add.reduceat(count, first, axis=0)
            kinds = np.add.reduceat((count > 0).astype(float), first, axis=0)
            where = np.searchsorted(contexts, context)
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(count > 0, np.log2((total + kinds)[where] / count), np.inf)
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            self.keys.append(keys)
            self.bits.append(bits.astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(escape.astype(np.float32))

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each context key's last byte, per language."""
        cost = np.full((len(keys), len(LANGUAGES)), 8.0, np.float32)
        for m in range(1, LONGEST + 1):
            gram = keys & np.uint64((1 << (8 * m)) - 1)
            context = gram >> np.uint64(8)
            i = np.minimum(np.searchsorted(self.contexts[m], context), len(self.contexts[m]) - 1)
            cost = cost + np.where((self.contexts[m][i] == context)[:, None], self.escapes[m][i], np.float32(0))
            i = np.minimum(np.searchsorted(self.keys[m], gram), len(self.keys[m]) - 1)
            found = np.where((self.keys[m][i] == gram)[:, None], self.bits[m][i], np.float32(np.inf))
            cost = np.where(np.isinf(found), cost, found)
        return cost


GAP = "\n" * (LONGEST - 1)


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context keys of all bytes of the texts; code points and each code point's first byte."""
    joined = GAP + "".join(t + GAP for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    raw = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    if not len(texts):
        return np.empty(0, np.uint64), points[:0], np.empty(0, np.int64)
    key = np.zeros(len(raw), np.uint64)
    for back in range(LONGEST):
        key[back:] |= raw[: len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(size) - size
    return key, points, at


def _class_of(points: np.ndarray) -> np.ndarray:
    """Script classes of code points: 0 none, 1 Latin, 2 Cyrillic, 3 Han and kana, 4 Hangul, 5 Arabic, 6 Devanagari, 7 Thai, 8 other letters."""
    c = np.zeros(len(points), np.int8)
    for lo, hi, k in ((0x41, 0x5B, 1), (0x61, 0x7B, 1), (0xAA, 0x250, 1), (0x300, 0x370, 0), (0x370, 0x400, 8), (0x400, 0x530, 2), (0x600, 0x700, 5), (0x900, 0x980, 6), (0xE00, 0xE80, 7), (0x1100, 0x1200, 4), (0x1E00, 0x1F00, 1), (0x3040, 0x3100, 3), (0x3400, 0xA000, 3), (0xAC00, 0xD7B0, 4), (0x20000, 0x30000, 3)):
        c[(points >= lo) & (points < hi)] = k
    for odd in (0xAB, 0xBB, 0xBF, 0xD7, 0xF7, 0xB7, 0x60C, 0x61B, 0x61F, 0x964, 0x965, 0xE3F):
        c[points == odd] = 0
    return c


def score(trees: ContextTrees, texts: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """Code lengths of each text per language, and the clauses: (text, words, chars, best, margin)."""
    n, width = len(texts), len(LANGUAGES)
    totals = np.zeros((n, width), np.float32)
    empty = pd.DataFrame({k: np.empty(0, t) for k, t in (("text", int), ("words", int), ("chars", int), ("best", int), ("margin", float))})
    if not n or not any(texts):
        return totals, empty
    key, points, at = keys_of(texts)
    code, distinct = pd.factorize(key)
    cost = trees.code_lengths(distinct.astype(np.uint64))
    newline = points == 10
    group = len(GAP)
    # the text of each code point: texts are parted by GAP, and no prepared text holds a line break
    ends = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, n) + group) + group
    owner = np.searchsorted(ends, np.arange(len(points)), "right")
    owner[newline] = n
    kind = _class_of(points)
    letter = kind > 0
    index = np.arange(len(points))
    last = np.maximum.accumulate(np.where(letter, index, -1))
    carried = np.where(last >= 0, kind[np.maximum(last, 0)], 0)
    prior = np.r_[np.int8(0), carried[:-1]]
    stop = np.isin(points, np.frombuffer('.,!?"'.encode("utf-32-le"), np.uint32))
    cut = np.zeros(len(points), bool)
    cut[1:] = stop[:-1] & ~stop[1:]
    # a point or comma between letters or digits, as in numbers and file names, parts nothing
    inside = np.zeros(len(points), bool)
    inside[1:-1] = stop[1:-1] & (points[:-2] < 0x80) & (points[2:] < 0x80) & (points[2:] != 32)
    cut[1:] &= ~inside[:-1]
    cut |= letter & (prior > 0) & (prior != kind)
    cut[1:] |= owner[1:] != owner[:-1]
    cut[0] = True
    space = points == 32
    word = cut.copy()
    word[1:] |= space[:-1] & ~space[1:]
    unspaced = (kind == 3) | (kind == 7)
    word |= unspaced
    starts = np.flatnonzero(word)
    cost[(distinct.astype(np.uint64) & np.uint64(255)) == 10] = 0  # line breaks only part the texts
    byte_starts = at[starts]
    word_cost = np.empty((len(starts), width), np.float32)
    for language, column in enumerate(np.ascontiguousarray(cost.T)):
        word_cost[:, language] = np.add.reduceat(column[code], byte_starts)
    word_owner = owner[starts]
    clause_of = np.cumsum(cut)[starts] - 1
    has_letter = np.add.reduceat(letter.astype(np.int32), starts) > 0
    is_char = unspaced[starts]
    keep = word_owner < n
    word_cost, word_owner, clause_of, has_letter, is_char = word_cost[keep], word_owner[keep], clause_of[keep], has_letter[keep], is_char[keep]
    first = np.flatnonzero(np.r_[True, word_owner[1:] != word_owner[:-1]])
    totals[word_owner[first]] = np.add.reduceat(word_cost, first, axis=0)
    # changes of language inside a clause, where each saves enough
    begin = np.flatnonzero(np.r_[True, clause_of[1:] != clause_of[:-1]])
    size = np.diff(np.r_[begin, len(clause_of)])
    whole = np.add.reduceat(word_cost, begin, axis=0)
    # no division can save more than the best language of each word by itself
    most = whole.min(axis=1) - np.add.reduceat(word_cost.min(axis=1), begin)
    extra = []
    for c in np.flatnonzero((most > SWITCH_BITS) & (size > 5)):
        extra += [begin[c] + k for k in switches(word_cost[begin[c] : begin[c] + size[c]], SWITCH_BITS)]
    if extra:
        begin = np.unique(np.r_[begin, extra])
        whole = np.add.reduceat(word_cost, begin, axis=0)
    ranked = np.partition(whole, 1, axis=1)
    clauses = pd.DataFrame(
        {
            "text": word_owner[begin],
            "words": np.add.reduceat((has_letter & ~is_char).astype(int), begin),
            "chars": np.add.reduceat((has_letter & is_char).astype(int), begin),
            "best": whole.argmin(axis=1),
            "margin": ranked[:, 1] - ranked[:, 0],
        }
    )
    return totals, clauses


def switches(cost: np.ndarray, price: float) -> list[int]:
    """Words at which the cheapest sequence of languages changes, if every change costs ``price`` bits.

    ``cost``: words x languages. The best path is found word by word: a word's language is that of the word before it, or,
    for the price, any.
    """
    path = cost[0].astype(np.float64)
    changed = np.zeros(cost.shape, bool)
    came = np.zeros(len(cost), np.int64)
    for k in range(1, len(cost)):
        came[k] = int(path.argmin())
        bought = path[came[k]] + price
        changed[k] = bought < path
        path = np.minimum(path, bought) + cost[k]
    language, out = int(path.argmin()), []
    for k in range(len(cost) - 1, 0, -1):
        if changed[k, language]:
            out.append(k)
            language = int(came[k])
    return out[::-1]


def fit(sampled: dict[int, list[str]], rounds: int = 3) -> ContextTrees:
    """Context trees from transcripts (id -> prepared texts).

    Labels are too often wrong to learn from, and trees that learned a wrongly placed transcript would call its place right.
    So transcripts are judged by trees that were fitted on the other half of the sample: first on the seeds alone, then on
    what was judged before. A transcript is of the language of most of its texts, and its texts are learned if nothing in
    them is of another. The last trees learn both halves.
    """
    seeds = {l: [s.strip() for s in regex.split(r"(?<=[.?。？।])", prepared(t)) if s.strip()] for l, t in SEEDS.items()}
    order = sorted(sampled)
    half = {i: n % 2 for n, i in enumerate(order)}
    flat = [(i, t) for i in order for t in sampled[i] if len(t) > 12]
    learnt: list[str | None] = [None] * len(flat)

    def trees(of: int | None) -> ContextTrees:
        texts = {l: list(s) for l, s in seeds.items()}
        for (i, t), l in zip(flat, learnt):
            if l in texts and (of is None or half[i] == of):
                texts[l].append(t)
        return ContextTrees(texts)

    for _ in range(rounds if flat else 0):
        models = [trees(0), trees(1)]
        for h in (0, 1):
            mine = [n for n, (i, _) in enumerate(flat) if half[i] != h]
            if not mine:
                continue
            totals, clauses = score(models[h], [flat[n][1] for n in mine])
            best = totals.argmin(axis=1)
            votes = pd.DataFrame({"i": [flat[n][0] for n in mine], "l": best}).groupby(["i", "l"]).size().reset_index(name="n").sort_values(["n", "l"]).drop_duplicates("i", keep="last")
            major = dict(zip(votes.i, votes.l))
            sure = clauses[clauses.margin >= MARGIN_BITS]
            mixed = set(sure.text[sure.best.to_numpy() != best[sure.text.to_numpy()]])
            for k, n in enumerate(mine):
                learnt[n] = LANGUAGES[best[k]] if best[k] == major[flat[n][0]] and k not in mixed else None
    return trees(None)


def fitting_sample(segments: DataFrame, transcripts: DataFrame) -> dict[int, list[str]]:
    """Prepared texts of at most FIT_TRANSCRIPTS transcripts of each known label, FIT_SEGMENTS segments of each, FIT_BYTES of
    each text; the labels only spread the sample over the languages."""
    tag = F.regexp_extract(F.lower(F.trim(F.regexp_replace(F.coalesce("language", F.lit("")), "_", "-"))), r"^([a-z]*)", 1)
    known = transcripts.select("transcript_id", tag.alias("tag")).where(F.col("tag").isin(LANGUAGES))
    lists = known.select("transcript_id", "tag", F.xxhash64("transcript_id").alias("h"))
    chosen = lists.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("h", "transcript_id"))).where(F.col("n") <= FIT_TRANSCRIPTS).select("transcript_id", "tag")
    rows = (
        segments.where(F.col("ordinal").between(0, FIT_SEGMENTS - 1) & ~is_blank(F.col("text")))
        .join(F.broadcast(chosen), "transcript_id")  # at most 12 labels x FIT_TRANSCRIPTS rows
        .select("transcript_id", F.substring("text", 1, FIT_BYTES).alias("text"))
        .collect()
    )
    out: dict[int, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.transcript_id, r.text)):
        if t := prepared(r.text):
            out.setdefault(r.transcript_id, []).append(t)
    return out


SCHEMA = "transcript_id bigint, segment_id bigint, best int, confidence double, clauses array<int>"


def _judge(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = broadcast.value
        for b in batches:
            texts = prepared_batch(b.column(2).to_pylist())
            n = len(texts)
            totals, clauses = score(trees, texts)
            bits = totals - totals.min(axis=1, keepdims=True)
            weight = 1.0 / np.exp2(-np.minimum(bits, 200)).sum(axis=1)
            size = clauses.groupby("text")[["words", "chars"]].sum().reindex(range(n), fill_value=0)
            best = totals.argmin(axis=1)
            telling = ((size.words + size.chars / 3).to_numpy() >= 3) & (weight > 0.99)
            sure = clauses[clauses.margin >= MARGIN_BITS]
            # a sentence is one or several neighbouring clauses of a language, with at most one between that doesn't tell
            t, l, place = sure.text.to_numpy(), sure.best.to_numpy(), sure.index.to_numpy()
            run = np.cumsum(np.r_[True, (t[1:] != t[:-1]) | (l[1:] != l[:-1]) | (np.diff(place) > 2)]) if len(sure) else np.empty(0, int)
            merged = sure.groupby(run).agg(text=("text", "first"), best=("best", "first"), words=("words", "sum"), chars=("chars", "sum"))
            merged = merged[(merged.words >= LEAST_WORDS) | (merged.chars >= LEAST_CHARS)].drop_duplicates(["text", "best"])
            lists: list[list[int] | None] = [None] * n
            for t, l in zip(merged.text, merged.best):
                lists[t] = (lists[t] or []) + [int(l)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.where(telling, best, -1), pa.int32()), pa.array(weight, pa.float64()), pa.array(lists, pa.list_(pa.int32()))],
                ["transcript_id", "segment_id", "best", "confidence", "clauses"],
            )

    return run


def judge_segments(spark: SparkSession, segments: DataFrame, trees: ContextTrees) -> DataFrame:
    """(transcript_id, segment_id, best, confidence, clauses): one row per segment with text.

    ``best`` is the index in LANGUAGES of the language with the shortest code, -1 where there is too little text to tell;
    ``clauses`` are the languages of whole clauses of enough length. The trees have a fixed bound (the fitting sample).
    """
    shared = spark.sparkContext.broadcast(trees)
    rows = segments.where(~is_blank(F.col("text")) & F.col("segment_id").isNotNull() & F.col("transcript_id").isNotNull())
    judged = rows.select("transcript_id", "segment_id", "text").mapInArrow(_judge(shared), SCHEMA)
    return keep(judged.dropDuplicates(["segment_id"]))  # scored once, read for the majorities and for the clauses


def language_findings(judged: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(level, id, language, confidence): labels to correct, and segments with clauses in another language.

    The language of a transcript is that of most of its telling segments, ties by language code; its confidence is
    their share. A transcript without telling segments gets none.
    """
    names = F.array(*[F.lit(l) for l in LANGUAGES])
    counts = judged.where("best >= 0").groupBy("transcript_id", "best").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("transcript_id").agg(F.max(F.struct(F.col("n"), (-F.col("best")).alias("b"))).alias("m"), F.sum("n").alias("all"))
    most = most.select("transcript_id", (-F.col("m.b")).alias("major"), (F.col("m.n") / F.col("all")).alias("share"))
    tag = F.element_at(F.split(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.coalesce("language", F.lit("")), "_", "-"))), r"[\x09-\x0d\x1c-\x20\x85\p{Z}]+", ""), "-"), 1)
    labels = transcripts.join(most, "transcript_id").withColumn("language_found", F.element_at(names, F.col("major") + 1))
    wrong = labels.where(tag != F.col("language_found")).select(F.lit("transcript").alias("level"), F.col("transcript_id").alias("id"), F.col("language_found").alias("language"), F.col("share").alias("confidence"))
    other = judged.where("clauses is not null").select("transcript_id", "segment_id", "confidence", F.explode("clauses").alias("l")).join(most, "transcript_id").where("l <> major")
    foreign = other.select(F.lit("segment").alias("level"), F.col("segment_id").alias("id"), F.element_at(names, F.col("l") + 1).alias("language"), "confidence")
    return wrong.unionByName(foreign)


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Languages of wrongly labelled transcripts, and of segments with a clause in another language."""
    segments, transcripts = table(spark, directory, "segments"), current_transcripts(spark, directory)
    trees = fit(fitting_sample(segments, transcripts))
    return language_findings(judge_segments(spark, segments, trees), transcripts).select("level", "id", "language")
