"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A sentence is the average of the vectors of its words and subwords (hashed); every area has its own logistic output. The
model is fitted on a bounded sample of labelled documents, which stays partitioned on the cluster: each step sends the
parameters out, every partition returns the gradient over its sentences, and their sum moves the parameters. Sentences
first carry the labels of their document; as most labelled documents also hold sentences of no area, and some labels are
wrong, the later steps follow what the model itself is sure of. Every document is then scored sentence by sentence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import is_blank
from cuelake.llm import glyphs
from cuelake.session import spread
from cuelake.sources.tables import table

#: Hash buckets and width of the embeddings.
BUCKETS, WIDTH = 1 << 15, 12
#: The fitting sample, the bound: labelled documents; and the partitions that hold it.
FIT_DOCUMENTS, FIT_PARTITIONS = 4000, 6
#: Steps and rate of the first fit, and of each of the two that follow.
FIRST, AGAIN = (24, 0.09), (9, 0.05)
#: Share of the sentences from which a document is of an area.
SHARE = 0.3

_TIMES = regex.compile(r"^\s*\d+\s*$|\[?\s*\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?\s*(?:-->|-|–)\s*\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?\s*\]?|<[^<>]{1,60}>|^\s*#.*$|^\s*-\s*\w+:.*$", regex.M)
_SPLIT = regex.compile(r"[.!?…]+[\"”»)\]]*\s+|[。！？।؟．｡]+[\"”»」』）]*\s*|\n[ \t]*\n")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
#: A piece of more words than this closes no sentences; its lines do.
_LONG = 45


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a document as words: cue times, numbering, headings and tags left out."""
    if not text:
        return []
    cleaned = _TIMES.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    out = []
    for piece in _SPLIT.split(regex.sub(r"\n\s*\n", "\n", cleaned) if _TIMES.search(text) else cleaned):
        words = _WORD.findall(glyphs.printed(piece).casefold())
        if len(words) > _LONG and "\n" in piece:
            out += [_WORD.findall(glyphs.printed(line).casefold()) for line in piece.split("\n")]
        else:
            out.append(words)
    return [w for w in out if len(w) >= 3 or sum(map(len, w)) >= 6]


class Features:
    """Hashed features of words, kept per worker."""

    def __init__(self) -> None:
        self.known: dict[str, list[int]] = {}

    def of(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if _UNSPACED.search(word):
                grams = [word[i : i + n] for n in (2, 3, 4) for i in range(len(word) - n + 1)]
            else:
                marked = f"<{word}>"
                grams = [marked, *(marked[i : i + 5] for i in range(len(marked) - 4))] if len(word) > 4 else [marked]
            found = [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]
            if len(self.known) > 500_000:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = found
        return found

    def matrix(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of all sentences, where sentences begin, and how many each text has."""
        flat: list[int] = []
        begin: list[int] = []
        count = []
        for t in texts:
            n = 0
            for words in sentences(t):
                at = len(flat)
                for w in words:
                    flat += self.of(w)
                if len(flat) > at:
                    begin.append(at)
                    n += 1
            count.append(n)
        return np.array(flat, np.int64), np.array(begin, np.int64), np.array(count, np.int64)


class Model:
    """Embeddings, output weights and biases; Adam moments live with the fit."""

    def __init__(self, areas: list[str], seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.areas = areas
        self.p = [rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, len(areas))).astype(np.float32), np.full(len(areas), -1.5, np.float32)]

    def probabilities(self, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Averages and area probabilities of sentences."""
        size = np.diff(np.r_[begin, len(flat)])[:, None]
        mean = np.add.reduceat(self.p[0][flat], begin, axis=0) / size
        return mean, 1 / (1 + np.exp(-np.clip(mean @ self.p[1] + self.p[2], -30, 30)))

    def gradient(self, flat: np.ndarray, begin: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Sum over the sentences of the gradient of the logistic losses."""
        mean, p = self.probabilities(flat, begin)
        dz = (p - target).astype(np.float32)
        size = np.diff(np.r_[begin, len(flat)])
        ds = (dz @ self.p[1].T) / size[:, None]
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
        de = np.zeros_like(self.p[0])
        de[flat[order][first]] = np.add.reduceat(ds[np.repeat(np.arange(len(size)), size)[order]], first, axis=0)
        return [de, mean.T @ dz, dz.sum(axis=0)]


def labelled_sample(documents: DataFrame, labels: DataFrame, areas: list[str]) -> DataFrame:
    """(doc_id, labels, flat, begin): at most FIT_DOCUMENTS labelled documents with text, spread over partitions."""
    marks = labels.where(F.col("area").isin(areas) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("area")).alias("labels"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)
    rows = documents.where(~is_blank(F.col("text"))).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most FIT_DOCUMENTS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            flat, begin, count = [], [], []
            for t in b.column(1).to_pylist():
                f, s, c = features.matrix([t])
                flat.append(f)
                begin.append(s)
                count.append(int(c[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(flat, pa.list_(pa.int64())), pa.array(begin, pa.list_(pa.int64()))], ["doc_id", "labels", "flat", "begin"])

    return rows.mapInArrow(run, "doc_id bigint, labels array<string>, flat array<bigint>, begin array<bigint>").repartition(FIT_PARTITIONS, "doc_id").persist()


def _joined(b: pa.RecordBatch, areas: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, sentence starts and document labels (per sentence) of a batch of the sample."""
    flats, begins = b.column(2), b.column(3)
    sizes, counts = np.diff(flats.offsets.to_numpy()), np.diff(begins.offsets.to_numpy())
    shift = np.cumsum(sizes) - sizes
    flat, begin = flats.flatten().to_numpy(), begins.flatten().to_numpy() + np.repeat(shift, counts)
    y = np.array([[a in ls for a in areas] for ls in b.column(1).to_pylist()], np.float32).reshape(-1, len(areas))
    return flat, begin, np.repeat(y, counts, axis=0)


def fit(sample: DataFrame, areas: list[str]) -> Model:
    """Full-batch Adam; every step is one synchronised pass over the partitions of the sample."""
    sc = sample.sparkSession.sparkContext
    model = Model(areas)
    # how often a sentence's document carries each area: what a sentence of no area looks like to the first fit
    said = sample.select("labels", F.size("begin").alias("n"))
    base = said.agg(F.sum("n").alias("all"), *[F.sum(F.when(F.array_contains("labels", a), F.col("n")).otherwise(0)).alias(f"a{i}") for i, a in enumerate(areas)]).first()
    sure = np.array([(1 + (base[f"a{i}"] or 0) / max(1, base["all"] or 0)) / 2 for i in range(len(areas))], np.float32)
    for phase, (steps, rate) in enumerate((FIRST, AGAIN, AGAIN)):
        teacher = sc.broadcast(model) if phase else None
        m, v = [np.zeros_like(p) for p in model.p], [np.zeros_like(p) for p in model.p]
        for step in range(1, steps + 1):
            sent = sc.broadcast(model)
            # halfway from the base rate to certainty after labels, then what the model itself calls likelier than not
            limit = sure if phase == 1 else np.float32(0.5)

            def run(batches: Iterator[pa.RecordBatch], sent=sent, teacher=teacher, limit=limit) -> Iterator[pa.RecordBatch]:
                total, n = None, 0
                for b in batches:
                    flat, begin, y = _joined(b, areas)
                    if not len(begin):
                        continue
                    if teacher is not None:
                        y = (teacher.value.probabilities(flat, begin)[1] >= limit).astype(np.float32)
                    g = sent.value.gradient(flat, begin, y)
                    total = g if total is None else [a + x for a, x in zip(total, g)]
                    n += len(begin)
                if total is not None:
                    packed = np.concatenate([x.astype(np.float32).ravel() for x in total]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([packed], pa.binary())], ["n", "g"])

            parts = sample.mapInArrow(run, "n bigint, g binary").collect()  # one gradient of fixed size per partition
            sent.destroy()
            if not parts:
                return model
            n = sum(r.n for r in parts)
            # summed in a fixed order, so that the model doesn't depend on which partition came first
            flat = np.sum(np.stack(sorted((np.frombuffer(r.g, np.float32) for r in parts), key=lambda x: x.tobytes()[-64:])), axis=0) / n
            at = 0
            moved = []
            for i, p in enumerate(model.p):
                g = flat[at : at + p.size].reshape(p.shape)
                at += p.size
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                moved.append((p - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
            new = Model.__new__(Model)
            new.areas, new.p = areas, moved
            model = new
    return model


def area_shares(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, area, share, confidence): each area's share of a document's sentences, where above 0; rows are moved only if there are too few input splits for all cores.

    Null, empty and blank texts, and texts without sentences, have no row. ``confidence`` is the mean probability over the
    sentences counted. The model has a fixed size.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                flat, begin, count = features.matrix(part.column(1).to_pylist())
                if not len(begin):
                    continue
                p = model.probabilities(flat, begin)[1]
                owner = np.repeat(np.arange(part.num_rows), count)
                hit = p >= 0.5
                n = np.zeros((part.num_rows, p.shape[1]))
                np.add.at(n, owner, hit)
                s = np.zeros_like(n)
                np.add.at(s, owner, p * hit)
                doc, area = np.nonzero(n)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array([model.areas[a] for a in area], pa.string()), pa.array(n[doc, area] / count[doc]), pa.array(s[doc, area] / n[doc, area])],
                    ["doc_id", "area", "share", "confidence"],
                )

    return spread(documents.select("doc_id", "text").where("doc_id is not null"), "doc_id").mapInArrow(run, "doc_id bigint, area string, share double, confidence double")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """The areas of every document."""
    documents = table(spark, directory, "documents")
    areas = sorted(r.area for r in table(spark, directory, "subject_areas").select("area").where("area is not null").distinct().collect())
    sample = labelled_sample(documents, table(spark, directory, "subject_labels"), areas)
    model = fit(sample, areas)
    sample.unpersist()
    return area_shares(documents, model).where(F.col("share") >= SHARE - 1e-9).select("doc_id", "area").distinct()
