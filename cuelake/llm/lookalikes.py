"""One consistent form for texts that look alike, by script-aware repair against the corpus vocabulary.

A text's printed form composes compatibility characters, drops invisible ones and folds white space. In it, a token that
mixes scripts, or stands in another script than the rest of its text, gets its look-alike letters replaced by those of
its dominant script, but only if the result is a word of the corpus: a word of one script found in some text, or one that
two different distortions agree on. Rows are never compared with each other to find that out; the vocabulary is folded per
input partition before it is shuffled, and tokens meet it in an equi-join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cuelake.functions.text import is_blank
from cuelake.llm import glyphs
from cuelake.session import keep
from cuelake.sources.tables import current_transcripts, table

#: Words that a task holds before it hands them on; bounds its memory.
VOCABULARY_FLUSH = 100_000
SCHEMA = "kind string, grp bigint, id bigint, form binary, raw binary, parts array<string>, tokens array<struct<token: string, fixed: string>>, word string"


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with the digests of its printed form and itself; suspicious texts also in parts with proposals."""
    schema = pa.schema(
        [("kind", pa.string()), ("grp", pa.int64()), ("id", pa.int64()), ("form", pa.binary()), ("raw", pa.binary()), ("parts", pa.list_(pa.string())),
         ("tokens", pa.list_(pa.struct([("token", pa.string()), ("fixed", pa.string())]))), ("word", pa.string())]
    )
    vocabulary: set[str] = set()

    def words() -> pa.RecordBatch:
        w = pa.array(sorted(vocabulary), pa.string())
        vocabulary.clear()
        return pa.RecordBatch.from_arrays([pa.array(["word"] * len(w), pa.string()), *[pa.nulls(len(w), f.type) for f in schema][1:7], w], schema=schema)

    for batch in batches:
        forms, raws, parts, tokens = [], [], [], []
        for text in batch.column(3).to_pylist():
            shown = glyphs.printed(text)
            raw = digest(text)
            raws.append(raw)
            forms.append(raw if shown == text else digest(shown))
            found = None
            if glyphs.may_mix(shown):
                around = glyphs.dominant(shown)
                found = {t: p for t in set(glyphs.WORDS.findall(shown)) if (p := glyphs.proposals(t, around)) is not None}
            if found:
                cut, at = [], 0
                for m in glyphs.WORDS.finditer(shown):
                    cut += [shown[at : m.start()], m[0]]
                    at = m.end()
                parts.append([*cut, shown[at:]])
                tokens.append([{"token": t, "fixed": p} for t, p in sorted(found.items())])
                vocabulary.update(w for w in glyphs.WORDS.findall(shown) if w not in found)
            else:
                parts.append(None)
                tokens.append(None)
                vocabulary.update(glyphs.WORDS.findall(shown))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(forms, pa.binary()), pa.array(raws, pa.binary()), pa.array(parts, schema.field(5).type), pa.array(tokens, schema.field(6).type), pa.nulls(len(raws), pa.string())],
            schema=schema,
        )
        if len(vocabulary) > VOCABULARY_FLUSH:
            yield words()
    if vocabulary:
        yield words()


@F.pandas_udf(BinaryType())
def _digest(texts):  # noqa: ANN001, ANN202
    return texts.map(lambda t: None if t is None else digest(t))


def consistent_forms(texts: DataFrame) -> DataFrame:
    """(kind, grp, id, form, raw): digests of the consistent form and of the text itself.

    ``texts``: (kind, grp, id, text). Blank and null texts have no form and are left out; repeated rows stay repeated. A
    token whose repair isn't in the corpus vocabulary keeps its letters. ``form`` is a 128-bit digest, so that long texts
    needn't be shuffled.
    """
    rows = texts.where(~is_blank(F.col("text"))).select(F.col("kind"), F.col("grp").cast("bigint").alias("grp"), F.col("id").cast("bigint").alias("id"), "text")
    seen = keep(rows.mapInArrow(_inspect, SCHEMA))
    clean = seen.where("word is null and tokens is null").select("kind", "grp", "id", "form", "raw")
    doubtful = seen.where("tokens is not null")
    claims = doubtful.select(F.explode("tokens").alias("t")).select("t.token", "t.fixed").distinct()
    agreed = claims.groupBy("fixed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("fixed").alias("word"))
    known = seen.where("word is not null").select("word").unionByName(agreed).distinct()
    repairs = claims.join(known, claims.fixed == known.word, "left_semi")
    each = doubtful.select("kind", "id", "raw", F.explode("tokens").alias("t")).select("kind", "id", "raw", F.col("t.token").alias("token")).distinct()
    mapped = each.join(repairs, "token").groupBy("kind", "id", "raw").agg(F.map_from_entries(F.collect_list(F.struct("token", "fixed"))).alias("m"))
    repaired = doubtful.join(mapped, ["kind", "id", "raw"], "left").withColumn(
        "shown", F.expr("array_join(if(m is null, parts, transform(parts, p -> coalesce(try_element_at(m, p), p))), '')")
    )
    return clean.unionByName(repaired.select("kind", "grp", "id", _digest("shown").alias("form"), "raw"))


#: Rows of a class that one task pairs with the rest of the class.
SHARE = 1024


def alike_classes(forms: DataFrame) -> DataFrame:
    """(kind, grp, id, class, spelling, links): every row with its class of equal-looking rows and how many rows of the
    class are spelled otherwise.

    ``class`` and ``spelling`` are digests of the form and of the text. Spellings and classes are counted by partial
    aggregates, so a class of a third of all rows is a few counters when it is shuffled; a row repeated under one id counts
    once. Rows of a class of one spelling have no links.
    """
    rows = forms.select("kind", "grp", "id", "form", "raw").distinct()
    spelled = rows.groupBy("kind", "grp", "form", "raw").agg(F.count(F.lit(1)).alias("same"))
    sizes = spelled.groupBy("kind", "grp", "form").agg(F.sum("same").alias("all"))
    counted = spelled.join(sizes, ["kind", "grp", "form"])
    joined = rows.join(counted, ["kind", "grp", "form", "raw"])
    return joined.select("kind", "grp", "id", F.col("form").alias("class"), F.col("raw").alias("spelling"), (F.col("all") - F.col("same")).alias("links"))


def alike_pairs(forms: DataFrame, share: int = SHARE) -> DataFrame:
    """(record_kind, id_a, id_b): ids whose texts share kind, group and consistent form but not their code points.

    Only forms with at least two different texts take part, found by a partial aggregate before any row is moved; identical
    copies of one text form no pair among themselves. A class of n rows is cut into n / ``share`` parts, each of which meets
    the whole class in a place of its own, so that no task pairs a large class alone.
    """
    rows = forms.select("kind", "grp", "id", "form", "raw")
    several = rows.groupBy("kind", "grp", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    parts = several.select("kind", "grp", "form", F.ceil(F.col("n") / share).alias("parts"))
    members = rows.join(parts, ["kind", "grp", "form"]).distinct()
    a = members.withColumn("part", F.pmod(F.xxhash64("id", "raw"), "parts")).alias("a")
    b = members.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).alias("b")
    at = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("kind", "grp", "form", "part")]
    met = a.join(b, at[0] & at[1] & at[2] & at[3] & (F.col("a.id") != F.col("b.id")) & (F.col("a.raw") != F.col("b.raw")))
    x, y = F.col("a.id"), F.col("b.id")
    return met.where(x < y).select(F.col("a.kind").alias("record_kind"), x.alias("id_a"), y.alias("id_b")).distinct()


def placed_forms(spark: SparkSession, directory: str) -> DataFrame:
    """(kind, grp, id, form, raw) of the titles of sources and the texts of segments, segments grouped by source."""
    titles = table(spark, directory, "sources").where("source_key is not null").select(F.lit("title").alias("kind"), F.lit(0).alias("grp"), F.col("source_key").alias("id"), F.col("title").alias("text"))
    cues = table(spark, directory, "segments").where("segment_id is not null").select(
        F.lit("segment").alias("kind"), F.col("transcript_id").alias("grp"), F.col("segment_id").alias("id"), "text"
    )
    forms = consistent_forms(titles.unionByName(cues))
    of = current_transcripts(spark, directory).select(F.col("transcript_id").alias("grp"), F.col("source_key").alias("source"))
    placed = forms.join(of, (forms.grp == of.grp) & (forms.kind == "segment"), "left").where("kind = 'title' or source is not null")
    return keep(placed.select("kind", F.when(F.col("kind") == "title", F.lit(0)).otherwise(F.col("source")).alias("grp"), "id", "form", "raw"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Titles of sources, and texts of segments of one source, that look the same but differ in code points."""
    return alike_pairs(placed_forms(spark, directory))


def p3_classes(spark: SparkSession, directory: str) -> DataFrame:
    """The same as classes: (record_kind, id, class, spelling, links), one row per title and segment with text."""
    c = alike_classes(placed_forms(spark, directory))
    return c.select(F.col("kind").alias("record_kind"), "id", F.hex("class").alias("class"), F.hex("spelling").alias("spelling"), "links")
