"""The text operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import base64
import datetime as dt
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import areas, events, languages, leakage, lookalikes, repetition, sentences, tokens

NOW = dt.datetime(2025, 1, 1)
SEG = "segment_id bigint, transcript_id bigint, ordinal int, start_seconds double, end_seconds double, text string, confidence double, loaded_at timestamp"
LONG = "Word after word it goes on. " * 20_000
ODD = [None, "", "  　", "\x00", "a", "(laughter)", "♪ ♪", LONG, "é" * 3, "\U0001f600", "x" * 100_000]


def segment_rows():
    rows = [(i, 1, i, None, float("nan"), t, float("nan"), NOW) for i, t in enumerate(ODD)]
    rows += [(None, 1, 1, 0.0, 1.0, "no id here at all", None, NOW), (50, None, 1, 0.0, 1.0, "no transcript", None, NOW), (51, 2, None, 5.0, 1.0, "no order", None, None)]
    return rows + rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A data folder of nothing but odd rows."""
    d = str(tmp_path_factory.mktemp("odd"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).withColumn("extra", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n", F.lit(2)).write.parquet(f"{d}/{name}.parquet")
    put(segment_rows(), SEG, "segments")
    put([(1, 7, None, "local-captions", None, None, None), (1, 7, "xx", "local-captions", [], True, NOW), (2, None, " ", None, None, None, NOW), (None, 7, "en", None, None, None, NOW)], "transcript_id bigint, source_key bigint, language string, method string, warnings array<string>, verification_pending boolean, created_at timestamp", "transcripts")
    put([(7, None, NOW), (7, None, NOW), (8, "Ａ b", NOW), (9, "A  b", NOW), (None, "A b", NOW)], "source_key bigint, title string, ingested_at timestamp", "sources")
    put([(i, 7, i, 0.5 * i, t, 0.5, 0.1, 0.2, 0.3, 0.1, NOW) for i, t in enumerate(ODD)] * 2 + [(None, None, None, None, "x", None, None, None, None, None, None)], "observation_id bigint, source_key bigint, frame_ordinal int, timestamp_seconds double, text string, confidence double, x double, y double, width double, height double, loaded_at timestamp", "observations")
    put([(i, t) for i, t in enumerate(ODD)] + [(None, "a b c d")], "doc_id bigint, text string", "documents")
    put([(1, None), (2, ""), (3, "only three words"), (4, "x" * 5000)], "item_id bigint, text string", "eval_items")
    put([("law",), ("music",), (None,)], "area string", "subject_areas")
    put([(7, "law"), (7, "law"), (7, None), (None, "music"), (4, "unknown")], "doc_id bigint, area string", "subject_labels")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in "segments transcripts sources observations documents eval_items subject_areas subject_labels".split():
        spark.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d


QUERIES = {"p1": repetition.p1_found, "p2": events.p2_found, "p3": lookalikes.p3_found, "p5": sentences.p5_found, "p6": languages.p6_found, "p7": tokens.p7_ids, "p8": leakage.p8_found, "p9": areas.p9_found}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, odd, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
    rows = QUERIES[name](spark, odd).collect()
    assert len(rows) == len(set(map(str, rows)))
    if name == "p7":
        assert {r.doc_id: r.ids for r in rows}[0] == []
        assert len(rows) == len(ODD) + 1
    if name == "p3":
        assert [tuple(r) for r in rows] == [("title", 8, 9)]
    spark.catalog.clearCache()


def stream_rows(seed):
    r = random.Random(seed)
    texts = ["our guest left the room", "our guest lcft the room", "Our guest left the room!", "the host stays 4 / 9", "the host stays 5 / 9", " ", None, "now what"]
    return [(i, k := r.randint(1, 3), i * 3, r.choice(texts) if r.random() < 0.7 else texts[0]) for i in range(150)]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_runs_match_a_plain_loop(spark, block):
    rows = stream_rows(block)
    df = spark.createDataFrame([("s", k, o, i, t, float(i), float(i + 1)) for i, k, o, t in rows] * 2, "stream string, key bigint, ord int, id bigint, text string, start_seconds double, end_seconds double")
    expected = []
    for key in (1, 2, 3):
        run, last = [], None
        for i, _, _, t in [r for r in rows if r[1] == key and r[3] and r[3].strip()] + [(None, key, None, None)]:
            if t is not None and last is not None and events.nearly_same(last, t):
                run.append(i)
            else:
                if run:
                    expected.append(("s", key, run[0], run[-1], len(run), float(run[0]), float(run[-1] + 1)))
                run = [i]
            last = t
    got = [tuple(r)[:7] for r in events.collapse_runs(df, block).collect()]
    assert sorted(got) == sorted(expected)
    spark.catalog.clearCache()


def test_lengths_of_code_points_break_no_run(spark):
    korean = "오늘은 우리가 함께 회의실에서 만났다"
    pairs = [(korean, unicodedata.normalize("NFD", korean)), ("We go home now", "\u200b".join("We go home now")), ("We go home now", "We go home now" + "!" * 40), ("We go", "We" + " " * 30 + "go")]
    pairs += [("We go home now", "We go home now and then we all sit down to eat")]
    rows = [("s", k, o, 2 * k + o, t, 0.0, 1.0) for k, p in enumerate(pairs) for o, t in enumerate(p)]
    df = spark.createDataFrame(rows, "stream string, key bigint, ord int, id bigint, text string, start_seconds double, end_seconds double")
    runs = events.collapse_runs(df)
    assert sorted((r.key, r.n) for r in runs.collect()) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1), (4, 1)]
    spark.catalog.clearCache()


def test_alike_pairs_match_brute_force(spark):
    texts = ["the coffee break", "the cоffee break", "the  coffee break", "the coffee break", "The coffee break", "кофе на столе", "кoфe на столе", "Kuzоka", "Kuzοka", "ｔｈｅ coffee break", "the coffee", "coffеe"]
    rows = [("segment", i % 2, i, t) for i, t in enumerate(texts * 2)]
    got = {tuple(r) for r in lookalikes.alike_pairs(lookalikes.consistent_forms(spark.createDataFrame(rows, "kind string, grp int, id int, text string"))).collect()}
    from cuelake.llm import glyphs

    same = lambda a, b: glyphs.printed(a).translate(glyphs.TO_LATIN) == glyphs.printed(b).translate(glyphs.TO_LATIN)
    expected = {("segment", i, j) for _, g, i, a in rows for _, h, j, b in rows if g == h and i < j and a != b and same(a, b)}
    assert got == expected
    spark.catalog.clearCache()


def test_token_ids_match_public_libraries(spark):
    import tiktoken

    lines = [x.split() for x in open(f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") if x.strip()]
    reference = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    r = random.Random(3)
    texts = ["", None, "<|endoftext|>", "a" * 5000, " \n\t ", "\U0001f600‍ naïve 中文 ไทย", *("".join(r.choice("abcdeЖ中 '1.\ńé") for _ in range(r.randint(1, 300))) for _ in range(200))]
    got = {row.doc_id: row.ids for row in tokens.token_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_repeats_across_blocks_are_found(spark):
    talk = [f"Speaker {i} explains the {w} of the day to us." for i, w in enumerate(["map", "sauce", "court", "code", "bond", "choir", "knee", "match"] * 4)]
    rows = [(i, 5, i, None, None, t, None, NOW) for i, t in enumerate(talk + talk)]
    whole = repetition.repetition(spark.createDataFrame(rows, SEG)).first()
    cut = repetition.repetition(spark.createDataFrame(rows, SEG), block=16).first()
    assert whole.band == "repetitive"
    assert whole.share == pytest.approx(0.5, abs=0.02)
    assert cut.share == pytest.approx(whole.share, abs=0.02)
    assert cut.chars == whole.chars
    spark.catalog.clearCache()


def test_slips_hide_no_repeat_across_blocks(spark):
    talk = [f"Speaker {i} explains the long {w} of the day to us." for i, w in enumerate(["map", "sauce", "court", "code", "bond", "choir", "knee", "match"] * 4)]
    talk = [t.replace("Speaker", random.Random(i).choice(["Host", "Guest", "Child"])) for i, t in enumerate(talk)]
    rows = [(i, 5, i, None, None, t, None, NOW) for i, t in enumerate(talk + [t.replace("explains", "explians") for t in talk[:16]] + [t.replace("the day", "the whole day") for t in talk[16:]])]
    cut = repetition.repetition(spark.createDataFrame(rows, SEG), block=32).first()
    assert cut.share == pytest.approx(0.5, abs=0.03)
    spark.catalog.clearCache()


@pytest.mark.parametrize("size", [8, 60, 170])
@pytest.mark.parametrize("letters, gap, end", [("abcdefghijklmnoprstuvwyz", " ", "."), ("".join(map(chr, range(0x4E00, 0x5600))), "", "。")])
def test_repeats_in_text_that_hardly_compresses_are_found(spark, letters, gap, end, size):
    r = random.Random(size)
    talk = [gap.join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 9))) + end for _ in range(size)]
    rows = [(i, 5, i, None, None, t, None, NOW) for i, t in enumerate(talk + talk[: round(0.58 * size)])]
    found = repetition.repetition(spark.createDataFrame(rows, SEG)).first()
    assert found.band in repetition.CHECKED
    assert found.share == pytest.approx(0.367, abs=0.05)
    spark.catalog.clearCache()


def test_repeats_in_other_letters_of_text_that_does_not_compress_are_found(spark, monkeypatch):
    """Letters of several scripts, said again in the other case: no byte string of any length comes twice."""
    r = random.Random(1)
    cased = [c for c in map(chr, range(0x41, 0x2000)) if len(c.swapcase()) == 1 and c.swapcase() != c and c.swapcase().swapcase() == c and unicodedata.is_normalized("NFKC", c)]
    plain = [c for c in map(chr, range(33, 127)) if c not in ".!?"]
    talk = [" ".join("".join(r.choice(plain if r.random() < 0.7 else cased) for _ in range(r.randint(3, 8))) for _ in range(7)) for _ in range(120)]
    swapped = ["".join(c.swapcase() if c.swapcase().swapcase() == c else c for c in t) for t in talk[:80]]
    texts = [f"{t}." for t in talk + swapped]
    assert max(repetition.ratios("\n".join(texts).encode())) < 1.15
    frame = spark.createDataFrame([(i, 5, i, None, None, t, None, NOW) for i, t in enumerate(texts)], SEG)
    monkeypatch.setattr(repetition, "table", lambda *_: frame)
    assert [x.transcript_id for x in repetition.p1_found(spark, "").collect()] == [5]
    spark.catalog.clearCache()


def _talk(r, again):
    """Cues of which some repeat, slip, gain or lose a word; sentences run over cues, or are never closed."""
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(3)) for _ in range(60)]
    said, cues = [], []
    for _ in range(60):
        words = [r.choice(names) for _ in range(r.randint(1, 16))]
        kind = r.random()
        if said and kind < again:
            words = list(r.choice(said))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(words))
                words[k] = words[k][:-1] + "q"
            if r.random() < 0.3:
                words.insert(r.randrange(len(words) + 1), "well")
            if r.random() < 0.2:
                words.pop(r.randrange(len(words)))
        elif kind > 0.95:
            words = [r.choice("abcdefgh") for _ in range(r.randint(11, 16))]
        elif kind > 0.9:
            words = words[:4] * 3
        words = words or ["so"]
        said.append(words)
        cut = r.randrange(len(words) + 1) if r.random() < 0.3 else 0
        cues += [" ".join(words[:cut]), " ".join(words[cut:]) + r.choice([".", ".", ".", "?", ""])]
    end = r.choice([".", ".", ""])
    return [c if end else c.rstrip(".?") for c in cues if c.strip(".?")]


def test_both_ways_of_the_exact_check_count_the_same():
    talks = [_talk(random.Random(i), again) for i in range(120) for again in (0.05, 0.5)] + [[], ["。"], ["今天 we go to the house again."] * 2]
    straight = [repetition.share(t) for t in talks]
    assert sum(x[1] > 0 for x in straight) > 200
    assert list(repetition.shares((t, "plain") for t in talks)) == straight
    assert list(repetition.shares((t, ("plain", "repetitive")[i % 2]) for i, t in enumerate(talks))) == straight


def test_band_decides_what_is_sought_in_the_history(monkeypatch):
    r = random.Random(2)
    sought = []
    said = repetition.History.said
    monkeypatch.setattr(repetition.History, "said", lambda self, words, remember=True: sought.append(words) or said(self, words, remember))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(6))
    new = [" ".join(word() for _ in range(7)) + "." for _ in range(40)]
    plain, repetitive = new + new[:3], new[:4] * 10
    counted = {}
    for texts in (plain, repetitive):
        sought.clear()
        columns = [[1], [0], [texts], [None]]
        row = next(repetition._inspect(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["transcript_id", "blk", "texts", "several"])]))).to_pylist()[0]
        counted[row["band"]] = (len(sought), row["repeated"])
    size = lambda texts: sum(len(w.strip(".")) for t in texts for w in t.split())
    assert counted == {"plain": (6, size(new[:3])), "repetitive": (40, size(new[:4]) * 9)}


def test_languages_are_told_apart_without_any_labelled_row():
    model = languages.fit({})
    strange = {
        "en": "they could not find where the cat was hiding", "de": "wir haben gestern nicht gewusst, wo der schlüssel ist", "fr": "nous ne savons pas où est passée la clé de la maison",
        "es": "nosotros no sabemos dónde está la llave de la casa", "pt": "nós não sabemos onde está a chave da nossa casa", "ru": "мы не знаем, где лежит ключ от дома", "zh": "我们不知道钥匙在哪里", "ja": "鍵がどこにあるのか分からない",
        "ko": "우리는 열쇠가 어디에 있는지 모른다", "ar": "لا نعرف أين مفتاح البيت", "hi": "हमें नहीं पता कि चाबी कहाँ है", "th": "เราไม่รู้ว่ากุญแจอยู่ที่ไหน",
    }
    totals, _ = languages.score(model, [languages.prepared(t) for t in strange.values()])
    assert [languages.LANGUAGES[i] for i in totals.argmin(axis=1)] == list(strange)


def test_code_lengths_are_exact():
    """The vectorised sums equal the plain recursion over counts."""
    import numpy as np

    texts = {"en": ["abab", "abc"], "de": ["bbb"]}
    model = languages.ContextTrees(texts)
    keys, points, at = languages.keys_of(["abcb"])
    lengths = model.code_lengths(keys)
    counts = {}
    for l, ts in texts.items():
        for t in ts:
            padded = b"\n" * (languages.LONGEST - 1) + t.encode()
            for i in range(languages.LONGEST - 1, len(padded)):
                for m in range(languages.LONGEST):
                    c = counts.setdefault((l, m, padded[i - m : i]), {})
                    c[padded[i]] = c.get(padded[i], 0) + 1

    def plain(l, context, symbol, m):
        if m < 0:
            return 8.0
        c = counts.get((l, m, context[len(context) - m :] if m else b""))
        if not c:
            return plain(l, context, symbol, m - 1)
        n, k = sum(c.values()), len(c)
        return float(np.log2((n + k) / c[symbol])) if symbol in c else float(np.log2((n + k) / k)) + plain(l, context, symbol, m - 1)

    padded = b"\n" * 8 + b"abcb"
    raw = (languages.GAP + "abcb" + languages.GAP).encode()
    for place, symbol in enumerate(b"abcb"):
        i = raw.index(b"abcb") + place
        for l in ("en", "de"):
            want = plain(l, padded[place + 4 : place + 8], symbol, languages.LONGEST - 1)
            assert lengths[i][languages.LANGUAGES.index(l)] == pytest.approx(want, abs=1e-4)


def test_foreign_clauses_and_wrong_labels_come_out(spark):
    own = ["The host tests the old map for a good minute.", "Nobody expected that the trainee explains the coffee break.", "Then my neighbour writes down the next episode.", "Our guest from Povida repeats the long journey."]
    rows = [(i, 1, i, None, None, own[i % 4], None, NOW) for i in range(12)]
    rows += [(20, 1, 20, None, None, "Потом наш гость долго объясняет старую фотографию.", None, NOW), (21, 1, 21, None, None, "The host tests the map. 然后我们的嘉宾描述了外面的天气和停车问题。", None, NOW)]
    rows += [(22, 1, 22, None, None, "He shouts Привет at the end of the long day.", None, NOW), (23, 1, 23, None, None, "(смех)", None, NOW)]
    t = spark.createDataFrame([(1, "fr", 5), (2, "en", 5)], "transcript_id bigint, language string, source_key bigint")
    judged = languages.judge_segments(spark, spark.createDataFrame(rows * 2, SEG), languages.fit({}))
    got = {(r.level, r.id, r.language) for r in languages.language_findings(judged, t).collect()}
    assert got == {("transcript", 1, "en"), ("segment", 20, "ru"), ("segment", 21, "zh")}
    spark.catalog.clearCache()


def test_areas_on_held_out_documents(spark):
    r = random.Random(8)
    words = {"law": ["court ruling", "appeal deadline", "breach of contract"], "music": ["bass line", "choir rehearsal", "cello solo"], "sport": ["penalty kick", "league table", "rowing stroke"]}
    plain = ["old photograph", "next episode", "coffee break"]

    def document(kinds, n=10, share=0.6):
        return " ".join(f"The {r.choice(['host', 'guest', 'viewer'])} {r.choice(['tests', 'mentions', 'questions'])} the {r.choice(words[r.choice(kinds)] if r.random() < share else plain)}." for _ in range(n))

    kinds = {i: r.sample(sorted(words), r.choice([1, 1, 2])) for i in range(240)}
    docs = spark.createDataFrame([(i, document(k)) for i, k in kinds.items()], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, a) for i, k in kinds.items() if i < 160 for a in (k if r.random() < 0.93 else ["law"])], "doc_id bigint, area string")
    sample = areas.labelled_sample(docs, marks, sorted(words))
    model = areas.fit(sample, sorted(words))
    got = {(x.doc_id, x.area): x.share for x in areas.area_shares(docs.where("doc_id >= 160"), model).collect()}
    true = {}
    for row in docs.where("doc_id >= 160").collect():
        said = [s for s in row.text.split(". ") if s]
        for a, ws in words.items():
            true[(row.doc_id, a)] = sum(any(w in s for w in ws) for s in said) / len(said)
    wrong = [k for k, v in true.items() if abs(v - got.get(k, 0)) > 0.11]
    assert len(wrong) <= 0.05 * len(true)
    spark.catalog.clearCache()


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_ITEM_CHARS", 3)
    with pytest.raises(ValueError, match="too many items"):
        leakage.leaked_items(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), [(1, "long text"), (2, "other")])


def test_like_sentences_of_earlier_blocks_match_brute_force(spark):
    """Every level of keys, bucket sizes and words put in, against all pairs."""
    rng = random.Random(5)
    names = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(30)]
    said: list[str] = []
    for _ in range(160):
        n = rng.randint(0, 9)
        words = rng.choice([
            ["in", rng.choice(names), rng.choice(names), "the", "old", "guest", "calls", "the", "map", str(n)],
            ["nobody", "from", rng.choice(names), "saw", rng.choice(["this", "that"]), "line", "twice"],
            ["we", "said", rng.choice(names), str(n)],
            ["a", "viewer", "of", "the", "chat", "asks", rng.choice(names), "about", rng.choice(names)],
        ])
        if rng.random() < 0.5 and said:
            words = rng.choice(said).split(" ")
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(words))
                w = words[k]
                words[k] = w if len(w) < 4 else w[:1] + w[2:] if rng.random() < 0.5 else w[:-1] + "q"
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), "well")
        said.append(" ".join(words))
    said = list(dict.fromkeys(said))
    rows = [(i, 7, i // 20, w.replace(" ", repetition._SEP)) for i, w in enumerate(said)]
    split = [tuple(w.split(" ")) for w in said]
    wanted = {i for i, a in enumerate(split) if any(repetition.alike(a, b, False) for j, b in enumerate(split) if j // 20 < i // 20)}
    assert 20 < len(wanted) < len(said)
    frame = spark.createDataFrame(rows, "id bigint, transcript_id bigint, blk bigint, w string")
    for light in (1, 4, 64):
        assert {r.id for r in repetition.said_like_before(frame, light).collect()} == wanted, light
    other = frame.withColumn("transcript_id", frame.blk)
    assert repetition.said_like_before(other).count() == 0


def test_null_ordinals_are_cut_into_blocks(spark):
    texts = [f"The {a} of the {b} is seen from far away." for a in ("top", "roof", "wall", "door") for b in ("house", "barn", "mill")]
    rows = [(1, None, i, t, 0.0) for i, t in enumerate(texts + texts)]
    kept = [(r[0], r[1], r[2], r[3]) for r in rows]
    frame = spark.createDataFrame(kept, "transcript_id bigint, ordinal int, segment_id bigint, text string")
    whole, cut = repetition.repetition(frame).first(), repetition.repetition(frame, block=4).first()
    assert (whole.chars, whole.repeated) == (cut.chars, cut.repeated) and cut.share == 0.5


def test_items_come_in_blocks_of_bounded_size(spark):
    items = spark.createDataFrame([(2, "bb" * 5), (1, "a" * 9), (1, "a" * 9), (3, None), (4, "c" * 50)], "item_id bigint, text string")
    assert [[i for i, _ in b] for b in leakage.blocks_of_items(items, 20)] == [[1, 2], [4]]
    assert list(leakage.blocks_of_items(items.limit(0), 20)) == []


def test_classes_and_pairs_of_equal_looking_rows(spark):
    rows = [("t", 0, i, f"form{i % 4}".encode(), f"raw{i % 4}{i % 3}".encode()) for i in range(60)] + [("t", 0, 100, b"alone", b"x"), ("t", 0, 3, b"form3", b"raw30")]
    forms = spark.createDataFrame(rows, "kind string, grp long, id long, form binary, raw binary")
    once = sorted(set(rows))
    want = {(a[2], b[2]) for a in once for b in once if a[2] < b[2] and a[3] == b[3] and a[4] != b[4]}
    for share in (1, 4, 1024):
        got = [(r.id_a, r.id_b) for r in lookalikes.alike_pairs(forms, share).collect()]
        assert sorted(got) == sorted(want)
    classes = lookalikes.alike_classes(forms).collect()
    assert len(classes) == len(once)
    assert {r.id: r.links for r in classes if r.id == 100} == {100: 0}
    assert sum(r.links for r in classes) == 2 * len(want)


def test_a_hot_class_is_counted_not_gathered(spark):
    forms = spark.range(100_000).select(F.lit("t").alias("kind"), F.lit(0).cast("long").alias("grp"), "id", F.lit(b"f").alias("form"), F.when(F.col("id") % 2 == 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("raw"))
    got = lookalikes.alike_classes(forms).agg(F.count(F.lit(1)).alias("n"), F.min("links").alias("lo"), F.max("links").alias("hi")).first()
    assert (got.n, got.lo, got.hi) == (100_000, 50_000, 50_000)
