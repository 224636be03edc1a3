"""Pure functions of the text operators."""

import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import events, glyphs, languages, leakage, repetition, tokens
from cuelake.llm.events import distance, nearly_same
from cuelake.llm.sentences import sentences


def parts(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dr. Mora tests it at approx. 84.79 metres. Really?! See Fig. 3 and No. 4, e.g. the map.", ["Dr. Mora tests it at approx. 84.79 metres.", "Really?!", "See Fig. 3 and No. 4, e.g. the map."]),
        ("It all ends at 11 p.m. Then our guest left. At 9 a.m. a viewer came.", ["It all ends at 11 p.m.", "Then our guest left.", "At 9 a.m. a viewer came."]),
        ("Wait... my neighbour left. Wait... Then we go.", ["Wait... my neighbour left.", "Wait...", "Then we go."]),
        ('He said, "Not today." The value rose. "Is that it?" my neighbour asked.', ['He said, "Not today."', "The value rose.", '"Is that it?" my neighbour asked.']),
        ("„Ist das so?“, fragt er. Am 3. Mai kommt er, z. B. spät. So\nein Tag!", ["„Ist das so?“, fragt er.", "Am 3. Mai kommt er, z. B. spät.", "So\nein Tag!"]),
        ("(That was it.) Then we go. (That was all.)", ["(That was it.)", "Then we go.", "(That was all.)"]),
        ("See (cf. Fig. 3.) the map. Done", ["See (cf. Fig. 3.) the map.", "Done"]),
        ("First one.Then another. Open notes.v3.txt now. It is cf. that.", ["First one.", "Then another.", "Open notes.v3.txt now.", "It is cf. that."]),
        ("「今日は無理だ。」と言ってから、測った。待って……比較した。", ["「今日は無理だ。」と言ってから、測った。", "待って……比較した。"]),
        ("老技师说：“今天不行。”为什么？“这是印章吗？”老技师问道。", ["老技师说：“今天不行。”", "为什么？", "“这是印章吗？”老技师问道。"]),
        ("क्या यह सही है? डॉ. सापो बताता है। रुको... वह आता है।", ["क्या यह सही है?", "डॉ. सापो बताता है।", "रुको... वह आता है।"]),
        ("ดร.โปคูโซบรรยาย ค่าเพิ่มจาก60.13เป็น20.43 นาทีที่262ผู้ชม", ["ดร.โปคูโซบรรยาย", "ค่าเพิ่มจาก60.13เป็น20.43", "นาทีที่262ผู้ชม"]),
        ("Проф. Рулупа сравнивает и т. д. по памяти. См. рис. 49 и т. д. Наш гость.", ["Проф. Рулупа сравнивает и т. д. по памяти.", "См. рис. 49 и т. д.", "Наш гость."]),
        ("  ", []),
        (None, []),
        ("", []),
        ('"Never closed. So it goes.', ['"Never closed.', "So it goes."]),
    ],
)
def test_sentences(text, expected):
    assert parts(text) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?…\"“”「」()。\n«»", max_size=60))
def test_sentences_are_ordered_and_cover_all_but_white_space(text):
    at = 0
    for a, b in sentences(text):
        assert at <= a < b <= len(text)
        assert not text[at:a].strip()
        assert text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_very_long_texts_are_walked_once():
    text = "One more. " * 50_000
    assert len(sentences(text)) == 50_000


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("The knife grip 4 / 9", "The knlfe grip 4 / 9.", True),
        ("The knife grip 4 / 9", "The knife grip 5 / 9", False),
        ("Why  does nobody mention it?", "why docs nobody mentlon it", True),
        ("our guest from Nidesa left", "our guest from Nidesa never left", False),
        ("the long journey", "the long joumey", True),
        ("Ｗｈｙ not now", "Why not now", True),
        ("The whole team tests it", "The whole team checks it", False),
        ("主持人检查了合唱排练和八度跳进。", "主持人检查了合排练和八度跳进", True),
        ("整个团队画出了今天的议程。", "整个团队记下了今天的议程。", False),
        ("第28分钟，志愿者比较了通知", "第29分钟，志愿者比较了通知", False),
        ("♪ ♪", "♪♪", True),
        ("♪ ♪", "♪", False),
        ("…", "...", True),
        ("♪", "...", False),
        ("in a minute", "in minute", False),
    ],
)
def test_nearly_same(a, b, same):
    assert nearly_same(a, b) is same
    assert nearly_same(b, a) is same


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance_matches_the_plain_recurrence(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert distance(a, b, 20) == d[len(a), len(b)]


def test_printed_forms():
    assert glyphs.printed("Ｗｈｙ  not​　now") == "Why not now"
    assert glyphs.printed("café") == "café"
    assert glyphs.printed("é") != glyphs.printed("e")


def test_repairs_follow_the_dominant_script():
    latin = glyphs.dominant("the quick brown")
    assert glyphs.proposals("cоffее", latin) == "coffee"
    assert glyphs.proposals("Α", latin) == "A"
    assert glyphs.proposals("кoфe", glyphs.dominant("перерыв на")) == "кофе"
    assert glyphs.proposals("плохо", latin) is None
    assert glyphs.proposals("coffee", latin) is None


def test_tiles_are_longest_first_and_never_overlap():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 14))] for _ in range(2))
        found = leakage.tiles(a, b)
        ina, inb = [], []
        for p, q, n in found:
            assert n >= leakage.TILE
            assert a[p : p + n] == b[q : q + n]
            ina += range(p, p + n)
            inb += range(q, q + n)
        assert len(set(ina)) == len(ina)
        assert len(set(inb)) == len(inb)
        longest = max((n for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        if longest >= leakage.TILE:
            assert found[0][2] == longest
        # nothing of two tokens or more is left unmarked
        free_a, free_b = [-1 if i in ina else x for i, x in enumerate(a)], [-2 if j in inb else x for j, x in enumerate(b)]
        assert not any(free_a[i : i + 2] == free_b[j : j + 2] for i in range(len(a) - 1) for j in range(len(b) - 1))


def test_running_hashes_report_all_maximal_runs():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randint(0, 2) for _ in range(r.randint(0, 30))] for _ in range(2))
        free_a, free_b = (bytearray(r.random() < 0.9 for _ in x) for x in (a, b))
        s = r.randint(2, 4)
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                same = lambda k, i=i, j=j: 0 <= i + k < len(a) and 0 <= j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]
                if same(0) and not same(-1):
                    n = 1
                    while same(n):
                        n += 1
                    if n >= s:
                        want.add((i, j, n))
        assert set(leakage.karp_rabin(a, b, free_a, free_b, s)) == want
        free = [bytearray(b"\x01") * len(x) for x in (a, b)]
        assert set(leakage.karp_rabin(a, b, *free, s)) >= set()


def test_chains_match_brute_force():
    r = random.Random(2)
    for _ in range(100):
        n = r.randint(0, 7)
        at, to = r.sample(range(0, 60, 4), n), r.sample(range(0, 60, 4), n)
        found = [(p, q, r.randint(1, 4)) for p, q in zip(at, to)]
        best = 0
        for mask in range(1 << n):
            part = sorted(f for k, f in enumerate(found) if mask >> k & 1)
            if all(x[1] < y[1] for x, y in zip(part, part[1:])):
                best = max(best, sum(f[2] for f in part))
        chain = leakage.in_order(found)
        assert sum(f[2] for f in chain) == best
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))


ITEM = "A crate in Runesa weighs 44.71 kilos and holds 230 reels, and a viewer questions the lemon glaze only after reel 8 has been rewound. Which statement about Dameni follows from minute 280?"


@pytest.mark.parametrize(
    ("text", "leaks"),
    [
        (ITEM, True),
        (ITEM.lower().replace(",", "").replace(".", " "), True),
        ("Some talk before. " + ITEM.replace("kilos", "um kilos uh") + " And after.", True),
        (ITEM.replace("viewer", "viewr").replace("lemon", "lmeon").replace("Runesa", "Rnuesa"), True),
        ("\n".join(f"[00:{i:02d} - 00:{i + 1:02d}] " + " ".join(ITEM.split()[i : i + 5]) for i in range(0, 35, 5)), True),
        (ITEM.replace("Runesa", "Povida").replace("44.71", "26.34").replace("230", "353").replace("8", "2").replace("Dameni", "Zolupa").replace("280", "11"), False),
        (" ".join(ITEM.split()[:8]), False),
        ("", False),
        (None, False),
        ("nothing of the kind was ever said here by anyone at all", False),
    ],
)
def test_leaks(text, leaks):
    others = [(i, ITEM.replace("Runesa", f"Name{i}").replace("44.71", f"{i}.{i}").replace("230", str(i * 3)).replace("Dameni", f"Other{i}").replace("280", str(i + 7))) for i in range(10, 20)]
    found = leakage.leaks(leakage.Items([(1, ITEM), *others]), text)
    assert ([1] if leaks else []) == [([1, *(i for i, _ in others)])[n] for n, _, _, c, o in found if leakage.is_case(c, o)]


SENTENCES = ["A crate in Runesa weighs 44.71 kilos and holds 230 reels.", "The narrator claims that 289 of 682 listeners in Nepapa remembered the league table.", "Between Kulaba and Kumeku the tram stops 9 times before noon."]


def test_reordered_passages_are_covered_but_not_ordered():
    index = leakage.Items([(1, " ".join(SENTENCES)), (2, "What would Mekuda have to change so that a null pointer no longer matters?")])
    (n, covered, own, ordered, _) = leakage.leaks(index, "Hello. " + " ".join(SENTENCES[::-1]) + " Bye.")[0]
    assert (index.ids[n], own) == (1, 1.0)
    assert covered > 0.95
    assert ordered < 0.6
    (_, covered, _, ordered, _) = leakage.leaks(index, " ".join(SENTENCES))[0]
    assert covered == ordered == 1.0


def test_a_true_passage_is_found_behind_others_of_the_same_phrasing():
    index = leakage.Items([(1, " ".join(SENTENCES))])
    decoy = "A crate in Povida weighs 26.34 kilos and holds 353 reels. The narrator claims that 321 of 308 listeners in Bagoni remembered the league table. " + "Nothing else was said there. " * 30
    found = leakage.leaks(index, decoy * 3 + " ".join(SENTENCES).replace("Kulaba", "Klaba") + " " + decoy * 3)
    assert [round(x[3]) for x in found] == [1]


def test_short_items_and_long_texts():
    index = leakage.Items([(1, "Tedaka 220"), (2, "Rupoba"), (3, "x" * 10)])
    assert {index.ids[r[0]] for r in leakage.leaks(index, "in Tedaka 220 tries") if r[3] >= 0.5} == {1}
    assert {index.ids[r[0]] for r in leakage.leaks(index, "from Rupoba") if r[3] >= 0.5} == {2}
    words = " ".join(f"w{i} of" for i in range(20_000))
    index = leakage.Items([(1, words)])
    assert leakage.leaks(index, words)[0][1:] == (1.0,) * 4


def test_pruning_loses_next_to_nothing():
    """Against the tiling of every passage that has a seed: cases with few edits, and where most words are edited."""
    r = random.Random(6)
    name = lambda: "".join(r.choice("BDFGKLMNPRSTVZ" if k == 0 else "bdfgklmnprstvz") + r.choice("aeiou") for k in range(3))
    things = ["lemon glaze", "league table", "orbit diagram", "lava chart", "bass line"]
    make = [
        lambda: f"A crate in {name()} weighs {r.randint(1, 99)} kilos and holds {r.randint(1, 999)} reels of the {r.choice(things)}.",
        lambda: f"The narrator claims that {r.randint(1, 999)} listeners in {name()} remembered the {r.choice(things)} at once.",
        lambda: f"Between {name()} and {name()} the tram stops {r.randint(2, 12)} times for the {r.choice(things)}.",
    ]
    texts = [" ".join(m() for m in r.sample(make, 3)) for _ in range(12)]
    index = leakage.Items(list(enumerate(texts)))
    ok = lambda found: {index.ids[x[0]] for x in found if leakage.is_case(x[3], x[4])}
    cases, kept = 0, 0
    for n in range(300):
        words = r.choice(texts).split()
        lo = r.randint(0, len(words) // 2)
        words = words[lo : lo + r.randint(len(words) // 3, len(words))]
        for _ in range(r.randint(0, 4 if n % 2 else 12)):
            k = r.randrange(len(words))
            words[k] = r.choice([words[k][:2] + words[k][3:], "uh " + words[k], r.choice(texts).split()[k % 20]])
        text = " ".join([make[0](), *words, make[1]()])
        full = ok(leakage.leaks(index, text, pruned=False))
        found = ok(leakage.leaks(index, text))
        assert found <= full
        cases += len(full)
        kept += len(found)
    assert cases > 100
    assert kept >= 0.9 * cases


@pytest.mark.parametrize("text", ["word 12. März " * 70_000, "(" * 100_000 + '\u201d"' * 50_000, 'a "b. ' * 100_000, "No. 5 \"x\" " * 60_000, "1. " * 200_000])
def test_long_texts_are_cut_in_linear_time(text):
    began = time.perf_counter()
    sentences(text)
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("1. Open the door. 2. Close it.", ["1. Open the door.", "2. Close it."]),
        ("a. Open the door. b. Close it.", ["a. Open the door.", "b. Close it."]),
        ("i. Open it. ii. Close it. iii. Go.", ["i. Open it.", "ii. Close it.", "iii. Go."]),
        ("1. Open it. a. Push. b. Pull. 2. Close it.", ["1. Open it.", "a. Push.", "b. Pull.", "2. Close it."]),
        ("1.2. Open the door. 1.3. Close it.", ["1.2. Open the door.", "1.3. Close it."]),
    ],
)
def test_list_markers_belong_to_their_items(text, units):
    assert [text[a:b] for a, b in sentences(text)] == units


def test_language_switches_are_the_cheapest_path():
    import itertools

    import numpy as np

    r = random.Random(3)
    for _ in range(60):
        cost = np.array([[r.randint(0, 9) for _ in range(3)] for _ in range(r.randint(1, 6))], np.float32)
        best = min(sum(cost[k, l] for k, l in enumerate(p)) + 4 * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=len(cost)))
        cuts = [0, *languages.switches(cost, 4.0), len(cost)]
        assert sum(cost[a:b].sum(axis=0).min() for a, b in zip(cuts, cuts[1:])) + 4 * (len(cuts) - 2) == best


def test_decorated_texts_are_nearly_the_same():
    assert events.nearly_same("Right", "[[ Right ]] ... !!! \u266a\u266a")
    assert events.nearly_same("Ok, so let us go", "\u200b".join("Ok, so let us go"))
    text = "今天我们学习" * 2000
    assert events.nearly_same(text, text[:300] + "刁" + text[301:])
    assert not events.nearly_same(text, text[:300] + "不是这样的话" + text[300:])


def test_pairs_of_tokens_are_forgotten_and_settled_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PAIRS", 50)
    small = tokens.Encoder(f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken")
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(40)]
    flat = [small.encode_batch([t])[0] for t in texts]
    assert len(small.pairs) < 2000
    monkeypatch.setattr(tokens, "KEPT_PAIRS", 10**9)
    large = tokens.Encoder(f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken")
    assert flat == [large.encode_batch([t])[0] for t in texts]
