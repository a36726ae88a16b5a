"""Problems 7, 8 and 9: packing, leaks, look-alikes."""

import random
import sys
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hodograph.llm import leaks, lookalike, packing
from hodograph.runtime import Scratch

from ..conftest import rows


# --- look-alikes ----------------------------------------------------------------------------------------------------
PLAIN = lookalike.Canon()


@pytest.mark.parametrize("a,b", [
    ("abc", "ａｂｃ"), ("é", "é"), ("é", "е́"), ("a b", "a b"), ("ab", "a​b"), ("é", "e​́"), ("Ho", "Нο"),
    ("ế", "ế"), ("ế", "е̂‍́"), ("ệ", "ệ"), ("й", "й"), ("ё", "ë"), ("K", "K"), ("가", "가"), ("", "​﻿"), ("x y", "x　y"),
])
def test_same_look(a, b):
    assert PLAIN(a) == PLAIN(b)


@pytest.mark.parametrize("a,b", [("a", "b"), ("e", "é"), ("A", "a"), ("1", "l"), ("O", "0"), ("a\nb", "a b"), ("rn", "m"), ("a  b", "a b"), ("и", "й"), ("²", "2"), ("", " "), ("①", "1"), ("ſ", "s"), ("ㄱㅏ", "가")])
def test_other_look(a, b):
    assert PLAIN(a) != PLAIN(b)


def test_frequency_chooses_the_representative():
    cyrillic = lookalike.Canon({"а": 10, "a": 1, "é": 5, "é": 1})
    assert cyrillic("a") == "а" and cyrillic("é") == cyrillic("е́") == "é" and PLAIN("а") == "a"


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoаеоéёẹ̣́̂​ ｅ Kн"), max_size=12))
def test_one_form(text):
    form = PLAIN(text)
    assert PLAIN(form) == form
    assert PLAIN(unicodedata.normalize("NFD", text)) == form == PLAIN(unicodedata.normalize("NFC", text))
    assert form == PLAIN.whole(text)  # by pieces or as a whole


COMPOSED = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.normalize("NFD", c) != c]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*COMPOSED, "a", "е", "\u0301", "\u0323", "\u034f", "ﬁ", "Ⅳ", "ﾞ", "ｶ", "ᄀ", "ᅡ", "𝐇"]), max_size=8).map("".join))
def test_one_form_of_composed(text):
    form = PLAIN(text)
    assert PLAIN(form) == form == PLAIN.whole(text)
    assert PLAIN(unicodedata.normalize("NFD", text)) == form == PLAIN(unicodedata.normalize("NFC", text))


def test_every_composed_character_has_the_form_of_its_parts():
    assert [c for c in COMPOSED if PLAIN(c) != PLAIN(unicodedata.normalize("NFD", c)) or PLAIN(PLAIN(c)) != PLAIN(c)] == []
    pairs, _ = lookalike.relations()
    assert [p for p in pairs if PLAIN(p[0]) != PLAIN(p[1])] == []


def test_public_letters(spark):
    """The public table adds letters, keeps the fixed ones, and lets no two letters of a script fall together."""
    got = lookalike.alike_letters(spark)
    assert set(lookalike.listed()) <= set(got) and len(got) > 100
    canon = lookalike.Canon(alike=got)
    greek, cyrillic = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    for letters in (greek, cyrillic, greek.upper(), cyrillic.upper()):
        assert len({canon(c) for c in letters}) == len(letters)
    assert canon("Ⲥ") == canon("C") and canon("σ") != canon("o") and canon("1") != canon("l")


def test_kinds_can_be_added():
    assert lookalike.Canon(kinds=lookalike.KINDS | {"circle"})("ⓗ") == "h" != PLAIN("ⓗ")


def test_lookalike_pairs(spark):
    data = [
        (1, "abc"), (2, "ａbc"), (3, "abc"), (4, "a​bc"), (5, "abd"), (6, None), (7, ""), (8, "​"), (9, ""), (None, "abc"), (2, "ａbc"),
        (10, "x" * 300_000 + "é"), (11, "x" * 300_000 + "é"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, rep string")
    pairs, members = lookalike.lookalikes(df)
    got = set(map(tuple, lookalike.expand_pairs(pairs, members, inner=False).collect()))
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8), (8, 9), (10, 11)}
    forms = {r.id: r.form for r in lookalike.canonical_text(df).collect()}
    assert forms[2] == "abc" and forms[8] == "" and 6 not in forms
    assert lookalike.lookalikes(df.limit(0))[0].count() == 0


# --- leaks ----------------------------------------------------------------------------------------------------------
WORDS = [f"{a}{b}{c}" for a in ("bra", "dol", "fen", "gri", "hap") for b in ("mo", "nu", "ti", "le") for c in ("st", "nd", "rk")]


def brute_leaks(doc, item):
    """Longest case by trying every alignment and window."""
    w, v = [x.lower().strip(".,!?") for x in doc.split()], [x.lower().strip(".,!?") for x in item.split()]
    best = 0
    for shift in range(-len(v) + 1, len(w)):
        for a in range(len(v)):
            for b in range(a + 12, len(v) + 1):
                if a + shift < 0 or b + shift > len(w):
                    continue
                kinds = [0 if x == y else (1 if leaks.misspelt(x, y) else 9) for x, y in zip(v[a:b], w[a + shift : b + shift])]
                ends = [x == y or leaks.slip(x, y) for x, y in ((v[a], w[a + shift]), (v[b - 1], w[b - 1 + shift]))]
                if 9 not in kinds and all(ends) and 8 * sum(kinds) <= b - a:
                    best = max(best, b - a)
    return best


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(20, 40)))) for i in range(6)]
    docs = []
    for d in range(60):
        filler = lambda n: [r.choice(WORDS) + "x" for _ in range(n)]
        words = items[r.randrange(6)][1].split()
        a = r.randrange(0, 9)
        part = words[a : a + r.choice([6, 11, 12, 16, 24])]
        for k in range(len(part)):
            if r.random() < 0.08:
                part[k] = part[k][:2] + "q" + part[k][3:]
        docs.append((d, " ".join([*filler(r.randrange(8)), *part, *filler(r.randrange(8))])))
    got = {(x.doc_id, x.item_id): x.n_words for x in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): n for d, t in docs for i, v in items if (n := brute_leaks(t, v))}
    assert got == want and len(want) > 10


ITEM = "Of mesteast fotron what light in now preapeam grivoclear what just like vufaind doopra"


def test_leaks_through_subtitle_styles(spark):
    w = ITEM.split()
    subtitle = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Of MESTEAST,</i> [door\r\ncreaks] fotron what\r\n\r\n2\r\n00:00:03.000 -> 00:00:04.000 align:start\r\n{\\an8}NONNA: light in (laughs) now prea­peam\r\n\r\n3\r\n*bang* griv​oclear what just, like vufaind doopra"
    data = [
        (1, subtitle), (2, ITEM.replace("e", "е").upper()), (3, " ".join(w[:11])), (4, " ".join(sorted(w))), (5, None), (6, ""), (7, "ｏｆ " + " ".join(w[1:])),
        (8, ITEM.replace("light", "l1ght")), (9, ITEM.replace("light", "l1ght").replace("now", "nvw")), (None, ITEM), (1, subtitle), (10, "x " * 200_000 + ITEM),
    ]
    docs = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (None, ITEM)], "item_id long, text string")
    found = leaks.find_leaks(docs, items)
    got = {r.doc_id: r for r in found.collect()}
    assert got.keys() == {1, 2, 7, 8, 10} and got[1].n_words == 14 and subtitle[got[1].start :].startswith("Of") and subtitle[: got[1].stop].endswith("doopra")
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0 and leaks.find_leaks(docs.limit(0), items).count() == 0
    blocks = leaks.find_leaks(docs, items.union(items.withColumn("item_id", F.col("item_id") + 10)), block_chars=150)
    assert {(r.item_id, r.doc_id) for r in blocks.collect()} == {(i, d) for i in (1, 11) for d in got}
    clean = {r.doc_id: r for r in leaks.remove_spans(docs.dropDuplicates(["doc_id"]), found).collect()}
    assert clean[10].text == "x " * 200_000 and clean[3].n_removed == 0 and clean[5].text is None


def test_overlapping_spans_go_once(spark):
    docs = spark.createDataFrame([(1, "0123456789")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 1, 2, 5), (2, 1, 4, 7), (3, 1, 8, 9)], "item_id long, doc_id long, start long, stop long")
    r = leaks.remove_spans(docs, spans).first()
    assert (r.text, r.n_removed) == ("0179", 6)


def test_edit_distance():
    assert leaks.edits("kitten", "sitting", 5) == 3 and leaks.edits("abc", "abcdefgh", 2) == 3
    assert leaks.misspelt("in", "m") and not leaks.misspelt("gadir", "por")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 0, 0, 1, 2]), max_size=60), st.randoms())
def test_stretch_is_the_longest(kinds, r):
    end = [k == 0 or (k == 1 and r.random() < 0.5) for k in kinds]
    n = len(kinds)
    best = max((b - a for a in range(n) for b in range(a + 12, n + 1) if end[a] and end[b - 1] and 2 not in kinds[a:b] and 8 * sum(kinds[a:b]) <= b - a), default=0)
    got = leaks.stretch(np.array(kinds, dtype=np.int64), np.array(end, dtype=bool))
    assert (got[1] - got[0] if got else 0) == best


def test_leaks_at_the_ends_and_without_blanks(spark):
    """Twelve words of which the last is misspelt, eleven with a like neighbour, and text of a script without blanks."""
    words = [w + "en" for w in WORDS[:30]]
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张"
    items = spark.createDataFrame([(1, " ".join(words)), (2, han)], "item_id long, text string")
    wrong = words[15][:-1] + "x"
    docs = [(1, " ".join(["zzz", *words[4:15], wrong, "qqq"])), (2, " ".join(["zzz", *words[4:15], "so"])), (3, "，".join([han[:7], han[7:13]])), (4, han[:11])]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert rows(got.select("item_id", "doc_id", "n_words")) == [(1, 1, 12), (2, 3, 13)]


# --- packing --------------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 50)), max_size=80), st.integers(50, 80))
def test_packing_places_everything(items, capacity):
    data = [(s, i, 0, n) for i, (s, n) in enumerate(items)]
    out = packing.pack(data, capacity, {"a": 0.5, "b": 0.3, "c": 0.2}, {})
    assert sorted((s, i, p, n) for _, _, s, i, p, n in out) == sorted(data)
    load = {}
    for w, _, _, _, _, n in out:
        load[w] = load.get(w, 0) + n
    assert all(x <= capacity for x in load.values())
    full = sorted(load.values())
    assert len(full) < 2 or full[0] + full[1] > capacity  # no two windows would fit into one


def test_mixture_follows_targets():
    r = random.Random(0)
    items = [(s, i, 0, r.randint(5, 60)) for i, s in enumerate("a" * 600 + "b" * 300 + "c" * 100)]
    total = sum(x[3] for x in items)
    share = {s: sum(x[3] for x in items if x[0] == s) / total for s in "abc"}
    out = packing.pack(items, 256, share, {})
    last = max(x[0] for x in out)
    for cut in (last // 4, last // 2):
        part = [x for x in out if x[0] <= cut]
        for s in "abc":
            got = sum(x[5] for x in part if x[2] == s) / sum(x[5] for x in part)
            assert got == pytest.approx(share[s], abs=0.05)
    assert total / ((last + 1) * 256) > 0.95


def test_pack_texts(spark):
    r = random.Random(1)
    counts = spark.createDataFrame([(i, r.choice(["a", "b", ""]), r.choice([0, 3, 40, 100, 257, 1000])) for i in range(500)], "id long, source string, tokens long")
    kinds = spark.createDataFrame([(1, 100), (2, 256), (3, None), (4, 0), (1, 100)], "container_id int, capacity int")
    got = packing.pack_texts(counts, kinds, Scratch(spark, "t"), part_rows=100).collect()
    want = {c.id: c.tokens for c in counts.collect() if c.tokens}
    for kind, cap in ((1, 100), (2, 256)):
        mine = [g for g in got if g.container_id == kind]
        sums, load = {}, {}
        for g in mine:
            sums[g.id] = sums.get(g.id, 0) + g.tokens
            load[g.part, g.window] = load.get((g.part, g.window), 0) + g.tokens
            assert want[g.id] > cap or g.piece == 0
        assert sums == want and max(load.values()) <= cap and len({g.part for g in mine}) > 3
    assert {g.container_id for g in got} == {1, 2}
    assert packing.pack_texts(counts.limit(0), kinds, Scratch(spark, "t")).count() == 0
    assert packing.pack_texts(counts, kinds.filter("container_id > 2"), Scratch(spark, "t")).count() == 0


def test_token_counts(spark):
    data = [(1, "one two three", "s"), (2, "", "s"), (3, None, None), (4, "word " * 50_000, None), (1, "one two three", "s"), (None, "x", "s"), (5, "<|endoftext|> é 日本", "s")]
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, source string, id int")
    got = {r.id: (r.source, r.tokens) for r in packing.token_counts(df, "doc_id", "text", "source").collect()}
    assert got.keys() == {1, 4, 5} and got[1] == ("s", 3) and got[4][0] == "" and got[4][1] >= 50_000
    e = packing.tokenizer(packing.TOKENIZER)
    assert e.decode(e.encode_ordinary("héllo  wörld")) == "héllo  wörld"
