"""Operators on texts: encoding, leakage, garbled characters."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import garble
from ledgerline.llm.leakage import leaked
from ledgerline.llm.tokenize import VOCABULARY, WordEncoder, encode_corpus, load_vocabulary
from ledgerline.llm.words import column_words

# ---- words -------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 .éİK 日\n", max_size=30)), max_size=8))
def test_words_equal_a_regular_expression(texts):
    got: dict[int, list[str]] = {}
    for w in column_words(pa.array(texts, pa.string())):
        for i, t in enumerate(w.text):
            got.setdefault(w.first + int(t), []).append(w.word(i))
    for i, t in enumerate(texts):
        assert got.get(i, []) == re.findall("[a-z0-9]+", (t or "").lower())


# ---- 7 -----------------------------------------------------------------------------------------------------------

TEXTS = [
    "Hello world, it's 2024's  best\n\n test!", "", None, "<|endoftext|> is text", "naïve café — “quoted” €38.9", "経営陣は当四半期に保証引当金", "   leading", "x" * 1000,
    "ab" * 3000 + "!" * 700, " \n \t ", "​﻿", "नमस्ते دقائق", "1234567890" * 60,
]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_library(spark, tokenizer):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    want = sorted((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in [*enumerate(TEXTS), (0, TEXTS[0])])
    assert got == want
    assert all(tokenizer.decode(ids) == (TEXTS[i] or "") for i, ids in got if i not in (10,))
    assert encode_corpus(df.where("false")).count() == 0


def test_long_words_go_through_the_query_like_others(tokenizer):
    """Words of 5,000 bytes and more, of many kinds, and runs of one character of every parity."""
    enc = WordEncoder(*load_vocabulary())
    rnd = random.Random(1)
    words = {"".join(rnd.choice("aehlorst éñ日").strip() or "a" for _ in range(rnd.randrange(1, 120))) for _ in range(60)}
    words |= {"".join(rnd.choice("etaoinshrdlu") for _ in range(5_000)), "".join(rnd.choice("日本語東京都") for _ in range(7_000))}
    words |= {c * n for c in "a日é" for n in (1, 2, 3, 5, 31, 5_000)}
    enc.learn(words)
    for w in words:
        assert enc.store[w] == tokenizer.encode(w, add_special_tokens=False).ids



# ---- 8 -----------------------------------------------------------------------------------------------------------


def test_leakage_equals_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([5, 11, 12, 30]))) for i in range(25)] + [(50, None), (51, ""), (None, text(20)), (3, text(15))]
    docs = [(i, text(rnd.randrange(60))) for i in range(60)] + [(100, None), (101, ""), (None, items[0][1])]
    for k in range(60):
        w = rnd.choice(items)[1] or ""
        w = w.split()
        a = rnd.randrange(len(w)) if w else 0
        docs.append((200 + k, text(9) + "... " + ", ".join(w[a : a + rnd.choice([11, 12, 13, 25])]).upper() + "; " + text(4)))
    docs += [(500, text(100_000) + " " + items[3][1]), docs[70]]
    grams = lambda t: {tuple(w[j : j + 12]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for j in range(len(w) - 11)}
    have = [(i, grams(t)) for i, t in items if i is not None]
    want = {(d, i) for d, t in docs if d is not None for g in [grams(t)] for i, x in have if g & x}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, fp string")
    it = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, item_text string, gram string")
    got = [tuple(r) for r in leaked(df, it).collect()]
    assert set(got) == want and len(got) == len(want)
    assert leaked(df.where("false"), it).count() == 0 and leaked(df, it.where("false")).count() == 0


# ---- 9 -----------------------------------------------------------------------------------------------------------


def sloppy(text, codec):
    back = {b: c for c, b in garble.char_bytes(codec).items()}
    return "".join(back[b] for b in text.encode("utf-8"))


def swapped(text, written, read):
    back = {b: c for c, b in garble.char_bytes(read).items()}
    return "".join(c if c.isascii() else back[garble.char_bytes(written)[c]] for c in text)


CLEAN = [
    "Counsel for Guimarelães called the “valued” plant — closed", "The café in Zürich–Malmö was sold for €38.9 million", "La dirección registró las pólizas vencidas", "Gläubigerversammlung prüfte die übrigen Erträge",
    "The board’s naïve résumé of events", "L’établissement prêteur a réduit les coûts", "NÃO AUDITADO é Ç Ü–Ä É”", "Вектор-Прибор и Ελλάδα", "当四半期に保証引当金を再評価した。", "plain text only",
]


def corpus():
    docs = [(i, t) for i, t in enumerate(CLEAN * 6)]
    bad = []
    for k, t in enumerate(CLEAN[:6]):
        bad += [(1000 + k, sloppy(t, "cp1252")), (1010 + k, sloppy(sloppy(t, "cp1252"), "cp1252")), (1020 + k, sloppy(t, "mac_roman")), (1030 + k, "Fine first half. " + sloppy(t, "latin-1"))]
        bad.append((1040 + k, swapped(t, "cp1252", "mac_roman")))
    bad += [(1100, "Malm�ren fell"), (1101, sloppy("﻿The plain", "cp1252")), (1102, sloppy(CLEAN[8], "cp1252"))]
    return docs, bad, [(2000, None), (2001, ""), (2002, " "), (None, bad[0][1])]


def test_garbled_documents_are_found_and_restored(spark):
    docs, bad, odd = corpus()
    df = spark.createDataFrame([(*x, 1) for x in docs + bad + odd + bad[:1]], "doc_id bigint, text string, n int").repartition(3)
    learned = garble.Learned(df)
    assert {"cp1252", "mac_roman", "latin-1"} <= set(learned.codecs) and "cp1252>mac_roman" in learned.swaps
    got = [r.doc_id for r in garble.garbled(df, learned).collect()]
    assert len(got) == len(set(got)) and set(got) == {i for i, _ in bad}
    back = {r.doc_id: (r.restored, r.whole) for r in garble.restored(df).collect()}
    assert set(back) == set(got)
    assert all(back[1000 + k][0] == back[1010 + k][0] == back[1020 + k][0] == back[1040 + k][0] == t for k, t in enumerate(CLEAN[:6]))
    assert back[1100][1] is False and back[1000][1] is True and back[1101][0] == "The plain"


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "caf�"), (2, "plain"), (3, None)], "doc_id bigint, text string")
    assert [r.doc_id for r in garble.garbled(df).collect()] == [1]
    assert garble.garbled(df.where("false")).count() == 0


def test_alignment():
    assert garble.align("GuimarelÃ£es", "Guimarelães") == [("Ã£", "ã")]
    assert garble.align("abÃ£", "aãb") is None
    assert "cp1252" in garble.explain("Ã£", "ã")[0] and garble.explain("ã", "Ã£") == ([], [])


def test_a_text_misread_five_times_is_explained_and_restored():
    from ledgerline.llm.garble import explain, restore_text

    bad, mapping = "café", {}
    for _ in range(5):
        bad = "".join(c if c.isascii() else c.encode("utf-8").decode("latin-1") for c in bad)
    assert "latin-1" in explain(bad.removeprefix("caf"), "é")[0]
    mapping = {c.encode("utf-8").decode("latin-1"): c for c in map(chr, range(0x80, 0x100))}
    assert restore_text(bad, mapping, {}) == "café"


def test_long_garbled_neighbours_give_the_same_key():
    from ledgerline.llm.garble import twin_key

    for x in ("é", "Ã©"):
        text = "a" * 60 + x + " ß " + x + "b" * 60
        at = text.index("ß")
        assert twin_key(text, at, at + 1) == ("a" * 60 + "  " + "b" * 60, "ß")
