"""Operators on records: survivorship, splitting, near-duplicates, nearest time."""

import random
import zlib
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import neardup
from ledgerline.llm.nearest_time import nearest_in_time
from ledgerline.llm.neardup import near_duplicates
from ledgerline.llm.splitting import LIMIT, OVERLAP, block_starts, boundary_of, split_oversized, split_text, squeeze
from ledgerline.llm.survivorship import best_facts
from ledgerline.llm.words import column_words

D0 = date(2021, 1, 1)

# ---- 1 -----------------------------------------------------------------------------------------------------------

FACT = "fact_id bigint, company_cik string, company_ticker string, concept string, val double, unit string, fiscal_year int, fiscal_period string, period_end_date date, filed_date date, source string, source_tag string, accession_number string, priority string"


def fact(i, val=1.0, source="xbrl", tag="us-gaap:A", filed=D0, acc="0000000001-24-000001", cik=" 007", concept="Revenue ", year=2024, period="q1"):
    return (i, cik, None, concept, val, "USD", year, period, None, filed, source, tag, acc, "clash")


def survivors(spark, rows, tags=(("revenue", "A", 1), ("revenue", "B", 2))):
    t = spark.createDataFrame(list(tags), "concept string, source_tag string, priority int")
    return sorted((r.fact_id, r.accession_number) for r in best_facts(spark.createDataFrame(rows, FACT), t).collect())


def test_survivor_order(spark):
    nan = float("nan")
    assert survivors(spark, [fact(1, nan), fact(2, 3.0, "html")]) == [(2, "0000000001-24-000001")]
    assert survivors(spark, [fact(1, source="html"), fact(2)]) == [(2, "0000000001-24-000001")]
    assert survivors(spark, [fact(1, tag="B"), fact(2, tag="x:A"), fact(3, tag=None)])[0][0] == 2
    assert survivors(spark, [fact(1, filed=None), fact(2, filed=D0), fact(3, filed=D0 + timedelta(1))])[0][0] == 3
    assert survivors(spark, [fact(5), fact(4), fact(4)])[0][0] == 4


def test_gaps_keys_and_empties(spark):
    assert survivors(spark, [fact(1, acc=None), fact(2, acc="000000000924000007", source="html")]) == [(1, "0000000009-24-000007")]
    assert survivors(spark, [fact(1, acc=" "), fact(2, acc=None)]) == [(1, "")]
    assert survivors(spark, [fact(1)]) == [] and survivors(spark, [fact(1, None), fact(2, float("inf"))]) == []
    assert survivors(spark, [fact(1, cik="7"), fact(2, cik="0000000007", concept="REVENUE", period=" Q1")]) == [(1, "0000000001-24-000001")]
    assert survivors(spark, [fact(1, year=None), fact(2, year=None), fact(3, cik=None), fact(4, cik="x")]) == []
    assert best_facts(spark.createDataFrame([], FACT), spark.createDataFrame([], "concept string, source_tag string, priority int")).count() == 0


# ---- 2 -----------------------------------------------------------------------------------------------------------


def check_pieces(text, limit, overlap, blocks=None):
    cuts = split_text(text, limit, overlap, blocks)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(cuts, cuts[1:]):
        assert a < c and b < d, "pieces move on"
        assert c <= b + 1 and b - c <= overlap
        assert c == b or c < b or text[b] == " "
    assert all(0 < b - a <= limit for a, b, _ in cuts)
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from(["", "", ".", "?"])), min_size=1, max_size=60), st.integers(8, 50), st.integers(0, 7))
def test_pieces_cover_within_the_limit(words, limit, overlap):
    text = " ".join("x" * n + end for n, end in words)
    check_pieces(text, limit, overlap)


def test_cuts_prefer_coarse_boundaries():
    text = "aa bb. cc dd. ee ff."
    assert [text[a:b] for a, b, _ in split_text(text, 13, 0)] == ["aa bb. cc dd.", "ee ff."]
    assert [text[a:b] for a, b, _ in split_text(text, 13, 6)] == ["aa bb. cc dd.", "cc dd. ee ff."]
    text = "a" * 10 + " " + "b" * 10 + " " + "c" * 10
    assert [c for _, _, c in split_text(text, 21, 0, [11, 22])] == ["section", "block"]
    assert [c for _, _, c in split_text(text, 21, 0, [11, 22], [22])] == ["section", "section"]
    assert [b - a for a, b, _ in split_text("z" * 100, 30, 5)][:2] == [25, 30]


def test_squeeze_and_blocks():
    assert squeeze("  a \n\n b\tc ") == ("a b c", [2])
    assert squeeze("")[0] == "" and squeeze(" \n ")[0] == ""
    known = lambda *x: [(len(t or ""), zlib.crc32((t or "").encode()), s) for t, s in x]
    assert block_starts("aa bb cc", known(("aa", "x"), (None, "y"), ("bb", "x"), ("cc", "z"))) == ([3, 6], [6])
    assert block_starts("aa bb", known(("xx", "x"))) == ([], []) and block_starts("aa", None) == ([], [])


def test_boundary():
    assert boundary_of("ab cd. " * 300 + "x.") == "sentence"
    assert boundary_of("abc " * 500) == "word"
    assert boundary_of("a b. " + "x" * 1501) == "none"


def test_split_oversized(spark):
    long = "Some words here. " * 200
    rows = [(1, "a", "s", long, " Prose", [0, 1, 2], "clash"), (1, "a", "s", long, "prose", None, "clash"), (2, None, None, "x" * 200_000, "prose", [5], ""), (3, "a", "s", long, "table", [0], ""), (4, "a", "s", None, "prose", [0], ""), (5, "a", "s", "", None, [0], ""), (6, "a", "s", " " * 3000, "prose", [0], "")]
    chunks = spark.createDataFrame(rows, "chunk_key bigint, accession_number string, section string, text string, kind string, source_orders array<int>, piece string")
    part = "Some\u00a0words  here. "
    blocks = spark.createDataFrame([(1, "a", "A", part * 80, 0), (2, "a", "B", part * 80, 1), (3, "a", "B", None, 1), (4, None, None, "q", 5), (5, "a", "B", part * 40, 2)], "block_id bigint, accession_number string, section string, text string, block_order int")
    got = split_oversized(chunks, blocks).collect()
    assert {r.chunk_key: r.boundary for r in got} == {1: "sentence", 2: "none"}
    assert sum(r.piece_no == 0 for r in got if r.chunk_key == 1) == 2
    assert all(len(r.piece) <= LIMIT for r in got)
    assert sum(len(r.piece) for r in got if r.chunk_key == 2) <= 200_000 * LIMIT / (LIMIT - OVERLAP) + LIMIT
    assert sorted((r.piece_no, r.cut) for r in got if r.chunk_key == 1 and r.piece_no > 0) == [(1, "block"), (1, "sentence"), (2, "block"), (2, "sentence")]
    assert split_oversized(chunks.where("false"), blocks).count() == 0
    assert split_oversized(chunks, blocks.where("false")).count() == len(got)


# ---- 3 -----------------------------------------------------------------------------------------------------------


def shingles(text):
    import re

    w = re.findall("[a-z0-9]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def pairs_of(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    sets = [x for x in sets if x[1]]
    return {(min(a, b), max(a, b)) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if a != b and 8 * len(x & y) >= 3 * (len(x) + len(y))}


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(999)}"
    return " ".join(w)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id bigint, text string, bucket int")
    return sorted(tuple(r) for r in near_duplicates(df).collect())


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(None, "a b c d e"), (900, None), (901, ""), (902, "one two"), (903, "Not applicable today"), (904, "not APPLICABLE, today."), (905, "N/A " * 50000)]
    for base in range(12):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([6, 40, 90, 300]))]
        for k in range(6):
            rows.append((base * 10 + k, edited(rnd, words, rnd.randrange(0, len(words) // 8 + 1))))
        rows.append((base * 10 + 6, rows[-1][1].upper().replace(" ", "\n")))
    got = found(spark, rows)
    assert len(got) == len(set(got))
    assert set(got) == pairs_of(rows)


def test_large_buckets_go_through_tiles(spark, monkeypatch):
    """More like texts than a tile holds: every pair of a bucket is still compared."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(120)]
    rows = [(i, edited(rnd, words, 2)) for i in range(300)]
    assert set(found(spark, rows)) == pairs_of(rows)


def test_the_order_keeps_the_most_frequent_shingles(spark, monkeypatch):
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, edited(rnd, words[: rnd.randrange(20, 60)], 2)) for i in range(80)]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    known, often, _ = neardup.shingle_order(texts)
    monkeypatch.setattr(neardup, "ORDERED", 15)
    few, n, _ = neardup.shingle_order(texts)
    assert 0 < len(few) <= 15 and min(n) >= sorted(often)[-16] and set(few.tolist()) <= set(known.tolist())
    assert set(found(spark, rows)) == pairs_of(rows)


def test_repeats_and_empty_table(spark):
    assert found(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d")]) == [(1, 2), (1, 2)]
    assert found(spark, []) == []


def test_signatures_never_rule_out_a_similar_pair():
    import pyarrow as pa

    rnd = random.Random(2)
    words = [f"w{k}" for k in range(100)]
    texts = [edited(rnd, words, rnd.randrange(12)) for _ in range(120)]
    (w,) = column_words(pa.array(texts))
    text, first, tokens = neardup.shingle_sets(w)
    n = np.diff(np.r_[first, len(tokens)])
    sig = neardup.signatures(n, tokens, 256)
    i, j = neardup.compare_tiles(sig, n, sig, n, Fraction(3, 5), True)
    assert pairs_of(list(enumerate(texts))) <= set(zip(i.tolist(), j.tolist()))


def test_signatures_fold_to_those_of_half_the_bits():
    rng = np.random.default_rng(3)
    tokens, n = rng.integers(0, 1 << 32, 700, dtype=np.uint32), np.array([100, 600])
    assert (neardup.fold(neardup.signatures(n, tokens, 1024), 2) == neardup.signatures(n, tokens, 128)).all()


@pytest.mark.parametrize("hot", [1 << 62, 50, 1])
def test_prefixes_and_tiles_lose_no_pair(hot):
    """Sets over a few shingles of very unlike frequency; every similar pair shares a key that both can lead to."""
    rng, t = np.random.default_rng(hot % 1000), Fraction(3, 5)
    sets = [np.unique((40 * rng.random(rng.integers(1, 60)) ** 2).astype(np.uint32)) for _ in range(400)]
    sets = [np.array(x, np.uint32) for x in {tuple(x.tolist()) for x in sets}]
    size, tokens = np.array([len(x) for x in sets]), np.concatenate(sets)
    known, often = np.unique(tokens, return_counts=True)
    own, key, most = neardup.prefixes(size, tokens, (known, often), t, hot)
    most = neardup.unpack_most(neardup.pack_most(most, size[own], t), size[own], t)
    sig = neardup.Signatures(size, {128: (np.arange(len(size)), neardup.signatures(size, tokens, 128))})
    sort = np.lexsort((size[own], key))
    own, key, most = own[sort], key[sort], most[sort]
    found = set()
    for i, j in neardup.tile_pairs(key, size[own], sig.population()[own], most, t):
        x, y = sig.near(own[i], own[j], neardup.radius(size[own[i]], size[own[j]], t))
        found |= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 8 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (size[a] + size[b])}
    assert len(near) > 50 and near <= found


def test_encoded_tokens_round_trip():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32)) for n in (1, 2, 7, 8, 9, 80, 3000)] + [np.array([0, 2**32 - 1], np.uint32)]
    size = np.array([len(x) for x in sets])
    known = np.unique(np.concatenate([rng.integers(0, 1 << 32, 1 << 19, dtype=np.uint32), *(x[::2] for x in sets[:6])]))
    for listed in (known, np.empty(0, np.uint32)):
        coded = neardup.encode_tokens(size, np.concatenate(sets), listed)
        n, tokens = neardup.decode_tokens(pa.array(coded, pa.binary()), listed)
        assert n.tolist() == size.tolist()
        assert all(sorted(x.tolist()) == y.tolist() for x, y in zip(np.split(tokens, np.cumsum(n)[:-1]), sets))


def test_no_pair_at_the_threshold_is_lost(spark):
    """Pairs of exactly 0.6, of like and of unlike size, among texts that share frequent shingles."""
    rnd, rows = random.Random(11), []
    common = [f"c{k}" for k in range(30)]
    for base in range(1500):
        own = [f"b{base}x{k}" for k in range(rnd.choice([52, 62]))]
        kept = 3 * (len(own) + 28) // 5 - 28
        rows.append((2 * base, " ".join(common + own)))
        rows.append((2 * base + 1, " ".join(common + own[:kept])))
    for base in range(1500):
        a, b, both = ([f"{s}{base}y{k}" for k in range(n)] for s, n in (("l", 10), ("r", 10), ("m", 32)))
        rows.append((4000 + 2 * base, " ".join(a + both)))
        rows.append((4001 + 2 * base, " ".join(b + both)))
    sets = {i: shingles(x) for i, x in rows}
    near = [(i, i + 1) for i in range(0, 7000, 2) if i in sets and 8 * len(sets[i] & sets[i + 1]) >= 3 * (len(sets[i]) + len(sets[i + 1]))]
    exact = [p for p in near if 5 * len(sets[p[0]] & sets[p[1]]) == 3 * len(sets[p[0]] | sets[p[1]])]
    assert len(exact) == 3000
    assert set(near) <= set(found(spark, rows))


@pytest.mark.parametrize("large", [1, 40])
def test_buckets_over_the_limit_are_dealt(spark, large):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(150)]
    rows = [(i, edited(rnd, words[: rnd.randrange(90, 150)], rnd.randrange(6))) for i in range(150)]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    classes = {frozenset(shingles(x)) for _, x in rows}
    want = sum(8 * len(x & y) >= 3 * (len(x) + len(y)) for n, x in enumerate(list(classes)) for y in list(classes)[:n])
    assert neardup.class_links(texts, large=large).count() == want


# ---- 4 -----------------------------------------------------------------------------------------------------------


def test_nearest_in_time_equals_brute_force(spark):
    rnd = random.Random(4)
    day = lambda: rnd.choice([None, *[D0 + timedelta(days=rnd.randrange(1500)) for _ in range(20)]])
    left = [(rnd.choice([1, 1, 2, None]), rnd.choice(["FY", "Q", None]), day()) for _ in range(400)]
    right = [(rnd.choice([1, 1, 2, 3]), rnd.choice(["FY", "Q"]), day(), rnd.randrange(60)) for _ in range(120)]
    left += [(1, "Q", D0), (1, "Q", D0)]
    right += [(1, "Q", D0 + timedelta(45), 7), (1, "Q", D0 - timedelta(45), 8), (1, "Q", D0 - timedelta(45), 6)]
    want = {}
    for e, c, d in left:
        hits = [(abs((rd - d).days), rd, rid) for re, rc, rd, rid in right if (re, rc) == (e, c) and rd and d and abs((rd - d).days) <= 45]
        if None not in (e, c, d) and hits:
            want[e, c, d] = min(hits)[1:]
    l = spark.createDataFrame([(*x, 1) for x in left], "entity bigint, class string, day date, side int")
    r = spark.createDataFrame([(*x, "t") for x in right], "entity bigint, class string, day date, right_id bigint, ts string")
    got = [tuple(x) for x in nearest_in_time(l, r, 45, rows_per_slice=150).collect()]
    assert {x[:3]: x[3:] for x in got} == want and len(got) == len(want)


def test_nearest_in_time_empty_sides(spark):
    l = spark.createDataFrame([(1, "Q", D0)], "entity bigint, class string, day date")
    r = spark.createDataFrame([(1, "Q", D0, 5)], "entity bigint, class string, day date, right_id bigint")
    assert nearest_in_time(l.where("false"), r.where("false"), 45).count() == 0
    assert nearest_in_time(l, r.where("false"), 45).count() == 0


def test_days_before_1970_are_not_late(spark):
    days = [date(1931, 5, 1), date(1969, 12, 31), date(1970, 1, 1), date(2001, 1, 1)]
    left = spark.createDataFrame([(1, "Q", d) for d in days], "entity bigint, class string, day date")
    right = spark.createDataFrame([(1, "Q", d + timedelta(k), 10 * n + k) for n, d in enumerate(days) for k in (3, 9)], "entity bigint, class string, day date, right_id bigint")
    got = {(r.day, r.right_id) for r in nearest_in_time(left, right, 45).collect()}
    assert got == {(days[0], 3), (days[1], 13), (days[2], 13), (days[3], 33)}


def test_order_counts_all_shingles_of_all_texts(spark):
    long = " ".join(f"w{i}" for i in range(700))
    texts = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w0 w1 w2"), (4, None), (5, "one two")], "id bigint, text string")
    known, often, whole = neardup.shingle_order(texts)
    assert whole is True and len(known) == 698 and sorted(often.tolist()) == [2] * 697 + [3]
