"""Co-occurrence, term frequencies and formatting duplicates against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.llm import codes, cooccur, dupes, termfreq

LINK = "edge_id bigint, src string, dst string, hs string, k int"


def brute_pairs(baskets, least, lift):
    n, single, pair = len(baskets), Counter(), Counter()
    for b in baskets:
        single.update(b)
        pair.update(combinations(sorted(b), 2))
    return {(a, b): (m, single[a], single[b]) for (a, b), m in pair.items() if m >= least and m * n >= lift * single[a] * single[b]}


def test_pairs(spark, monkeypatch):
    rng = random.Random(3)
    baskets = [{f"i{int(rng.paretovariate(0.6)) % 60:02d}" for _ in range(rng.randrange(1, 14))} for _ in range(300)]
    baskets.append({f"i{k:02d}" for k in range(60)})
    df = spark.createDataFrame([(k, sorted(b)) for k, b in enumerate(baskets)], "record int, items array<string>")
    want = brute_pairs(baskets, 3, 1.2)
    assert want
    for large, dense, width, load in ((1024, 256, 256, 1 << 20), (10, 8, 4, 20), (1024, 3, 3, 1 << 20)):
        monkeypatch.setattr(cooccur, "LARGE", large)
        monkeypatch.setattr(cooccur, "SLICE", 4)
        monkeypatch.setattr(cooccur, "DENSE", dense)
        monkeypatch.setattr(cooccur, "WIDTH", width)
        monkeypatch.setattr(cooccur, "LOAD", load)
        monkeypatch.setattr(cooccur, "SMALL", 100 if width == 4 else 0)
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in cooccur.cooccurrence(df, 3, 1.2).collect()}
        assert got == want


def test_gram_blocks(monkeypatch):
    """Dense products, item blocks and slices add up to all pairs, however little is held."""
    monkeypatch.setattr(cooccur, "BLOCK", 4)
    monkeypatch.setattr(cooccur, "PAIRS", 2)
    whole = [[0, 1, 2, 5], [1, 5, 6], [0, 6], [0, 2], [1, 5, 6, 7]]
    split = [([0, 1], [0, 1]), ([0, 1], [4, 6]), ([4, 6], [4, 6])]
    kind = pa.list_(pa.int64())
    prefixes = sorted(((b, x[: max(k for k, j in enumerate(x) if j // 3 == b) + 1]) for x in whole for b in {j // 3 for j in x if j >= 3}), key=lambda r: r[0])
    block = pa.record_batch([pa.array([b for b, _ in prefixes]), pa.array([1] * len(prefixes)), pa.array([x for _, x in prefixes], kind)], names=["b", "salts", "ids"])
    dense = pa.record_batch([pa.array([[j for j in x if j < 3] for x in whole], kind)], names=["ids"])
    slices = pa.record_batch([pa.array([a for a, _ in split], kind), pa.array([b for _, b in split], kind)], names=["left", "right"])
    want = Counter(p for b in [*whole, [0, 1, 4, 6]] for p in combinations(b, 2))
    for held in (1, 100):
        monkeypatch.setattr(cooccur, "HELD", held)
        got = Counter()
        for out in [*cooccur._dense(3)(iter([dense])), *cooccur._blocks(3, 1)(iter([block.slice(0, 3), block.slice(3)])), *cooccur._slices(iter([slices]))]:
            for r in out.to_pylist():
                got[r["i"], r["j"]] += r["n"]
        assert got == want
    early = [r for out in cooccur._blocks(3, 2)(iter([block])) for r in out.to_pylist()]
    assert early and all(r["n"] >= 2 for r in early)


def test_latest_baskets(spark):
    rows = [(1, ["a", "a", None, " ", "b"], 2, "x"), (1, ["old"], 1, "x"), (2, None, 1, "x"), (3, [], 1, "x"), (None, ["a"], 1, "x"), (4, ["c"], None, "x"), (4, ["c"], None, "x")]
    df = spark.createDataFrame(rows, "page_id int, entities array<string>, at int, record string")
    got = {r.record: r["items"] for r in cooccur.latest_baskets(df, "page_id", "entities", "at").collect()}
    assert got == {1: ["a", "b"], 4: ["c"]}
    assert cooccur.cooccurrence(cooccur.latest_baskets(df.limit(0), "page_id", "entities", "at")).count() == 0


def test_terms(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "RANGE", 16)
    monkeypatch.setattr(termfreq, "HELD", 2)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"t{rng.randrange(80)}", rng.choice(["a", "b", "c", None, " ", ""])) for _ in range(900)]
    rows += [(None, "a"), ("", "a"), ("  ", "b"), ("x" * 70000, "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "dst string, src string, id int, n int")
    n, records = Counter(), defaultdict(set)
    for d, s in rows:
        if d and d.strip(" "):
            n[d] += 1
            records[d] |= {s} if s and s.strip(" ") else set()
    for share in (0.1, 0.9):
        got = {r.dst: (r.n_occurrences, r.n_records) for r in termfreq.term_frequencies(df, "dst", "src", share).collect()}
        assert got == {d: (n[d], len(records[d])) for d in n}
    marks = {r.dst: r.mark for r in termfreq.marked_terms(df, "dst", "src", rare=2, common=1 / 1, share=0.1).collect()}
    assert marks == {d: "rare" if len(records[d]) < 2 else "common" if len(records[d]) > 3 else None for d in n}
    assert termfreq.term_frequencies(df.limit(0), "dst", "src").count() == 0


def plain(text):
    return "".join(c for c in text or "" if c.isalpha() or c.isdecimal()).casefold()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB1é É-_.\xad​漢ß", max_size=12), min_size=1, max_size=12))
def test_fold_hash_and_pointers(texts):
    column = pa.array([*texts, None, ""], pa.string())
    hashes, n = dupes.fold_hash(column)
    forms = [plain(t) for t in [*texts, None, ""]]
    low = [f.replace("ss", "ß") if "ß" in (t or "") else f for f, t in zip(forms, [*texts, None, ""])]
    assert list(n) == [len(x) for x in low]
    for i in range(len(low)):
        for j in range(len(low)):
            assert (hashes[i] == hashes[j]) == (low[i] == low[j])
    other = column.take(pa.array(np.arange(len(column))[::-1]))
    assert list(dupes.same_folded(column, other)) == [a == b for a, b in zip(low, low[::-1])]


def test_groups(spark):
    rng = random.Random(5)
    names = ["Ann Lee", "ann  LEE", "Ann-Lee.", "Änn Lee", "Bob", "b o b", "“Bob”", "1998", "19 98", "...", "", None, "x" * 50000, "X" * 50000 + "!"]
    rows = [(k, rng.choice(names), rng.choice(names), "c", k) for k in range(400)] + [(None, "a", "b", "c", 1)]
    rows += [(1000 + k, "Hot Key", "hot_key", "c", 1) for k in range(300)]
    groups = defaultdict(list)
    for e, s, d, *_ in rows:
        if e is not None and plain(s) and plain(d):
            groups[plain(s), plain(d)].append(e)
    want = {(min(v), e) for v in groups.values() for e in v}
    df = spark.createDataFrame(rows, LINK).repartition(3)
    for share in (1 / 1000, 1 / 4):
        assert {tuple(r) for r in dupes.link_groups(df, share).collect()} == want
    got = {r.edge_id: r.n_copies for r in dupes.distinct_links(df).collect()}
    assert got == {min(v): len(v) for v in groups.values()}
    assert dupes.link_groups(df.limit(0)).count() == 0


def test_long_values(monkeypatch):
    monkeypatch.setattr(dupes, "STEP", 100)
    a, b = "Ab漢-é" * 700, ", ".join("aB漢É" * 700)
    column = pa.array([a, b, b[:-1] + "x", a + "!", "kurz"])
    hashes, n = dupes.fold_hash(column)
    assert n.tolist() == [2800, 2800, 2800, 2800, 4] and hashes[0] == hashes[1] == hashes[3] and hashes[0] != hashes[2]
    assert dupes.same_folded(column, pa.array([b, a, a, b, "KURZ."])).tolist() == [True, True, False, True, True]
    assert dupes.same_folded(column, pa.array([b + "y", b[2:], b[:-1] + "X", None, None])).tolist() == [False, False, True, False, False]


def test_colliding_hashes_are_told_apart():
    batch = pa.record_batch(
        [pa.array([7] * 5), pa.array([7] * 5), pa.array([1, 2, 3, 4, 5]), pa.array(["ab", "A-B", "xy", "ab.", "X y"]), pa.array(["c"] * 5)],
        names=["hs", "hd", "edge_id", "src", "dst"],
    )
    out = [r for b in dupes._scan_runs(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert {(r["first_edge_id"], r["edge_id"]) for r in out} == {(1, 1), (1, 2), (3, 3), (1, 4), (3, 5)}


def test_words():
    texts = pa.array(["Ein Wort, ein_Wort! 桥很稳", None, "", "EIN-wort­e", "wort"], pa.string())
    hashes, at = codes.word_hashes(texts)
    assert list(np.diff(at)) == [7, 0, 0, 2, 1]
    first = hashes[:7]
    assert first[0] == first[2] == hashes[7] and first[1] == first[3] == hashes[9] and hashes[8] != hashes[9]
