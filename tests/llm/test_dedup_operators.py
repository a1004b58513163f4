"""Near-duplicates, line dedup and suffix-array dedup against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from docmill.llm import linededup, neardup, perfecthash, suffixdedup
from docmill.llm.gsaca import suffix_array
from tests.llm.test_text_operators import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if i is None or j is None or not a or not b:
            continue
        common = len(a & b)
        if 100 * common >= percent * (len(a) + len(b) - common):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def near_copies(seed, groups=6, size=12):
    rng = random.Random(seed)
    rows, k = [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60)] = f"edit{rng.randint(0, 10**6)}"
            rows.append((k, " ".join(words).replace("g", rng.choice("gG"))))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(0, 256), (1, 4)])
def test_components_lose_no_link(spark, seed, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "one")]
    want = components(rows, 3, 85)
    got = neardup.near_duplicates(table(spark, rows), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles == len(shingles(dict(rows)[r.doc_id], 3)) for r in got)
    kept = neardup.drop_near_duplicates(table(spark, rows), shingle=3, percent=85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []
    rows = [(None, "some words that are here twice"), (None, "some words that are here twice"), (5, "x y z"), (5, "x y z"), (5, "different text altogether"), (8, "X Y Z")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect())
    assert got == sorted([("None", None, True)] * 2 + [("5", 5, True)] * 3 + [("8", 5, False)])


def test_plans_keep_the_promised_risk():
    for percent in (50, 80, 85, 95):
        plan = neardup.Plan(3, percent)
        assert (1 - (percent / 100) ** plan.rows) ** neardup.BANDS <= neardup.MISS
        assert 0 < plan.agreement < plan.hashes * percent / 100


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def deduped(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(h := holders.get(key(x), ())) > 1 and i != min(h))]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a shared line of text", "A SHARED line of text \t", "éééééééééé", "short", "", "  ", "another line that repeats", "tenletters", "ninelette"]
    rows = [(i, "\n".join(rng.choice([*pool, f"own line {rng.random()}"]) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    rows += [(99, None), (98, ""), (3, "a shared line of text"), (None, "another line that repeats\nx"), (None, "another line that repeats")]
    docs = table(spark, rows, _n_lines="9")
    got = linededup.dedup_lines(docs, keys_per_shard=2)
    assert sorted((str(r.doc_id), r._n_lines, r._n_dropped, r.text or "") for r in got.collect()) == deduped(rows)
    assert {"_drop", "_doc", "shard"} <= set(got.columns)
    assert linededup.dedup_lines(table(spark, [])).collect() == []


def test_a_line_that_every_document_holds(spark):
    rows = [(i, f"the very same boilerplate line\nown line number {i}") for i in range(500)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == {0: rows[0][1], **{i: f"own line number {i}" for i in range(1, 500)}}


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=30, deadline=None)
def test_shards_answer_for_their_keys_only(keys, others):
    hi = np.array(sorted(keys), np.uint64).view(np.int64)
    lo = hi * 31 + 7
    count, first = np.arange(2, len(hi) + 2), np.arange(len(hi)) * 3
    shard = linededup.Shard.load(linededup.Shard.build(hi, lo, count, first).dump())
    got = shard.probe(hi, lo)
    assert (got[0] == count).all() and (got[1] == first).all()
    strangers = np.array(sorted(others - keys), np.uint64).view(np.int64)
    assert (shard.probe(strangers, strangers * 31 + 7)[0] == 0).all()
    assert (shard.probe(hi, lo + 1)[0] == 0).all()


def test_perfect_hash_positions_are_a_permutation():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    at = perfecthash.PerfectHash.build(keys).positions(keys)
    assert sorted(at) == list(range(len(keys)))
    twice = np.array([5, 5, 9], np.uint64)
    assert (perfecthash.PerfectHash.build(twice).positions(twice)[:2] == -1).all()


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_arrays_of_few_symbols(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.binary(max_size=80), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_suffix_arrays_of_repeats(block, times):
    text = [*[b + 1 for b in block * times], 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def cut(rows, span):
    holders = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - span + 1):
            if i is not None:
                holders[raw[k : k + span]] = min(i, holders.get(raw[k : k + span], i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - span + 1):
            if i is not None and holders[raw[k : k + span]] < i:
                gone[k : k + span] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(i), len(raw), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_bytes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = "abé \n" if seed % 2 else "ab"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [make(rng.randint(15, 80)) for _ in range(5)]
    rows = [(i, "".join(rng.choice([make(rng.randint(0, 30)), rng.choice(passages)]) for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(100), 40)]
    rows += [(200, None), (201, ""), (202, "a" * 300), (203, "a" * 200), (204, rows[0][1]), (205, passages[0][:20]), (None, passages[0] * 2)]
    got = suffixdedup.drop_repeats(table(spark, rows, anchor="z", ranges="y"), span=20, gram=7).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == cut(rows, 20)


def test_repeats_of_odd_tables(spark):
    assert suffixdedup.drop_repeats(table(spark, [])).collect() == []
    same = "one and the same text of more than fifty bytes, which two rows of one id hold"
    got = suffixdedup.drop_repeats(table(spark, [(1, same), (1, same)])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_one_passage_in_every_document(spark):
    passage = "this passage of considerably more than fifty bytes stands in each and every document"
    rows = [(i, f"{i * 7919} {passage} {i * 104729}") for i in range(300)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.drop_repeats(table(spark, rows)).collect())
    assert got == cut(rows, 50)


def told(found):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())


@pytest.mark.parametrize("hot", [0, 3, 50])
def test_strings_of_hot_anchors_go_by_their_own_hashes(spark, hot):
    rng = random.Random(hot)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(90))
    rows = [(i, f"{rng.random()} {passage[: rng.randint(40, 90)]} {rng.random()} {passage[rng.randint(0, 20) :]}") for i in range(60)]
    assert told(suffixdedup.drop_repeats(table(spark, rows), hot=hot)) == cut(rows, 50)


def test_texts_longer_than_a_slice_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 300)
    monkeypatch.setattr(suffixdedup, "LEAST_BLOCK", 500)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (60, 80, 400)]
    rows = [(i, "".join(rng.choice([*passages, f"{rng.random()}"]) for _ in range(rng.randint(1, 20)))) for i in range(25)]
    assert max(len(t) for _, t in rows) > 2000
    assert told(suffixdedup.drop_repeats(table(spark, rows))) == cut(rows, 50)


def test_bytes_that_repeat_nowhere_stay(spark):
    # 64-bit hashes of these two agree in their upper halves, and they share an anchor.
    rows = [(1, "zeyewqmyoiserhgdrqcsprlqtuqswwedfrqlseuiuspdbixyfv"), (2, "zeyewqmyoiserhgdrqcsprlqamhfqsvqsgltykvvknlekqltio")]
    assert [r[2] for r in told(suffixdedup.drop_repeats(table(spark, rows)))] == [0, 0]


def test_different_texts_of_one_id_are_cut_each_by_itself(spark):
    a, b, c = ("".join(random.Random(k).choice("abcdefgh") for _ in range(70)) for k in range(3))
    rows = [(1, a + b), (2, f"{c} x {a}"), (2, f"y {b} {c}"), (2, None), (3, c)]
    got = {(r.doc_id, bytes(r.kept)) for r in suffixdedup.drop_repeats(table(spark, rows)).collect()}
    assert got == {(1, (a + b).encode()), (2, f"{c} x ".encode()), (2, f"y  {c}".encode()), (2, b""), (3, b"")}
