import re
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm import common, neardup
from tests.llm import odd


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n):
    """component of each id by all pairs."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "\t", " ", "\n", "\xa0", "x y", "\x1c", "\0"]), max_size=40), st.integers(1, 6))
def test_shingles_count_as_sets_of_words(parts, n):
    text = "".join(parts)
    assert len(neardup.shingles(text, n)) == len(shingle_set(text, n))


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    text = " ".join("w" * (k % 37) + str(k) for k in range(3000)) + " " + "z" * 5000 + " end"
    whole = neardup.word_hashes(text)
    monkeypatch.setattr(neardup, "STRETCH", 100)
    assert len(whole) == len(text.split()) and (neardup.word_hashes(text) == whole).all()


def near(r, base, edits):
    out = list(base)
    for _ in range(edits):
        out[int(r.integers(len(out)))] = f"edit{int(r.integers(10**6))}"
    return " ".join(out)


def test_same_classes_as_all_pairs(spark):
    r = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(3000)]
    for size in (3, 8, 20, 60, 300):
        for _ in range(12):
            base = list(r.choice(words, size))
            rows += [near(r, base, int(e)) for e in r.integers(0, max(2, size // 12), 6)] + [" ".join(base)] * 2
    hot = list(r.choice(words, 80))
    rows += [near(r, hot, int(e)) for e in r.integers(0, 9, 250)]
    rows += ["", None, " ", "one", "one", "ONE", "one two", "two one", odd.LONG, odd.LONG + "end"]
    order = r.permutation(len(rows))
    table = [(int(i), rows[k]) for i, k in enumerate(order)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in table], "doc_id long, text string, node int, root string")
    for n in (2, 5):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.classes(spark, docs, common.Scratch(spark, "t"), words=n).collect()}
        assert got == brute(table, n)


def test_small_tiles_and_one_forest_after_the_other_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    monkeypatch.setattr(neardup, "SPREAD", 2)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    r = np.random.default_rng(5)
    hot, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(400)]
    table = [(i, near(r, hot, 5)) for i in range(14)] + [(20 + i, near(r, other, 40)) for i in range(9)] + [(40, near(r, hot, 3)), (41, " ".join(other))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.classes(spark, docs, common.Scratch(spark, "t"), words=2).collect()}
    assert got == brute(table, 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 99)), max_size=40), st.lists(st.integers(0, 4), min_size=10, max_size=10), st.integers(1, 3))
def test_forests_join_what_all_pairs_join(pairs, component, most):
    p, q, cost = (np.asarray(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
    component = np.unique(component, return_inverse=True)[1]

    def joined(chosen):
        root = component.copy()
        for a, b in zip(p[chosen], q[chosen]):
            root[root == root[a]] = root[b]
        return (root[:, None] == root[None, :]).tolist()

    every = neardup.forests(p, q, cost, component, None)
    chosen = neardup.forests(p, q, cost, component, most)
    assert joined(chosen) == joined(every) and not (chosen & ~every).any()
    assert chosen.sum() <= most * (component.max() if len(component) else 0)


def test_whole_ids_beside_a_null_and_repeated_rows(spark):
    rows = [(2**53 + 1, "a b c d e f"), (2**53 + 3, "a b c d e f"), (None, "a b c d e f"), (None, "a b c d e f"), (2**53 + 3, "a b c d e f")]
    got = neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), common.Scratch(spark, "t"))
    assert sorted(((x.doc_id, x.component_id) for x in got.collect()), key=str) == sorted([(2**53 + 1, 2**53 + 1), (2**53 + 3, 2**53 + 1), (None, None), (None, None), (2**53 + 3, 2**53 + 1)], key=str)


def test_odd_tables(spark):
    rows = neardup.classes(spark, odd.docs(spark), common.Scratch(spark, "t")).collect()
    assert len(rows) == len(odd.TEXTS) + 2
    of = {x.doc_id: x.component_id for x in rows}
    assert of[5] == 4 and of[0] == 0 and of[1] == 1 and of[None] is None
    assert neardup.classes(spark, odd.empty(spark), common.Scratch(spark, "t")).count() == 0
