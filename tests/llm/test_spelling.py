"""Spelling variants against all pairs by edit distance, and wavelet trees against plain filters."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm import common, spelling


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, times=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= times}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(spark, rows, schema="doc_id long, text string", **how):
    found = spelling.variants(spark, spark.createDataFrame(rows, schema), common.Scratch(spark, "t12"), **how)
    return {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_same_as_all_pairs(spark):
    r = np.random.default_rng(3)
    base = ["letters", "étages", "aaaaaa", "abcde", "ÿÿÀÿÿÿ", "through", "thought", "word" * 20]
    words = list(base)
    for _ in range(250):
        w = list(words[r.integers(0, len(words))])
        at = int(r.integers(0, len(w)))
        kind = r.integers(0, 3)
        w[at : at + (kind != 1)] = [] if kind == 0 else [chr(r.choice([97, 98, 101, 116, 0xE9, 0xFF]))]
        words.append("".join(w))
    rows = []
    for k in range(150):
        own = [words[int(len(words) * r.random() ** 3)] for _ in range(60)]
        rows.append((k, [" ", "-", "×"[:0] + "3", "Ā", "Ā ", "𝒜"][k % 6].join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in own)))
    rows += [(None, "letters Letters LETTERS"), (7, None), (8, ""), (9, "日本語 only")] + [rows[0]] * 3
    want = plain(rows)
    assert len(want) > 80 and sum(w[1] is not None and w[2] != w[1] for w in want) > 3  # some forms have forms
    assert got(spark, rows) == want
    assert got(spark, rows, block=4) == want  # many tiles for each key


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == set()
    rows = [(1, "clash clash clash clasp clasp clasp clasp clasp clasp", 3, "f"), (2, None, None, None)]
    assert got(spark, rows, "doc_id long, text string, n long, form string") == plain([r[:2] for r in rows])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 10**6))
def test_wavelet(size, seed):
    r = np.random.default_rng(seed)
    values = r.permutation(size)
    lo, low = r.integers(0, size + 1, 20), r.integers(0, size + 1, 20)
    hi, high = np.minimum(size, lo + r.integers(0, size + 1, 20)), np.minimum(size, low + r.integers(0, size + 1, 20))
    search, value = spelling.Wavelet(values).report(lo, hi, low, high)
    want = sorted((k, int(v)) for k in range(20) for v in values[lo[k] : hi[k]] if low[k] <= v < high[k])
    assert sorted(zip(search.tolist(), value.tolist())) == want
