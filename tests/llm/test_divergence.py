"""Divergence of sources against a plain loop over whole numbers, with odd rows, and terms at the edges of blocks."""

import re
from collections import Counter

import numpy as np

from sylvan.llm import common, divergence


def plain(rows, least, top):
    split = lambda t: [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    rows = [(lang or "", source or "", split(text or "")) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for r in rows if r[0] == lang for t in set(r[2]))
        kept = sorted((t for t, n in docs.items() if n >= least), key=lambda t: t.encode())
        sources = {r[1] for r in rows if r[0] == lang}
        count = {s: Counter(t for r in rows if r[:2] == (lang, s) for t in r[2] if docs[t] >= least) for s in sources}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(count[s]) for s in sources}, share(sum(count.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}))
            marks = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", marks)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def got(spark, df, least, top=10, **how):
    return {tuple(r) for r in divergence.divergence(spark, df, common.Scratch(spark, "t11"), least, top, **how).select("lang", "source", "part", "item", "value", "rank").collect()}


SCHEMA = "lang string, source string, text string"


def test_same_as_plain(spark):
    r = np.random.default_rng(1)
    vocabulary = ["the", "Of", "AND", "żółw", "été", "Été", "İx", "x", "日本", "don", "𝒜b", "ßß", "a" * 5000]
    rows = []
    for k in range(300):
        own = r.choice(vocabulary, r.integers(0, 30))
        rows.append((["en", "fr", None][k % 3], f"s{min(r.integers(0, 9), 4)}", [" ", "1", "_", "'", "\n", "\x00"][k % 6].join(own)))
    rows += [("en", "s0", None), ("en", "only-empty", ""), ("xx", "a", "rare words"), ("xx", "b", None), ("xx", "c", "7"), ("one", "a", "alone"), (None, None, "the the the")] + [rows[0]] * 12
    want = plain(rows, 3, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(spark, df, 3, 2) == want
    assert got(spark, df, 3, 2, block_rows=2, cells=7, summed=3) == want


def test_extra_columns_and_empty(spark):
    rows = [("en", f"s{k % 2}", "same words here") for k in range(12)]
    df = spark.createDataFrame([(*r, 1, b"x", "y") for r in rows], SCHEMA + ", n long, term binary, once string")
    assert got(spark, df, 10) == plain(rows, 10, 10)
    assert got(spark, spark.createDataFrame([], SCHEMA), 10) == set()


def test_scaled_is_exact():
    r = np.random.default_rng(2)
    whole = r.integers(1, 8 * 10**15, 1000)
    n = (whole * r.random(1000)).astype(np.int64)
    assert divergence.scaled(n, whole).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, whole)]
    assert divergence.scaled(np.asarray([7]), 7).tolist() == [1 + 10**9]
