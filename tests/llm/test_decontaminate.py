import re
from hashlib import sha256

from sylvan.llm import decontaminate
from tests.llm import odd

PASSAGE = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"


def brute(text, items):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            g = w[k : k + 8]
            for at in range(len(own) - len(g) + 1):
                if own[at : at + len(g)] == g:
                    hit |= set(range(at, at + len(g)))
                    found.add(str(item))
    return len(own), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest()


def test_same_as_brute_force(spark):
    items = [(1, PASSAGE), (2, "zeta eta theta iota kappa lambda mu nu xi"), (10, "short one"), (3, None), (4, "..."), (5, "élan vital ÉLAN")]
    texts = [None, "", PASSAGE, f"Well: {PASSAGE.upper()} nu xi!", "a short  one; short-one", "beta gamma delta epsilon zeta eta theta iot", "élan Vital Élan ÉLAN", PASSAGE.replace(" ", "\n") + " short one", odd.LONG + PASSAGE]
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    docs = odd.docs(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.scan(spark, docs, bench).collect()}
    assert got == {i: brute(t, [x for x in items if x[1]]) for i, t in enumerate(texts)}
    cut = {r.doc_id: r.text for r in decontaminate.scan(spark, docs, bench, cut=True).collect()}
    assert cut[3] == "Well: !" and cut[5] == texts[5] and cut[4] == "a "


def test_many_machines_find_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd.docs(spark, [t for _, t in items] + [items[3][1] + " and " + items[7][1]])
    want = decontaminate.scan(spark, docs, bench).collect()
    monkeypatch.setattr(decontaminate, "MAX_PATTERN_BYTES", 700)
    assert decontaminate.scan(spark, docs, bench).collect() == want and want[-1].n_items == 2


def test_odd_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_items for r in decontaminate.scan(spark, odd.docs(spark), bench).collect()} == {0}
    assert decontaminate.scan(spark, odd.empty(spark), bench).count() == 0
