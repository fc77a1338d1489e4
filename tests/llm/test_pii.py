import random
import re
from hashlib import sha256

import numpy as np
import pytest

from sylvan.llm import pii
from tests.llm import odd

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(x)] + [("ip", *m.span()) for m in IP.finditer(x) if all(int(v) <= 255 for v in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(x) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(x) if 9 <= len(digits(m)) <= 15]


def test_base_spans_are_the_patterns_leftmost_matches():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice("0123456789 0123..--+()@ab_%é\n5") for _ in range(r.randrange(80)))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 150_000, "a@" * 100_000):
        pii.base_spans(text)


def test_sums_over_segmentations_agree_with_enumeration():
    r = np.random.default_rng(1)
    scored = [(i, j, r.normal(size=4)) for i in range(5) for j in range(i + 1, 6) if r.random() < 0.6]

    def every(at):
        if at == 5:
            return [((), 0.0)]
        out = every(at + 1)
        for k, (i, j, s) in enumerate(scored):
            if i == at:
                out += [(((k, y), *rest), s[y] + v) for rest, v in every(j) for y in range(4)] if j <= 5 else []
        return out

    ways = every(0)
    total = sum(np.exp(v) for _, v in ways)
    got = pii._marginals(5, [s for s in scored if s[1] <= 5])
    for k, p in zip([k for k, s in enumerate(scored) if s[1] <= 5], got):
        for y in range(4):
            assert abs(p[y] - sum(np.exp(v) for used, v in ways if (k, y) in used) / total) < 1e-9


def test_best_path_agrees_with_enumeration():
    r = np.random.default_rng(4)
    for _ in range(200):
        scored = [(i, j, r.normal(1, 2, size=4)) for i in range(6) for j in range(i + 1, 7) if r.random() < 0.5]

        def best(at):
            if at == 6:
                return 0.0
            return max([best(at + 1)] + [best(j) + float(s.max()) - pii.LEAST for i, j, s in scored if i == at])

        got = pii.decode(6, scored)
        assert abs(sum(s for *_, s in got) - best(0)) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_windows_give_what_decoding_the_whole_text_gives():
    r, finder = random.Random(9), pii.Finder(pii.train())
    for _ in range(30):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts += [pii._form(r)[0]] + [r.choice(["word", "tel", "a-b", ".", "(", "\n", "x" * 90, "ab [at] cd" + " [dot] ef" * 30, "1 " * 45]) for _ in range(r.randrange(60))]
        text = " ".join(parts)
        tokens = pii._TOKEN.findall(text)
        starts = np.cumsum([0, *map(len, tokens)])
        whole = [(pii.KINDS[k], int(starts[i]), int(starts[j])) for i, j, k, _ in pii.decode(len(tokens), pii._scored(pii.segments(tokens), finder.w))]
        assert finder.stretch(text) == whole


def test_long_local_parts_and_joined_addresses():
    finder = pii.Finder(pii.train())
    for form in ("a" * 90 + "[at]example[dot]org", ".".join(["abc"] * 13) + "[at]example[dot]org"):
        assert finder.spans(f"write to {form} now")[1] == [("email", 9, 9 + len(form))]


def test_field_on_fresh_sentences():
    r, finder, right, wrong = random.Random(77), pii.Finder(pii.train()), 0, 0
    for _ in range(400):
        form, kind = pii._form(r)
        text = f"some words {form} and more"
        base, every = finder.spans(text)
        assert set(base) <= set(every)
        got = [s for s in every if s not in base]
        if base:  # the form, or a part of it, is of the patterns: the field adds nothing over it
            ok = not any(a < y and b > x for _, a, b in got for _, x, y in base)
        else:
            ok = got == ([(kind, 11, 11 + len(form))] if kind else [])
        right, wrong = right + ok, wrong + (not ok)
    assert right / (right + wrong) > 0.95


@pytest.mark.parametrize(
    "kind, form",
    [
        ("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("ip", "fe80:1a2b:3c4d:5e6f:7a8b:9c0d:1e2f:3a4b"), ("ip", "1a2b:3c4d:5e6f:7a8b:9c0d:1e2f:3a4b:5c6d"), ("ip", "2001:db8::1f"),
        ("email", "jane.doe42 [at] example [dot] com"), ("email", "user [at] example [dot] co [dot] uk"), ("email", "john_smith (at) uni-bonn (dot) de"),
        ("email", "anna.lena.maria [at] mail [dot] institute [dot] department [dot] faculty [dot] university [dot] example [dot] co [dot] uk"),
    ],
)
def test_long_forms_are_found_whole(kind, form):
    finder = pii.Finder(pii.train())
    for left, right in (("some words ", " and more"), ("", "")):
        assert finder.spans(left + form + right)[1] == [(kind, len(left), len(left) + len(form))]


#: Texts of other templates than the training's, with what they hold.
OTHERS = [
    ("on 2023-10-11 12:30:45 it ran", []), ("GET 2023 1011 123045", []), ("mac 12:34:56:78:9a:bc up", []), ("mac 12-34-56-78-9a-bc up", []), ("ISBN 978-3-16-148410-0 is", []), ("on 11.10.2023 12:30 it", []),
    ("log 2023-10-11T12:30:45.123 x", []), ("from 1999-2004 on", []), ("at 20231011 1230 z", []), ("2024/05/06 07:08 done", []), ("created 2019-12-31 23", []), ("id 1234567890:12345678", []), ("[2021-03-04 05:06:07] GET /a 200", []),
    ("call 1-800-555-0199 now", [("phone", "1-800-555-0199")]), ("dial 555-123-4567 now", [("phone", "555-123-4567")]), ("call (030) 123-4567.", [("phone", "(030) 123-4567")]), ("addr 2001:db8::1f x", [("ip", "2001:db8::1f")]),
    ("card 4111.1111.1111.1111 ok", [("card", "4111.1111.1111.1111")]), ("reach anna.b [at] mail [dot] org today", [("email", "anna.b [at] mail [dot] org")]), ("2020-01-02 03:04 call 555-987-6543", [("phone", "555-987-6543")]),
]


def test_precision_and_recall_on_other_templates():
    finder = pii.Finder(pii.train())
    got = [{(k, text[a:b]) for k, a, b in finder.spans(text)[1]} for text, _ in OTHERS]
    right = sum(len(g & set(want)) for g, (_, want) in zip(got, OTHERS))
    assert right / sum(map(len, got)) >= 0.9 and right / sum(len(want) for _, want in OTHERS) >= 0.9
    assert all(not g for g, (_, want) in zip(got, OTHERS) if not want)  # days, clocks, hardware and books are nobody's


def test_tables_and_masks(spark):
    docs = odd.docs(spark)
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert rows[0].spans == "" and rows[0].base_sha256 == sha256(b"").hexdigest()
    assert (rows[9].n_email, rows[9].n_ip, rows[9].n_card, rows[9].n_phone) == (1, 1, 0, 1)
    assert rows[9].spans == "email:0:7,ip:8:15,phone:16:33"
    masked = pii.mask(docs)
    assert masked.schema == docs.schema and masked.collect()[9].text == "<EMAIL> <IP> <PHONE>" and masked.collect()[0].text is None
    assert pii.find(odd.empty(spark)).count() == 0 and pii.mask(odd.empty(spark)).count() == 0


def test_whole_ids_beside_a_null_and_other_columns(spark):
    docs = spark.sql("select * from values (9007199254740993L, 'a@b.c', array(struct(1 as x, null as y)), map('k', 1L), timestamp'2020-01-01 00:00:00'), (9007199254740995L, null, null, null, null), (null, '1.2.3.4', null, null, null) as t(doc_id, text, extra, more, at)").coalesce(1)
    ids = [2**53 + 1, 2**53 + 3, None]
    assert [r.doc_id for r in pii.find(docs).collect()] == ids
    got = pii.mask(docs)
    assert [r.doc_id for r in got.collect()] == ids and got.drop("text").collect() == docs.drop("text").collect()
