"""Personal data: fixed patterns, and a semi-Markov conditional random field for the forms these don't have.

The base patterns (e-mail, IP, card, phone) give each kind's leftmost matches, found in linear time.  The field adds spans apart from
them: telephone numbers without a plus, cards with other separators, spelled-out e-mail addresses, IPv6 addresses.  It scores whole
candidate segments of up to ``LONGEST`` tokens (and whole spelled-out addresses of any length) by features of the whole span (shape, digits, checksum, separators, neighbours), and dynamic
programming over the tokens chooses boundaries and kinds together.  Segments without a digit, an at sign or a spelled-out one can't be
entities, so only windows of tokens around those are decoded: wide enough for any segment that holds one and for all that its features
look at, which gives what decoding all of the text would.  The base spans stand; the stretches between them are decoded, each as a text of
its own.  Weights are trained in numpy by conditional likelihood (forward sums over segmentations) on made-up sentences with a fixed seed.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; n_* count base spans; repeated rows each have
a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, but for spelled addresses, which may be of any length: eight groups of an IPv6 address have 39 at most
#: (four characters that are tokens each, seven colons), and nineteen digits of a card each set apart have 37.
LONGEST = 40
#: Digits of a telephone number or a card.
DIGITS = (7, 19)
#: Tokens before and after a segment that its features look at, and before it those among which a hint is sought.
BEFORE, AFTER = 10, 8
HINTED = 4
#: What each entity costs on the best path: spans are added where they are likely, not just likelier than none.
LEAST = 1.0

# --- base patterns ------------------------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits either begins a match or no place in it does, so looking only at its first digit loses nothing.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


#: What looks like a telephone number or an address, but is a day or a hardware address.
_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[-/. ]?(?:0[1-9]|1[0-2])[-/. ]?(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)[0-9]{2})(?![0-9])")
_HARDWARE = re.compile(r"[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > last and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    if any(c in text for c in "0123456789"):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the field ----------------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]", re.I)
_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]", re.I)
_SPELLED = re.compile(r"[\w.+-]+ ?[\[({<] ?at ?[\])}>] ?[\w-]+(?:(?: ?[\[({<] ?dot ?[\])}>] ?|\.)\w+)+", re.I)
_SPELLED_END = re.compile(r" ?[\w-]+(?:(?: ?[\[({<] ?dot ?[\])}>] ?|\.)\w+)+", re.I)
_MORE = re.compile(r"(?: ?[\[({<] ?dot ?[\])}>] ?|\.)\w", re.I)
_SIGN = re.compile(r"@|" + _AT.pattern, re.I)
_NAMES = re.compile(r" ?[\w-]+(?:(?: ?[\[({<] ?dot ?[\])}>] ?|\.)[\w-]+)*", re.I)
_HEX = re.compile("[A-Fa-f]+")
_HINTS = {"tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "mail": "email", "email": "email", "contact": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "server": "ip"}


def features(tokens: list[str], i: int, j: int, text: str) -> list[str]:
    """Features of the whole segment tokens[i:j]; none if it can't be an entity."""
    first, last = tokens[i], tokens[j - 1]
    if first.isspace() or last.isspace() or not (first.isalnum() or first in "([+:") or not (last.isalnum() or last in ")]"):
        return []
    if not _TRIGGER.search(text):
        return []
    digits = _digits(text)
    letters = sum(c.isalpha() for c in text)
    shape = re.sub(r"\s+", " ", re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", text)))
    out = [f"shape={shape}" if len(shape) < 16 else "shape=long", f"n={min(len(digits), 20)}", f"letters={min(letters, 3)}", f"seps={''.join(sorted(set(re.sub(r'[\w]', '', text))))}"]
    groups = re.findall("[0-9]+", text)
    out.append("groups=" + (",".join(str(len(g)) for g in groups) if 0 < len(groups) <= 6 else "many" if groups else "none"))
    if 13 <= len(digits) <= 19 and not letters:
        out.append("luhn" if luhn(digits) else "noluhn")
    if not letters and 9 <= len(digits) <= 15 and len(groups) >= 2 and all(2 <= len(g) <= 8 for g in groups):
        out.append("dialled")
    if re.fullmatch(r"(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})", text) or re.fullmatch(r"(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f:]*", text):
        out.append("sixteenths")
    if _DATE.search(text):
        out.append("dated")
    if _HARDWARE.fullmatch("".join(tokens[max(0, i - BEFORE) : i]).rpartition(" ")[2] + text + "".join(tokens[j : j + AFTER]).partition(" ")[0]):
        out.append("hardware")
    if digits[:3] in ("978", "979") and len(digits) == 13 and len(groups) in (4, 5):
        out.append("book")
    if i > 1 and tokens[i - 1] == ":" and tokens[i - 2].isdecimal() or j + 1 < len(tokens) and tokens[j] == ":" and tokens[j + 1].isdecimal():
        out.append("timed")
    if _AT.search(text) and _SPELLED.fullmatch(text):
        if i and tokens[i - 1] in "._+-" or _MORE.match("".join(tokens[j : j + AFTER])):
            out.append("part")  # of a longer address
        else:
            out.append("spelled")
    before = next((t for t in reversed(tokens[max(0, i - HINTED) : i]) if t.isalpha()), "").lower()
    if before in _HINTS:
        out.append(f"hint={_HINTS[before]}")
    if i and (tokens[i - 1].isalnum() or tokens[i - 1] in "-.@:/+$€#") or j < len(tokens) and (tokens[j].isalnum() or tokens[j] in "@:/%"):
        out.append("cut")
    return out


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of spelled-out addresses, in linear time: both sides end at the next bracketed at."""
    for m in _AT.finditer(text):
        start = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        stop = start
        while start and (text[start - 1] in ".+-_" or text[start - 1].isalnum()):
            start -= 1
        while start < stop and not text[start].isalnum() and text[start] != "+":
            start += 1
        if start < stop and (end := _SPELLED_END.match(text, m.end())):
            yield start, end.end()


def _numeric(i: int, tokens: list[str], kinds: str) -> Iterator[int]:
    """Ends of segments from i of digits, spaces and marks, with as many digits as a telephone number or a card has."""
    digits = 0
    for j in range(i, min(len(tokens), i + LONGEST)):
        if kinds[j] == "d":
            digits += len(tokens[j])
        elif kinds[j] not in "sm":
            return
        if digits > DIGITS[1]:
            return
        if digits >= DIGITS[0] and kinds[j] != "s":
            yield j + 1


def _sixteenths(i: int, tokens: list[str], kinds: str) -> Iterator[int]:
    """Ends of segments from i of hexadecimal groups and two colons at least."""
    colons = 0
    for j in range(i, min(len(tokens), i + LONGEST)):
        if kinds[j] not in "dhc":
            return
        colons += kinds[j] == "c"
        if colons > 1 and kinds[j] != "c":
            yield j + 1


def _addresses(tokens: list[str], text: str, place: list[int]) -> Iterator[tuple[int, int]]:
    """Segments around an at sign or a spelled-out one: words and marks before it, names after it."""
    where = {p: k for k, p in enumerate(place)}
    for m in _SIGN.finditer(text):
        first = bisect.bisect_right(place, m.start()) - 1
        first -= bool(first and tokens[first - 1] == " ")
        starts = []
        for i in range(first - 1, max(0, first - LONGEST) - 1, -1):
            if not (tokens[i].isalnum() or tokens[i] in ".+-_"):
                break
            starts.append(i)
        if end := _NAMES.match(text, m.end()):
            last = bisect.bisect_left(place, end.end())
            for j in range(bisect.bisect_left(place, m.end()) + 1, min(last, first + LONGEST) + 1):
                if tokens[j - 1].isalnum():
                    yield from ((i, j) for i in starts if j - i <= LONGEST)
    for a, b in spelled(text) if _AT.search(text) else ():
        i, j = where.get(a), where.get(b)
        if i is not None and j is not None and j - i > LONGEST:
            yield i, j


def segments(tokens: list[str]) -> list[tuple[int, int, list[str]]]:
    """Candidate segments (i, j, features) of a window: the bounded ones that can be entities at all."""
    text = "".join(tokens)
    if not _TRIGGER.search(text):
        return []
    place = [0, *accumulate(map(len, tokens))]
    kinds = "".join("d" if t.isdecimal() and t.isascii() else "h" if len(t) <= 4 and _HEX.fullmatch(t) else "c" if t == ":" else "m" if t in "().+-/" else "s" if t.isspace() and "\n" not in t else "o" for t in tokens)
    found = set(_addresses(tokens, text, place)) if _SIGN.search(text) else set()
    for i, kind in enumerate(kinds):
        if kind in "dm":
            found.update((i, j) for j in _numeric(i, tokens, kinds))
        if kind in "dhc" and ":" in tokens[i : i + 5]:
            found.update((i, j) for j in _sixteenths(i, tokens, kinds))
    return [(i, j, own) for i, j in sorted(found) if (own := features(tokens, i, j, text[place[i] : place[j]]))]


def _scored(found: list[tuple[int, int, list[str]]], w: dict[str, np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    zero = np.zeros(len(KINDS))
    return [(i, j, sum((w.get(f, zero) for f in own), w["bias"])) for i, j, own in found]


def decode(n: int, scored: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int, float]]:
    """The best segmentation of n tokens: (i, j, kind, score less LEAST) of its entities."""
    best, back, by_end = [0.0] * (n + 1), [None] * (n + 1), defaultdict(list)
    for i, j, s in scored:
        k = int(s.argmax())
        by_end[j].append((i, k, float(s[k]) - LEAST))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in by_end[j]:
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, j, k, s)
    out, j = [], n
    while j:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _marginals(n: int, scored: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
    """The probability of each segment and kind, by sums over all segmentations."""
    ends, starts = defaultdict(list), defaultdict(list)
    for k, (i, j, s) in enumerate(scored):
        ends[j].append((i, k))
        starts[i].append((j, k))
    lse = [np.logaddexp.reduce(s) for _, _, s in scored]
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        a[j] = np.logaddexp.reduce([a[j - 1], *(a[i] + lse[k] for i, k in ends[j])])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([b[i + 1], *(b[j] + lse[k] for j, k in starts[i])])
    return [np.exp(a[i] + s + b[j] - a[n]) for i, j, s in scored]


# --- training -----------------------------------------------------------------------------------------------------------------------


def _luhn_number(r: random.Random, n: int) -> str:
    head = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if luhn(head + c))


def _word(r: random.Random) -> str:
    return "".join(r.choice(["an", "er", "th", "lo", "mi", "ka", "so", "tu"]) for _ in range(r.randint(1, 3)))


def _form(r: random.Random) -> tuple[str, str | None]:
    """A made-up entity or something that only looks like one."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = _luhn_number(r, 16)
    wrong = card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10)
    quads = lambda c, s: s.join(c[k : k + 4] for k in range(0, 16, 4))
    at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", ".")])
    day = lambda s: f"{r.randint(1950, 2030)}{s}{r.randint(1, 12):02d}{s}{r.randint(1, 28):02d}"
    clock = f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}" + r.choice(["", f":{r.randint(0, 59):02d}"])
    forms = [
        (f"({d(3)}) {d(3)}-{d(4)}", "phone"), (f"{d(3)}-{d(3)}-{d(4)}", "phone"), (f"0{d(2)} {d(3)} {d(4)}", "phone"), (f"00{d(2)} {d(2)} {d(7)}", "phone"), (f"{d(3)}.{d(3)}.{d(4)}", "phone"),
        (quads(card, "."), "card"), (quads(card, "/"), "card"), (f"{_word(r)}{at}{_word(r)}{dot}com", "email"), (f"{_word(r)}.{_word(r)}{at}{_word(r)}{dot}org", "email"),
        (f"{_word(r)}{r.choice('._')}{_word(r)}{r.choice(['', d(2)])}{at}{_word(r)}{r.choice(['', '-' + _word(r)])}{dot}com", "email"), (f"{r.choice(['', _word(r) + '.'])}{_word(r)}{at}{dot.join(_word(r) for _ in range(r.randint(2, 6)))}{dot}uk", "email"),
        (":".join(format(r.randrange(65536), "x") for _ in range(8)), "ip"), (f"2001:db8::{r.randrange(1, 999):x}", "ip"), (f"fe80::{r.randrange(4096, 9999)}:{r.randrange(99)}", "ip"),
        (quads(wrong, "."), None), (wrong, None), (quads(wrong, " "), None), (d(r.randint(1, 12)), None), (f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", None), (f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", None),
        (f"{d(2)}.{d(2)}", None), (f"{r.randint(10, 23)}:{d(2)}:{d(2)}", None), (f"${d(3)},{d(3)}", None), (f"{d(3)} {_word(r)} {d(2)}", None), (f"{_word(r)}@{_word(r)}", None), (f"{d(1)} {d(2)} {d(3)}", None), (f"{_word(r)}{d(5)}", None), (f"{d(4)}-{d(4)}", None), (f"{d(2)}%", None), (f"{d(10)}:{d(8)}", None),
        (f"1-{r.choice('2345678')}{d(2)}-{d(3)}-{d(4)}", "phone"), (f"{day('-')} {clock}", None), (f"{day('-')}T{clock}", None), (f"{day('/')} {clock}", None), (f"{day(' ')} {d(6)}", None), (f"{day('')[:4]} {day('')[4:]} {d(6)}", None), (f"{day('')} {d(4)}", None),
        (f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1950, 2030)} {clock}", None), (f"{day('-')} {r.randint(10, 23)}", None), (":".join(f"{r.randrange(256):02x}" for _ in range(6)), None), ("-".join(f"{r.randrange(256):02x}" for _ in range(6)), None),
        (f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", None), (f"979-{d(2)}-{d(5)}-{d(2)}-{d(1)}", None), (f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}", None),
    ]
    return r.choice(forms)


@lru_cache(maxsize=1)
def train(seed: int = 5, sentences: int = 800, epochs: int = 6) -> dict[str, np.ndarray]:
    """Weights by feature: one number a kind."""
    r, data = random.Random(seed), []
    for _ in range(sentences):
        text, kind = _form(r)
        left = " ".join(_word(r) for _ in range(2)) + " " + r.choice(["", "", "", "tel ", "mail ", "card ", "ip ", "call "])
        tokens = _TOKEN.findall(left) + _TOKEN.findall(text) + _TOKEN.findall(r.choice([" ", ". ", ", "]) + _word(r))
        i = len(_TOKEN.findall(left))
        data.append((len(tokens), segments(tokens), (i, i + len(_TOKEN.findall(text))), kind))
    w: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(KINDS)))
    g2: dict[str, np.ndarray] = defaultdict(lambda: np.full(len(KINDS), 1e-3))
    w["bias"] = np.full(len(KINDS), -2.0)
    for _ in range(epochs):
        r.shuffle(data)
        for n, found, span, kind in data:
            grad: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(KINDS)))
            for (i, j, own), p in zip(found, _marginals(n, _scored(found, w))):
                p = -p
                if kind and (i, j) == span:
                    p[KINDS.index(kind)] += 1
                for f in (*own, "bias"):
                    grad[f] += p
            for f, g in grad.items():
                g = g - 1e-3 * w[f]
                g2[f] += g * g
                w[f] = w[f] + 0.4 * g / np.sqrt(g2[f])
    return dict(w)


# --- texts --------------------------------------------------------------------------------------------------------------------------


def windows(tokens: list[str], text: str) -> list[tuple[int, int]]:
    """Ranges of tokens that hold every segment with a trigger and all that its features look at."""
    starts = np.cumsum([0, *map(len, tokens)])
    found = [m.span() for m in _TRIGGER.finditer(text)]
    reach = [(LONGEST + BEFORE, LONGEST + AFTER)] * len(found)
    if _AT.search(text):
        long = list(spelled(text))
        found, reach = found + long, reach + [(BEFORE, AFTER)] * len(long)
    if not found:
        return []
    heads = np.searchsorted(starts, [a for a, _ in found], "right") - 1
    tails = np.searchsorted(starts, [b for _, b in found], "left")
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, int(h) - r), min(len(tokens), int(t) + f)) for h, t, (r, f) in zip(heads, tails, reach)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Finder:
    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    def stretch(self, text: str) -> list[tuple[str, int, int]]:
        """The field's spans of a text without base spans."""
        out, tokens = [], _TOKEN.findall(text)
        starts = np.cumsum([0, *map(len, tokens)])
        for a, b in windows(tokens, text):
            for i, j, k, _ in decode(b - a, _scored(segments(tokens[a:b]), self.w)):
                out.append((KINDS[k], int(starts[a + i]), int(starts[a + j])))
        return out

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The field's spans apart from the base spans; none that cuts a word that goes on in a base span."""
        out, at = [], 0
        for x, y in sorted((a, b) for _, a, b in base) + [(len(text), len(text))]:
            if x > at and _TRIGGER.search(text, at, x):
                for kind, a, b in self.stretch(text[at:x]):
                    s, e = at + a, at + b
                    if not (s and text[s].isalnum() and text[s - 1].isalnum() or e < len(text) and text[e - 1].isalnum() and text[e].isalnum()):
                        out.append((kind, s, e))
            at = max(at, y)
        return out

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans, both by kind, then start."""
        base = base_spans(text)
        more = self.added(text, base) if _TRIGGER.search(text) else []
        return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train())  # a few hundred features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            found = [finder.spans(t) for t in batch.column("text").to_pylist()]
            out = {"doc_id": batch.column("doc_id")}
            out |= {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
            out["base_sha256"] = pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in found], pa.string())
            out["spans"] = pa.array([_said(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return common.documents(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with <KIND> for every span; of overlapping spans the first, then the longest, names the stretch that all cover."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns with spans masked and n_chars, if there, brought up to date."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in common.parts(batches, "text", common.PART):
            texts = [t if t is None else masked(t, finder.spans(t)[1]) for t in batch.column("text").to_pylist()]
            out = {"text": texts}
            if "n_chars" in batch.schema.names:
                out["n_chars"] = [0 if t is None else len(t) for t in texts]
            yield common.replaced(batch, **out)
        common.give_back()

    return docs.mapInArrow(run, docs.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    return find(common.read(spark, sf_dir, "documents"))
