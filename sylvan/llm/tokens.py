"""Whole texts to token ids with a public tokenizer, by way of the texts' distinct white-space separated chunks.

Where the tokenizer drops white space and never looks across it, a text's ids are its chunks' ids one after the other.  Arrow splits a
group of texts at ASCII white space and finds the distinct chunks; only those go to the tokenizer, once while they stay in a bounded
cache, and numpy puts the ids together.  Chunks keep whatever else the tokenizer may count as white space, so it decides on that itself.
What is known of a tokenizer is read from its file: one whose steps aren't known here encodes whole texts.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

CACHED_CHUNKS = 450_000
LONGEST_CACHED = 64
#: Characters of a group of texts, unless one alone has more.
GROUP = 12_000_000
#: Lower-case letters of Latin-1, which no normalisation changes, with marks on either side: the marks are words of their own.
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_MARKED = re.compile("([!-&(-/:-@\\[-`{-~]*)([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: A mark after a letter or digit is a word of its own, so it can stand apart: fewer different chunks.
_MARK = "([a-z0-9ß-öø-ÿ])([!-&(-/:-@\\[-`{-~])"
#: Steps of a normaliser that change nothing in such letters, and nothing else in A-Z than their case.
_KNOWN_STEPS = ("NFC", "Replace", "Lowercase")


class ChunkEncoder:
    """``encode(texts)`` gives the ids of all texts one after the other, and where each text's end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = json.dumps(said["pre_tokenizer"])
        self.by_chunk = '"behavior": "Removed"' in pre and '"add_prefix_space": false' in pre
        steps = said.get("normalizer") or {}
        steps = steps.get("normalizers", [steps] if steps else [])
        known = all(s["type"] in _KNOWN_STEPS and (s["type"] != "Replace" or s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps)
        self.lower = self.by_chunk and known and any(s["type"] == "Lowercase" for s in steps)
        self.size = self.tokenizer.get_vocab_size()
        #: Tokens that are looked for in a text before anything else: texts that may have one go to the tokenizer whole.
        self.apart = [t["content"] for t in said.get("added_tokens", [])]
        suffix = said["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.one_word = self.by_chunk and known and bool(suffix) and "\\p{L}]+" in pre and "[^\\\\s\\\\p{L}\\\\p{N}]+" in pre
        # The same vocabulary and merges (one copy in memory) without the steps that change nothing in words of lower-case Latin letters.
        self.lean = Tokenizer(self.tokenizer.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Words of Latin letters: many are encoded as one text, and cut after the tokens that end a word."""
        out: dict[str, bytes] = {}
        words.sort()  # neighbours share their first merges
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.asarray(self.lean.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                out.update(zip(part, self.whole(part)))
                continue
            raw, cuts = ids.tobytes(), (cuts * 4).tolist()
            out.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        return out

    def learn(self, chunks: list[str]) -> None:
        """Put the chunks' ids into the cache."""
        cache = self.cache
        if not self.one_word:
            cache.update(zip(chunks, self.whole(chunks)))
            return
        plain, marked, other, fresh = [], [], [], set()
        for c in chunks:
            if _LATIN.fullmatch(c):
                plain.append(c)
            elif m := _MARKED.fullmatch(c):
                marked.append((c, m.groups()))
                fresh.update(x for x in m.groups() if x and x not in cache)
            else:
                other.append(c)
        fresh.difference_update(plain)
        plain += [x for x in fresh if _LATIN.fullmatch(x)]
        other += [x for x in fresh if not _LATIN.fullmatch(x)]
        cache.update(self.words(plain))
        cache.update(zip(other, self.whole(other)))
        for c, (a, b, d) in marked:
            cache[c] = cache[a] + cache[b] + cache[d]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (little-endian unsigned 32-bit), and the place after each text's last one."""
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        ids, ends, at, base = [], [], 0, 0
        while at < len(texts):
            stop = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), GROUP, "right")))
            own, cuts = self._encode(texts.slice(at, stop - at))
            ids.append(own)
            ends.append(cuts + base)
            at, base = stop, base + len(own)
        return np.concatenate(ids or [np.zeros(0, "<u4")]), np.concatenate(ends or [np.zeros(0, np.int64)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_chunk:
            return self._joined(self.whole(texts.to_pylist()))
        apart = np.zeros(len(texts), bool)
        for token in self.apart:
            apart |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._chunks(texts)
        ids, ends = self._chunks(pc.if_else(pa.array(apart), "", texts))
        own, cuts = self._joined(self.whole(texts.filter(pa.array(apart)).to_pylist()))
        each = np.zeros(len(texts), np.int64)
        each[apart] = np.diff(cuts, prepend=0)
        return np.insert(ids, np.repeat(ends, each), own), ends + np.cumsum(each)

    @staticmethod
    def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(raw), "<u4"), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) >> 2

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            texts = pc.ascii_lower(texts)
        if self.one_word:
            texts = pc.replace_substring_regex(texts, _MARK, "\\1 \\2")
        split = pc.ascii_split_whitespace(texts)
        last = np.asarray(split.offsets)[1:].astype(np.int64) - int(split.offsets[0].as_py())
        coded = split.flatten().dictionary_encode()
        which, seen = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) + len(seen) > CACHED_CHUNKS:
            self.cache.clear()
        cache = self.cache
        cache[""] = b""
        self.learn([c for c in seen if c not in cache])
        raw = list(map(cache.__getitem__, seen))
        for c in [c for c in seen if len(c) > LONGEST_CACHED]:
            del cache[c]
        if len(cache) > CACHED_CHUNKS:
            cache.clear()
        every = np.frombuffer(b"".join(raw), "<u4")
        each = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        first, each = (np.cumsum(each) - each)[which], each[which]
        ends = np.cumsum(each)
        place = np.repeat(first - ends + each, each)
        place += np.arange(len(place))
        out = every[place]
        return out, np.concatenate([[0], ends])[last]

    def rest(self) -> None:
        """Empty the cache at a task's end."""
        self.cache.clear()
        common.give_back()


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker and tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
