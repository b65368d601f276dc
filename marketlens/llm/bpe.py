"""Byte-level BPE of whole texts in units that repeat: cuts, caches and array merging.

A cut before a space that something other than white space follows is always a boundary of
pre-tokens, so a text's tokens are those of its units, one after the other. Units repeat, so
workers remember what they gave, up to a bounded number, across tasks. The tokenizer's special
strings are found before anything else, as the tokenizer itself does.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from functools import cache
from unicodedata import category

import numpy as np
import regex

MOST_UNITS, LONGEST_UNIT, LONGEST_SPACE = 400_000, 200, 10_000
#: The pattern of the byte-level pre-tokenizer (fixed values).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_ODD_SPACE = regex.compile(r" (?:\s|\Z)")
_CUT = regex.compile(r" (?=\S)")
_LONG_SPACE = regex.compile(rf"\s{{{LONGEST_SPACE},}}+")
NONE = np.iinfo(np.int32).max


class Units:
    """What a function of units gives, remembered. ``learn`` takes new units and gives their values.

    Keys without the first space stand for units that begin with one; a text's first unit has ``first``.
    """

    def __init__(self, special: Iterable[str], learn: Callable[[list[str]], list], special_values: dict):
        self.special = tuple(special)
        self.learn, self.special_values = learn, special_values
        self.rest: dict = {}
        self.old: dict = {}
        self.first: dict = {}
        if self.special:
            self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def _parts(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return self.split.split(text)
        return [text]

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its units in order. What is not known yet is learned together."""
        if len(self.rest) > MOST_UNITS // 2:  # what is used again moves back from the older half
            self.old, self.rest = self.rest, {}
        if len(self.first) > MOST_UNITS // 4:
            self.first = {}
        out, holes, first_holes = [], [], []
        known, first = self.rest.get, self.first.get
        for text in texts:
            own: list = []
            for part in self._parts(text):
                if not part:
                    continue
                if part in self.special_values:
                    own.append(self.special_values[part])
                    continue
                units = _CUT.split(part) if _ODD_SPACE.search(part) else part.split(" ")
                if units[0]:
                    if (value := first(units[0])) is None:
                        first_holes.append((own, len(own), units[0]))
                    own.append(value)
                del units[0]
                base, values = len(own), list(map(known, units))
                own += values
                at = -1
                while True:
                    try:
                        at = values.index(None, at + 1)
                    except ValueError:
                        break
                    holes.append((own, base + at, units[at]))
            out.append(own)
        for into, gaps, space in ((self.first, first_holes, ""), (self.rest, holes, " ")):
            wanted = {key for _, _, key in gaps}
            values = {key: self.old[key] for key in wanted.intersection(self.old)} if space else {}
            new = list(wanted.difference(values))
            if new:
                values.update(zip(new, self.learn([space + key for key in new]), strict=True))
            for own, at, key in gaps:
                own[at] = values[key]
            into.update((key, value) for key, value in values.items() if len(key) <= LONGEST_UNIT)
        return out


@cache
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_ids(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(open(path, encoding="utf-8").read())["added_tokens"]}


def pretokens(text: str, path: str) -> list[str]:
    """The tokenizer's pre-tokens. Texts with code points on which Unicode versions differ are left to the tokenizer."""
    if not text.isascii() and any(category(c) == "Cn" for c in text):
        return [text[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(text)]
    return PATTERN.findall(text)


def _byte_letters() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


@cache
def _ranks(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first symbol of each byte, sorted pair keys, their ranks, the symbols they make)."""
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    vocab, merges = model["vocab"], model["merges"]
    letters = _byte_letters()
    symbols = np.array([vocab[letters[b]] for b in range(256)], np.int64)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return symbols, keys[order], order.astype(np.int32), made[order]


def merged_counts(tokens: list[str], path: str) -> np.ndarray:
    """How many symbols each pre-token keeps, merging all of them at once.

    The symbols of all pre-tokens are one flat array. Every round finds each sequence's pair of lowest
    rank and merges all its occurrences, from the left and without overlap, in all
    sequences together; sequences with nothing left to merge drop out. A merge makes only
    pairs of higher rank, so this is the order of one merge at a time.
    """
    symbols, keys, ranks, made = _ranks(path)
    data = [t.encode("utf-8", "surrogatepass") for t in tokens]
    lengths = np.array([len(d) for d in data], np.int64)
    counts = lengths.copy()
    ids = symbols[np.frombuffer(b"".join(data), np.uint8)]
    seq = np.repeat(np.arange(len(data)), lengths)
    while len(ids) > 1:
        key = ids[:-1] << 20 | ids[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = (keys[at] == key) & (seq[:-1] == seq[1:])
        rank = np.append(np.where(hit, ranks[at], NONE), NONE)
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        lowest = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(ids)))
        low = np.repeat(lowest, size)
        live = low < NONE
        take = (rank == low) & live
        place = np.arange(len(ids))
        begin = take & ~np.concatenate(([False], take[:-1]))
        run = np.maximum.accumulate(np.where(begin, place, 0))
        take &= (place - run) % 2 == 0
        ids = ids.copy()
        where = np.flatnonzero(take)
        ids[where] = made[at[where]]
        keep = live.copy()
        keep[where + 1] = False
        counts -= np.bincount(seq[where], minlength=len(counts))
        ids, seq = ids[keep], seq[keep]
    return counts


@cache
def count_units(path: str) -> Units:
    """Counts of tokens by array merging."""
    known: dict[str, int] = {}

    def learn(units: list[str]) -> list[int]:
        if len(known) > MOST_UNITS:
            known.clear()
        parts = [pretokens(u, path) for u in units]
        new = list({p for own in parts for p in own}.difference(known))
        step, at = 1 << 18, 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and (size < step or stop == at):
                size += len(new[stop])
                stop += 1
            known.update(zip(new[at:stop], merged_counts(new[at:stop], path).tolist(), strict=True))
            at = stop
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > LONGEST_UNIT:
                del known[p]
        return out

    special = special_ids(path)
    return Units(special, learn, dict.fromkeys(special, 1))


def long_spaces(text: str, special: tuple[str, ...]) -> list[tuple[int, int]]:
    """Runs of much white space, up to where the next pre-token begins.

    The last sign of a run belongs to what follows, unless nothing or a special string does.
    """
    half = LONGEST_SPACE // 2  # such a run fills a whole block of half its length
    if not any(text[at : at + half].isspace() for at in range(0, len(text) - half + 1, half)):
        return []
    ends = lambda at: at == len(text) or text.startswith(special, at)
    return [(m.start(), m.end() if ends(m.end()) else m.end() - 1) for m in _LONG_SPACE.finditer(text)]


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them without added special tokens.

    A byte-level file like byte_bpe_50k.json is read into tiktoken, whose merges are the same (tests compare the two
    over awkward texts and every code point) at a third of the time; any other file goes to the library itself.
    Its pattern keeps a place to return to for every sign of a run of white space, so long runs, which are pre-tokens of their own,
    are left to the library.
    """
    file = json.loads(open(path, encoding="utf-8").read())
    before = file["pre_tokenizer"] or {}
    if file["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        own = library(path)
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, "<u4")
    import tiktoken

    letters = {letter: b for b, letter in _byte_letters().items()}
    special = special_ids(path)
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in special}
    own = tiktoken.Encoding("file", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for start, stop in long_spaces(text, tuple(special)):
            parts += [own.encode_to_numpy(text[at:start], allowed_special=allowed),
                      library(path).encode(text[start:stop], add_special_tokens=False).ids]
            at = stop
        rest = own.encode_to_numpy(text[at:], allowed_special=allowed)
        return np.asarray(np.concatenate([*parts, rest]) if parts else rest, "<u4")

    return encode
