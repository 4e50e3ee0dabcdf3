"""Hashed features of whole texts, made with array operations over many texts at once.

Words are runs of letters in lower case; digits, marks and blanks part them. Of
each word there are the word itself and its first bytes, for several lengths;
letters of three bytes, as in scripts without blanks, give pairs of neighbours
too. With shapes there are, of each blank-separated token, the runs of upper and
lower letters, digits and single marks it is made of, and how often a token
follows itself. All are hashed into buckets.

A hash of bytes i to j is the difference of two running sums of byte * BASE**place,
moved to place 0 by the inverse power, so all tokens of a block are hashed at once.
Texts are never cut: a text longer than a block is taken in parts that end
between tokens, and its counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Characters hashed at a time: some 90 bytes of arrays for each, in each Python worker.
BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
UPPER, LETTER, DIGIT, MARK = 1, 2, 3, 5
AGAIN = 102  # the salt of tokens that follow themselves


@dataclass(frozen=True)
class Kinds:
    """buckets: a power of two. prefixes: lengths in bytes."""

    buckets: int = 1 << 22
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 8)
    shapes: bool = False


@dataclass(frozen=True)
class Block:
    """Counts of a run of texts: `n` features `at` (a bucket) in text `doc`; `words` of each text from `first` on."""

    first: int
    doc: np.ndarray
    at: np.ndarray
    n: np.ndarray
    words: np.ndarray


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < size, by doubling."""
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done, step = done + more, step * step % (1 << 64)
        made.append(out)
    return made[0], made[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, (size - 1).bit_length()))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of single bytes and of two-byte characters: 0 a blank, a letter, a digit, else the mark itself."""

    def kind(c: str) -> int:
        if c.isspace():
            return 0
        if c.isalpha():
            return UPPER if c.isupper() else LETTER
        return DIGIT if c.isdigit() else max(MARK, ord(c)) if c < "\x80" else MARK

    one = np.array([kind(chr(i)) if i < 128 else LETTER for i in range(256)], np.uint8)
    two = np.full(1 << 16, LETTER, np.uint8)
    for i in range(0x80, 0x800):
        two[int.from_bytes(chr(i).encode(), "big")] = kind(chr(i))
    return one, two


def kinds(x: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8."""
    one, two = _tables()
    out = one[x]
    lead = np.flatnonzero(x[:-1] >= 0xC2)
    if len(lead):
        head, after = x[lead], x[lead + 1]
        short = lead[head < 0xE0]
        made = two[x[short].astype(np.uint16) << 8 | x[short + 1]]
        out[short] = made
        out[short + 1] = made
        marks = lead[((head == 0xE2) | (head == 0xE3)) & (after == 0x80)]  # general and ideographic punctuation
        for k in range(3):
            out[np.minimum(marks + k, len(x) - 1)] = MARK
        signs = lead[(head == 0xF0) & (after == 0x9F)]  # pictographs
        for k in range(4):
            out[np.minimum(signs + k, len(x) - 1)] = MARK
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and end."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


class Rolling:
    """Hashes of any parts of some bytes."""

    def __init__(self, x: np.ndarray) -> None:
        up, self.down = powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def _parts(texts: Sequence[str | None], block: int) -> Iterator[list[tuple[int, str]]]:
    """Texts in groups of about a block; a longer text in parts that end at a blank, each a group of its own."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > block:
            if group:
                yield group
                group, size = [], 0
            at = 0
            while at < len(text):
                end = at + block
                while end < len(text) and not text[end].isspace():
                    end += 1
                yield [(i, text[at:end])]
                at = end
            continue
        group.append((i, text))
        size += len(text)
        if size >= block:
            yield group
            group, size = [], 0
    if group:
        yield group


def _features(group: list[tuple[int, str]], settings: Kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, bucket) of each feature's each occurrence, and the number of words of each text of the group."""
    shift = np.uint64(64 - (settings.buckets - 1).bit_length())
    doc, at = [], []

    def add(which: np.ndarray, h: np.ndarray, salt: int) -> None:
        doc.append(which.astype(np.int32))
        at.append((mixed(h, salt) >> shift).astype(np.int32))

    def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        starts = np.cumsum([0] + [len(r) + 1 for r in raw])
        return np.frombuffer(b"\n".join(raw), np.uint8), starts

    texts = [t for _, t in group]
    x, starts = joined([t.lower() for t in texts])
    kind, hashes = kinds(x), Rolling(x)
    letter = (kind == LETTER) | (kind == UPPER)
    begin, end = runs(letter)
    of = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(of, minlength=len(group))
    add(of, hashes.of(begin, end), 1)
    for n in settings.prefixes:
        long = end - begin >= n
        first = begin[long]
        add(of[long], hashes.of(first, first + n), 1 + n)
    wide = np.flatnonzero((x[:-5] >= 0xE0) & (x[:-5] < 0xF0)) if len(x) > 5 else np.zeros(0, int)
    wide = wide[(x[wide + 3] >= 0xE0) & (x[wide + 3] < 0xF0) & letter[wide] & letter[wide + 3]]
    if len(wide):
        add(np.searchsorted(starts, wide, "right") - 1, hashes.of(wide, wide + 6), 101)
    if settings.shapes:
        x, starts = joined(texts)
        kind, hashes = kinds(x), Rolling(x)
        begin, end = runs(kind != 0)
        of = np.searchsorted(starts, begin, "right") - 1
        token = hashes.of(begin, end)
        same = np.flatnonzero((token[1:] == token[:-1]) & (of[1:] == of[:-1]))
        add(of[same], np.zeros(len(same), np.uint64), AGAIN)
        change = np.ones(len(x), bool)
        change[1:] = kind[1:] != kind[:-1]
        spots = np.flatnonzero(change)
        shape = Rolling(kind[spots])
        begin, end = runs(kind[spots] != 0)
        add(np.searchsorted(starts, spots[begin], "right") - 1, shape.of(begin, end), 103)
    return np.concatenate(doc), np.concatenate(at), words


def _summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    if n is None:
        return np.unique(key, return_counts=True)
    found, back = np.unique(key, return_inverse=True)
    return found, np.bincount(back, n, minlength=len(found)).astype(np.int64)


def blocks(texts: Sequence[str | None], settings: Kinds, kept: np.ndarray | None = None, block: int = BLOCK) -> Iterator[Block]:
    """Counts of all texts, in runs of whole texts. kept: True for the buckets that are wanted, else all are.

    Null and empty texts have no features; each text lies in exactly one run.
    """
    done, held, words = 0, None, None
    groups = iter(_parts(texts, block))
    group = next(groups, None)
    while group is not None:
        after = next(groups, None)
        doc, at, count = _features(group, settings)
        if kept is not None:
            some = kept[at]
            doc, at = doc[some], at[some]
        key, n = _summed(doc.astype(np.int64) << 32 | at)
        if held is not None:
            key, n = _summed(np.concatenate([held[0], key]), np.concatenate([held[1], n]))
            count = words + count
        last = group[-1][0]
        if after is not None and after[0][0] == last:  # the text goes on
            again = int(mixed(np.zeros(1, np.uint64), AGAIN)[0] >> np.uint64(64 - (settings.buckets - 1).bit_length()))
            if settings.shapes and (kept is None or kept[again]) and group[-1][1].rsplit(None, 1)[-1:] == after[0][1].split(None, 1)[:1]:
                key, n = _summed(np.append(key, again), np.append(n, 1))
            held, words = (key, n), count
        else:
            ids = np.array([i for i, _ in group])
            total = np.zeros(last + 1 - done, np.int64)
            total[ids - done] = count
            yield Block(done, ids[key >> 32], (key & 0xFFFFFFFF).astype(np.int32), n, total)
            done, held, words = last + 1, None, None
        group = after
    if done < len(texts):
        none = np.zeros(0, np.int64)
        yield Block(done, none, none.astype(np.int32), none, np.zeros(len(texts) - done, np.int64))
