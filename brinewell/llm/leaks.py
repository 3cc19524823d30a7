"""Evaluation items leaking into training text, by greedy string tiling.

Texts and items become words without case, markup, escapes and invisible characters; a word one edit away from a word of the items
counts as that word. Seeds are runs of SEED equal words, found by Karp-Rabin fingerprints over the whole text at once and verified.
Around its seeds each item is tiled: the longest run of equal words that is still unmarked in the text is marked, again and again.
Tiles that follow each other closely on both sides are one passage; what is shorter than MIN_PASSAGE words is dropped. The passages
that lie in the item's order cover a part of the item; from min_share on the text leaks the item. An item is tiled only if its seeds could cover
that part: each seed has SEED words, so it needs a SEED-th of the words that it must cover.

The items are the stated query set. They are looked up in sorted arrays of 16 bytes a word and 12 bytes a spelling; the texts are read once for every
MAX_BLOCK_CHARS characters of items.

Defined results: null and empty texts leak nothing; items without a word are never found; items with equal text are all reported; a
passage that occurs several times in a text counts once; texts of any length are read to their end.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

SEED = 2
MIN_PASSAGE = 8
MAX_GAP = 4
SEGMENT_GAP = 16
MAX_BLOCK_CHARS = 32 << 20
REMEMBERED = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

_INVISIBLE = re.compile(
    "[" + "".join(map(chr, (0xAD, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF))) + "]"
)
_COMBINING = re.compile(f"[{chr(0x300)}-{chr(0x36F)}]")
_CODE_ESCAPE = re.compile(r"\\+u([0-9a-fA-F]{4})")
_BLANK_ESCAPE = re.compile(r"\\+[nrtfv]")
# A tag with its attributes; their quotes may be escaped.
_TAG = re.compile(r"""</?[a-zA-Z][\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:\\*+"[^"]*+"|\\*+'[^']*+'|[^\s"'=<>`]++))?+)*+\s*+/?>""")
_HYPHEN = re.compile(f"(?<=[a-z])[-{chr(0x2010)}{chr(0x2011)}]" + r"""(?:(?=[a-z])|[ \t#>"',/*]*+\n[\s#>"',/*]*+(?=[a-z]))""")
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """The words of a text in which case, markup, escapes, line breaks and invisible characters make no difference."""
    if "\\" in text:
        if "\\u" in text:
            text = _CODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = _BLANK_ESCAPE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    text = text.lower()
    if "-" in text or not text.isascii():
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text)


def spellings(word: str) -> list[str]:
    """The word and what is left of it without one letter; words one edit apart share one of these."""
    return [word, *{word[:k] + word[k + 1 :] for k in range(len(word))}]


class Items:
    """The items of a block, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids: list[int] = []
        self.codes: dict[str, int] = {}
        texts: list[np.ndarray] = []
        for i, text in rows:
            if w := words(text or ""):
                self.ids.append(i)
                texts.append(np.array([self.codes.setdefault(x, len(self.codes)) for x in w], np.int64))
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.whole = np.concatenate([*texts, np.empty(0, np.int64)])
        prints = [fingerprints(t) for t in texts]
        where = [np.arange(len(p), dtype=np.int32) for p in prints]
        hashes = np.concatenate([*prints, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in prints])[order]
        self.place = np.concatenate([*where, np.empty(0, np.int32)])[order]
        spelled = [(v, c) for w, c in self.codes.items() if len(w) >= 4 and w.isalpha() for v in spellings(w)]
        near = np.array([xxh3_64_intdigest(v) for v, _ in spelled], np.uint64)
        order = np.argsort(near, kind="stable")
        self.near, self.near_code = near[order], np.array([c for _, c in spelled], np.int32)[order]
        self.longest = max((len(w) for w in self.codes), default=0)
        self._ready()

    def _ready(self) -> None:
        self.words = list(self.codes)
        self.memory = dict(self.codes)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "memory")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def code(self, word: str) -> int:
        """The code of the word of the items that is meant, or -1."""
        found = -1
        if 4 <= len(word) <= self.longest + 1 and word.isalpha():
            asked = np.array([xxh3_64_intdigest(v) for v in spellings(word)], np.uint64)
            low, high = np.searchsorted(self.near, asked), np.searchsorted(self.near, asked, "right")
            close = {self.words[c] for a, b in zip(low.tolist(), high.tolist()) for c in self.near_code[a:b].tolist()}
            close = {c for c in close if abs(len(c) - len(word)) <= 1 and set(spellings(c)) & set(spellings(word))}
            if close:
                found = self.codes[min(close, key=lambda c: (c[0] != word[0], abs(len(c) - len(word)), c))]
        if len(self.memory) >= REMEMBERED:
            self.memory = dict(self.codes)
        self.memory[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        w = words(text)
        get = self.memory.get
        out = [get(x, -2) for x in w]
        if -2 in out:
            out = [self.code(w[k]) if c == -2 else c for k, c in enumerate(out)]
        return np.array(out, np.int64)

    def seeds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the text and place in the item of every run of SEED words that both have."""
        prints = fingerprints(codes)
        low = np.searchsorted(self.hashes, prints)
        d = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == prints) if len(self.hashes) else np.empty(0, np.int64)
        low = low[d]
        count = np.searchsorted(self.hashes, prints[d], "right") - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        d, k, i = np.repeat(d, count), self.item[at], self.place[at]
        same = np.ones(len(d), bool)
        for n in range(SEED):
            same &= codes[d + n] == self.whole[self.starts[k] + i + n]
        return k[same], d[same], i[same]


def fingerprints(codes: np.ndarray) -> np.ndarray:
    """The Karp-Rabin fingerprint of each run of SEED words; unknown words are never part of an equal run."""
    if len(codes) < SEED:
        return np.empty(0, np.uint64)
    c = (codes + 2).astype(np.uint64)
    h = np.zeros(len(c) - SEED + 1, np.uint64)
    for k in range(SEED):
        h = h * _BASE + c[k : k + len(h)]
    return h


def tiles(text: list[int], item: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: (place in text, place in item, length), no word of the text in two tiles.

    Words of the item stay free for other stretches of the text: where it carries a passage twice, each with other words changed, tiles of the one must not
    break up the other. ordered_cover() counts them once.
    """
    known, runs = set(), []
    for d, i in sorted(seeds):
        if (d - 1, i - 1) not in known:
            n = SEED
            while d + n < len(text) and i + n < len(item) and text[d + n] == item[i + n]:
                n += 1
            runs.append((-n, d, i))
        known.add((d, i))
    heapify(runs)
    taken, out = set(), []
    while runs:
        n, d, i = heappop(runs)
        n = -n
        free = [d + k not in taken for k in range(n)]
        if all(free):
            taken.update(range(d, d + n))
            out.append((d, i, n))
            continue
        edges = [-1, *(k for k in range(n) if not free[k]), n]
        for a, b in pairwise(edges):
            if b - a - 1 >= SEED:
                heappush(runs, (a + 1 - b, d + a + 1, i + a + 1))
    return sorted(out)


def passages(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of close tiles, in order; each tile is in one of them."""
    best, before = [t[2] for t in parts], [-1] * len(parts)
    for y, (d, i, n) in enumerate(parts):
        for x in range(y - 1, -1, -1):
            a, b, m = parts[x]
            twice = max(0, b + m - i)  # words at the tile's head that the tile before it has already
            if twice < n and 0 <= d + twice - a - m <= MAX_GAP and i + twice - b - m <= MAX_GAP and best[x] + n - twice > best[y]:
                best[y], before[y] = best[x] + n - twice, x
    used, out = set(), []
    for y in sorted(range(len(parts)), key=lambda k: -best[k]):
        chain = []
        while y != -1 and y not in used:
            chain.append(y)
            used.add(y)
            y = before[y]
        if chain:
            tiles_in, end = [], 0
            for d, i, n in (parts[k] for k in reversed(chain)):
                twice = max(0, end - i)
                tiles_in.append((d + twice, i + twice, n - twice))
                end = i + n
            out.append(tiles_in)
    return [c for c in out if c[-1][1] + c[-1][2] - c[0][1] >= MIN_PASSAGE]


def stretches(chains: list[list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, int, int]]:
    """Of each passage (from, to in text, from, to in item, equal words), whole and behind each end of another one inside it in the item.

    Tiles of different segments may share words of the item; these count once, and the rest of the passage still counts.
    """
    ends = sorted({c[-1][1] + c[-1][2] for c in chains})
    for c in chains:
        (d, i, _), (a, b, m) = c[0], c[-1]
        for k in (i, *ends[bisect_right(ends, i) :]):
            if k < b + m:
                yield d, a + m, k, b + m, sum(max(0, min(n, j + n - k)) for _, j, n in c)


def ordered_cover(found: list[tuple[int, int, int, int, int]], size: int) -> int:
    """Most equal words in passages that follow each other in the text and in the item of size words."""
    ends: list[tuple[int, int, int]] = []  # passages by their end in the text, waiting to be usable
    best = [0] * (size + 1)  # by end in the item
    top = 0
    for d0, d1, i0, i1, n in sorted(found):
        while ends and ends[0][0] <= d0:
            _, at, value = heappop(ends)
            for k in range(at, size + 1):
                if best[k] >= value:
                    break
                best[k] = value
        value = best[i0] + n
        heappush(ends, (d1, i1, value))
        top = max(top, value)
    return top


def leaks_of(items: Items, text: str, min_share: float = 1 / 3) -> Iterator[tuple[int, int, int]]:
    """(item id, covered words, words of the item) for every item that could reach min_share of its words in passages of the text."""
    codes = items.encode(text)
    k, d, i = items.seeds(codes)
    if not len(k):
        return
    places = np.unique(items.starts[k] + i)
    owner = np.searchsorted(items.starts, places, "right") - 1
    enough = np.bincount(owner, minlength=len(items.sizes)) * SEED >= items.sizes * min_share
    use = enough[k]
    if not use.any():
        return
    k, d, i = k[use], d[use], i[use]
    order = np.lexsort((i, d, k))
    k, d, i = k[order], d[order], i[order]
    whole = codes.tolist()
    for a, b in pairwise([*np.flatnonzero(np.diff(k, prepend=-1)).tolist(), len(k)]):
        size = int(items.sizes[k[a]])
        item = items.whole[items.starts[k[a]] : items.starts[k[a]] + size].tolist()
        pairs = list(zip(d[a:b].tolist(), i[a:b].tolist()))
        cuts = [0, *(n + 1 for n, (x, y) in enumerate(pairwise(pairs)) if y[0] - x[0] > SEGMENT_GAP), len(pairs)]
        found = []
        for x, y in pairwise(cuts):
            if pairs[y - 1][0] + SEED - pairs[x][0] >= MIN_PASSAGE - MAX_GAP:
                found += passages(tiles(whole, item, pairs[x:y]))
        if found:
            yield items.ids[k[a]], ordered_cover(list(stretches(found)), size), size


def _block_leaks(df: DataFrame, key: str, text: str, block: list[tuple[int, str | None]], min_share: float) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Items(block))
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            keys, found = batch.column(0), []
            for n, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    found += [(n, *x) for x in leaks_of(items, t, min_share)]
            if found:
                at, ids, covered, size = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), pa.array(ids, pa.int64()), pa.array(covered, pa.int32()), pa.array(size, pa.int32())],
                    names=["key", "item_id", "covered", "item_words"],
                )

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return out.mapInArrow(work, f"key {kind}, item_id bigint, covered int, item_words int").withColumnRenamed("key", key)


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str, min_share: float = 1 / 3) -> DataFrame:
    """One row per text and item it leaks: key, item_id, covered (equal words in passages), item_words.

    The items come to the driver in blocks of bounded size; each block reads the texts once.
    """
    rows = items.select(F.col(item_id).cast("bigint"), F.col(item_text)).toLocalIterator()
    blocks: list[list[tuple[int, str | None]]] = [[]]
    chars = 0
    for i, t in rows:
        if chars > MAX_BLOCK_CHARS:
            blocks.append([])
            chars = 0
        blocks[-1].append((i, t))
        chars += len(t or "")
    out = None
    for block in blocks:
        part = _block_leaks(df, key, text, block, min_share)
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("covered") >= F.col("item_words") * F.lit(min_share) - 1e-9)
