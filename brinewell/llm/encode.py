"""Encoding of whole texts by a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern. Here that is done on arrays of character classes, a batch at once, instead of by a
regular expression. Words of the lexicon get their ids from the memory-mapped transducer of lexicon.py; all others are merged exactly by
the tokenizer's ranks and remembered. The lexicon has the vocabulary's own words and the frequent ones of a bounded sample
(lexicon_docs documents); it decides the speed alone, the ids are the tokenizer's in any case.

Defined results: null and empty texts give an empty list; special tokens' strings in a text are ordinary text; no text is cut.
"""

from __future__ import annotations

import base64
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm import lexicon
from brinewell.session import mounted, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the tokenizer cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
CHUNK_CHARS = 1 << 21
REMEMBERED = 200_000
SAMPLE_CHARS = 1 << 16  # longer texts are not among the sample's documents, which bounds what the driver reads


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import unicodedata

    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = DIGIT
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


def word_starts(cp: np.ndarray, kinds: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the words of the concatenated non-empty texts start; cp: code points, text_starts: each text's first place."""
    n = len(cp)
    kind = kinds[cp]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[text_starts] = True
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[text_starts] = True
    last_of_text[n] = True
    run_kind = kind[runs]
    blank = np.flatnonzero((run_kind == SPACE) & ~last_of_text[ends])  # white space before something in the same text
    tail = ends[blank] - 1  # its last sign: alone, or part of the next word if it is a plain space
    plain = cp[tail] == 32
    start = edge
    start[tail] = True
    start[ends[blank][plain]] = False
    quote = np.flatnonzero((run_kind == OTHER) & (ends - runs == 1) & (cp[runs] == 39) & ~last_of_text[ends])
    at = runs[quote]
    at = at[start[at]]  # not after a plain space
    if len(at):
        limit = text_starts[np.searchsorted(text_starts, at, side="right") % len(text_starts)]
        limit = np.where(limit <= at, n, limit)
        one, two = cp[np.minimum(at + 1, n - 1)], np.where(at + 2 < limit, cp[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long, 3)):
            b = at[hit]
            start[b + 1] = False
            after = b + size
            inner = after[(after < n)]
            inner = inner[~last_of_text[inner]]
            start[inner] |= kind[inner] == LETTER
    return np.flatnonzero(start)


class Encoder:
    """Encodes lists of texts; one in each worker."""

    def __init__(self, ranks: dict[bytes, int], arrays: dict[str, np.ndarray]):
        import tiktoken

        self.exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.arrays = arrays
        self.offsets, self.ids = np.asarray(arrays["offsets"]), np.asarray(arrays["ids"])
        self.size = np.diff(self.offsets)
        self.kinds = _classes()
        self.memory: dict[bytes, list[int]] = {}

    def merged(self, word: bytes) -> list[int]:
        ids = self.memory.get(word)
        if ids is None:
            ids = self.exact._encode_single_piece(word)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            if len(word) <= 64:
                self.memory[word] = ids
        return ids

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts, byte offsets of their words (with the end), and the words of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts_of = np.cumsum(lengths) - lengths
        some = starts_of[lengths > 0]
        starts = word_starts(cp, self.kinds, some)
        raw = whole.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        per_text = np.searchsorted(starts, starts_of + lengths) - np.searchsorted(starts, starts_of)
        if len(data) == len(cp):
            return data, np.append(starts, len(cp)), per_text
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        return data, np.append(leads[starts], len(data)), per_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not any(texts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        data, edges, per_text = self.words(texts)
        starts, ends = edges[:-1], edges[1:]
        rank = lexicon.ranks(self.arrays, data, starts, ends)
        size = np.where(rank >= 0, self.size[rank], 0) if len(self.size) else np.zeros(len(rank), np.int64)
        unseen = np.flatnonzero(rank < 0)
        raw = data.tobytes()
        extra = [self.merged(raw[a:b]) for a, b in zip(starts[unseen].tolist(), ends[unseen].tolist())]
        size[unseen] = list(map(len, extra))
        to = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        known = np.flatnonzero(rank >= 0)
        single = known[size[known] == 1]
        out[to[single]] = self.ids[self.offsets[rank[single]]]
        several = known[size[known] > 1]
        if len(several):
            n = size[several]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[several], n) + step] = self.ids[np.repeat(self.offsets[rank[several]], n) + step]
        if len(unseen):
            n = size[unseen]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[unseen], n) + step] = np.fromiter((i for x in extra for i in x), np.int32, int(n.sum()))
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        totals = np.concatenate([[0], np.cumsum(size)])[bounds]
        return out, np.diff(totals)


def read_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def build_lexicon(ranks: dict[bytes, int], sample: list[str]) -> dict[str, np.ndarray]:
    """The transducer of the vocabulary's words and of those that occur three times or more in sample."""
    import regex
    import tiktoken

    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    counts: Counter = Counter()
    pattern = regex.compile(PATTERN)
    for t in sample:
        counts.update(pattern.findall(t))
    words = {*ranks, *(w.encode("utf-8", "surrogatepass") for w, n in counts.items() if n >= 3)}
    return lexicon.compile_lexicon({w: exact._encode_single_piece(w) for w in words if len(w) <= 48})


_ENCODERS: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, lexicon_docs: int = 500) -> DataFrame:
    """key and ids (array<int>) of every row of df."""
    spark = df.sparkSession
    ranks = read_ranks(tokenizer)
    sample = [r[0] for r in df.select(text).where(F.length(text) <= SAMPLE_CHARS).limit(lexicon_docs).collect()]
    arrays = build_lexicon(ranks, sample)
    name, folder = uuid.uuid4().hex, shared_dir(spark, "lexicon")
    local = mounted(spark, folder)
    if local:
        lexicon.save(arrays, Path(local))
        shipped = None
    else:  # a shared folder that isn't mounted: the arrays travel with the job, a few MB whatever the corpus
        shipped = spark.sparkContext.broadcast(arrays)
    vocabulary = spark.sparkContext.broadcast(ranks)
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(vocabulary.value, lexicon.mapped(local) if local else shipped.value)
        encoder = _ENCODERS[name]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                b, chars = a + 1, len(texts[a])
                while b < len(texts) and chars + len(texts[b]) <= CHUNK_CHARS:
                    chars += len(texts[b])
                    b += 1
                ids, sizes = encoder.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["key", "ids"])
                a = b

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
