"""Personal information inside free text: finding it and putting typed placeholders in its place.

Candidates come from mentions.py; the skip-chain field of skipchain.py decides which are meant. It is trained when a query is built, on
SAMPLES made-up documents (a fixed number, whatever the corpus) of madeup.py.

Defined results: null and empty texts have no mentions and stay as they are; a value counts once a document; of overlapping mentions the one
that starts first is replaced, then the longer one; everything outside the mentions stays as it is, byte for byte; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.madeup import made_up
from brinewell.llm.mentions import Mention, mentions
from brinewell.llm.skipchain import SkipChain

SAMPLES = 4000
BATCH_CHARS = 4 << 20

@lru_cache(maxsize=1)
def trained(samples: int = SAMPLES) -> SkipChain:
    documents, meant = [], []
    for text, places in made_up(samples):
        found = mentions(text)
        documents.append(found)
        meant.append([(m.label, m.start, m.end) in places for m in found])
    return SkipChain.train(documents, meant)


def _decided(chain: SkipChain, texts: list[str]) -> list[list[Mention]]:
    """The meant mentions of each text, free of overlaps."""
    candidates = [mentions(t) for t in texts]
    out = []
    for found, yes in zip(candidates, chain.decide(candidates)):
        kept: list[Mention] = []
        for m, is_meant in zip(found, yes):
            if is_meant and (not kept or m.start >= kept[-1].end):
                kept.append(m)
        out.append(kept)
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    a = 0
    while a < len(texts):
        b, chars = a + 1, len(texts[a] or "")
        while b < len(texts) and chars + len(texts[b] or "") <= BATCH_CHARS:
            chars += len(texts[b] or "")
            b += 1
        yield a, [t or "" for t in texts[a:b]]
        a = b


def find_personal(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, label and value, as written in the text, of each mention; once a document."""
    shared = df.sparkSession.sparkContext.broadcast(trained())
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for start, texts in _chunks(batch.column(1).to_pylist()):
                rows = []
                for k, (t, found) in enumerate(zip(texts, _decided(shared.value, texts))):
                    rows += [(start + k, *x) for x in dict.fromkeys((m.label, t[m.start : m.end]) for m in found)]
                if rows:
                    at, labels, values = zip(*rows)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(labels), pa.array(values)], names=["key", "label", "value"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(work, f"key {kind}, label string, value string").withColumnRenamed("key", key)


def mask_personal(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the text with <EMAIL>, <PHONE>, <IDENTITY>, <ADDRESS> and <NAME> in place of the mentions; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(trained())
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            for start, texts in _chunks(given):
                out = []
                for k, (t, found) in enumerate(zip(texts, _decided(shared.value, texts))):
                    parts, at = [], 0
                    for m in found:
                        parts += [t[at : m.start], f"<{m.label.upper()}>"]
                        at = m.end
                    out.append(None if given[start + k] is None else "".join([*parts, t[at:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(out, pa.string())], names=["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"key {kind}, text string").withColumnRenamed("key", key)
