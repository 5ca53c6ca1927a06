"""Substring dedup over sliding spans of sentences.

Texts are cut into sentences, and sentences of more than LONG words into shorter ones: after each word
that has the least hash of some WINDOW neighbouring words of its sentence. So a cut depends on the words
within WINDOW of it only, parts have at most WINDOW words, and two places that share 51 words share a run
of at least WORDS words, wherever the 51 stand in the sentences around them. From each sentence the
shortest run of at least `sentences` sentences and `words` words is hashed, as a polynomial of the hashes of its
parts, for many texts at once; runs that occur more than once in the corpus meet by their hash, and every sentence that a run other than the first covers is
removed. First is the smallest document id, then the earlier place. The hashes are counted before
anything is joined, places are looked up for repeated runs only, and the rows of a hot run are dealt
over many tasks.

Defined cases: a null text stays null. Texts with fewer words or sentences than a run are left alone.
Rows that agree in doc_id and text are one document: they are rewritten alike and don't repeat each
other. A null doc_id comes last. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, kept, skewed_join

#: A sentence with its ending and the white space after it; together they are the whole text.
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
SPACED = re.compile(r"\s*\S+\s*")
SENTENCES, WORDS = 2, 20
#: Words of a sentence that isn't cut further, and words among which one ends a part of a longer one:
#: 4 * (WINDOW - 1) + WORDS is less than 51.
LONG, WINDOW = 15, 8
#: Texts that a task rewrites before it passes them on, and parts that it holds.
TEXTS, HELD = 500, 50_000
PARTS = "doc_id long, h long, hashed array<long>, sizes array<int>"
#: Of the hashes of runs.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CLEAN = "doc_id long, text string, n_removed int, removed array<struct<start:int,end:int>>"


@lru_cache(1 << 16)
def mark(word: str) -> int:
    return zlib.crc32(word.encode()) * 0x9E3779B1 & 0xFFFFFFFF


def cuts(words: list[str]) -> list[int]:
    """Where the parts of a sentence end, counting its words."""
    n = len(words)
    if n <= LONG:
        return [n]
    marks, out, best = list(map(mark, words)), [], -1
    for end in range(WINDOW - 1, n):
        if best <= end - WINDOW:
            window = marks[end - WINDOW + 1 : end + 1]
            best = end - window[::-1].index(min(window))
            out.append(best + 1)
        elif marks[end] <= marks[best]:
            best = end
            out.append(best + 1)
    if out[-1] != n:
        out.append(n)
    return out


def sentences_of(text: str) -> list[str]:
    """The sentences of a text, parts of long ones for themselves; together they are the text."""
    out = []
    for sentence in SENTENCE.findall(text):
        found = cuts(sentence.split())
        if len(found) == 1:
            out.append(sentence)
            continue
        spaced, start = SPACED.findall(sentence), 0
        for at in found:
            out.append("".join(spaced[start:at]))
            start = at
    return out


def cut(text: str) -> tuple[bytearray, list[int]]:
    """The hashes of the parts of a text, 8 bytes each, and their words."""
    from xxhash import xxh3_64_digest

    sizes, hashed = [], bytearray()
    for sentence in SENTENCE.findall(text):
        said, start = sentence.split(), 0
        for at in cuts(said):
            sizes.append(at - start)
            hashed += xxh3_64_digest(" ".join(said[start:at]))
            start = at
    return hashed, sizes


def parts_of(docs: DataFrame) -> DataFrame:
    """doc_id, h, and the hashes and words of the parts of each text of docs (doc_id, h, text)."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(ids: list, hs: list, hashed: bytearray, sizes: list[int], counts: list[int]) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *counts], dtype=np.int32))
            hashes = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(bytes(hashed), dtype="<i8")))
            columns = [pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), hashes, pa.ListArray.from_arrays(ends, pa.array(sizes, pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "hashed", "sizes"])

        for batch in batches:
            ids, hs, hashed, sizes, counts = [], [], bytearray(), [], []
            for doc_id, h, text in zip(batch.column("doc_id"), batch.column("h"), batch.column("text"), strict=True):
                found, n = cut(text.as_py())
                ids.append(doc_id.as_py())
                hs.append(h.as_py())
                hashed += found
                sizes += n
                counts.append(len(n))
                if len(sizes) >= HELD:
                    yield batch_of(ids, hs, hashed, sizes, counts)
                    ids, hs, hashed, sizes, counts = [], [], bytearray(), [], []
            yield batch_of(ids, hs, hashed, sizes, counts)

    return docs.select("doc_id", "h", "text").filter("text is not null").mapInArrow(batches_of, PARTS)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(hashed: np.ndarray, sizes: np.ndarray, ends: np.ndarray, sentences: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The runs of texts whose parts follow each other; ends: where each text's parts end. The number of each run's
    text, the part of all at which it starts, how many it has, and its hashes: polynomials of those of its parts
    in odd numbers, modulo 2^64."""
    said, at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.arange(len(sizes))
    end = np.maximum(np.searchsorted(said, said[:-1] + words), at + sentences)
    text = np.searchsorted(ends, at, side="right")
    whole = end <= ends[text] if len(ends) else np.zeros(0, dtype=bool)
    text, at, end = text[whole], at[whole], end[whole]
    hashes = []
    for base in BASES:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashed * powers(base, len(hashed)), dtype=np.uint64)])
        hashes.append((sums[end] - sums[at]) * powers(pow(base, -1, 1 << 64), len(hashed))[at])
    return text, at, end - at, hashes


def spans(parts: DataFrame, sentences: int = SENTENCES, words: int = WORDS, places: bool = True) -> DataFrame:
    """a (the first hash) of each run of parts; with places also b (the second), doc_id, h, pos and n."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, start = np.cumsum(batch.column("hashed").value_lengths().to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:
                # Texts of HELD parts together, or one of more.
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + HELD, side="right")))
                part = batch.slice(start, stop - start)
                hashed, sizes = (part.column(c).flatten().to_numpy() for c in ("hashed", "sizes"))
                own = ends[start:stop] - before
                text, at, n, hashes = runs(hashed.view(np.uint64), sizes, own, sentences, words)
                a, b = (pa.array(h.view(np.int64)) for h in hashes)
                start = stop
                if not places:
                    yield pa.RecordBatch.from_arrays([a], names=["a"])
                    continue
                pos, rows = at - np.concatenate([[0], own])[text], pa.array(text)
                columns = [a, b, part.column("doc_id").take(rows), part.column("h").take(rows), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc_id", "h", "pos", "n"])

    return parts.mapInArrow(batches_of, "a long, b long, doc_id long, h long, pos int, n int" if places else "a long")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "pos")


def repeated(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, h, covered: the runs of each document that aren't the first of their kind, as
    (pos, n), counting sentences."""
    # Texts are cut once and their parts written; runs are made of them twice, as these take as much room as the texts.
    parts = kept(parts_of(keyed(docs)), "parts")
    # Counted by the first hash, which may take a run too many along; places are told apart by both.
    counts = kept(spans(parts, sentences, words, places=False).groupBy("a").agg(F.count("*").alias("runs")).filter("runs > 1"), "counts")
    total = counts.agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("runs") * HOT_KEYS > total).select("a")
    spread = F.struct("doc_id", "h", "pos")
    again = kept(skewed_join(spans(parts, sentences, words), counts.drop("runs"), ["a"], spread, hot), "runs")
    first = again.groupBy("a", F.col("b").alias("own")).agg(F.min(place()).alias("first"))
    others = skewed_join(again, first, ["a"], spread, hot).filter(F.col("b") == F.col("own")).filter(~place().eqNullSafe(F.col("first")))
    return others.groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "n")).alias("covered"))


def dedup(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """One row for each row of docs: its text without the covered sentences, and their places in
    the old text (code points, neighbours joined)."""
    covered = repeated(docs, sentences, words).select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), "covered")
    rows = keyed(docs).join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left").select("doc_id", "text", "covered")

    def rewritten(doc_id: int, text: str | None, covered) -> tuple:
        if covered is None:
            return doc_id, text, 0, []
        parts = sentences_of(text)
        gone = {i for c in covered for i in range(c["pos"], c["pos"] + c["n"])}
        places, at = [], 0
        for i, part in enumerate(parts):
            if i in gone:
                if places and places[-1]["end"] == at:
                    places[-1]["end"] = at + len(part)
                else:
                    places.append({"start": at, "end": at + len(part)})
            at += len(part)
        return doc_id, "".join(p for i, p in enumerate(parts) if i not in gone), len(gone), places

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            for at in range(0, len(batch), TEXTS):
                part = slice(at, at + TEXTS)
                out = [rewritten(*row) for row in zip(ids[part], batch["text"][part], batch["covered"][part], strict=True)]
                yield pd.DataFrame(out, columns=["doc_id", "text", "n_removed", "removed"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(rewrite, CLEAN)
