"""Spelling variants: words one edit apart, found by two-dimensional range reporting with wavelet trees.

Two words are near if one code point is inserted, deleted or replaced. A word w of L code points is one
edit at position i away from the words that begin with w[:i] and end with w[i+1:] (of L code points:
replaced) or with w[i:] (of L + 1: inserted). Words that begin alike are an interval of the words in order,
words that end alike one of the words in order of their reversals; a word is a point of its two places, and the words near w
at i are the points of a rectangle. A wavelet tree over the places in reverse order, taken in forward
order, reports them level by level, for all words of a part at once. Inserted code points count at their
last possible position, so that each pair is found once.

Words are dealt so that no task gets them all: the edits of a class of L and L + 1 code points at positions
[a, b) only concern words that share their first a and their last L - b code points, which is their bucket.
Positions are first halved; a bucket of more than PART code points has its positions halved again, until it
fits or one position is left, where the alphabet bounds it. Buckets meet in parts of about PART code points.
Pairs stay in their task: a word leaves it with its number of near words and the best of them.

Defined cases: a null text has no words; a null doc_id counts as an empty one. Equal rows are counted
each. A word's form is its near word of the largest count, ties to the smallest by code points, if that count is
at least TIMES the word's; so forms can't go round, and a root is at most log(counts) / log(TIMES) steps away.
Very long words are words like any other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dimension_join, kept

#: Letters of a run, in UTF-8 after A-Z were lowered: a-z, or U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LEAST, OCCURRENCES, TIMES, DAMAGED = 7, 2, 10, 31
#: Code points of a part.
PART = 1 << 20
#: Words that a task counts before it passes their counts on.
HELD = 200_000
NEAR = "word string, n_near long, best_n long, best string"


def altered(run: bytes, seed: int, least: int = LEAST) -> str | None:
    """The run as it is counted: without one code point, if DAMAGED divides its hash."""
    h = crc32(run, seed)
    word = run.decode()
    if h % DAMAGED == 0:
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
    return word if len(word) >= least else None


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """word and n of all words of at least `least` code points in the whole texts."""

    def table(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                seed = crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                for run, n in Counter(RUN.findall((text.as_py() or b"").lower())).items():
                    if len(run) >= least and (word := altered(run, seed, least)) is not None:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield table(counts)
                    counts = {}
        yield table(counts)

    return docs.select("doc_id", "text").mapInArrow(batches_of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Points:
    """A wavelet tree (of levels, without pointers) over the second coordinates in order of the first."""

    def __init__(self, second: np.ndarray) -> None:
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for bit in reversed(range(max(1, int(len(second) - 1).bit_length()))):
            ones = (second >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, int(zeros[-1]), zeros))
            second = np.concatenate([second[~ones], second[ones]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, second coordinate) of the points in [low, high) x [least, most), all rectangles at once."""
        row, base = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for bit, n_zeros, zeros in self.levels:
            z0, z1 = zeros[low], zeros[high]
            upper = base + (1 << bit)
            left, right = (z0 < z1) & (least[row] < upper), (high - z1 > low - z0) & (most[row] > upper)
            low, high = np.concatenate([z0[left], (n_zeros + low - z0)[right]]), np.concatenate([z1[left], (n_zeros + high - z1)[right]])
            row, base = np.concatenate([row[left], row[right]]), np.concatenate([base[left], upper[right]])
            able = (base < most[row]) & (base + (1 << bit) > least[row])
            row, base, low, high = row[able], base[able], low[able], high[able]
        return row, base


class Order:
    """Words in order: their places, and the intervals of those that share their first code points."""

    def __init__(self, words: list[str], long: np.ndarray, width: int) -> None:
        order = np.array(sorted(range(len(words)), key=words.__getitem__))
        self.codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype="<u4").reshape(-1, width)
        self.place = np.empty(len(words), dtype=np.int64)
        self.place[order] = np.arange(len(words))
        shared = np.full(len(words), -1)
        for at in range(1, len(words), BLOCK):
            rows = order[at - 1 : at + BLOCK]
            differ = self.codes[rows[1:]] != self.codes[rows[:-1]]
            shared[at : at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.shared, self.most = shared, int(shared.max(initial=0))
        #: Places among the short and among the long words.
        self.among = [np.concatenate([[0], np.cumsum(x[order])]) for x in (~long, long)]
        self.of = [order[~long[order]], order[long[order]]]

    def sharing(self, length: int, kind: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals, among words of a kind (0 short, 1 long), of those that share the first code points of each of `words`."""
        first = self.shared < length
        starts = np.append(np.flatnonzero(first), len(first))
        group = (np.cumsum(first) - 1)[self.place[words]]
        return self.among[kind][starts[group]], self.among[kind][starts[group + 1]]


#: Neighbours in order that are compared at a time.
BLOCK = 8192


def near_words(words: list[str], n: np.ndarray, length: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words, best near word) for the words of `length` and length + 1 code points that have
    near ones by edits at positions [a, b) of the shorter word."""
    long = np.array([len(w) > length for w in words])
    short = np.flatnonzero(~long)
    forward, backward = Order(words, long, length + 1), Order([w[::-1] for w in words], long, length + 1)
    trees, second = [], [np.cumsum(~long[np.argsort(backward.place)]) - 1, np.cumsum(long[np.argsort(backward.place)]) - 1]
    for kind in (0, 1):
        trees.append(Points(second[kind][backward.place[forward.of[kind]]]))
    source, target = [], []
    for i in range(a, b):
        for kind in (0, 1):
            rest = length - i - 1 + kind
            if rest < 0 or i > forward.most or rest > backward.most:
                continue
            (low, high), (least, most) = forward.sharing(i, kind, short), backward.sharing(rest, kind, short)
            able = (high - low > 1 - kind) & (most - least > 1 - kind)
            asked = short[able]
            row, place = trees[kind].report(low[able], high[able], least[able], most[able])
            x, y = asked[row], backward.of[kind][place]
            other = (forward.codes[y, i] != forward.codes[x, i]) if kind else x != y
            source.append(x[other])
            target.append(y[other])
            if kind:
                source.append(y[other])
                target.append(x[other])
    if not source:
        return (np.zeros(0, np.int64),) * 3
    x, y = np.concatenate(source), np.concatenate(target)
    best = np.lexsort((forward.place[y], -n[y], x))
    x, y = x[best], y[best]
    found, first, counts = np.unique(x, return_index=True, return_counts=True)
    return found, counts, y[first]


def bucket(class_: Column, a: Column, b: Column, word: Column) -> Column:
    """What the words share that edits of the class at positions [a, b) can link."""
    tail = F.greatest(class_ - b, F.lit(0))
    return F.xxhash64(class_, a, b, F.substring(word, F.lit(1), a), F.substring(word, F.length(word) - tail + 1, tail))


def halves(class_: Column, a: Column, b: Column, word: Column) -> Column:
    """The two halves of the positions [a, b), with their buckets."""
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(*[F.struct(x.alias("a"), y.alias("b"), bucket(class_, x, y, word).alias("bucket")) for x, y in ((a, middle), (middle, b))])


def dealt(words: DataFrame, part: int = PART) -> DataFrame:
    """Rows of words with class_ (the code points of the shorter words), positions [a, b) and bucket, in
    which no bucket has more than `part` code points unless it has one position."""
    classes = F.array(F.length("word"), F.length("word") - 1)
    rows = words.withColumn("class_", F.explode(classes))
    rows = rows.withColumn("half", F.explode(halves(F.col("class_"), F.lit(0), F.col("class_") + 1, F.col("word")))).select("word", "n", "class_", "half.*")
    done = None
    while True:
        rows = kept(rows, "dealt")
        size = F.count("*") * (F.first("class_") + 1)
        large = kept(rows.filter(F.col("b") - F.col("a") > 1).groupBy("bucket").agg(size.alias("size")).filter(F.col("size") > part).select("bucket"), "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        # There are at most rows / part large buckets.
        fit = dimension_join(rows, large.withColumn("split", F.lit(True)), "bucket", "left")
        ready = fit.filter(F.col("split").isNull() | (F.col("b") - F.col("a") <= 1)).drop("split")
        done = ready if done is None else done.unionByName(ready)
        rows = fit.filter(F.col("split") & (F.col("b") - F.col("a") > 1)).withColumn("half", F.explode(halves(*map(F.col, ("class_", "a", "b", "word"))))).select("word", "n", "class_", "half.*")


def near_counts(words: DataFrame, part: int = PART) -> DataFrame:
    """word, n_near, best (by count, then by code points) and best_n, for words that have near ones."""
    rows = dealt(words, part).select("word", "n", "class_", "a", "b", "bucket")
    parts = rows.groupBy("class_", "a", "b").agg(F.ceil(F.count("*") * (F.col("class_") + 1) / part).cast("int").alias("parts"))
    rows = dimension_join(rows, parts, ["class_", "a", "b"]).withColumn("part", F.pmod("bucket", F.col("parts")).cast("int"))

    def of_part(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        length, a, b = (int(k) for k in key[:3])
        names, n = held["word"].tolist(), held["n"].to_numpy()
        found, counts, best = near_words(names, n, length, a, b)
        text = np.array(names, dtype=object)
        return pd.DataFrame({"word": pd.Series(text[found], dtype=object), "n_near": counts, "best_n": n[best], "best": pd.Series(text[best], dtype=object)})

    found = rows.groupBy("class_", "a", "b", "part").applyInPandas(of_part, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("row")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("row.less")).alias("best_n"), "row.best")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the rows of forms (word, form), by following forms to the last."""
    found = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # What is reached is doubled each time.
        found = kept(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.drop("moved")


def variants(docs: DataFrame, least: int = LEAST, often: int = OCCURRENCES, times: int = TIMES, part: int = PART) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of at least `least` code points that occur at
    least `often` times."""
    words = kept(occurrences(docs, least).filter(F.col("n") >= often), "words")
    near = near_counts(words, part)
    has = F.col("best_n") >= times * F.col("n")
    rows = kept(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "variants")
    rooted = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
