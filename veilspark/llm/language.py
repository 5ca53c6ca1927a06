"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's bytes are folded (A-Z lower, other ASCII that is no letter as a space) and its runs of 1 to
4 bytes hashed into buckets. Each bucket has an embedding; a text is the average of those of its
runs, and a linear softmax over that average gives the languages. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. On a part of
the sample that training leaves out, a temperature calibrates the probabilities, and a quantile of the
true language's probability becomes the threshold below which a text is rejected. A softmax is sure of
anything, so a text is rejected too if too few of its runs of three bytes occur in the sample, as are
those of other languages and of junk; that threshold comes from the texts left out as well.

As the model is linear after the average, prediction adds a row of language scores for each run:
tasks work on Arrow buffers a slice at a time, so the length of a text doesn't matter.

Defined cases: a text that is null or has no letter is `und` with score 0 and rejected. Ties go to
the language first in code point order. Rows with a null lang aren't learned from. Without any
labelled text every text is `und`. Rows with equal doc_id are predicted each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names

BUCKETS, DIMENSIONS, ORDERS = 1 << 14, 16, (1, 2, 3, 4)
#: Bytes that a task hashes at once.
SLICE = 1 << 18
UNKNOWN = "und"
#: Share of a text's runs of three bytes that the sample must know, at most, and as a part of what its
#: least familiar hundredth of texts has; runs that every text gets as if they were such.
FAMILIAR, PART, SMOOTHED = 0.6, 0.75, 5
#: Bytes as the features see them.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], dtype=np.uint32)


def hashed(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of `order` folded bytes, and which of them are more than spaces."""
    n = len(data) - order + 1
    code = data[:n].copy()
    for i in range(1, order):
        code <<= np.uint32(8)
        code |= data[i : i + n]
    blank = np.uint32(int.from_bytes(b" " * order, "big"))
    return ((code * np.uint32(2654435761) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(18)).astype(np.int32), code != blank


def counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs, over its runs' number."""
    total = np.zeros(BUCKETS)
    for at in range(0, len(text), SLICE):
        data = FOLD[np.frombuffer(text[at : at + SLICE + max(ORDERS) - 1], dtype=np.uint8)]
        for order in ORDERS:
            if len(data) >= order:
                bucket, real = hashed(data, order)
                own = slice(0, SLICE)
                total += np.bincount(bucket[own][real[own]], minlength=BUCKETS)
    return total / max(1.0, total.sum())


def dense(seen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of all buckets for each text, from those that occur in it; only a few texts have such rows at once."""
    x = np.zeros((len(seen), BUCKETS), dtype=np.float32)
    for row, (at, share) in zip(x, seen, strict=True):
        row[at] = share
    return x


def runs_of_three(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes below 2 ** 24 of the runs of three folded bytes, and which are more than spaces."""
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    return code, code != 0x202020


@dataclass
class Model:
    languages: list[str]
    #: Score of each language for a bucket, and its bias; scores are divided by the temperature.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: A bit for each run of three bytes that the sample holds, and the share of them that a text needs.
    known: np.ndarray
    familiar: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x + self.bias) / self.temperature
        z -= z.max(axis=-1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 30, rate: float = 20.0, held: int = 5, lost: float = 0.005, seed: int = 7) -> Model:
    """Fit to texts and labels in the order given; every `held`-th text calibrates only. `lost` is the
    share of true texts that the threshold may reject."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    seen = [(at := np.flatnonzero(c := counts(t)).astype(np.uint16), c[at].astype(np.float32)) for t in texts]
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    softmax, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    left_out = np.arange(len(y)) % held == held - 1
    if not left_out.any() or len(y) < 4 * held:
        left_out[:] = False
    fit = np.flatnonzero(~left_out)
    weight = len(fit) / (len(languages) * np.maximum(1, np.bincount(y[fit], minlength=len(languages))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            rows = dense([seen[i] for i in batch])
            average = rows @ embedding
            z = average @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[y[batch]][:, None] / len(batch)
            back = p @ softmax.T
            softmax -= step / 20 * average.T @ p
            bias -= step / 200 * p.sum(axis=0)
            used = np.flatnonzero(rows.any(axis=0))
            embedding[used] -= step * rows[:, used].T @ back
    known = np.zeros(1 << 24, dtype=bool)
    for i in fit:
        known[runs_of_three(FOLD[np.frombuffer(texts[i] + b"  ", dtype=np.uint8)])[0]] = True
    model = Model(languages, embedding @ softmax, bias, 1.0, 0.0, np.packbits(known), 0.0)
    check = np.flatnonzero(left_out) if left_out.any() else fit
    z = np.concatenate([dense([seen[i] for i in check[at : at + 64]]) @ model.table for at in range(0, len(check), 64)])

    def loss(t: float) -> float:
        model.temperature = t
        return -float(np.log(np.maximum(model.probabilities(z)[np.arange(len(check)), y[check]], 1e-12)).mean())

    model.temperature = min(np.geomspace(0.2, 5, 40), key=loss)
    true = np.sort(model.probabilities(z)[np.arange(len(check)), y[check]])
    model.threshold = min(0.5, float(true[int(lost * len(true))]))
    _, share = scores(pa.array([texts[i] for i in check], pa.large_binary()), np.arange(len(check)), model)
    model.familiar = min(FAMILIAR, PART * float(np.sort(share)[len(share) // 100]))
    return model


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id's text modulo 4 isn't 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = 400, rows: int = 2400, text_bytes: int = 20_000) -> tuple[list[bytes], list[str]]:
    """At most `rows` labelled texts, per_language of each language and at least one, by the order of a hash of
    their id. Of a text over text_bytes only a window of text_bytes / 4 characters, at a
    place that the hash gives, is learned."""
    labelled = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull())
    seen = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not seen:
        return [], []
    per_language = max(1, min(per_language, rows // len(seen)))
    usable = labelled.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("draw"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - text_bytes // 4)) + 1
    window = F.when(F.octet_length("text") <= text_bytes, F.col("text")).otherwise(F.substring("text", start.cast("int"), F.lit(text_bytes // 4)))
    usable = usable.withColumn("text", window).filter(F.col("text").rlike(r"\p{L}"))
    # The share of a language that is drawn by hash grows until enough rows pass, or it has no more.
    found: dict[str, list] = {r["lang"]: [] for r in seen}
    counts, factor = {r["lang"]: r["count"] for r in seen}, 2
    while short := [name for name in counts if len(found[name]) < per_language]:
        least = {name: min(1 << 20, 1 + factor * per_language * (1 << 20) // counts[name]) for name in short}
        pick = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang"))
        place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "text"))
        for name in short:
            found[name] = []
        for r in usable.filter(F.col("draw") < pick).withColumn("place", place).filter(F.col("place") <= per_language).orderBy("draw", "doc_id", "text").collect():
            found[r["lang"]].append(r)
        counts = {name: counts[name] for name in short if least[name] < 1 << 20}
        factor *= 8
    rows_ = sorted((r for own in found.values() for r in own), key=lambda r: (r["draw"], r["doc_id"], r["text"]))
    return [r["text"].encode() for r in rows_], [r["lang"] for r in rows_]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and rejected added (dropping columns of these names)."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    rows = docs.drop(*(f.name for f in added))
    (own,) = free_names(rows.columns, "_letters")
    schema = T.StructType([*rows.schema.fields, *added])
    rows = rows.withColumn(own, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(own).to_numpy(zero_copy_only=False)
            languages, score, rejected = np.full(len(letters), UNKNOWN, dtype=object), np.zeros(len(letters)), np.ones(len(letters), dtype=bool)
            if model is not None and letters.any():
                which = np.flatnonzero(letters)
                x, share = scores(batch.column("text"), which, model)
                p = model.probabilities(x)
                best = p.argmax(axis=1)
                languages[which] = np.array(model.languages, dtype=object)[best]
                score[which] = p.max(axis=1)
                rejected[which] = (score[which] < model.threshold) | (share < model.familiar)
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != own]
            names = [f.name for f in batch.schema if f.name != own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, *(f.name for f in added)])

    return rows.mapInArrow(predict, schema)


def scores(texts: pa.Array, which: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean row of the model's table over each text's runs, and the share of its runs of three bytes that
    the model knows, for the texts at `which`. Short texts share a slice; a long one takes several."""
    table, known = np.ascontiguousarray(model.table), np.unpackbits(model.known)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    out, n, met, seen = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        for at in range(begin, end, SLICE):
            stop = min(end, at + SLICE)
            folded = FOLD[data[at : min(end, stop + max(ORDERS) - 1)]]
            # Row of each position; a run that leaves its text belongs to none.
            row = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first : last + 1], at, stop)))
            ends = offsets[1:][row] - at
            position = np.arange(stop - at)
            for order in ORDERS:
                if len(folded) < order:
                    continue
                bucket, real = hashed(folded, order)
                m = min(len(bucket), stop - at)
                keep = np.flatnonzero(real[:m] & (position[:m] + order <= ends[:m]))
                at_row, at_bucket = row[keep] - first, bucket[keep]
                n[first:last] += np.bincount(at_row, minlength=last - first)
                if order == 3:
                    seen[first:last] += np.bincount(at_row, minlength=last - first)
                    met[first:last] += np.bincount(at_row, weights=known[runs_of_three(folded)[0][keep]], minlength=last - first)
                for k in range(table.shape[1]):
                    out[first:last, k] += np.bincount(at_row, weights=table[at_bucket, k], minlength=last - first)
        first = last
    return out[which] / np.maximum(1.0, n[which])[:, None], (met[which] + SMOOTHED) / (seen[which] + SMOOTHED)


def fit(docs: DataFrame, **bounds: int) -> Model | None:
    texts, labels = sample(docs, **bounds)
    return train(texts, labels) if texts else None
