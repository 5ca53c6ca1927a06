"""Codes in a stream's state and rows handed over once, over several batches."""

import random
import tracemalloc

import pandas as pd
import pytest

from veilspark.streaming import book

SCHEMA = "doc_id long, part_no int, seq int, st int, kind string, orig string, extra string"


def rows_of(rng, batch):
    kinds, origs = ("電話", "電話", "電話", "番号", None), ("hot", "hot", None, "", "長" * 3000, *map(str, range(batch * 5, 25 + batch * 10)))
    rows = [(rng.choice((None, batch, rng.randrange(9))), 0, rng.randrange(4), i, rng.choice(kinds), rng.choice(origs), "x") for i in range(120)]
    return rows + rows[:4]


@pytest.mark.parametrize("parts", [1, 4])
def test_codes_over_batches(spark, tmp_path, parts):
    """An original keeps its number, no number is given twice, and those of a part are gapless."""
    rng, folder, path, seen, n_rows = random.Random(5), f"file://{tmp_path}/spans", f"file://{tmp_path}/book", {}, 0
    (tmp_path / "spans").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    for batch in range(3):
        rows = rows_of(rng, batch)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        found = book.run(book.coded(stream, parts), path)
        n_rows += sum(r[4] is not None and r[5] is not None for r in rows)
        got = found.collect()
        assert len(got) == n_rows
        numbers = {(r.prefix, r.orig): r.n for r in got}
        assert len({(r.prefix, r.orig, r.n) for r in got}) == len(numbers) == len({(p, n) for (p, _), n in numbers.items()})
        assert seen.items() <= numbers.items()
        # What is new in this batch comes after what was there, in order of its first place.
        first = {}
        for r in sorted((r for r in got if (r.prefix, r.orig) not in seen), key=lambda r: (r.doc_id is not None, r.doc_id, r.seq, r.st)):
            first.setdefault((r.prefix, r.orig), len(first))
        for prefix in ("電話", "番号"):
            for part in range(parts):
                own = [n for (p, _), n in numbers.items() if p == prefix and (n - 1) % parts == part]
                assert sorted(own) == [part + 1 + parts * i for i in range(len(own))]
                new = sorted((k for k in first if k[0] == prefix and (numbers[k] - 1) % parts == part), key=first.get)
                assert [numbers[k] for k in new] == sorted(numbers[k] for k in new)
        kept = book.book_of(found).collect()
        assert {(r.prefix, r.orig): r.n for r in kept} == numbers and len(kept) == len(numbers)
        seen = numbers
    # Running it again without new files changes nothing.
    assert book.run(book.coded(stream, parts), path).count() == n_rows


def test_no_spans(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert book.run(book.coded(spark.readStream.schema(SCHEMA).parquet(folder))).collect() == []


def test_rows_are_handed_over_once(spark, tmp_path):
    folder, path, schema = f"file://{tmp_path}/rows", f"file://{tmp_path}/out", "a long, b string"
    (tmp_path / "rows").mkdir()
    stream = spark.readStream.schema(schema).parquet(folder)
    for rows, upto in (([(1, "x"), (1, "x"), (None, "x"), (1, None)], 3), ([(1, "x"), (2, "x"), (1, None), (1, "")], 5), ([(None, "x")], 5)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = book.run(book.handed_over(stream), path).collect()
        assert len(got) == upto == len({(r.a, r.b) for r in got}) == len({r.content_hash for r in got})


class Handle:
    """State of one key, in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def getValueState(self, *_):  # noqa: N802
        return self

    def getMapState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802
        return key in self.map

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value


def test_a_counter_holds_no_more_than_a_chunk(spark):
    def chunks():
        for c in reversed(range(60)):
            ids = range(c * 5000, c * 5000 + 5000)
            yield pd.DataFrame({"doc_id": ids, "part_no": 0, "seq": 0, "st": 0, "prefix": "p", "orig": [f"original-{i % 7}" for i in ids], "part": 3})

    counter = book.Counter(16)
    counter.init(Handle())
    tracemalloc.start()
    rows, codes, new = 0, {}, {}
    for out in counter.handleInputRows(("p", 3), chunks(), None):
        rows += len(out)
        codes |= dict(zip(out["orig"], out["n"], strict=True))
        new |= {o: d for o, d, n in zip(out["orig"], out["doc_id"], out["new"], strict=True) if n}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 300_000 and peak < 12e6
    assert codes == {f"original-{i}": 16 * i + 4 for i in range(7)} and new == {f"original-{i}": i for i in range(7)}
