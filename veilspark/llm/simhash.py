"""SimHash near-dedup: fingerprints over word shingles, joined on pigeonhole blocks.

A fingerprint's bit is the majority of that bit in the hashes of a text's shingles. There are two uses:

- `near_groups`: 64 bits, links at a Hamming distance. A fingerprint is cut into `blocks` parts. Two
  fingerprints that differ in at most `distance` bits agree in at least `blocks - distance` parts, so
  all such pairs meet on some choice of that many parts. The number of parts grows with the number of
  different fingerprints (`blocks_for`), so that chance meetings per fingerprint stay bounded.
- `similar_groups` and `keepers`: links at a Jaccard similarity of the shingle sets. At 0.8 about 15 %
  of the bits differ, which 64 bits can't tell from chance, so a block is a band of least hashes: BANDS
  bands of BAND hashes each, whatever the number of texts. A pair at similarity s shares a band with a
  probability of 1 - (1 - s^7)^24: 0.996 at 0.8, 0.9998 at 0.85, 0.17 at 0.5. Candidates are verified by the
  Hamming distance of fingerprints, of the first 64 bits and then of BITS, and what is left by the sets
  themselves. (`keyed_by_blocks` makes blocks of fingerprints alone, without the sets; their number grows
  with the texts.)

Equal fingerprints (or sets) are one class first: only classes are joined, copies cost a row each. A
block's classes aren't crossed: they are verified against one of them and what this links is united. Blocks
whose classes are still in different groups get further leaders (by similarity, about log2 of their rows). In
what these leave in different groups the rows outside of a block's largest group are compared with all of its
rows, hot blocks dealt over many tasks; no other pair can unite anything. By similarity both steps compare fingerprints of WIDE bits, so that hardly a
pair below it leaves the join.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words (or null) have
fingerprint 0 and the empty set, and link like any other. A null doc_id is never the smallest unless
alone. Rows that share a doc_id are judged by their own texts: `keepers` keeps one row of each group,
the one of the smallest doc_id, and one of rows that are equal in all columns. Other columns are passed
on by `keepers` and ignored elsewhere. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, dimension_join, hot_keys, kept, skewed_join
from .components import components, extended

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Of the use by similarity: bands of least hashes and hashes of a band.
BANDS, BAND = 24, 7
#: Of the use by similarity: words of a shingle, similarity, bits, tables of blocks of 20 bits.
SIMILAR_SHINGLE, SIMILARITY, BITS, TABLES = 5, 0.8, 1024, 96
#: Bits of the fingerprints by which a block's pairs are told apart: at 0.7 some 7 % of pairs pass, at 0.66 one in a thousand.
WIDE = 2048
#: Bits that a fingerprint's carried part has, and the share of bits in which a pair at SIMILARITY differs.
CARRIED, DIFFERING = 64, 0.1515
#: Values of a block for each text.
ROOMY = 16
#: Shingles whose bits are counted at a time.
STEP = 1 << 12
SKETCH = "doc_id long, h long, class long, n int, print array<long>, bands array<int>"
KEYED = "class long, w0 long, key long"


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of all shingles of the lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], last)), dtype="<u8", count=len(last))  # noqa: B905


def widened(h: np.ndarray, words: int) -> np.ndarray:
    """`words` hashes for each hash: itself, and mixes of it."""
    if words == 1:
        return h[:, None]
    z = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    z ^= z >> np.uint64(31)
    z[:, 0] = h
    return z


def majority(h: np.ndarray, bits: int = 64) -> np.ndarray:
    """The fingerprint of the hashes, as bytes: bit by bit what more than half of them have."""
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(h), STEP):
        spread = np.unpackbits(np.ascontiguousarray(widened(h[at : at + STEP], bits // 64)).view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little")
        for part in range(0, len(spread), 255):
            ones += spread[part : part + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return int(majority(hashes(text, shingle)).view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and print (the 64 bits as a long)."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches_of, "doc_id long, print long")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Parts of a 64-bit fingerprint for n of them: the fewest whose choices meet by chance less than
    about four times for each, or distance + 5."""
    for blocks in range(distance + 3, distance + 5):
        choices = masks(blocks, distance)
        if len(choices) * n >> 64 * (blocks - distance) // blocks <= 4:
            return blocks
    return distance + 5


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The choices of parts, as bit masks (signed 64 bits)."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    found = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


Near = Callable[[str, str], Column]


def united(keyed: DataFrame, carried: list[str], near: Near, verified: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, refined: Callable[[DataFrame], DataFrame] = lambda rows: rows, nearer: Near | None = None, leading: Column | None = None) -> DataFrame:
    """node and root of the classes that links join. keyed: key, class and the carried columns, a row for
    each class and block; near(x, y): whether structs x and y of class and carried columns are candidates;
    verified: the links among pairs (a, b). Where a block is compared pair by pair, refined gives rows (with
    `me`) larger structs, which `nearer` judges. leading: over `rows` of a block, how many further leaders it
    then has, about."""
    shared = kept(keyed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = shared.filter(F.col("rows") * HOT_KEYS > total).select("key")
    me = F.struct("class", *carried)
    members = kept(skewed_join(keyed.select("key", me.alias("me")), shared, ["key"], F.col("me.class"), hot), "members")
    leaders = members.groupBy("key").agg(F.min("me").alias("leader"))

    def pairs_of(met: DataFrame, x: str, y: str, close: Near) -> DataFrame:
        a, b = F.col(f"{x}.class"), F.col(f"{y}.class")
        return met.filter((a != b) & close(x, y)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def met_in_blocks(rows: DataFrame, other: DataFrame) -> DataFrame:
        return skewed_join(rows, other, ["key"], F.col("me.class"), hot)

    def rooted(rows: DataFrame, roots: DataFrame, of: str, name: str) -> DataFrame:
        named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return rows.join(named, F.col(of) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", of)).drop("_node", "_root")

    judged = kept(pairs_of(met_in_blocks(members.select("key", "me"), leaders), "me", "leader", near), "stars")
    links = kept(verified(judged), "links")
    roots = kept(components(links), "united")
    # The leader meets everybody, so a block of two classes has no other pair; and whom a link joins to it has its root.
    large = members.filter("rows > 2")
    led = rooted(leaders.select("key", F.col("leader.class").alias("head")), roots, "head", "led")
    loose = met_in_blocks(large, led).select("key", F.col("me.class").alias("class"), "head", "led").filter("class <> head")
    loose = loose.withColumn("a", F.least("class", "head")).withColumn("b", F.greatest("class", "head")).join(links, ["a", "b"], "left_anti")
    apart = kept(rooted(loose, roots, "class", "root").filter("root <> led").select("key").distinct(), "blocks")
    if apart.isEmpty():
        return roots
    near, placed = nearer or near, kept(refined(rooted(met_in_blocks(large, apart), roots, "me.class", "root")), "whole")
    if leading is not None:
        more = placed.filter(F.pmod(F.xxhash64("key", "me.class"), F.col("rows")) < leading).select("key", F.col("me").alias("leader"), F.col("root").alias("led"))
        stars = kept(pairs_of(met_in_blocks(placed, more).filter("root <> led"), "me", "leader", near).join(judged, ["a", "b"], "left_anti"), "stars")
        judged, roots = judged.union(stars), kept(extended(roots, kept(verified(stars), "links")), "united")
        placed = kept(rooted(placed.drop("root"), roots, "me.class", "root"), "placed")
    # Of two rows in different groups one at least is outside of the block's largest.
    largest = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("groups"))
    largest = kept(largest.filter("groups > 1").select("key", "major"), "largest")
    placed = kept(met_in_blocks(placed, largest).select("key", "me", "root", (F.col("root") != F.col("major")).alias("minor")), "apart")
    x = placed.select("key", "me", F.col("root").alias("root_x"), "minor")
    y = placed.filter("minor").select("key", F.col("me").alias("other"), F.col("root").alias("root_y"))
    rest = met_in_blocks(x, y).filter("root_x <> root_y and (not minor or me.class < other.class)")
    rest = kept(pairs_of(rest, "me", "other", near).join(judged, ["a", "b"], "left_anti"), "rest")
    if rest.isEmpty():
        return roots
    return extended(roots, kept(verified(rest), "links"))


def grouped(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (doc_id, class, ...) with component_id, the smallest doc_id of the group. classes: class, least
    and copies."""
    rooted = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("class", "root", "component_id")
    hot = classes.filter(F.col("copies") * HOT_KEYS > rows.count()).select("class")
    return skewed_join(rows, named, ["class"], F.col("doc_id"), hot)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """doc_id, print and component_id, the smallest doc_id reachable over links of at most `distance` bits."""
    rows = kept(fingerprints(docs, shingle).withColumnRenamed("print", "class"), "prints")
    classes = kept(rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    choices = masks(blocks or blocks_for(classes.count(), distance), distance)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("class").bitwiseAND(F.lit(m))) for i, m in enumerate(choices)])
    keyed = classes.select("class", F.explode(keys).alias("key"))
    roots = united(keyed, [], lambda x, y: F.bit_count(F.col(f"{x}.class").bitwiseXOR(F.col(f"{y}.class"))) <= distance)
    return grouped(rows, classes, roots).select("doc_id", F.col("class").alias("print"), "component_id")


def width_for(n: int) -> int:
    """Bits of a block for n classes: as many as have ROOMY values for each."""
    return max(16, (ROOMY * max(1, n) - 1).bit_length())


def tables_for(width: int, tables: int = TABLES) -> int:
    """Tables that find as many pairs at SIMILARITY as `tables` of 20 bits do, and not fewer than these."""
    share = 1 - DIFFERING
    return max(tables, int(np.ceil(tables * np.log1p(-(share**20)) / np.log1p(-(share**width)))))


def bands_of(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of the least values of BAND mixes of h; factors: two for each mix."""
    from xxhash import xxh32_intdigest

    x, least = (h >> np.uint64(32)).astype(np.uint32), np.full(len(factors), (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(x), STEP):
        np.minimum(least, (factors[:, :1] * x[at : at + STEP] + factors[:, 1:]).min(axis=1), out=least)
    return np.array([xxh32_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, BAND)], dtype=np.uint32).view(np.int32)


def factors_of_bands() -> np.ndarray:
    found = np.random.default_rng(SEED).integers(0, 1 << 32, (BANDS * BAND, 2), dtype=np.uint32)
    found[:, 0] |= 1
    return found


def sketches(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, bits: int = BITS) -> DataFrame:
    """For each row of docs its doc_id, the hash of all its columns, the hash and size of its set of
    shingles, its fingerprint and its bands."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def lists(rows: list[np.ndarray], width: int, kind: type) -> pa.Array:
            ends = pa.array(np.arange(0, len(rows) * width + 1, width, dtype=np.int32))
            return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.zeros(0, kind)))

        factors = factors_of_bands()
        for batch in batches:
            classes, sizes, prints, bands = [], [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                found = np.unique(hashes(text.as_py() or b"", shingle))
                classes.append(xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(majority(found, bits).view("<i8"))
                bands.append(bands_of(found, factors))
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(np.array(classes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists(prints, bits // 64, np.int64), lists(bands, BANDS, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "class", "n", "print", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(*docs.columns).alias("h"), "text").mapInArrow(batches_of, SKETCH)


def keyed_by_blocks(classes: DataFrame, width: int, tables: int, bits: int = BITS) -> DataFrame:
    """A row for each class and table: its block there, with the carried part."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        places = np.stack([rng.choice(bits, width, replace=False) for _ in range(tables)])
        powers = 1 << np.arange(width, dtype=np.int64)
        table = np.arange(tables, dtype=np.int64) << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = part.column("print").flatten().to_numpy().reshape(-1, bits // 64)
                spread = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little")
                keys = np.stack([spread[:, p].astype(np.int64) @ powers for p in places], axis=1) + table
                again = [np.repeat(c, tables) for c in (part.column("class").to_numpy(), words[:, 0])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, again), pa.array(keys.ravel())], names=["class", "w0", "key"])

    return classes.select("class", "print").mapInArrow(batches_of, KEYED)


def within(bits: int) -> int:
    """The distance that all but one in thousands of pairs at SIMILARITY keep over so many bits."""
    return int(bits * DIFFERING + 3.5 * (bits * DIFFERING * (1 - DIFFERING)) ** 0.5)


def sets_of(docs: DataFrame, chosen: DataFrame, shingle: int = SIMILAR_SHINGLE, bits: int | None = None) -> DataFrame:
    """class and shingles of the classes in chosen (class, h: a row of docs that stands for it); or, instead of
    the shingles, a fingerprint of so many bits."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                part = batch.slice(row, 1000)
                found = [np.unique(hashes(t.as_py() or b"", shingle)) for t in part.column("text").cast(pa.large_binary())]
                found = [majority(f, bits).view("<i8") if bits else f.view(np.int64) for f in found]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("class"), lists], names=["class", "shingles"])

    rows = dimension_join(docs.select(F.xxhash64(*docs.columns).alias("h"), "text"), chosen, "h").select("class", "text")
    return rows.mapInArrow(batches_of, "class long, shingles array<long>").dropDuplicates(["class"])


def similar_groups(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h (of the row), class, root (of the group) and component_id, for groups over links of at
    least `similarity`, which is SIMILARITY or more."""
    found = kept(sketches(docs, shingle), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "n", "print", "bands")
    classes = kept(found.groupBy("class").agg(F.min(row).alias("row"), F.count("*").alias("copies")).select("class", "copies", F.col("row.doc_id").alias("least"), "row.h", "row.n", "row.print", "row.bands"), "classes")
    # Texts without words are one class and similar to nothing else.
    keyed = classes.filter("n > 0").select("class", F.col("print")[0].alias("w0"), F.posexplode("bands").alias("band", "least"))
    keyed = keyed.select("class", "w0", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("least")).alias("key"))

    def fit(n: Column, m: Column) -> Column:
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    def near(x: str, y: str) -> Column:
        return F.bit_count(F.col(f"{x}.w0").bitwiseXOR(F.col(f"{y}.w0"))) <= within(CARRIED)

    def nearer_by(bits: int) -> Near:
        def judge(x: str, y: str) -> Column:
            differ = [F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(bits // 64)]
            return fit(F.col(f"{x}.n"), F.col(f"{y}.n")) & (reduce(lambda a, b: a + b, differ) <= within(bits))

        return judge

    def whole(table: DataFrame, bits: int) -> DataFrame:
        return table.select("class", F.struct("class", "n", *[F.col("print")[i].alias(f"p{i}") for i in range(bits // 64)]).alias("whole"))

    prints, nearer = whole(classes, BITS), nearer_by(BITS)

    def refined(rows: DataFrame) -> DataFrame:
        """Fingerprints of WIDE bits, made for these classes only."""
        chosen = kept(classes.select("class", "h", "n").join(rows.select(F.col("me.class").alias("class")).distinct(), "class"), "chosen")
        wide = sets_of(docs, chosen.select("class", "h"), shingle, WIDE).withColumnRenamed("shingles", "print")
        wide = whole(wide.join(chosen.select("class", "n"), "class"), WIDE)
        return rows.join(wide, F.col("me.class") == wide["class"]).drop("me", "class").withColumnRenamed("whole", "me")

    def with_both(pairs: DataFrame, table: DataFrame, column: str, x: str, y: str) -> DataFrame:
        """pairs, a table, with `column` of a as x and of b as y. Hot keys are those of the pairs, not of a join that counting would run again."""
        hot = {side: hot_keys(pairs, [side]) for side in ("a", "b")}
        for side, other, name in (("a", "b", x), ("b", "a", y)):
            pairs = skewed_join(pairs, table.select(F.col("class").alias(side), F.col(column).alias(name)), [side], F.col(other), hot[side])
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        met = with_both(pairs, prints, "whole", "p", "q")
        close = kept(met.filter(nearer("p", "q")).select("a", "b"), "close")
        wanted = close.select(F.col("a").alias("class")).union(close.select(F.col("b").alias("class"))).distinct()
        sets = kept(sets_of(docs, classes.select("class", "h").join(wanted, "class"), shingle), "sets")
        met = with_both(close, sets, "shingles", "x", "y")
        both = F.size(F.array_intersect("x", "y"))
        return met.withColumn("both", both).filter(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("a", "b")

    roots = united(keyed, ["w0"], near, verified, refined, nearer_by(WIDE), F.log2("rows"))
    return grouped(found.select("doc_id", "h", "class"), classes.select("class", "least", "copies"), roots)


def keepers(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of near copies."""
    rows = kept(similar_groups(docs, shingle, similarity).select("root", "doc_id", "h"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    stays = rows.groupBy("root").agg(F.min(order).alias("stays"), F.count("*").alias("rows"))
    stays = kept(stays.filter("rows > 1").select("root", F.col("stays.h").alias("stays")), "stays")
    hot = hot_keys(rows, ["root"])
    # A row for each hash in a group of several: it goes, or it stays and is there `rows` times.
    marks = skewed_join(rows, stays, ["root"], F.col("h"), hot).groupBy("h").agg(F.max(F.col("h") == F.col("stays")).alias("stays"), F.count("*").alias("rows"))
    marks = kept(marks.filter("not stays or rows > 1").select("h", "stays"), "marks")
    columns, own, mark = docs.columns, "_h", "_stays"
    while own in columns or mark in columns:
        own, mark = f"_{own}", f"_{mark}"
    marks = marks.select(F.col("h").alias(own), F.col("stays").alias(mark))
    marked = dimension_join(docs.withColumn(own, F.xxhash64(*columns)), marks, own, "left")
    return marked.filter(F.col(mark).isNull()).select(columns).unionByName(marked.filter(mark).select(columns).dropDuplicates())
