"""Line dedup against a plain Python version of its rule, and its recall on planted templates."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilspark.llm import lines

WORDS = [a + b for a in "ka lo mi tu re sa no pe".split() for b in "n r s t l m".split()]


def long_of(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values):
    """Spark's xxhash64 of strings, ints (as int) and longs (as tuples of one)."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxh64_intdigest(data, h)
    return long_of(h)


def murmur(text):
    """Spark's hash of a string."""
    data, h, m = text.encode(), 42, 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> 32 - r) & m
    whole = len(data) // 4 * 4
    for k in [*struct.unpack(f"<{whole // 4}i", data[:whole]), *struct.unpack(f"{len(data) - whole}b", data[whole:])]:
        k = turn((k & m) * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def tokens_of(raw):
    masked = re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", raw, flags=re.ASCII)
    t = re.split(r"\s+", masked.strip(" \t\r\v\f"), flags=re.ASCII)
    if t == [""]:
        return None
    return tuple(re.split(r"\s+", raw.strip(" \t\r\v\f"), flags=re.ASCII)) if len(t) < 3 and set(t) == {"<*>"} else tuple(t)


def brute_templates(seen):
    """Template of each different line (tuple of tokens)."""
    out, groups = {}, defaultdict(set)
    for t in seen:
        groups[chained(len(t), *t[:3])].add(t)
    for level in range(3):
        later = defaultdict(set)
        for leaf, members in groups.items():
            if len(members) < 5:
                continue
            width = len(next(iter(members)))
            counts = [Counter(t[i] for t in members) for i in range(width)]
            constants = {i: c.most_common(1)[0][0] for i, c in enumerate(counts) if c.most_common(1)[0][1] >= 0.8 * len(members)}
            is_template = 0.5 * width <= len(constants) < width
            split = min(((len(c), i) for i, c in enumerate(counts) if len(c) > 1), default=None)
            for t in members:
                if is_template and all(t[i] == x for i, x in constants.items()):
                    out[t] = chained((leaf,), level)
                elif split:
                    later[chained((leaf,), level, murmur(t[split[1]]))].add(t)
        groups = later
    return out


def brute_dedup(texts):
    parsed = {x: [tokens_of(raw) for raw in x.split("\n")] for x in set(texts)}
    fitted = brute_templates({t for ts in parsed.values() for t in ts if t})
    named = {x: [t and fitted.get(t, chained(*t)) for t in ts] for x, ts in parsed.items()}
    n = Counter(t for ts in named.values() for t in set(ts) - {None})
    support = defaultdict(lambda: [set(), set(), set()])
    for ts in named.values():
        every = sorted((int(math.log2(n[t])), t) for t in set(ts) - {None})
        place = int(0.2 * len(every))
        for at, (_, t) in enumerate(every):
            if n[t] < 5:
                continue
            side = place + (at <= place)
            peers = [p for r, p in every if r == every[side][0]] if side < len(every) else []
            for k in range(3):
                two = sorted((chained((p,), k), p) for p in peers)[:2]
                support[t][k].add(next((x for x, p in two if p != t), 0))
    gone = {t for t, seen in support.items() if 5 <= (m := sorted(map(len, seen))[1]) and m >= 0.5 * n[t]}
    return ["\n".join(raw for raw, t in zip(x.split("\n"), named[x], strict=True) if t not in gone) for x in texts]


def line(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randrange(6, 14)))


def rows_with(rng, frames, docs=40, copies=5):
    """Documents of own lines among which lines of the frames stand; {} is a word, {n} a number."""
    out = []
    for _ in range(docs):
        x = [line(rng) for _ in range(rng.randrange(2, 9))]
        for f in rng.sample(frames, rng.randrange(0, min(4, len(frames)) + 1)):
            x.insert(rng.randrange(len(x) + 1), f.format(*[rng.choice(WORDS) for _ in range(f.count("{}"))], n=rng.randrange(10**4)))
        out.append("\n".join(x))
    return out + [rng.choice(out) for _ in range(copies)]


FRAMES = ["menu", "read more", "page {n} of {n}", "posted today by {} in {} on our site", "posted today by the whole {} staff {} thanks", "see also here {} and {} now",
          "{n}", "copyright held by the owners of this page", "kan lor mis {} tur and more words follow", "kan lor mis {} ren yet other words come"]


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_plain_version(spark, seed):
    rng = random.Random(seed)
    texts = rows_with(rng, FRAMES, 60) + ["", " \t", "\n\n", "x", "menu", "é 漢字 ñ", "word " * 3000]
    df = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(7, None)], "doc_id long, text string")
    got = lines.dedup(df)
    want = Counter(zip((i if i % 5 else None for i in range(len(texts))), brute_dedup(texts), strict=True)) + Counter([(7, None)])
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_recall_of_templates_and_lines_left_alone(spark):
    """Of lines of frames that at least 20 documents hold nearly all go, two frames of one leaf too; of others none."""
    rng = random.Random(11)
    frames = FRAMES[:6] + FRAMES[8:]
    own, planted, texts = 0, 0, []
    for _ in range(150):
        x = [line(rng) for _ in range(6)]
        own += len(x)
        more = [f.format(*[rng.choice(WORDS) + rng.choice(WORDS) for _ in range(f.count("{}"))], n=rng.randrange(10**4)) for f in rng.sample(frames, 2)]
        planted += len(more)
        texts.append("\n".join([more[0], *x, more[1]]))
    got = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).agg(F.sum("n_dropped"), F.sum("n_lines")).first()
    left = lines.dedup(spark.createDataFrame([(i, "\n".join(t.split("\n")[1:-1])) for i, t in enumerate(texts)], "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0]
    assert got[1] == own + planted and got[0] >= 0.97 * planted and left == 0
