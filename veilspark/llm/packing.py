"""Packing of token pieces into sequences: first-fit decreasing over a tournament tree.

A document is its text's ids and one end id. It is cut into full sequences and a rest; full pieces
fill a sequence alone. Documents are dealt into groups by a hash of their row, so that each group is
a random sample of bounded size, and each group is packed by itself: pieces in falling length, each
into the first bin with room. The tree holds the most room under each node, so a piece finds its bin
in logarithmic steps.

Defined cases: a null text is empty, its document is the end id alone. Equal rows are packed once
each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Rows of a packing group, about.
GROUP_ROWS = 1024
#: Words whose ids a task remembers.
REMEMBERED = 200_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def padded(length: int, capacity: int = CAPACITY) -> int:
    """Padding of a sequence: none at a power of two, else up to the capacity."""
    return 0 if length & (length - 1) == 0 else capacity - length


class Words(dict):
    """Ids of a word with the space before it, as little-endian bytes; forgets all when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()
        return ids


def encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library
    with add_special_tokens=False.

    Words are looked up where a single space stands between two words, as the splitting rule never
    crosses it there. Other texts are encoded whole. The ranks beside the file are the same
    vocabulary in a form that encodes faster; texts with a special token's string go through
    tokenizers itself.
    """
    import base64
    import json

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    else:
        fast = lambda text: whole.encode(text, add_special_tokens=False).ids
    words = Words(fast)
    unsafe = re.compile(r"\s \s")

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text or unsafe.search(text):
            return array("I", fast(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", fast(first)).tobytes()
        return head + b"".join(map(words.__getitem__, rest))

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, end_id: int = 0) -> DataFrame:
    """Cut each document; `part` is its packing group."""
    groups = max(1, -(-docs.count() // group_rows))
    end = array("I", [end_id]).tobytes()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # The row number in the scan spreads equal rows too; a repeated task numbers its rows alike.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, text, part in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["part"], strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                out += [(doc_id, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, part) for at in range(0, n, capacity)]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])
            yield frame.astype({"doc_id": "Int64"})

    return rows.mapInPandas(cut, PIECE)


def first_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each length, for lengths in the order given: the first bin with room."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = []
    for n in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < n:
                at += 1
        bins.append(at - leaves)
        room[at] -= n
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence and their place in it. A group's sequences share the upper half of
    sequence_id."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins = first_fit(frame["length"].tolist(), capacity)
        used: dict[int, int] = {}
        offsets = []
        for b, n in zip(bins, frame["length"].tolist(), strict=True):
            offsets.append(used.get(b, 0))
            used[b] = offsets[-1] + n
        frame["sequence_id"] = [(int(frame["part"].iloc[0]) << 32) + b for b in bins]
        frame["offset"] = offsets
        frame["padding"] = [padded(used[b], capacity) for b in bins]
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]]

    return pieces.groupBy("part").applyInPandas(one, PACKED)
