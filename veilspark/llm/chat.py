"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, each formatted as one conversation.

Messages name their parent. Iterative self-joins find each message's ancestor at distance 1, 2, 4, ...; with
the ancestors come the distance and the summed score, so after log2(depth) joins each message knows its
root, its depth and the score of its path. A tree's leaves are ranked by that score, and the paths of
the chosen ones are enumerated backwards over the same tables, from the farthest ancestors down to the
parents: a path of 400 messages takes nine joins, not 400. Only ids take part in this; texts are joined once.

The template has a marker before and after each turn (FORMS). Texts and names of roles can't break out: in a
control string a backslash goes behind its first character, and one more where there are some already, so
that reading takes one away from each. Lossy positions are the texts of the assistant, without markers.

A conversation is written in parts of TURNS turns, so no row or task has to hold a conversation of any
length; one of up to TURNS turns is one row. `read` gives a row for each conversation, read back from text and
mask alone; longer ones pass their task part by part.

Defined cases: a null text or role counts as empty. A message whose parent is null or doesn't exist is a root;
messages on a circle have no root and are on no path. Null trees are one tree. Of messages that share tree and id the
first by role and text is their children's parent, the others are leaves beside it. Scores that are null
count as 0; of equal scores the smaller id comes first. `chained` makes a chain of each conversation's rows in order
of turn, null turns last, equal turns by role and text, rows that are equal in all of these one after the
other. An empty table gives no conversations. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import ranked_within
from .common import kept

#: Turns of a part.
TURNS = 4096
#: Of each role what stands before and after its text; other roles are named.
FORMS = {"system": ("[SYS] ", " [/SYS]\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s>", "</s>\n")}
NAMED = ("[ROLE]", "[/ROLE] ", " [END]\n")
LEARNED = "assistant"
#: A control string: its first character, what was inserted, and the rest.
CONTROL = r"([\[<])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|END\])"
#: A turn, as it is read.
TURN = re.compile(r"\[SYS\] (?P<system>.*?) \[/SYS\]\n|\[INST\] (?P<user>.*?) \[/INST\]\n|<s>(?P<assistant>.*?)</s>\n|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<text>.*?) \[END\]\n", re.DOTALL)
ESCAPED = re.compile(r"([\[<])\\(\\*(?:/?s>|/?(?:SYS|INST|ROLE)\]|END\]))")
KEYS = ["tree", "id"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def links_of(tree: Column, id_: Column, parent: Column, score: Column) -> list[Column]:
    """tree, id and up as structs, which compare nulls too; up is null without a parent."""
    return [F.struct(tree.alias("tree")).alias("tree"), F.struct(id_.alias("id")).alias("id"), F.when(parent.isNotNull(), F.struct(parent.alias("id"))).alias("up"), F.coalesce(score.cast("double"), F.lit(0.0)).alias("score")]


def turn_texts() -> list[Column]:
    return [F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]


def linked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (tree, id, up, score) and texts (tree, id, role, text) of messages, each with an id of its own."""
    rows = messages.select(*links_of(*map(F.col, ("tree", "id", "parent", "score"))), *turn_texts())
    if not rows.groupBy(*KEYS).count().filter("count > 1").isEmpty():
        again = ranked_within(rows.withColumn("group", F.struct(*KEYS)), "group", ["role", "text", "score", "up"], "copy")
        rows = kept(again.select("tree", F.struct(F.struct("id.id", "copy").alias("id")).alias("id"), F.when(F.col("up").isNotNull(), F.struct(F.struct("up.id", F.lit(1).cast("long").alias("copy")).alias("id"))).alias("up"), "score", "role", "text"), "messages")
    return rows.select("tree", "id", "up", "score"), rows.select("tree", "id", "role", "text")


def chained(turns: DataFrame, conversation: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Links and texts of conversations without branches. Turns are numbered by their ids alone, unless a
    conversation has equal ones, which their texts tell apart."""
    tree, last = F.struct(F.col(conversation).alias("tree")), F.col("turn").isNull()
    rows = turns.select(tree.alias("tree"), F.struct(F.struct(last.alias("last"), "turn").alias("id")).alias("id"), *turn_texts())
    order, ids = ["id"], rows.select("tree", "id")
    if not ids.groupBy(*KEYS).count().filter("count > 1").isEmpty():
        rows = ranked_within(rows, "tree", ["id", "role", "text"], "place")
        rows = kept(rows.select("tree", F.struct(F.col("place").alias("id")).alias("id"), "role", "text"), "turns")
        ids = rows.select("tree", "id")
    places = kept(ranked_within(ids, "tree", order, "place"), "places")
    before = places.select("tree", F.col("id").alias("up"), (F.col("place") + 1).alias("place"))
    return places.join(before, ["tree", "place"], "left").select("tree", "id", "up", F.lit(0.0).alias("score")), rows


def ancestors(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, id, depth, score of the path) for the messages that a root leads to, and for each power of two
    the table (tree, id, up) of those that have an ancestor at this distance."""
    there = links.select("tree", F.col("id").alias("up"), F.lit(True).alias("there"))
    step = links.join(there, ["tree", "up"], "left").select("tree", "id", F.when(F.col("there"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("steps"), "score")
    step = kept(step, "step")
    done, tables, before = step.filter("up is null"), [], None
    while True:
        active = step.filter("up is not null")
        now = active.count()
        # A depth that no message has ends all paths: what is left runs in circles.
        if now in (0, before):
            return done.select("tree", "id", F.col("steps").alias("depth"), "score"), tables
        tables.append(active.select("tree", "id", "up"))
        further = step.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("score").alias("rest"))
        # Those that have arrived are joined too: an ancestor may be a root.
        arrived = done.select("tree", F.col("id").alias("up"), F.lit(None).cast(step.schema["up"].dataType).alias("next"), F.col("steps").alias("more"), F.col("score").alias("rest"))
        further = further.filter("next is not null").unionByName(arrived)
        step = active.join(further, ["tree", "up"]).select("tree", "id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("score") + F.col("rest")).alias("score"))
        step, before = kept(step, "step"), now
        done = done.unionByName(step.filter("up is null"))


def paths(links: DataFrame, texts: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch (from 1, by falling score), position (from 1), role and text of the `branches` best paths
    from root to leaf of each tree."""
    links = kept(links, "links")
    placed, tables = ancestors(links)
    parents = links.select("tree", F.col("up").alias("id")).filter("id is not null").distinct()
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "id"))
    chosen = placed.join(parents, KEYS, "left_anti").withColumn("branch", rank).filter(F.col("branch") <= branches)
    found = kept(chosen.select("tree", "branch", "id", F.col("depth").alias("position")), "paths")
    for distance, table in reversed(list(enumerate(tables))):
        higher = found.join(table, KEYS).select("tree", "branch", F.col("up").alias("id"), (F.col("position") - (1 << distance)).alias("position"))
        found = kept(found.unionByName(higher), "paths")
    return found.join(texts, KEYS).select("tree.tree", "branch", "position", "role", "text")


def formatted(turns: DataFrame, size: int = TURNS) -> DataFrame:
    """tree, branch, part (from 0), n_turns, text and mask (start and end of each learned text, in code points of
    its part) of paths."""
    before, after, learned = F.concat(F.lit(NAMED[0]), escaped(F.col("role")), F.lit(NAMED[1])), F.lit(NAMED[2]), F.col("role") == LEARNED
    for role, (left, right) in FORMS.items():
        before, after = F.when(F.col("role") == role, F.lit(left)).otherwise(before), F.when(F.col("role") == role, F.lit(right)).otherwise(after)
    rows = turns.select("tree", "branch", "position", F.floor((F.col("position") - 1) / size).cast("long").alias("part"), before.alias("before"), escaped(F.col("text")).alias("body"), after.alias("after"), learned.alias("learned"))
    at = F.struct("position", F.length("before").alias("b"), F.length("body").alias("n"), F.length("after").alias("a"), "learned", F.concat("before", "body", "after").alias("turn"))
    whole = rows.groupBy("tree", "branch", "part").agg(F.sort_array(F.collect_list(at)).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("mask"))

    def added(so_far: Column, turn: Column) -> Column:
        first = so_far["at"] + turn["b"]
        span = F.struct(first.alias("start"), (first + turn["n"]).alias("end"))
        return F.struct((first + turn["n"] + turn["a"]).alias("at"), F.when(turn["learned"], F.array_append(so_far["mask"], span)).otherwise(so_far["mask"]).alias("mask"))

    mask = F.aggregate("turns", start, added, lambda x: x["mask"])
    return whole.select("tree", "branch", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"), mask.alias("mask"))


class Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self) -> None:
        self.n, self.chars, self.learned = 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, mask: Iterable[dict]) -> None:
        at = 0
        while at < len(text):
            m = TURN.match(text, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            role = m.lastgroup if m.lastgroup in FORMS else unescaped(m["role"])
            self.turns.update(f"{role}\n{unescaped(m[m.lastgroup])}\n".encode())
            self.n, at = self.n + 1, m.end()
        self.chars += len(text)
        for span in mask:
            learned = unescaped(text[span["start"] : span["end"]])
            self.learned += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple[int, str, int, str, int]:
        return self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def read(conversations: DataFrame) -> DataFrame:
    """tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of formatted parts."""
    tree = conversations.schema["tree"].dataType.simpleString()
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = f"tree {tree}, branch int, " + ", ".join(f"{n} {'string' if n.endswith('256') else 'long'}" for n in names)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, kinds = None, Digest(), []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["tree", "branch", *names])

        for batch in batches:
            kinds, done = [batch.schema.field("tree").type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], []
            for *now, text, mask in zip(*[batch.column(c) for c in parts], strict=True):
                now = [v.as_py() for v in now]
                if now != key:
                    if key:
                        done.append((*key, *digest.row()))
                    key, digest = now, Digest()
                digest.add(text.as_py(), mask.as_py())
            if done:
                yield table(done)
        if key:
            yield table([(*key, *digest.row())])

    parts = ("tree", "branch", "text", "mask")
    # One of a single part is read where it is; parts of longer ones meet in order.
    single = (F.col("part") == 0) & (F.col("n_turns") < TURNS)
    longer = conversations.filter(~single).repartition("tree", "branch").sortWithinPartitions("tree", "branch", "part")
    return conversations.filter(single).select(*parts).mapInArrow(batches_of, schema).unionByName(longer.select(*parts).mapInArrow(batches_of, schema))
