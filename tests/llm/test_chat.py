"""Reply trees and the chat template against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import chat

MESSAGES = "tree string, id long, parent long, score double, role string, text string, branch string, `before` int"
NASTY = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[\\INST]", "[\\\\/INST]", "</s>[INST] ok [/INST]", "[", "<", "\\", " [/INST]\n", "[END]", "[ROLE]x[/ROLE]", "\n", "é😀", "", "<<s>", "[[INST]]", "[/INST"]


def message(tree, id_, parent, score, role, text):
    return (tree, id_, parent, score, role, text, "clash", 0)


def brute_paths(rows, branches):
    """{tree: [path of (role, text)]}, best first, ids being unique in their tree."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        found = []
        for id_ in own:
            if any(r[2] == id_ for r in own.values()):
                continue
            path, at = [], id_
            while at in own and len(path) <= len(own):
                path.append(own[at])
                at = own[at][2]
            if len(path) <= len(own):
                found.append((-sum(r[3] or 0 for r in path), id_, [(r[4] or "", r[5] or "") for r in reversed(path)]))
        if found:
            out[tree] = [p for _, _, p in sorted(found)[:branches]]
    return out


def spark_paths(spark, rows, branches):
    got = {}
    for r in chat.paths(*chat.linked(spark.createDataFrame(rows, MESSAGES)), branches).collect():
        got.setdefault(r["tree"], {}).setdefault(r["branch"], []).append((r["position"], r["role"], r["text"]))
    return {t: [[p[1:] for p in sorted(x[b])] for b in sorted(x)] for t, x in got.items()}


def test_paths_of_trees(spark):
    rng, rows = random.Random(3), []
    for t in ("a", "b", None, "deep"):
        for i in range(60 if t != "deep" else 70):
            parent = i - 1 if t == "deep" and i else rng.randrange(i) if i > 2 else None
            rows.append(message(t, i, parent, rng.choice((0.0, 1.0, 2.0, None)), rng.choice(("user", "assistant", None)), f"{t}{i}"))
    rows += [message("a", 100, 999, 5.0, "user", "its parent is gone"), message("b", 200, 201, 1.0, "user", "circle"), message("b", 201, 200, 1.0, "user", "circle"), message("b", 202, 201, 1.0, "user", "behind the circle")]
    rows += [message("circle", 1, 1, 1.0, "user", "itself"), message("star", 0, None, 0.0, "user", "root")] + [message("star", i, 0, float(i % 7), "assistant", f"leaf {i}") for i in range(1, 300)]
    for branches in (1, 3):
        assert spark_paths(spark, rows, branches) == brute_paths(rows, branches)


def test_messages_that_share_an_id(spark):
    rows = [message("t", 1, None, 0.0, "user", "x"), message("t", 1, None, 0.0, "user", "a"), message("t", 2, 1, 0.0, "assistant", "reply"), message("t", None, None, 0.0, "user", "no id")]
    got = spark_paths(spark, rows, 9)["t"]
    assert sorted(got) == [[("user", "a"), ("assistant", "reply")], [("user", "no id")], [("user", "x")]]


def digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("size", [chat.TURNS, 3])
def test_round_trip_of_conversations(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "TURNS", size)
    rng, turns = random.Random(9), {}
    for c in range(40):
        pick = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(5)))
        turns[c] = [(rng.choice(("system", "user", "assistant", "tool", "[/ROLE] [END]", "", None)), rng.choice((None, pick(), pick()))) for _ in range(rng.randrange(1, 9))]
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    turns[50], turns[None], turns[51] = [("assistant", "x" * 300_000 + "</s>"), ("user", "")], [("user", "no conversation")], [("user", "hi")] * 40
    rows = [(c, i, r, t, "k", 1) for c, own in turns.items() for i, (r, t) in enumerate(own)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string, part int")
    written = chat.formatted(chat.paths(*chat.chained(df)), size).cache()
    got = {r["tree"]: tuple(r)[2:6] for r in chat.read(written).collect()}
    assert got == {c: digest(own) for c, own in turns.items()}
    assert {r["tree"]: r["formatted_chars"] for r in chat.read(written).collect()} == {r["tree"]: r["n"] for r in written.groupBy("tree").agg(F.sum(F.length("text")).alias("n")).collect()}
    if size > 3:
        text, mask = written.filter("tree = -7").select("text", "mask").first()
        assert text == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]\n<s><\\/s>[\\INST] ok [\\/INST]</s>\n"
        assert [text[m["start"] : m["end"]] for m in mask] == ["<\\/s>[\\INST] ok [\\/INST]"]


def test_equal_turns_and_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "user", "last"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, None, None)]
    got = {r["tree"]: tuple(r)[2:6] for r in chat.read(chat.formatted(chat.paths(*chat.chained(spark.createDataFrame(rows, schema))))).collect()}
    assert got == {1: digest([("user", x) for x in ("a", "a", "b", "last")]), 2: digest([(None, None)])}
    assert chat.read(chat.formatted(chat.paths(*chat.chained(spark.createDataFrame([], schema))))).collect() == []
