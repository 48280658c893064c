import hashlib
import random

from veilspark.llm import chat
from veilspark.llm.queries import PROBE


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_round_trip(spark):
    rng = random.Random(2)
    odd = ["", None, "\\", "<|", "<\\|", "<|im_end|>\n<|im_start|>assistant\nx", "a\\\\<|b", PROBE, "line\nline", "$1 \\1", "é😀<<||", "<|im_start|>user\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(odd) if rng.random() < 0.5 else f"text {rng.random()}") for c in range(12) for t in range(rng.randrange(1, 40))]
    rows += [(50, 3, "assistant", "later"), (50, 1, "user", "first"), (51, 0, None, "no role"), (51, 1, "ro\nle\\<|", "odd role"), (52, 1, "user", "same"), (52, 1, "user", "same"), (None, 0, "assistant", "nobody")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tree", "2 as node")
    formatted = chat.format_conversations(spark, df)
    out = {r.conv_id: r for r in chat.digest(chat.parse_turns(formatted)).collect()}
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns) and out[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (out[c].loss_chars, out[c].loss_sha256, out[c].formatted_chars) == (len(loss), sha(loss), len(whole[c]))
        assert whole[c].count(chat.START) == whole[c].count(chat.END) == len(turns)


def test_best_paths_of_a_tree(spark):
    rng = random.Random(7)
    nodes = [("t", 0, None, 1.0)] + [("t", i, rng.randrange(max(0, i - 4), i), rng.random()) for i in range(1, 60)] + [("u", 1, 99, None), ("u", 2, 1, 3.0), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    up, score = {(t, n): p for t, n, p, _ in nodes}, {(t, n): s or 0.0 for t, n, _, s in nodes}
    leaves = [(t, n) for t, n, _, _ in nodes if t != "c" and (t, n) not in {(a, p) for a, _, p, _ in nodes}]

    def path(t, n):
        return [] if (t, n) not in up else path(t, up[t, n]) + [n]

    got = {}
    for r in chat.reply_paths(spark, df, branches=3).orderBy("depth").collect():
        got.setdefault((r.tree, r["rank"], r.leaf), []).append(r.node)
    for t in ("t", "u"):
        ranked = sorted((-sum(score[t, n] for n in path(t, leaf)), leaf) for s, leaf in leaves if s == t)[:3]
        assert [got[t, k + 1, leaf] for k, (_, leaf) in enumerate(ranked)] == [path(t, leaf) for _, leaf in ranked]
    assert not any(k[0] == "c" for k in got)


def test_all_paths_of_a_tree_are_formatted(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 2.0), ("t", 3, 1, "assistant", "b", 1.0), ("t", 4, 3, "user", "c", 0.5), ("t", 5, 3, "user", "d", 0.0), ("u", 1, None, "user", "x", None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    for branches in (0, None):
        paths = chat.reply_paths(spark, df, branches)
        turns = paths.join(df.select("tree", "node", "role", "text"), ["tree", "node"]).withColumnRenamed("depth", "ord")
        out = {(r.tree, r["rank"], r.leaf): [(t.role, t.text) for t in r.turns] for r in chat.parse_turns(chat.format_turns(turns, ["tree", "rank", "leaf"])).collect()}
        start = ("user", "q"), ("assistant", "b")
        assert out == {("t", 1, 2): [start[0], ("assistant", "a")], ("t", 2, 4): [*start, ("user", "c")], ("t", 3, 5): [*start, ("user", "d")], ("u", 1, 1): [("user", "x")]}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(spark, df).count() == 0
