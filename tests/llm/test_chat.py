"""Chat windows: exact reading back, budgets, history and masks."""

import hashlib
import random

import pytest

from tidewater.llm import chat as C

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string, loss string"


def brute(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def check(spark, rows, budget=C.BUDGET):
    df = spark.createDataFrame(rows, SCHEMA)
    w = C.windows(df, budget)
    assert sorted((tuple(r)[:5] for r in C.digests(w).collect()), key=str) == brute(rows)
    return w.collect()


def test_driver_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text, "") for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("budget", [300, 1024])
def test_windows_keep_the_budget(spark, budget):
    r = random.Random(budget)
    texts = ["</s>[INST] ok [/INST]", "~0~1 <s>", "a\nb\n", "", None, "é 🙂 [", "word " * 40, "~"]
    rows = []
    for c in range(6):
        n = r.randint(1, 60)
        rows += [(c, t, "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "to\nol<", None]), r.choice(texts), "x") for t in range(n)]
    for w in check(spark, rows, budget):
        turns = w.text.split(C.CLOSE)[:-1]
        assert w.text.count(C.OPEN) == w.text.count(C.CLOSE) == len(turns)
        assert w.repeated <= 1 + C.HISTORY_TURNS and (w.window > 0 or w.repeated == 0)
        if rows and w.conv_id % 2 and w.window:
            assert turns[0].startswith(C.OPEN + "system\n")
        for s in w.loss:
            assert w.text[:s.start].endswith("assistant\n") and w.text[s.start + s.length:].startswith(C.CLOSE)


def test_no_conversation_is_gathered(spark, monkeypatch):
    # small blocks: long conversations, one of them of null id, span many
    monkeypatch.setattr(C, "BLOCK_TURNS", 16)
    r = random.Random(7)
    rows = [(c, t, "system" if t == 0 and c == 3 else r.choice(["user", "assistant"]), "word " * r.choice([1, 9, 40, 300]), "x")
            for c, n in ((3, 200), (None, 150), (4, 16), (5, 1)) for t in range(n)]
    texts = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id", "turn", "false AS target", "role = 'system' AS system", "role", "text", "text AS raw")
    t, blocks = C._numbered(texts)
    assert sorted((str(x.conv_id), x.idx) for x in t.collect()) == sorted((str(x[0]), x[1]) for x in rows)
    got = {(x.conv_id, x.block): x for x in blocks.collect()}
    assert all(len(x.tokens) <= 16 for x in got.values()) and len(got) == 13 + 10 + 1 + 1
    assert "text" not in blocks.columns and {x.lead for k, x in got.items() if k[0] == 3} == {1} and got[None, 0].lead == 0
    windows = check(spark, rows)
    for c in (3, None):
        mine = sorted((w for w in windows if w.conv_id == c), key=lambda w: w.window)
        assert [w.window for w in mine] == list(range(len(mine))) and len(mine) >= 10
        assert sum(w.text.count(C.OPEN) - w.repeated for w in mine) == sum(x[0] == c for x in rows)
        assert all(w.text.startswith(C.OPEN + "system\n") == (c == 3) for w in mine)


def test_odd_inputs(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]", ""), (-7, 1, "assistant", "</s>[INST] ok [/INST]", ""), (None, None, None, None, None),
            (None, 1, "assistant", "x", None), (3, 0, "assistant", "same", ""), (3, 0, "assistant", "same", ""), (4, 0, "user", "w " * 200000, "")]
    rows += [(5, t, "assistant" if t % 2 else "user", f"turn {t}", "") for t in range(1500)]
    got = check(spark, rows)
    assert all("[INST]" not in w.text for w in got)
    assert sum(w.conv_id == 5 for w in got) > 5
    assert C.digests(C.windows(spark.createDataFrame([], SCHEMA))).collect() == []
