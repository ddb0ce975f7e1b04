import hashlib
import random

from pyspark.sql import functions as F

from tagmill.llm import chat

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[IMG]", "<\\s>", "[\\\\INST]", "[", "<", "\\", "ok", "é😀", "\n", "INST]", "/s>", "$1"]


def conversations():
    r = random.Random(1)
    out = []
    for c in range(40):
        for t in range(r.randint(1, 6)):
            out.append((c, t, r.choice(["user", "assistant", "system", None, "[/ROLE]</s>"]), r.choice([None, "", "".join(r.choice(CONTROL) for _ in range(12))]), "x"))
    return [*out, out[0], out[0], (None, None, "user", "a", "x"), (None, 1, "assistant", "b", "x")]


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chat(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    want: dict = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        turns = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns and r.n_turns == len(turns)
        assert r.loss == "".join(text for role, text in turns if role == "assistant")
        assert r.formatted.count("</s>") == len(turns) == r.formatted.count("<s>")


def test_parts(spark):
    rows = [(1, 0, "user", [("text", "see [IMG]", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", None), (None, "x y", None, None)]), (1, 1, "assistant", [("document", None, "c.pdf", 3), None]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert got[1].formatted == "<s>[ROLE]user[/ROLE][INST]see [\\IMG][IMG][AUDIO]x y[/INST]</s><s>[ROLE]assistant[/ROLE][DOC]</s>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, 1, "image", "a.png", 1152), (0, 2, "audio", "b.wav", 25), (1, 0, "document", "c.pdf", 2304)]
    assert got[1].expanded_tokens == 2 + 1152 + 25 + 2 + 2304 and got[2].formatted == "<s>[ROLE]user[/ROLE][INST][/INST]</s>"


def test_query_adds_the_extra_conversation(spark):
    row = chat.op5_chat(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_empty_table(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
