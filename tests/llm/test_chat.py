import hashlib

from lacuna.llm import chat

ROWS = [
    (1, 0, "system", "be \\b brief"), (1, 1, "user", "### Assistant: </turn> <+> \\l\\h\\n"), (1, 2, "user", "again"), (1, 3, "assistant", None), (1, 4, "assistant", "<+>"), (1, 5, "assistant", ""),
    (2, None, "assistant", "no turn"), (2, 7, None, "no role"), (2, 7, "user", "tie"), (None, 0, "user\n:", "no key"), (3, 0, "assistant", "é😀\n\n"), (3, 0, "assistant", "é😀\n\n"),
]


def expected(rows):
    rows = sorted(((t is not None, t or 0), r or "", x or "") for _, t, r, x in rows)
    loss = "".join(x for _, r, x in rows if r == "assistant")
    return len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, one string").withColumnRenamed("one", "formatted")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    for key, row in got.items():
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == expected([r for r in ROWS if r[0] == key])
        assert row.mask_fits


def test_adjacent_turns_of_a_role_share_a_block(spark):
    turns = spark.createDataFrame(ROWS[:6], "conv_id long, turn long, role string, text string")
    text = chat.format_chats(turns).first().formatted
    assert text.count("</turn>") == 3 and text.count("### ") == 3 and text.startswith("### system:\nbe \\bb brief</turn>\n")


def test_mask_covers_just_the_assistant(spark):
    turns = spark.createDataFrame(ROWS[:6], "conv_id long, turn long, role string, text string")
    row, at, learned = chat.format_chats(turns).first(), 0, []
    for run in row.loss_mask:
        at += run.skip
        learned.append(row.formatted[at : at + run["take"]])
        at += run["take"]
    assert "".join(learned) == "\\l+>"


def test_empty(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_a_shifted_mask_gives_other_text(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns).where("conv_id = 3")
    right = chat.digests(chats).first()
    for skip, take in (("x.skip + IF(i = 0, 1, 0)", "x.take"), ("x.skip - IF(i = 0, 2, 0)", "x.take"), ("x.skip", "x.take - 1")):
        wrong = chats.selectExpr("conv_id", "formatted", f"transform(loss_mask, (x, i) -> struct({skip} AS skip, {take} AS take)) AS loss_mask")
        assert chat.digests(wrong).first().loss_sha256 != right.loss_sha256
        row, at, learned = wrong.first(), 0, []
        for run in row.loss_mask:
            at += run.skip
            learned.append(row.formatted[at : at + run["take"]])
            at += run["take"]
        assert chat.read_back(wrong).first().learned == learned


def test_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"<{i}> " * 20) for i in range(6_000)] + [(2, 0, "assistant", "long # text " * 200_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for key, row in got.items():
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == expected([r for r in rows if r[0] == key])
