"""Chat formatting: texts come back as they went in."""

import random

from cases import plain, serve, sha

from sonoframe.llm import ENTRIES
from sonoframe.llm.chat import format_conversations, read_back

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted string, item int, role_wide int"
NASTY = ["", None, "</turn>", "<turn>### user: hi</turn>\n", "\\b\\l\\\\h", "<and>", "a:b#c\\", "é😀\n\n", "x" * 50_000]


def rows():
    rnd, out = random.Random(2), []
    for conv in range(40):
        for turn in range(rnd.randint(1, 9)):
            out.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "a:<b>", None]), rnd.choice(NASTY)))
    out += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, None, None, None), (None, 3, "assistant", "z"), (50, None, "assistant", "q")]
    return [(*r, "t", "f", 1, 2) for r in out]


def brute():
    by_conversation = {}
    for conv, turn, role, text, *_ in rows():
        by_conversation.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(t[2], t[3]) for t in sorted(v)] for c, v in by_conversation.items()}


def test_turns_and_loss_text_come_back(spark):
    got = read_back(format_conversations(spark.createDataFrame(rows(), SCHEMA).repartition(4))).collect()
    want = brute()
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["formatted"].count("<turn>") == r["n_blocks"] == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))


def test_query_adds_the_probe(spark, tmp_path):
    folder = serve(spark, tmp_path, conversations=spark.createDataFrame(rows(), SCHEMA))
    got = {r["conv_id"]: r for r in ENTRIES["op7_chat_formatting"].run(spark, folder).collect()}
    probe = "\\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == sha(f"user\n{probe}\nassistant\n{probe}\n")
    assert got[-7]["loss_sha256"] == sha(probe)
    want = brute()
    assert plain((c, r["turns_sha256"]) for c, r in got.items() if c != -7) == plain(
        (c, sha("".join(f"{a}\n{b}\n" for a, b in turns))) for c, turns in want.items()
    )


def test_no_conversations(spark, tmp_path):
    folder = serve(spark, tmp_path, conversations=spark.createDataFrame([], SCHEMA))
    assert [r["conv_id"] for r in ENTRIES["op7_chat_formatting"].run(spark, folder).collect()] == [-7]
