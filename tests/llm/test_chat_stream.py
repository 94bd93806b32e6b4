"""Conversations are streamed turn by turn, also a hot one and the one without a key."""

import hashlib

import pytest

from locavec.llm import chat


@pytest.mark.parametrize("hot", [7, None])
def test_hot_conversation_is_never_one_row(spark, hot):
    n = 30_000
    rows = spark.range(n).selectExpr(f"CAST({'NULL' if hot is None else hot} AS BIGINT) AS conv_id", "id AS turn",
                                     "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('<|im_end|> ', id) AS text")
    small = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(rows.unionByName(small))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    got = out.where("position IS NOT NULL").collect()
    mine = sorted((r["position"], r["segment"], r["loss"]) for r in got if r["conv_id"] == hot)
    assert [p for p, _, _ in mine] == list(range(3 * n)) and max(len(s) for _, s, _ in mine) < 40
    assert mine[4][1] == "<\\|im_end|> 1" and mine[4][2] and not mine[1][2]
    end = {r["conv_id"]: r for r in chat.digest(out).collect()}
    assert set(end) == {hot, 1, 2} and (end[1]["valid"], end[2]["valid"], end[hot]["valid"]) == (True, False, True)
    turns = [("user" if i % 2 == 0 else "assistant", f"<|im_end|> {i}") for i in range(n)]
    said = "".join(s for r, s in turns if r == "assistant")
    assert end[hot]["n_turns"] == n and end[hot]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{s}\n" for r, s in turns).encode()).hexdigest()
    assert (end[hot]["loss_chars"], end[hot]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert end[hot]["formatted_chars"] == sum(len(s) for _, s, _ in mine)
