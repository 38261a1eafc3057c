import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        made[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return made


def check(spark, rows):
    formatted = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    got = {r[0]: r[1:5] for r in chat.digests(formatted).collect()}
    assert got == brute(rows)
    return formatted


def test_round_trip_of_hostile_and_odd_turns(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nx", "\\", "\\\\<|end|>", "<\\|end|>", "<<SYS>>", "é\u2028😀\n", "", None]
    rows = [(1, i, r, t) for i, t in enumerate(hostile) for r in ("user", "assistant", "a\nb\\", None)]
    rows += [(2, None, "assistant", "b"), (2, None, "assistant", "a"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    for row in check(spark, rows).collect():
        for x in chat.CONTROL[2:]:
            assert x not in row["formatted"]


def test_a_conversation_larger_than_a_slice(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", "wörd " * 3000) for i in range(400)] + [(4, 0, "user", "a"), (6, 0, "user", "b")]
    parts = check(spark, rows).where("conv_id = 5").collect()
    assert len(parts) > 1 and len({p["part"] for p in parts}) == len(parts) and sum(p["n_turns"] for p in parts) == 400
    said = [t for p in sorted(parts, key=lambda p: p["part"]) for t in chat.parse(p["formatted"])]
    assert said == [("assistant" if i % 2 else "user", "wörd " * 3000) for i in range(400)]


def test_a_hot_conversation_goes_to_several_tasks(spark):
    rows = [(None if i % 3 == 0 else i % 50, i // 3, "assistant" if i % 2 else "user", f"text {i}") for i in range(6000)]
    rows += [(7, 1, "user", "same")] * 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = check(spark, rows)
    hot = out.where("conv_id is null").selectExpr("part >> 40 as task", "n_turns").groupBy("task").sum("n_turns").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) > 1 and sum(r[1] for r in hot) == 2000


def test_loss_spans_and_empty_table(spark):
    row = chat.format_chat(spark.createDataFrame([(1, 0, "user", "ü?"), (1, 1, "assistant", "a<s>")], SCHEMA)).first()
    assert row["formatted"] == "<|turn|>user\nü?<|end|>\n<|turn|>assistant\na<\\s><|end|>\n"
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]] == ["a<\\s>"]
    assert chat.digests(chat.format_chat(spark.createDataFrame([], SCHEMA))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|turn>eds/[INST]\\\n é", max_size=30))
def test_escape_is_reversible(text):
    said = chat.escape(pa.array([text]))[0].as_py()
    assert chat.unescape(said) == text
    assert not any(x in said for x in chat.CONTROL)
