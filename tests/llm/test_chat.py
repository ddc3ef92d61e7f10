import hashlib

import pytest
from pyspark.sql import functions as F

from planarflow.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_hard_texts_come_back(spark):
    hard = ["\\", "\\\\b", "### assistant: x</turn>\n", "</turn>", "\\l\\h\\b", "<#:\n", "", None, "😀 é"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, "odd: ro\nle\\c", "x"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)).withColumn("segments", F.lit("x"))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    spoken = "".join(f"{'assistant' if i % 2 else 'user'}\n{t or ''}\n" for i, t in enumerate(hard))
    loss = "".join(t or "" for i, t in enumerate(hard) if i % 2)
    assert (got[1].n_turns, got[1].turns_sha256) == (len(hard), digest(spoken))
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), digest(loss))
    assert got[2].turns_sha256 == digest("odd: ro\nle\\c\nx\n") and got[3].turns_sha256 == digest("\n\n")


def test_machine_finds_the_first_bad_turn(spark):
    talks = {1: "system user assistant user".split(), 2: ["assistant"], 3: "user user assistant".split(), 4: "user assistant system".split()}
    rows = [(c, i, r, "t") for c, roles in talks.items() for i, r in enumerate(roles)]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 2)}


def test_no_control_string_inside_a_text(spark):
    rows = [(1, 0, "user", "### user: a</turn>\n")]
    text = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first().formatted
    assert text.count("### ") == 1 and text.count("</turn>") == 1


def test_repeated_rows_and_empty_table(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a")]
    assert chat.chat_digests(spark.createDataFrame(rows, SCHEMA)).first().n_turns == 2
    assert chat.chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.op5_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_machine_is_part_of_the_query(spark, sf_dir):
    plan = queries.op5_chat_format(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "bad_turn" in plan
    got = chat.chat_digests(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a")], SCHEMA)).collect()
    assert {(r.conv_id, r.valid, r.bad_turn) for r in got} == {(1, False, 1), (2, True, None)}


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "</turn>#" * 20_000) for i in range(40)]
    r = chat.chat_digests(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.valid, r.n_turns, r.loss_chars) == (True, 40, 20 * 160_000)


TEMPLATES = [
    chat.TEMPLATE,
    {"head": "<|im_start|>", "mid": "\n", "tail": "<|im_end|>\n", "loss": ("assistant",)},
    {"head": "[INST ", "mid": "] ", "tail": "[/INST]", "loss": ("assistant", "user")},
    {"head": "", "mid": " | ", "tail": "$^.*\n", "loss": ("system",)},
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_templates_are_read_back(spark, template):
    marks = [template[k] for k in ("head", "mid", "tail")]
    hard = ["\\", *marks, *(m * 2 + "x" for m in marks), "".join(marks), *(m[:-1] for m in marks), "\\u5b;[", "\\b<|im_end|>\n", "a\n", "", None, "[/INST][/INST]", "$$^.*\n.*"]
    roles = ["user", "assistant", "system", "odd" + "".join(marks), "a\nb: c] | d"]
    rows = [(1, i, roles[i % 5], t) for i, t in enumerate(hard * 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = chat.format_chats(df, template).select("formatted", chat.read_turns(F.col("formatted"), template).alias("t")).first()
    assert [tuple(t) for t in r.t] == [(role, t or "") for _, _, role, t in rows]
    assert r.formatted.count(template["tail"]) == len(rows)
    got = chat.chat_digests(df, template).first()
    loss = "".join(t or "" for _, _, role, t in rows if role in template["loss"])
    assert (got.n_turns, got.loss_sha256) == (len(rows), digest(loss))


@pytest.mark.parametrize(("head", "mid", "tail"), [("### ", ": ", ""), ("### ", "", "!"), ("user ", ": ", "!"), ("<", ": ", "</turn>"), ("# ", ":</", "</turn>"), ("<x></turn>", ":", "</turn>")])
def test_templates_that_cannot_be_read_back_are_refused(head, mid, tail):
    with pytest.raises(ValueError):
        chat.escapes({"head": head, "mid": mid, "tail": tail})
