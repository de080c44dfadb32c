from pyspark.sql import functions as F

from cohortlens.llm import chat

ROWS = [
    (1, 2, "assistant", "second <turn x> \\b \\l"),
    (1, 1, "user", "first </turn>\nwith > and <also>"),
    (1, 3, "assistant", "third, same role"),
    (1, 4, "user", None),
    (2, 1, "us<er>", ""),
    (2, 1, "us<er>", ""),
    (2, None, None, "no role"),
    (None, 5, "assistant", "x" * 100000),
    (None, 5000, "assistant", "later part"),
    (3, 0, "system", "漢字 🙂 $1 (a+b)"),
]


def test_round_trip_and_merging(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.parse_formatted(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in out[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
    first = out[1].formatted
    assert first.count("</turn>\n") == 3 and first.count("<also>") == 1
    assert first.startswith("<turn user>first \\l/turn\\g")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_loss_covers_assistant_texts_once(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    parsed = chat.parse_formatted(chat.format_conversations(df))
    loss = {r.conv_id: r.loss for r in parsed.select("conv_id", chat.loss_texts(F.col("turns")).alias("loss")).collect()}
    assert loss[1] == ["second <turn x> \\b \\l", "third, same role"]
    assert loss[3] == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = chat.parse_formatted(chat.format_conversations(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
