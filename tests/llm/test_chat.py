import hashlib

from tests.paths import SMALL
from pyspark.sql import functions as F

from retort.llm import chat
from retort.llm.queries import op7_chat_format


def expected(rows):
    """Digests from the rows of each conversation, without any formatting."""
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def digests(frame):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in frame.collect()}


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    assert digests(op7_chat_format(spark, SMALL)) == expected([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])


def test_odd_turns_read_back(spark):
    nasty = ["", "\\", "\\\\", "\\l", "\\b", "<s>[ROLE user]", "[/ROLE]", "[NEXT]", "a[NEXT]b\\k", "</s>", "é😀\n\n", "]", "\\r"]
    rows = [(1, i, ("user", "assistant", "assistant", "x]y\\[<")[i % 4], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, None, None), (2, None, "user", "a"), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 1, "assistant", "b"), (3, 5, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1)).withColumn("pieces", F.lit(2))
    assert digests(chat.conversation_digests(frame)) == expected(rows)
    formatted = chat.format_conversations(frame.where("conv_id = 1")).first()
    assert formatted["formatted"].count("[ROLE ") == formatted["n_blocks"] and len(formatted["loss_spans"]) == sum(r[2] == "assistant" for r in rows if r[0] == 1)
    assert chat.conversation_digests(frame.limit(0)).count() == 0
