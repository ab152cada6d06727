import hashlib
import random

from pyspark.sql import functions as F

from reviewmine.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns int, segments string"


def test_reads_back_what_it_formats(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choice(["\\", "#", "<", "### ", "</turn>\n", ": ", "b", "\n", "é", "\\b"]) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "to: ol", ""]), text, 1, "x"))
    rows += [(None, 0, "user", "no key", 1, "x"), (99, None, None, None, 1, "x"), (99, 1, "assistant", "same", 1, "x"), (99, 1, "assistant", "same", 1, "x")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    done = chat.format_conversations(chat.turns(spark.createDataFrame(shuffled, SCHEMA)))
    found = done.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.learned_text(F.col("segments")).alias("l"))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.l) for r in found.collect()}
    want = {}
    for conv, _, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns, learned = want.setdefault(conv, ([], []))
        turns.append((role or "", text or ""))
        learned += [text or ""] * (role == "assistant")
    assert got == {conv: (turns, "".join(learned)) for conv, (turns, learned) in want.items()}


def test_turn_order(spark):
    cases = {"sua": True, "ua": True, "uau": True, "u": True, "s": False, "au": False, "uua": False, "suas": False, "ux": False}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    ids = dict(enumerate(cases))
    rows = [(i, n, names[c], "t", 0, "") for i, word in ids.items() for n, c in enumerate(word)]
    found = chat.format_conversations(chat.turns(spark.createDataFrame(rows, SCHEMA))).select("conv_id", "valid").collect()
    assert {ids[i]: valid for i, valid in found} == cases


def test_a_long_text_and_no_rows(spark):
    text = "\\#<" * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", text, 0, "")], SCHEMA)
    row = chat.format_conversations(chat.turns(df)).select(chat.learned_text(F.col("segments"))).first()
    assert hashlib.sha256(row[0].encode()).digest() == hashlib.sha256(text.encode()).digest()
    assert chat.format_conversations(chat.turns(df.limit(0))).count() == 0
