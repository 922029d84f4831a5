import hashlib
import random
import re

from lingua_spark.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, rendered string, t int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fuzz():
    rng = random.Random(9)
    pool = ["\\", "\\e", "\\b", "\\h", "\\c", "</turn>", "</turn", ">", "\n", "###", "##", "#", "### Assistant: ", ": ", "é😀", "ok", " ", "\\\\", "</turn>\n", "\r\n"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "system", "a:b", "###", "", None, "x\n</turn>"])
            rows.append((c, t, role, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))) if rng.random() > 0.05 else None))
    rows += [(70, None, "user", "first"), (70, 1, "user", "b"), (70, 1, "assistant", "z"), (70, 1, "assistant", "z"), (70, 0, None, None),
             (None, 2, "assistant", "lost"), (71, 0, "assistant", "long " * 50000)]
    return rows


def expected(rows):
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), role or "", text or "") for k, t, role, text in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(c, i, r, x) for i, (c, _, r, x) in enumerate(fuzz()[:-7])] + fuzz()[-7:-6]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r)[:5] for r in chat.conversation_digests(df).collect()), key=str)
    assert got == expected(rows)


def test_ties_nulls_and_long_texts(spark):
    rows = fuzz()[-7:]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).repartition(3)
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {70: 5, None: 1, 71: 1}
    for c in got:
        want = next(w for w in expected(rows) if w[0] == c)
        assert tuple(got[c])[:5] == want
    assert chat.conversation_digests(df.where("false")).count() == 0


def test_mask_and_formatted_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", None, None), (1, 1, "assistant", "a </turn> b\\", None, None)], SCHEMA).select("conv_id", "turn", "role", "text")
    got = {r["conv_id"]: r for r in chat.format_conversations(rows.unionByName(chat.conflict_rows(spark))).collect()}
    assert got[1]["formatted"] == "### user: hi</turn>\n### assistant: a \\e b\\b</turn>\n"
    for r in got.values():
        at, text = 0, ""
        for skip, loss in r["mask"]:
            at += skip
            text += r["formatted"][at:at + loss]
            at += loss + (len("</turn>\n") if loss else 0)
        want = "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert text.replace("\\h", "###").replace("\\e", "</turn>").replace("\\b", "\\") == want
    assert [t["text"] for t in got[-7]["turns"]] == ["\\### Assistant: </turn> ok"] * 2


def test_no_python_in_the_plan(spark):
    plan = chat.conversation_digests(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
                                     .unionByName(chat.conflict_rows(spark)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
