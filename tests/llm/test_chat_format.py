import hashlib

from kiln.llm.chat_format import escape, format_windows, read_back, unescape
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string, c string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_escape_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system<|im_sep|>", r"<\|im_end|> [\\INST] \\", "<<SYS>><</SYS>>",
             "<<\\</s>", "[[INST]]", "", "plain", "<s><s>", "é<|endoftext|>é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", escape(F.col("t")).alias("e")).withColumn("back", unescape(F.col("e"))).collect()
    for r in got:
        assert r["back"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "<|im_sep|>"))


def test_windows_round_trip(spark):
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "x" * (37 * k % 400)) for k in range(1, 900)]
    rows += [(2, 0, "assistant", "a" * 30_000), (2, 1, "assistant", "<|im_end|>\n"), (2, None, "user", None),
             (2, 1, "assistant", "<|im_end|>\n"), (None, 0, None, "no id"), (3, 5, "assistant", ""),
             (4, 0, "user\n<|im_sep|>", "text")]
    windows = format_windows(make(spark, rows), 512, 64)
    back = sorted(read_back(windows).collect(), key=lambda r: (str(r["conv_id"]), r["window"]))
    order = sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = [(r["conv_id"], t["role"], t["text"]) for r in back for t in r["turns"]]
    assert turns == [(r[0], r[2] or "", r[3] or "") for r in order]
    loss = [(r["conv_id"], x) for r in back for x in r["loss"]]
    assert loss == [(r[0], r[3] or "") for r in order if r[2] == "assistant"]
    made = [w for w in windows.collect() if w["conv_id"] == 1]
    assert len(made) > 20
    for w in made:
        assert w["text"].startswith("<|im_start|>system<|im_sep|>be brief<|im_end|>\n")  # retained in every window
        assert w["n_turns"] > 0
    assert any(w["n_repeated"] > 1 for w in made)
    tokens = lambda t: -(-len(t) // 4) + 4
    for w in made:
        pieces = [p.split("<|im_sep|>")[1] for p in w["text"].split("<|im_end|>\n")[:-1]]
        assert sum(map(tokens, pieces[1:w["n_repeated"]])) <= 64
        assert sum(map(tokens, pieces)) <= 512 + max(map(tokens, pieces))


def test_empty(spark):
    assert format_windows(make(spark, [])).count() == 0


def test_digest_of_planted_conversation(spark):
    from kiln.llm.chat_format import PLANTED, op10_chat_format
    row = op10_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()[0]
    assert row["n_turns"] == 2 and row["loss_chars"] == len(PLANTED)
    assert row["loss_sha256"] == hashlib.sha256(PLANTED.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{PLANTED}\nassistant\n{PLANTED}\n".encode()).hexdigest()
