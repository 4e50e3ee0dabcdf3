"""Chat formatting against plain Python: what is read back equals the source, whatever the texts hold."""

import hashlib
import random
import re

import pytest

from lodestone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<\\/s>", "[\\\\INST]", "<", "[", "\\", "/s>", "INST]", "ok", "\n", "é", "😀", " "]


def escaped(text):
    return re.sub(r"(<)(\\*/?s>)", r"\1\\\2", re.sub(r"(\[)(\\*/?INST\])", r"\1\\\2", text))


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for r, x in turns).encode()
        made = "<s>" + "".join(f"[INST]{escaped(r)}[/INST]{escaped(x)}</s>" for r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(made), made)
    return out


def check(spark, rows):
    made = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    text = {r["conv_id"]: r["formatted"] for r in made.collect()}
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"], text[c]) == w
        assert r["identical"]


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_control_strings_come_back(spark, seed):
    rng = random.Random(seed)
    mess = lambda: rng.choice([None, "", *["".join(rng.choices(BITS, k=rng.randint(1, 6))) for _ in range(8)]])
    rows = [(rng.choice([None, 1, 2, 3, -1, 50]), rng.choice([None, 0, 1, 2]), rng.choice(["assistant", "user", mess()]), mess()) for _ in range(200)]
    check(spark, rows)


def test_null_empty_long_and_repeated_rows(spark):
    check(spark, [(1, None, None, None)])
    check(spark, [(1, 0, "assistant", "</s>" * 20_000 + "x" * 100_000), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 5, "user", "")])


def test_empty_table_and_clashing_columns(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, 0, "user", "q", "f", 1, "g"), (1, 1, "assistant", "a", "f", 2, "g")]
    df = spark.createDataFrame(rows, SCHEMA + ", formatted string, segment long, said string")
    assert chat.digests(chat.formatted(df)).first()["loss_chars"] == 1


def test_a_text_without_control_strings_is_not_changed(spark):
    df = spark.createDataFrame([(1, 0, "user", "a [b] <c> \\"), (1, 1, "assistant", "<\\s")], SCHEMA)
    row = chat.formatted(df).first()
    assert row["formatted"] == "<s>[INST]user[/INST]a [b] <c> \\</s>[INST]assistant[/INST]<\\s</s>" and row["n_escaped"] == 0
    none, span = row["loss_spans"]
    assert none is None
    assert row["formatted"][span["start"] : span["start"] + span["chars"]] == "<\\s"


@pytest.mark.parametrize(
    "text", ["", "<s>x", "[INST]u[/INST]a</s>", "<s>[INST]u[/INST]a", "<s>[INST]u a</s>", "<s>[INST]u[/INST]a[INST]b</s>", "<s>[INST]u[/INST]a<s></s>", "<s>u[/INST]a</s>"]
)
def test_the_parser_refuses_what_the_grammar_does_not_have(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(chat.parsed(df["t"]).alias("p")).first()["p"] is None


def test_the_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).selectExpr("conv_id", "turn", "role", "text")
    plan = chat.digests(chat.formatted(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
