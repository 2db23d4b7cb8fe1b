"""Chat formatting: exact round trips, masks, escapes and cases."""

import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row

from tidewatch.llm import chat
from tidewatch.llm.byte_bpe import merger
from tidewatch.llm.common import stored

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TURN = "conv_id long, turn long, role string, text string"
SAID = ["</s>[INST] ok [/INST]", "\\</s>\\\\[INST]", "<<s>", "<<SYS>>\\", "\\", "", None, "[TEXT", "[TEXT]é\n\n", "<s></s><s>", "ends in \\", "日本 🙂</s>"]


def rows(n=40, seed=1):
    r = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for turn in range(r.randint(1, 7)):
            out.append(Row(conv_id=conv, turn=turn, role=r.choice(["user", "assistant", "assistant", "system", "tool </s>", None]), text=r.choice(SAID)))
    r.shuffle(out)
    return out


def brute(some, template):
    by = {}
    for r in some:
        by.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[:3])
        said = [(role, text) for _, _, role, text in turns]
        marks = sum(len(template.escaped(t)) + (sum(map(len, template.marks[r])) if r in template.marks else sum(map(len, template.other)) + len(template.escaped(r))) for r, t in said)
        learned = "".join(t for r, t in said if r in template.learned)
        out.append((conv, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), marks))
    return sorted(map(repr, out))


def given(df):
    return sorted(repr(tuple(r)) for r in df.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())


@pytest.mark.parametrize("part", [1, 20, chat.PART])
def test_digests_read_back(spark, part):
    """Parts of one turn each give the same as whole conversations."""
    some = rows()
    parts = stored(chat.formatted(spark.createDataFrame(some, TURN), RANKS, part=part), "chat-test")
    assert given(chat.digests(parts, RANKS)) == brute(some, chat.LLAMA_LIKE)


def test_turns_read_back(spark):
    some = [r for r in rows(seed=2) if r["conv_id"] is not None]
    parts = stored(chat.formatted(spark.createDataFrame(some, TURN), RANKS, part=10), "chat-test")
    got = [(r["conv_id"], r["role"], r["text"]) for r in sorted(chat.turns(parts, RANKS).collect(), key=lambda r: (r["conv_id"], r["part"], r["place"]))]
    want = [(r["conv_id"], r["role"] or "", r["text"] or "") for r in sorted(some, key=lambda r: (r["conv_id"], r["turn"]))]
    assert got == want


def test_a_formatted_text_reads_one_way():
    t = chat.LLAMA_LIKE
    r = random.Random(4)
    pieces = [*t.controls, "\\", "<", "s>", "[", "x"]
    for _ in range(3000):
        text = "".join(r.choices(pieces, k=r.randint(0, 7)))
        told = t.escaped(text)
        assert t.unescaped(told) == text
        for c in t.controls:  # no control string stands without an escape
            at = told.find(c)
            while at >= 0:
                assert at > 0 and told[at - 1] == t.escape
                at = told.find(c, at + 1)


@pytest.mark.parametrize("bad", [dict(other=("[A]", "]x", "[C]")), dict(other=("[A]", "<s>", "[C]")), dict(other=("[A]", "\\n", "[C]")), dict(learned=("nobody",)), dict(other=("aba", "[B]", "[C]")), dict(other=("[<s>]", "[B]", "[C]"))])
def test_templates_that_could_be_misread_are_refused(bad):
    with pytest.raises(ValueError):
        chat.Template(**bad)


def test_mask_is_that_of_a_plain_walk():
    t, base = chat.LLAMA_LIKE, len(merger(RANKS).lengths)
    r = random.Random(5)
    ids, want = [], []
    for _ in range(200):
        k = r.randrange(3)
        body = [r.randrange(base) for _ in range(r.randrange(4))]
        ids += [base + 2 * k, *body, base + 2 * k + 1]
        want += [False, *[list(t.marks)[k] == "assistant"] * len(body), False]
    assert chat.loss_mask(np.array(ids), base, t).tolist() == want


def test_another_template_learns_two_roles(spark):
    t = chat.Template(marks={"user": ("<|u|>", "<|/u|>"), "bot": ("<|b|>", "<|/b|>"), "tool": ("<|t|>", "<|/t|>")}, other=("{{r}}", "{{t}}", "{{e}}"), learned=("bot", "tool"))
    some = [Row(conv_id=1, turn=k, role=role, text=f"say {k} <|b|> {{{{e}}}}") for k, role in enumerate(["user", "bot", "tool", "bot", "judge"])]
    parts = stored(chat.formatted(spark.createDataFrame(some, TURN), RANKS, t), "chat-test")
    assert given(chat.digests(parts, RANKS, t)) == brute(some, t)


def test_cases(spark):
    assert chat.digests(stored(chat.formatted(spark.createDataFrame([], TURN), RANKS), "chat-test"), RANKS).count() == 0
    long = "word </s> é " * 200_000
    some = [Row(conv_id=1, turn=None, role="user", text="first"), Row(conv_id=1, turn=2, role="assistant", text=long), *[Row(conv_id=1, turn=3, role="user", text="again")] * 3]
    df = spark.createDataFrame(some, TURN).selectExpr("*", "1 AS ids", "2 AS part", "3 AS n_turns", "4 AS loss")
    assert given(chat.digests(stored(chat.formatted(df, RANKS), "chat-test"), RANKS)) == brute(some, chat.LLAMA_LIKE)


def test_a_hot_conversation_spans_tasks(spark):
    some = [Row(conv_id=7, turn=k, role="assistant" if k % 2 else "user", text=f"turn {k} " * 20) for k in range(4000)] + [Row(conv_id=k, turn=0, role="user", text="x") for k in range(10, 500)]
    parts = stored(chat.formatted(spark.createDataFrame(some, TURN).repartition(8), RANKS, part=2000), "chat-test")
    assert given(chat.digests(parts, RANKS)) == brute(some, chat.LLAMA_LIKE)
    assert parts.filter("conv_id = 7").count() > 8


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_twin(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = c.execute(chat.OP12_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in chat.op12_chat(spark, SF).collect()) == want
