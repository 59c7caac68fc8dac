import hashlib
import random

import brute
from locusflow.llm import chat_format, topk_search
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, rank string"


def test_threshold_search_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)], "x") for i in range(300)]
    rows += [(300, rows[0][1], "tie"), (301, None, "x"), (302, [None] * 6, "x"), (303, [float("nan")] * 6, "x"),
             (304, [float("inf")] * 6, "x"), (305, [0.5, 0.5], "short"), (306, [1.0, -1.0], "short"), (None, [1.0] * 6, "x"), rows[0]]
    vectors = topk_search.integer_vectors(spark.createDataFrame(rows, VECTORS))
    held = {r["vec_id"]: list(r["v"]) for r in vectors.collect()}
    assert not {301, 302, 303, 304} & set(held)
    picked = [0, 7, 50, 300, 305]
    found = topk_search.top_k(vectors, vectors.where(F.col("vec_id").isin(picked)), 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == brute.top_k(held, {q: held[q] for q in picked}, 5)


def test_no_vectors_no_rows(spark):
    vectors = topk_search.integer_vectors(spark.createDataFrame([], VECTORS))
    assert topk_search.top_k(vectors, vectors).count() == 0


def test_escape_is_reversible(spark):
    texts = ["", "\\", "\\\\n", "</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>", "<\\|end|>", "plain", "[[INST]", "<|end|>\\"]
    rows = spark.createDataFrame([(t, chat_format.escape(t)) for t in texts], "t string, e string")
    assert rows.where(chat_format.unescaped(F.col("e")) != F.col("t")).count() == 0
    assert not any(c in chat_format.escape(t) for t in texts for c in chat_format.CONTROLS)


def test_long_conversation_is_rendered_as_by_the_template():
    turns = [(("user", "assistant")[i % 2], f"text {i} <|end|>") for i in range(300)]
    out, spans, rewritten = chat_format.render_turns(chat_format.marked_turns, turns)
    assert out == chat_format.marked_turns(turns) and not rewritten
    assert [out[c:d] for *_, c, d in spans] == [chat_format.escape(t) for _, t in turns]


def test_templates_that_look_back_or_rewrite():
    numbered = lambda turns: "".join(f"#{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))
    turns = [("user", str(i)) for i in range(150)]
    out, spans, rewritten = chat_format.render_turns(numbered, turns)
    assert out == numbered(turns) and not rewritten
    last_only = lambda turns: "".join(f"{r}{'' if i + 1 < len(turns) else ': ' + t}|" for i, (r, t) in enumerate(turns))
    out, spans, rewritten = chat_format.render_turns(last_only, turns[:5])
    assert rewritten and out == last_only(turns[:5])


def test_templates_that_rewrite_late():
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(150)]
    line = lambda r, t: f"{r}: {t}\n"
    last_100 = lambda turns: "".join(line(*x) for x in turns[-100:])
    summed_up = lambda turns: ("many turns\n" if len(turns) > 120 else "") + "".join(line(*x) for x in turns)
    passing = lambda turns: ("half way\n" if len(turns) == 90 else "") + "".join(line(*x) for x in turns)
    for template in (last_100, summed_up, passing):
        out, spans, rewritten = chat_format.render_turns(template, turns)
        assert out == template(turns) and rewritten and spans[-1][1] == len(out)
        assert not chat_format.render_turns(template, turns[:80])[2]


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, None, "x"), (None, 0, "assistant", "lost"),
            (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (3, None, "user\nodd", "</s>")]
    table = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(table)).collect()}
    want = {1: [("user", ""), ("assistant", "b"), ("", "x")], 2: [("assistant", "same")] * 2, 3: [("user\nodd", "</s>")], None: [("assistant", "lost")]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == len(chat_format.marked_turns(turns))
    assert chat_format.format_conversations(table.limit(0)).count() == 0
