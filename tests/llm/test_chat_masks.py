import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from casewright.llm import chat_masks
from casewright.llm.chat_masks import Template, encoded, formatted, learnt_tokens, read_back, tokenizer_of
from tests.llm.frames import clashing, empty

SCHEMA = "conv_id long, turn long, role string, text string"
AWKWARD = ["<|turn|>", "<|text|>", "<|end|>", "<\\|end|>", "<\\\\|turn|>", "<", "|end|>", "\\", "</s>[INST] ok [/INST]", "[\\INST]",
           "<|endoftext|>", " ", "\n\n  x", "", "🙂é‍日本", "a<|e", "nd|>", "<s", "ß  \t", "\x00", "Ġ", "don't 12 345"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, some in turns.items():
        said = [(r.decode(), t.decode()) for _, r, t in sorted(some)]
        loss = "".join(t for r, t in said if r == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def run(spark, rows, **options):
    frame = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), "number", "whole", "loss", "task")
    got = read_back(formatted(frame, **options)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:5] for r in got}, {r.conv_id: r.formatted_chars for r in got}


def sample(seed, n=300):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "".join(rng.choices(AWKWARD, k=rng.randrange(6)))])
    return [(rng.choice([None, 5, 5, *range(20)]), rng.choice([None, *range(8)]),
             rng.choice(["user", "assistant", "assistant", "system", None, "<|text|>", "assistant "]), text()) for _ in range(n)]


@pytest.mark.parametrize("part_chars", [1, 60, 1 << 16])
def test_texts_and_masks_come_back(spark, part_chars):
    rows = sample(part_chars)
    got, chars = run(spark, rows, part_chars=part_chars)
    assert got == brute(rows)
    template = Template()
    want = defaultdict(int)
    for conv, _, role, text in rows:
        want[conv] += sum(map(len, (template.escape(role or ""), template.escape(text or ""), *template.own)))
    assert chars == want


def test_parts_have_the_ids_of_the_whole_conversation():
    template = Template()
    turns = [(role or "", text or "") for _, _, role, text in sample(9, 120)]
    ids, mask = encoded(turns, chat_masks.VOCABULARY, template)
    parts = [encoded([t], chat_masks.VOCABULARY, template) for t in turns]
    assert ids == [i for p, _ in parts for i in p]
    assert mask.tolist() == [m for _, p in parts for m in p]


def test_mask_equals_a_search_through_all_spans():
    rng = random.Random(3)
    bounds = sorted(rng.sample(range(500), 120))
    tokens = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if rng.random() < 0.8]
    tokens += [tokens[7]] * 2  # bytes of one character
    tokens.sort()
    edges = sorted(rng.sample(bounds, 40))
    spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)] + [(edges[-1] + 1,) * 2]
    starts, ends = np.array(tokens).T
    want = [any(a < end and start < b for a, b in spans) for start, end in tokens]
    assert learnt_tokens(starts, ends, np.array(spans)).tolist() == want


def test_every_learnt_text_is_masked_token_by_token():
    template, tokenizer = Template(), tokenizer_of(chat_masks.VOCABULARY, Template())
    for role, text in [("assistant", "  leading and 🙂 trailing \n"), ("assistant", ""), ("user", "x")]:
        ids, mask = encoded([("user", "a "), (role, text)], chat_masks.VOCABULARY, template)
        masked = [i for i, m in zip(ids, mask, strict=True) if m]
        assert tokenizer.decode(masked, skip_special_tokens=False) == (text if role == "assistant" else "")
        assert sum(i >= 50257 for i in ids) == 6


def test_escapes_are_undone_and_leave_no_control_string():
    template, rng = Template(), random.Random(1)
    seen = {}
    for _ in range(3000):
        text = "".join(rng.choices([*AWKWARD, "<", "[", "\\", "INST]", "s>"], k=rng.randrange(7)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text
        assert not any(c in escaped for c in (*template.own, *template.foreign))
        assert seen.setdefault(escaped, text) == text
    with pytest.raises(ValueError):
        Template(turn="<<").marks


def test_one_conversation_holds_most_rows_and_long_texts(spark):
    rows = [(1, i % 50, ["user", "assistant"][i % 2], f"turn {i} ") for i in range(3000)]
    rows += [(2, 0, "assistant", "long text " * 100_000), (3, 0, "user", "")] + [(4, 1, "assistant", "same")] * 40
    got, _ = run(spark, rows, part_chars=500)
    assert got == brute(rows)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be put together again
    spark.conf.set(coalesce, "false")
    try:
        parts = formatted(spark.createDataFrame(rows, SCHEMA), part_chars=500)
        assert parts.filter("conv_id = 1").groupBy("task").count().count() > 1
        assert {r.conv_id: tuple(r)[1:5] for r in read_back(parts).collect()} == brute(rows)
    finally:
        spark.conf.unset(coalesce)


def test_empty_table(spark):
    assert read_back(formatted(empty(spark, SCHEMA))).count() == 0
