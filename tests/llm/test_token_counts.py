import random

import pytest
from pageloom.llm import bpe, token_counts as tc


def brute(text, sections, rule, c):
    ids = bpe.np.frombuffer(c.encode([text])[0], "<u4").tolist()
    at, owner = 0, [None] * len(text.encode())
    char_of = [i for i, ch in enumerate(text) for _ in ch.encode()]
    for k, (_, a, b) in enumerate(sections):
        for j, ch in enumerate(char_of):
            if a <= ch < b:
                owner[j] = k
    out = [0.0] * len(sections)
    for i in ids:
        n = len(c.bytes_of[i])
        chars = sorted(set(char_of[at : at + n]))
        own = [next((k for k, (_, a, b) in enumerate(sections) if a <= ch < b), None) for ch in chars]
        at += n
        if rule == "split":
            for k in own:
                if k is not None:
                    out[k] += 1 / len(own)
        elif (k := own[0 if rule == "first" else -1]) is not None:
            out[k] += 1
    return out


@pytest.mark.parametrize("rule", tc.RULES)
def test_allocation_equals_brute_force(rule):
    c = bpe.codec(bpe.vocabulary())
    rnd = random.Random(3)
    for _ in range(150):
        text = "".join(rnd.choice(["the ", "\n", "\n\n", " | ", "漢", "é", "token", "x", " ", "😀"]) for _ in range(rnd.randrange(0, 25)))
        if rnd.random() < 0.5:
            sections = tc.line_sections(text)
        else:
            cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 4)))
            sections = [("s", a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        spans = tc.token_spans(text, c.encode([text])[0], c) if text else (bpe.np.zeros(0, int), bpe.np.zeros(0, int))
        got, _ = tc.allocate(*spans, sections, rule)
        assert got.tolist() == pytest.approx(brute(text, sections, rule, c))


def test_line_kinds_cover_the_text():
    text = "Title\na | b\n\nbody text\nend"
    parts = tc.line_sections(text)
    assert [p[0] for p in parts] == ["heading", "table", "blank", "body", "body"]
    assert "".join(text[a:b] for _, a, b in parts) == text


def test_nulls_and_empties(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "one\ntwo", 5), (3, "one\ntwo", 5)], "doc_id long, text string, sections int")
    rows = tc.section_token_counts(df).collect()
    assert [(r.doc_id, len(r.sections)) for r in rows] == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert all(sum(s["tokens"] for s in r.sections) == r.n_tokens for r in rows)
    assert tc.section_token_counts(df.limit(0)).count() == 0
