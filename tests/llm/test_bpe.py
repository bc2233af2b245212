import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pageloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    raw = bpe.vocabulary(PATH)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.codec(raw), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_tiktoken_does_and_decode_back(both):
    own, ref = both
    rnd = random.Random(5)
    alphabet = list("aestmdrvl''' \n\t1.,!-é漢字٣  \x1c\x85") + ["'s", "'re", "'ll", "  ", "\r\n", "😀", "I'm", " 'tis"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))) for _ in range(3000)] + ["", " ", "'", "'s's're've'l'll'r"]
    for t, p in zip(texts, own.encode(texts)):
        assert np.frombuffer(p, "<u4").tolist() == ref.encode_ordinary(t), repr(t)
        assert own.decode(p) == t.encode()


def test_every_code_point_has_the_class_tiktoken_gives_it(both):
    own, ref = both
    texts = [f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    wrong = [t for t, p in zip(texts, own.encode(texts)) if np.frombuffer(p, "<u4").tolist() != ref.encode_ordinary(t)]
    assert not wrong, wrong[:20]


def test_long_runs_merge_as_tiktoken_does(both):
    own, ref = both
    rnd = random.Random(1)
    for t in ("".join(rnd.choice("abcdeth") for _ in range(5000)), "-" * 3000, "a" * 2500):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == ref.encode_ordinary(t)


def test_nulls_empties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "hi 'll", None), (2, "", "y")], "doc_id long, text string, n_tokens string")
    rows = sorted(bpe.digest_documents(df).select("doc_id", "n_tokens").collect(), key=str)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0, 0] and len(rows) == 4
    assert bpe.digest_documents(df.limit(0)).count() == 0
    got = {r.doc_id: r for r in bpe.encode_documents(df).collect()}
    assert got[None].decoded == "hi 'll" and got[None].byte_ends[-1] == 6


def test_ranges_decode_by_offsets(both):
    own, _ = both
    rnd = random.Random(9)
    for text in ("", "a", "Größe und 漢字 😀 — don't " * 7, "x" * 300):
        raw, packed = text.encode(), own.encode([text])[0]
        ends = own.byte_ends(packed)
        assert own.decode(packed, ends) == raw and own.decode(packed) == raw
        for _ in range(100):
            a = rnd.randrange(len(raw) + 2)
            b = rnd.randrange(len(raw) + 2)
            assert own.decode(packed, ends, a, b) == raw[a:b]
