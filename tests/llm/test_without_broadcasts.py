"""The ways that are taken beyond the bounds of broadcasts, and beyond the edges that one task finishes: results stay the same."""

import random

import numpy as np
import pytest
from pageloom.llm import common, exact_dedup, mixing, near_dedup, simhash, substring_dedup


@pytest.fixture
def docs(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(rnd.choice([5, 70, 120]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        if i % 3 == 0:
            w[rnd.randrange(len(w))] = word()
        if i % 5 == 0:
            w += base[3]
        rows.append((i, " ".join(w), f"s{i % 4}"))
    rows += [(None, None, None), (7, rows[7][1], "s3"), (7, rows[7][1], "s3")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize(
    "make",
    [
        lambda d: exact_dedup.exact_groups(d), lambda d: exact_dedup.drop_copies(d), lambda d: mixing.mix(d), lambda d: mixing.apply_mix(d), lambda d: substring_dedup.remove_repeats(d),
        lambda d: near_dedup.drop_near(d, common=5, part_docs=8), lambda d: simhash.near_groups(d),
    ],
    ids="exact_groups drop_copies mix apply_mix remove_repeats drop_near near_groups".split(),
)
def test_results_do_not_depend_on_broadcasts(docs, make, monkeypatch):
    docs = common.write_table(docs, "docs")
    rows = lambda: sorted(str(tuple(r)) for r in make(docs).collect())
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "LOCAL_EDGES", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    docs.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert not common.is_small(docs) and rows() == want
    finally:
        docs.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components(spark, local, monkeypatch):
    """Chains, hubs and cliques; also where no task may finish alone."""
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, int(x)) for x in range(501, 900)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (200, 2))] + [(7, 7)]
    n = 1300
    label = common.smallest_labels(n, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = {i: int(label[i]) for e in edges if e[0] != e[1] for i in e}
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long").repartition(7)
    got = common.components(df).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
