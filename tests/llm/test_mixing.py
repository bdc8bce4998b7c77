import pytest

from cellweave.llm import mixing

ROWS = [(i, "w " * (1 + i % 9) + ("!! " if i % 11 == 0 else ""), ["en", "de", None][i % 3 % (1 + i % 2 * 2)], f"s{min(i % 7, 3)}" if i % 13 else None) for i in range(600)] + [(None, None, None, None), (1, "", "en", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, "clash") for r in ROWS], "doc_id long, text string, lang string, source string, weight int, topic string")


def test_marginals_meet_the_targets(docs):
    got = mixing.mix(docs, 0.5, 60).collect()
    assert len(got) == len(ROWS) and max(r.probability for r in got) == 1.0
    tokens = sum(r.n_tokens for r in got)
    for m in mixing.MARGINS:
        share, raked = {}, {}
        for r in got:
            share[r[m]] = share.get(r[m], 0) + r.n_tokens / tokens
            raked[r[m]] = raked.get(r[m], 0) + r.n_tokens * r.weight / tokens
        norm = sum(v**0.5 for v in share.values())
        assert all(abs(raked[k] - v**0.5 / norm) < 1e-3 for k, v in share.items())


def test_frame_and_driver_agree(docs):
    one = sorted(map(tuple, mixing.mix(docs, 0.8, 6).collect()), key=repr)
    two = sorted(map(tuple, mixing.mix(docs, 0.8, 6, driver_cells=0).collect()), key=repr)
    assert one == two


def test_edges(docs):
    assert mixing.mix(docs.limit(0)).collect() == []
    kept = mixing.mix(docs, keep=("text",)).where("kept")
    assert "text" in kept.columns and 0 < kept.count() < len(ROWS)


def test_given_targets(docs):
    wanted = {"source": {"s0": 5, "s1": 1, "s3": 2, None: 2}, "lang": {"en": 1, "de": 1, None: 1}}
    got = mixing.mix(docs, rounds=80, targets=wanted).collect()
    tokens = sum(r.n_tokens for r in got)
    for m, aims in wanted.items():
        raked = {}
        for r in got:
            raked[r[m]] = raked.get(r[m], 0) + r.n_tokens * r.weight / tokens
        total = sum(aims.get(k, 0) for k in raked)
        assert all(abs(raked[k] - aims.get(k, 0) / total) < 2e-2 for k in raked)
    assert all(not r.kept for r in got if r.source == "s2")
    two = mixing.mix(docs, rounds=6, targets=wanted, driver_cells=0)
    assert sorted(map(tuple, two.collect()), key=repr) == sorted(map(tuple, mixing.mix(docs, rounds=6, targets=wanted).collect()), key=repr)
