import numpy as np

from cellweave.llm import quality


def test_identity_of_the_pairs():
    rng = np.random.default_rng(1)
    d = quality.STATS + quality.WORD_SLOTS
    m = quality.Machine(0.3, rng.normal(size=d), rng.normal(size=(d, 4)), np.zeros(quality.STATS), np.ones(quality.STATS))
    idx, val, ptr = rng.integers(0, d, 20), rng.normal(size=20), np.array([0, 7, 20])
    for k, (a, z) in enumerate(zip(ptr[:-1], ptr[1:], strict=True)):
        i, x = idx[a:z], val[a:z]
        pairs = sum(m.factor[i[p]] @ m.factor[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p + 1, len(i)))
        assert np.isclose(m.margins(ptr, idx, val)[k], 0.3 + m.weight[i] @ x + pairs)


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(700):
        w = list(rng.choice(words, rng.integers(5, 120)))
        bad = i % 5 == 1
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + ".", "en", "s", 9, 0 if bad else 1))
    docs = spark.createDataFrame([r[:5] for r in rows] + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "a" * 300_000, "en", "s", 1), (3, rows[3][1], "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], None, "clash") for r in rows] + [(5, None, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = quality.train(docs, labels, per_class=150)
    got = quality.score(docs, model).collect()
    assert len(got) == 704
    truth = {r[0]: r[5] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality.score(docs.limit(0), model).collect() == []
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(3), nothing).collect()} != set()
    keep = quality.accepted(docs, model)
    assert keep.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in keep.collect()} == {r.doc_id for r in got if r.predicted}


def test_memory_of_a_full_batch(spark):
    """What a batch of 8 MB takes follows a piece of it, and its rows are those that a machine on the whole batch accepts."""
    import tracemalloc

    import pyarrow as pa

    class Frame:
        sparkSession, schema = spark, None

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            return f

    rng = np.random.default_rng(3)
    words = np.array([f"word{k}" for k in range(5000)])
    texts = [" ".join(rng.choice(words, 400)) for _ in range(2200)] + [None, ""]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), pa.array(["en"] * n), pa.array(["web"] * n), pa.array([len(t or "") for t in texts])], ["doc_id", "text", "lang", "source", "n_chars"])
    assert batch.column(1).nbytes > 7e6
    d = quality.STATS + quality.WORD_SLOTS
    model = quality.Machine(-0.8, rng.normal(0, 0.3, d), rng.normal(0, 0.3, (d, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    ptr, slots, values, stats = quality.features(batch.column(1), batch.column(4))
    margin = model.margins(*quality._joined(ptr, slots, values, stats, model.mean, model.scale))
    want = np.flatnonzero(np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 6) >= 0.3).tolist()
    work = quality.accepted(Frame(), model)
    tracemalloc.start()
    got = [x for b in work([batch]) for x in b.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and 0 < len(want) < n and peak < 80e6
