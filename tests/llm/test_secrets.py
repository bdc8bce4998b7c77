"""Secret scans: held-out accuracy on made findings, and texts with planted keys."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cellweave.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(secrets.labelled_findings(spark))


def test_held_out_accuracy(spark, model):
    test = secrets.labelled_findings(spark, 60, "held out")
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.with_features(test))
    right = model.transform(data).select((F.col("prediction") == F.col("label")).alias("r"))
    assert right.agg(F.avg(F.col("r").cast("double"))).first()[0] > 0.97


def test_texts(spark, model):
    sha = hashlib.sha1(b"x").hexdigest()
    rows = [
        (1, f'from the rivers\ntoken = "{sha}" and on', "src0"), (2, f"fixed in commit {sha} of the tree", "src0"), (3, None, None), (4, "", "s"),
        (5, "plain words only, nothing more", "s"), (6, f'token = "{sha}"', None), (7, "very " * 3000 + f'secret = "{sha}"', "a/b"),
    ]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, candidate string, word int")
    got = sorted((r.doc_id, r.word, r.is_secret, r.candidate_sha256) for r in secrets.scan(docs, model).collect())
    d = hashlib.sha256(sha.encode()).hexdigest()
    assert got == [(1, 5, True, d), (2, 3, False, d), (6, 2, True, d), (7, 3002, True, d)]
    assert secrets.scan(docs.limit(0), model).collect() == []


def test_every_candidate_of_a_word(spark, model):
    """Minified JSON, an address with a key, and a text without blanks: each candidate is judged with its own surroundings."""
    sha, key = hashlib.sha1(b"x").hexdigest(), "ghp_" + hashlib.sha256(b"y").hexdigest()[:36]
    path = "com/some/long/path/2024"
    many = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(3000)]
    rows = [(1, f'{{"commit":"{sha}","token":"{key}"}}'), (2, f"see {path}?token={key}"), (3, ",".join(many)), (4, f'{{"token":"{key}","commit":"{sha}"}}'), (5, f"{key};{key}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("src0"))
    got = {}
    for r in secrets.scan(docs, model).collect():
        got.setdefault(r.doc_id, {})[r.word, r.nth] = (r.candidate_sha256, r.is_secret)
    d = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1] == {(0, 0): (d(sha), False), (0, 1): (d(key), True)}
    assert [v[0] for _, v in sorted(got[2].items())] == [d(path), d(key)]
    assert [v[0] for _, v in sorted(got[3].items())] == [d(x) for x in many]
    assert got[4] == {(0, 0): (d(key), True), (0, 1): (d(sha), False)}
    assert [v[0] for _, v in sorted(got[5].items())] == [d(key), d(key)]


def test_candidates_against_brute_force(spark):
    """Every run of key characters with a digit, with its padding, and every dotted token; names and equal signs are no part of them."""
    rng = random.Random(4)
    letters = "abcXYZ0189+/_-"
    texts = []
    for i in range(200):
        words = ["".join(rng.choice(letters) for _ in range(rng.choice((3, 15, 16, 17, 40)))) + rng.choice(["", "=", "==", "===", ",", '"']) for _ in range(rng.randrange(0, 9))]
        texts.append((i, rng.choice(["", "password=", "x "]).join(words) if i % 2 else " ".join(f"{rng.choice(['', 'key=', 'a,'])}{w}" for w in words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = sorted((r.doc_id, r.word, r.nth, r.candidate) for r in secrets.candidates(docs).where("candidate rlike '[0-9]'").collect())
    want = []
    for i, t in texts:
        for w, word in enumerate(t.split()):
            found = re.findall(r"[A-Za-z0-9+/_\-]{16,}={0,2}", word)
            want += [(i, w, k, c) for k, c in enumerate(found) if re.search("[0-9]", c)]
    assert got == sorted(want)


def test_long_runs_repeats_and_names(spark, model):
    """A run of ten million letters takes seconds; repeated rows repeat their findings; letters alone count after a name."""
    rows = [(1, "x" * 10_000_000, "s"), (2, 'password = "QxZvKpWjXqhGtRbNmLcD" and QxZvKpWjXqhGtRbNmLcD', "s"), (3, "the key eyJhbGciOi.eyJzdWIi0.c2lnbmF0dXJl here", "s"), (4, "a" * 5_000_000 + "1", "s"), (2, "token = 0123456789abcdef0123", "s"), (2, "token = 0123456789abcdef0123", "s")]
    began = time.time()
    got = sorted((r.doc_id, r.word, r.length) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), model).collect())
    assert time.time() - began < 60
    assert got == [(2, 2, 20), (2, 2, 20), (2, 2, 20), (3, 2, 33), (4, 0, 5_000_001)]
