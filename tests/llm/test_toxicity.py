"""Toxicity: held-out accuracy on the given tables, and features by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sumwise.llm import toxicity as tox
from sumwise.llm.queries import op1_toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scores = op1_toxicity(spark, folder)
    rows = scores.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    print("held out:", len(toxic), len(clean), "AUC", above, "right", right)
    assert above > 0.98 and right > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_features_by_hand():
    reader = tox.Reader({"vile": 4.0, "nasty*": 2.0})
    found = dict(zip(tox.FEATURES, reader.features("You are VILE! v1le nastyish a-b x")))
    assert found["words"] == math.log1p(7) and found["strong_density"] == 2 / 7 and found["weak_density"] == 3 / 7
    assert found["near_second_person"] == 2 / 7 and found["hidden_hits"] == 1 / 7 and found["obfuscated"] == 2 / 7
    assert found["capital_words"] == 1 / 7 and found["exclamations"] == 1 / 33 and found["largest_weight"] == 4.0
    assert reader.features(None) == reader.features("") == reader.features(" \n") == [0.0] * len(tox.FEATURES)


def made(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))]
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "vermin", "idiot"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    return d, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_edges(spark):
    docs, labels = made(300)
    docs += [(None, "scum idiot vermin", "x"), (900, None, "x"), (901, "", "x"), (902, "w1 " * 20000, "x"), (5, docs[5][1], "x")]
    labels += [(None, 1), (5, None), (12345, 1), (7, 1), (7, 0)]
    got = tox.toxicity(*run(spark, docs, labels)).collect()
    assert len(got) == 305 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].held_out is False and by_id[None].predicted == 1
    assert by_id[900].predicted == by_id[901].predicted == by_id[902].predicted == 0
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = made(300)
    import zlib

    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (sorted(map(tuple, tox.toxicity(*run(spark, docs, x)).collect())) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(0, 1)]])
def test_too_few_labels_score_zero(spark, labels):
    got = tox.toxicity(*run(spark, made(5)[0], labels)).collect()
    assert [r.score for r in got] == [0.0] * 5


def test_filter_and_empty_table(spark):
    docs, labels = made(300)
    d, l = run(spark, docs, labels)
    kept = tox.without_toxic(d, l)
    assert kept.columns == d.columns
    bad = {i for i, t in labels if t}
    left = {r.doc_id for r in kept.collect()}
    assert len(left & bad) < 8 and len(set(range(300)) - bad - left) < 5
    assert tox.toxicity(d.limit(0), l).count() == 0
    assert tox.held_out(F.lit(None).cast("long")) is not None
