import zlib

import numpy as np
import pytest

from siftwood.llm import fm, quality, text_features, toxicity


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    p = np.asarray(label) == 1
    return (rank[p].sum() - p.sum() * (p.sum() - 1) / 2) / (p.sum() * (~p).sum())


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    s = fm.FMSettings(dimensions=64, rank=3)
    model = fm.FMModel(s, 0.3, rng.normal(size=64), rng.normal(size=(64, 3)), rng.random(64) < 0.8)
    rows = [np.sort(rng.choice(64, k, False)) for k in (0, 1, 5, 20)]
    got = model.raw(np.concatenate(rows), np.array([len(r) for r in rows]))
    for r, value in zip(rows, got):
        r = r[model.used[r]]
        x = (len(r) + s.soften) ** -s.power
        pairs = sum(model.factors[i] @ model.factors[j] * x * x for a, i in enumerate(r) for j in r[a + 1 :])
        assert value == pytest.approx(0.3 + model.linear[r].sum() * x + pairs)


def test_learns_an_interaction_that_no_linear_model_can():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([1 if a else 2, 3 if b else 4]))
        labels.append(float(a == b))  # neither says anything alone
    settings = fm.FMSettings(dimensions=16, rank=4, epochs=20, rate=0.3, least_g=-1.0, keep=16)
    model = fm.train(rows[:3000], np.array(labels[:3000]), settings)
    score = model.score(np.concatenate(rows[3000:]), np.full(1000, 2))
    assert auc(score, labels[3000:]) > 0.99
    assert np.array_equal(fm.train(rows[:3000], np.array(labels[:3000]), settings).linear, model.linear)  # the same each time


def test_learns_a_term_that_matters_only_beside_another():
    """A term as frequent in label 1 as in label 0, which tells nothing alone, but much in rows with another term."""
    rng = np.random.default_rng(1)

    def make(n):
        rows, labels = [], []
        for _ in range(n):
            insult = rng.random() < 0.3
            toxic = insult and rng.random() < 0.5
            group = rng.random() < (0.6 if toxic else 0.05 if insult else 0.72)
            words = set((rng.choice(2000, 60, replace=False) + 100).tolist())
            rows.append(np.array(sorted(words | ({1} if insult else set()) | ({2} if group else set()))))
            labels.append(float(toxic))
        return rows, np.array(labels)

    rows, labels = make(6000)
    share = [np.mean([2 in r for r, y in zip(rows, labels) if y == k]) for k in (0, 1)]
    assert abs(share[0] - share[1]) < 0.05
    settings = fm.FMSettings(dimensions=4096, keep=1024, rate=0.3, epochs=8)
    model = fm.train(rows, labels, settings)
    assert model.used[1] and model.used[2] and model.used.sum() < 40
    more, told = make(3000)
    insults = [k for k, r in enumerate(more) if 1 in r]
    score = model.score(np.concatenate(more), np.array([len(r) for r in more]))
    assert auc(score[insults], told[insults]) > 0.75
    blind = fm.train(rows, labels, fm.FMSettings(dimensions=4096, keep=1024, rate=0.3, epochs=8, partners=0))
    assert auc(blind.score(np.concatenate(more), np.array([len(r) for r in more]))[insults], told[insults]) < 0.6


def test_held_out_rows_teach_nothing(spark, documents):
    from pyspark.sql import functions as F

    out = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = documents({i: f"plain text number {i} " + ("insult" if i in out else "kind") for i in range(1, 400)})
    labels = docs.select("doc_id", F.col("text").contains("insult").cast("int").alias("toxic"))
    model = toxicity.learn_toxicity(docs, labels)
    assert model.notes["positives"] == 0
    found = toxicity.score_toxicity(docs, model).collect()
    assert sorted(r.doc_id for r in found if r.held_out) == out


def test_rows_for_training_are_bounded(spark, documents):
    from pyspark.sql import functions as F

    docs = documents({i: f"text {i}" for i in range(200)})
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert toxicity.learn_toxicity(docs, labels, max_rows=50).notes["rows"] == 50


def test_metadata_and_structure():
    calm = text_features.structure(b"A quiet line.\nAnother one, longer than that.", (("n_chars", 5.0), ("other", None)))
    loud = text_features.structure(b"BUY!! BUY!! BUY!!\nBUY!! BUY!! BUY!!")
    assert calm["meta:n_chars"] == 5.0 and "meta:other" not in calm
    assert loud["upper"] == 1.0 and loud["same_lines"] == 0.5 and loud["runs"] > 0.5 > calm["runs"]
    assert text_features.structure(b"")["bytes"] == 0.0


@pytest.mark.parametrize("operator", ["toxic", "quality"])
def test_held_out_accuracy(spark, small, operator):
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    if operator == "toxic":
        found = toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels))
    else:
        found = quality.score_quality(docs, quality.learn_quality(docs, labels))
    told = found.where("held_out").join(labels, "doc_id").toPandas()
    assert told.score.between(0, 1).all()
    assert auc(told.score.values, told[operator].values) > 0.95
    assert (told.predicted == (told.score >= (0.5 if operator == "toxic" else 0.3))).all()


@pytest.mark.parametrize("name", ["op3_toxicity_fm", "op5_quality_fm"])
def test_query_against_all_pairs(spark, small, name):
    """The registered query's scores, from every pair of features one by one; learnt rows are those not held out."""
    from siftwood.llm.queries import queries

    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    module, threshold = (toxicity, 0.5) if name.startswith("op3") else (quality, 0.3)
    model = (module.learn_toxicity if module is toxicity else module.learn_quality)(docs, labels)
    assert model.notes["rows"] == sum(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in labels.join(docs, "doc_id").collect())
    found = {r.doc_id: r for r in queries()[name](spark, small).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    s, rng = model.settings, np.random.default_rng(0)
    for r in rng.permutation(len(rows))[:60].tolist():
        r = rows[r]
        raw = (r.text or "").encode()
        extra = () if module is toxicity else (("n_chars", np.log2(1 + r.n_chars)),)
        features = (text_features.words_only if module is toxicity else text_features.words_and_structure)(raw, extra, s.dimensions)
        own = [i for i in features if model.used[i]]
        x = (len(own) + s.soften) ** -s.power
        v = model.factors[own].astype(float)
        pairs = sum(v[a] @ v[b] for a in range(len(own)) for b in range(a)) * x * x
        value = 1 / (1 + np.exp(-np.clip(model.bias + model.linear[own].sum(dtype=float) * x + pairs, -30, 30)))
        assert found[r.doc_id].score == pytest.approx(value, abs=1e-5)
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert found[r.doc_id].predicted == (found[r.doc_id].score >= threshold)


def test_quality_without_metadata(spark, documents):
    docs = documents({i: f"plain text number {i}" for i in range(20)}).drop("n_chars")
    model = quality.learn_quality(docs, docs.selectExpr("doc_id", "doc_id % 2 AS quality"))
    assert quality.score_quality(docs, model).count() == 20
    assert quality.keep_good(docs, model, threshold=0.0).columns == docs.columns
