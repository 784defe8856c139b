"""Operators decide from all rows: nothing that counts is left to a sample or bound to one task."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lonja.llm import suffix_dedup, toxicity


def toxic_table(spark, n=9000, rare=6):
    """More documents than the fit once sampled; one word is in `rare` toxic documents only."""
    rng = random.Random(1)
    words = [a + b for a in "bcdfghjklm" for b in ("ana", "elo", "iru", "osa")]
    rows, labels = [], []
    for i in range(n):
        bad = i % 100 == 0
        text = [rng.choice(words) for _ in range(12)] + (["vile"] if bad else [])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    for i in range(n, n + rare):
        rows.append((i, "quxword " + rng.choice(words)))
        labels.append((i, 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_uses_every_training_document(spark):
    docs, labels = toxic_table(spark, 30000)
    w, *_ = toxicity.learn(docs, labels, parts=10**6, held=-1)  # nothing held out
    slot = int(toxicity.slots_of("quxword", toxicity.WordSlots())[0])
    assert w[slot] > 0
    counted = dict(docs.select("text", (F.col("doc_id") % 100 == 0).alias("toxic")).mapInPandas(toxicity._frequencies, "slot int, n long, p long").groupBy("slot").agg(F.sum("n")).collect())
    assert counted[-1] == 30006 and counted[int(toxicity.slots_of("vile", toxicity.WordSlots())[-1])] == 300


def test_toxicity_fit_in_executors_equals_the_driver(spark):
    docs, labels = toxic_table(spark)
    here, there = toxicity.learn(docs, labels), toxicity.learn(docs, labels, most_entries=0)
    assert here[0].any()
    for a, b in zip(here, there):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-5)


def test_cut_in_executors_equals_the_driver(spark):
    """Equal values, repeats of a row and ties of F1 included; values that are all alike, no toxic label, no row at all."""
    rng = random.Random(3)
    rows = [(rng.choice((rng.gauss(0, 2), rng.randrange(-5, 5) / 2)), rng.randrange(3), rng.randrange(3)) for _ in range(20000)]
    some = [[(f, p + (f > 1), p + q + 2) for f, p, q in rows], [(f, 0, 1) for f, *_ in rows], [(-1.5, 1, 2)] * 3, [(1.0, 1, 1), (0.0, 0, 1), (-1.0, 1, 1)], [(0.5, 0, 3), (0.25, 2, 2)], []]
    for rows in some:
        want = toxicity.calibrated(*np.array(rows, float).reshape(-1, 3).T)
        np.testing.assert_allclose(toxicity.spread_calibrated(spark.createDataFrame(rows, "f double, p long, known long")), want, rtol=1e-9)


def many_bags(spark):
    """More than 8,000 distinct bags of telling words in clean documents alone."""
    rng = random.Random(5)
    words = [a + b for a in "bcdfghjk" for b in ("ana", "elo", "iru", "osa")]
    rows = [(i, int(i % 8 == 0), " ".join(w for w in words if rng.random() < (0.3 if i % 8 == 0 else 0.1))) for i in range(24000)]
    docs = spark.createDataFrame([(i, text) for i, _, text in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, bad) for i, bad, _ in rows], "doc_id long, toxic int"), rows


def of_all_labels(model, rows):
    """Scale and cut that the driver's calibration gives for a model's weights on every labelled row."""
    memo = toxicity.WordSlots()
    f = np.array([model[0][toxicity.slots_of(text, memo)].sum(dtype=float) + model[1] for *_, text in rows])
    return toxicity.calibrated(np.round(f, 5), np.array([float(bad) for _, bad, _ in rows]), np.ones(len(rows)))


def test_toxicity_cut_is_taken_from_all_labels(spark):
    docs, labels, rows = many_bags(spark)
    model = toxicity.learn(docs, labels, most_entries=0, parts=10**6, held=-1)
    np.testing.assert_allclose(model[2:], of_all_labels(model, rows), rtol=1e-4)


def test_pipeline_takes_the_cut_from_all_labels(spark, tmp_path, monkeypatch):
    """A corpus beyond what is fitted on the driver: the stage keeps what lies below the cut of all training labels."""
    docs, labels, rows = many_bags(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    models, learn = [], toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a: models.append(learn(*a, most_entries=0)) or models[-1])
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    np.testing.assert_allclose(models[0][2:], of_all_labels(models[0], [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]), rtol=1e-4)
    assert left == {r.doc_id for r in toxicity.score(docs, models[0]).filter("predicted = 0").collect()} and len(left) < len(rows)


@pytest.mark.parametrize("most_entries", [8_000_000, 0])
def test_pipeline_learns_from_every_document_and_label(spark, tmp_path, monkeypatch, most_entries):
    """As the pipeline runs its stage, no fold is left out: cut by all labels, frequencies of all documents, those without a doc_id too."""
    docs, labels, rows = many_bags(spark)
    last = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2 and i % 8 == 0}
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(last), F.concat("text", F.lit(" quxword"))).otherwise(F.col("text")))
    rows = [(i, bad, text + " quxword" * (i in last)) for i, bad, text in rows]
    docs = docs.unionByName(spark.createDataFrame([(None, "quxword")] * 5, docs.schema))
    labels.unionByName(spark.createDataFrame([(None, 1)], labels.schema)).write.parquet(str(tmp_path / "labels.parquet"))
    models, counts, learn, fit = [], [], toxicity.learn, toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "learn", lambda *a, **k: models.append(learn(*a, most_entries=most_entries, **k)) or models[-1])
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda *a: counts.append(a[2:5]) or fit(*a))
    left = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path))
    np.testing.assert_allclose(models[0][2:], of_all_labels(models[0], rows), rtol=1e-4)
    assert counts == [(3000, 24005, 0.125)] and models[0][0][toxicity.slots_of("quxword", toxicity.WordSlots())[0]] > 0
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in toxicity.score(docs, models[0]).filter("predicted = 0").collect()}


def test_large_digits_are_not_refined_in_one_task(spark, monkeypatch):
    """One passage in every document with differing surroundings, and a periodic text: as before, but by no group held in a task."""
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(i, noise(40) + "THE SAME BOILERPLATE, SIXTY BYTES LONG, IN ALL OF THE TEXTS." + noise(40)) for i in range(80)] + [(80, "a" * 3000), (81, "a" * 400 + noise(60)), (82, noise(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, suffix_dedup.repeated_passages(docs).collect()))
    sent, spread = [], suffix_dedup.spread_spans

    def noted(large):
        sent.extend(large.groupBy("digit").agg(F.sum(F.octet_length("context"))).collect())
        return spread(large)

    monkeypatch.setattr(suffix_dedup, "LARGE", 300)
    monkeypatch.setattr(suffix_dedup, "spread_spans", noted)
    got = sorted(map(tuple, suffix_dedup.repeated_passages(docs).collect()))
    assert got == want and sum(r[2] > 0 for r in got) >= 80
    assert len(sent) > 1 and all(r[1] > 300 for r in sent)
    assert spark.createDataFrame(rows[:1], "doc_id long, text string").transform(suffix_dedup.repeated_passages).first()["kept_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()


def test_runs_of_texts_looked_at_together_are_those_of_each(monkeypatch):
    """Empty texts, texts of just below and just the window's length, repeats and a long one, in groups of any size."""
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 49, 50, 51, 700, 0, 120, 50, 5000, 49)] + [b"x" * 300, b"x" * 300]
    want = []
    for i, t in enumerate(texts):
        d = suffix_dedup.digits(t).tolist()
        cut = [j for j in range(len(d)) if not j or d[j] != d[j - 1]]
        want += [(i, d[j], j, k - j) for j, k in zip(cut, cut[1:] + [len(d)])]
    for size in (1, 200, 1 << 16):
        monkeypatch.setattr(suffix_dedup, "_CHUNK", size)
        got = [row for number, of, *rest in suffix_dedup.runs_of(texts) for row in zip(number[of].tolist(), *(x.tolist() for x in rest))]
        assert got == want
    assert list(suffix_dedup.runs_of([b"", b"y" * 49])) == []


def test_equal_keys_are_neighbours_whatever_their_mixture():
    key, digit = np.array([0x9E3779B97F4A7C15 - 2**64, 0] * 3), np.array([0, 1] * 3, np.uint64)  # both pairs make one number
    order = suffix_dedup.together(key, digit)
    assert (np.diff(digit[order].astype(int)) != 0).sum() == 1


def test_later_passes_find_what_comparison_of_all_windows_finds():
    """Groups with one context and with many, stretches that change owner, and batches that cut groups."""
    rng = random.Random(7)
    some = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(4)]
    rows = [(digit, mark, b"".join(rng.sample(some, 3))[rng.randrange(40) :], rng.randrange(50), rng.randrange(1, 3)) for digit in range(40) for mark in range(rng.choice((1, 1, 5)))]
    least = {}
    for digit, _, c, own, _ in rows:
        for i in range(len(c) - 49):
            least[digit, c[i : i + 50]] = min(own, least.get((digit, c[i : i + 50]), own))
    want = {}
    for digit, mark, c, own, n in rows:
        m = [least[digit, c[i : i + 50]] for i in range(len(c) - 49)]
        cut = [i for i in range(len(m)) if not i or m[i] != m[i - 1]]
        if n > 1 or set(m) != {own}:
            want[digit, mark] = [(i, j, m[i]) for i, j in zip(cut, cut[1:] + [len(m)])]
    pdf = pd.DataFrame(rows, columns=["digit", "mark", "context", "least", "n"])
    for batch in (1, 7, 1000):
        out = pd.concat(suffix_dedup._later_passes(pdf.iloc[i : i + batch].reset_index(drop=True) for i in range(0, len(pdf), batch)))
        got = {(d, m): list(map(tuple, np.frombuffer(x, "<i8").reshape(-1, 3).tolist())) for d, m, x in zip(out["digit"], out["mark"], out["spans"])}
        assert got == want and len(out) == len(want)
