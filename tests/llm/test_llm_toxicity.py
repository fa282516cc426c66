"""The estimator, its gradient, the choice of words and the scores of the toxicity model, each against plain Python."""

import math
import random
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import toxicity as tox

S = replace(tox.Settings(), epochs=30, trial_epochs=10)


def test_gradient_of_both_terms_by_finite_differences():
    rng = np.random.default_rng(1)
    for scale, prior in ((1.0, 0.2), (0.1, 0.3), (3.0, 0.05)):
        zp, zu = rng.standard_normal(7) * scale, rng.standard_normal(11) * scale - 1
        assert tox.risk(zp, zu, prior)[1] > 0
        of = lambda z: sum(tox.risk(z[:7], z[7:], prior))
        z, eps = np.concatenate([zp, zu]), 1e-6
        want = [(of(z + eps * e) - of(z - eps * e)) / (2 * eps) for e in np.eye(18)]
        assert np.allclose(np.concatenate(tox.slopes(zp, zu, prior, 0.1)), want, atol=1e-7)


def test_a_negative_second_term_is_stepped_back_from():
    zp, zu = np.full(5, 4.0), np.full(6, -6.0)
    assert tox.risk(zp, zu, 0.3)[1] < 0
    of = lambda z: tox.risk(z[:5], z[5:], 0.3)[1]
    z, eps = np.concatenate([zp, zu]), 1e-6
    want = [-0.1 * (of(z + eps * e) - of(z - eps * e)) / (2 * eps) for e in np.eye(11)]
    assert np.allclose(np.concatenate(tox.slopes(zp, zu, 0.3, 0.1)), want, atol=1e-8)


def word_of(word: str) -> int:
    return int(tox.word_ids(pa.array([word]))[2][0])


def rows_with(rng, n, toxic, rare):
    """Texts of which a share holds a common marking word, or one of many rare ones."""
    out = []
    for i in range(n):
        text = [rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(20)]
        marked = rng.random() < toxic
        if marked:
            text.insert(3, rng.choice(["vile", *(f"slur{k}" for k in range(rare))]))
        out.append((i, " ".join(text), int(marked)))
    return out


def sampled(rows):
    words = [np.unique(tox.word_ids(pa.array([t]))[2]) for _, t, _ in rows]
    pos = [i for i, r in enumerate(rows) if r[2]]
    flags = np.array([True] * len(pos) + [False] * len(rows))
    return flags, np.array([i % 4 + 1 for i in [*pos, *range(len(rows))]]), [words[i] for i in [*pos, *range(len(rows))]]


def test_telling_words_by_counting():
    flags, _, words = sampled(rows_with(random.Random(1), 500, 0.2, 5))
    n, m = flags.sum(), (~flags).sum()
    want = set()
    for w in set(np.concatenate(words).tolist()):
        a, b = sum(w in set(x.tolist()) for x, f in zip(words, flags) if f), sum(w in set(x.tolist()) for x, f in zip(words, flags) if not f)
        p, u = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
        if a + b >= 4 and (p - u) / math.sqrt(p * (1 - p) / n + u * (1 - u) / m) >= 2:
            want.add(w)
    size = np.array([len(x) for x in words])
    assert set(tox.telling(np.concatenate(words), np.repeat(flags, size), flags, 2.0, S).tolist()) == want and word_of("vile") in want


def test_training_follows_the_plain_loop():
    """The same steps, taken one row and one word at a time."""
    s, prior = replace(S, epochs=6, least_z=(2.0,)), 0.25
    flags, _, words = sampled(rows_with(random.Random(2), 60, 0.25, 2))
    known = tox.telling(np.concatenate(words), np.repeat(flags, [len(x) for x in words]), flags, 2.0, s).tolist()
    theta, bias = dict.fromkeys(known, 0.0), math.log(prior / (1 - prior))
    m, v = dict.fromkeys([*known, "bias"], 0.0), dict.fromkeys([*known, "bias"], 0.0)
    n_pos, n_unl = int(flags.sum()), int((~flags).sum())
    for step in range(1, s.epochs + 1):
        z = [bias + sum(theta.get(w, 0.0) for w in x.tolist()) for x in words]
        second = sum(math.log1p(math.exp(a)) for a, f in zip(z, flags) if not f) / n_unl - prior * sum(math.log1p(math.exp(a)) for a, f in zip(z, flags) if f) / n_pos
        grad = dict.fromkeys([*known, "bias"], 0.0)
        for a, f, x in zip(z, flags, words):
            sig = 1 / (1 + math.exp(-a))
            slope = -prior * sig / n_pos if f else sig / n_unl
            slope = -s.step_back * slope if second < 0 else slope + (prior * (sig - 1) / n_pos if f else 0)
            for w in [*(w for w in x.tolist() if w in theta), "bias"]:
                grad[w] += slope
        for w in [*known, "bias"]:
            m[w], v[w] = 0.9 * m[w] + 0.1 * grad[w], 0.999 * v[w] + 0.001 * grad[w] ** 2
            move = s.rate * (m[w] / (1 - 0.9**step)) / (math.sqrt(v[w] / (1 - 0.999**step)) + 1e-6)
            if w == "bias":
                bias -= move
            else:
                theta[w] -= move
                theta[w] = math.copysign(max(abs(theta[w]) - s.shrink, 0), theta[w])
    weights, got = tox.train(flags, words, prior, s)
    assert abs(got - bias) < 1e-9 and all(abs(weights[w] - x) < 1e-9 for w, x in theta.items()) and set(np.flatnonzero(weights)) <= set(known)


def test_the_cut_is_chosen_inside_the_training_rows():
    """Rare marking words need a low cut; without any the higher one costs no risk."""
    flags, folds, words = sampled(rows_with(random.Random(3), 1500, 0.2, 30))
    assert tox.chosen(flags, folds, words, 0.2, replace(S, least_z=(2.0, 9.0))) == 2.0
    assert tox.chosen(flags, np.ones(len(flags)), words, 0.2, replace(S, least_z=(3.0, 2.0))) == 3.0  # one fold: nothing to choose by


def test_scores_are_sums_over_the_words_of_whole_texts(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t, _ in rows_with(rng, 400, 0.25, 3)]
    labels = [(i, int("vile" in t or "slur" in t)) for i, t in rows]
    odd = [(5, "vile again"), (None, "Vile, no id"), (None, None), (900, ""), (901, "x " * 40_000 + "VILE vile"), (902, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "fold", "positive", "score", "words")}).repartition(3)
    lab = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    (flags, folds, words), prior = tox.training_rows(docs, lab, S, "doc_id", "text", "toxic")
    least = tox.chosen(flags, folds, words, prior, S)
    weights, bias = tox.train(flags, words, prior, replace(S, least_z=(least,)))
    assert not (folds == 0).any() and max(map(len, words)) < 40
    want = sorted((str(i), round(1 / (1 + math.exp(-(bias + sum(weights[w] for w in {word_of(w) for w in (t or "").split()})))), 9)) for i, t in rows + odd)
    got = tox.toxicity(docs, lab, settings=S).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)


def test_pipeline_stage_drops_what_scores_half(spark, sf):
    """The stage against a score by plain sums, with the model of the operator."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    (flags, folds, words), prior = tox.training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), tox.Settings(), "doc_id", "text", "toxic")
    s = tox.Settings()
    weights, bias = tox.train(flags, words, prior, replace(s, least_z=(tox.chosen(flags, folds, words, prior, s),)))
    white = str.maketrans("\t\n\x0b\x0c\r", "     ")
    score = lambda t: bias + sum(weights[w] for w in {word_of(w) for w in (t or "").translate(white).split(" ") if w})
    want = sorted(r.doc_id for r in docs.select("doc_id", "text").collect() if score(r.text) < 0)
    assert sorted(r.doc_id for r in corpus_pipeline.toxicity(spark, docs, sf).select("doc_id").collect()) == want


def test_recall_by_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = tox.toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).where("held_out")
    rows = scored.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").groupBy((F.col("lang") == "en").alias("en"), "toxic").agg(F.avg("predicted").alias("share"), F.count("*").alias("n")).collect()
    share = {(r.en, r.toxic): (r.share, r.n) for r in rows}
    whole = lambda t: sum(a * n for (_, x), (a, n) in share.items() if x == t) / sum(n for (_, x), (_, n) in share.items() if x == t)
    assert whole(1) >= 0.85 and share[False, 1][0] >= 0.8 and whole(0) < 0.02
