import hashlib

import corpus_pipeline
from test_llm_operators import WHITE, linked, shingles, windows_removed

from tracewright.llm import toxicity


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_match_brute_force(spark, sf):
    """Each stage on what its predecessor kept: columns, the rows that stay, and their texts."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def run(name, docs):
        out = spark.createDataFrame(stages[name](spark, docs, sf).toArrow())
        assert out.columns == docs.columns
        return out

    whole = texts_of(docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = run("toxicity", docs)
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert texts_of(clean) == {i: t for i, t in whole.items() if i not in bad}

    held, best = texts_of(clean), {}
    for i, t in sorted(held.items()):
        key = "".join(c for c in t or "" if c not in WHITE)
        if key not in best or len(t or "") > len(held[best[key]] or ""):
            best[key] = i
    exact = run("exact_dedup", clean)
    assert texts_of(exact) == {i: held[i] for i in best.values()}

    held = texts_of(exact)
    groups = linked({i: shingles(t) for i, t in held.items()})
    near = run("minhash_dedup", exact)
    assert texts_of(near) == {i: t for i, t in held.items() if groups[i] == i}

    held = texts_of(near)
    want = {i: (n, gone, mark) for i, (n, gone, mark) in windows_removed(held.items()).items() if not gone or gone < n}
    cut = run("substring_dedup", near)
    got = texts_of(cut)
    assert set(got) == set(want)
    assert all(got[i] == held[i] if not want[i][1] else hashlib.sha256(got[i].encode()).hexdigest() == want[i][2] for i in got)
    assert all(r.n_chars == len(r.text or "") for r in cut.collect() if want[r.doc_id][1])

    rows = stages["best_fit_packing"](spark, cut, sf).collect()
    assert {r.doc_id for r in rows} == set(got)


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_rows_that_share_or_lack_an_id(spark, sf):
    rows = [(1, "one text that stands here", "en"), (1, "one  text that stands here", "fr"), (None, "no id at all", "en"), (2, "no id at all", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = sorted(map(tuple, corpus_pipeline.exact_dedup(spark, docs, sf).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[3]], key=str)


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "substring_dedup", "best_fit_packing"]
