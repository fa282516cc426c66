"""The filter audit and fill-in-middle against brute force and DuckDB, and their defined results for odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import filter_audit, fim, queries


def odd_documents():
    rng = random.Random(5)
    rows = []
    for i in range(160):
        words = [rng.choice(["ab", "Cd", "e", "fgh", "IJ", "k"]) + str(rng.randrange(400)) * rng.randrange(2) for _ in range(rng.choice([3, 150, 199, 200, 230]))]
        rows.append((i, " ".join(words) + rng.choice(["", " #", "\n", " 日本"]), rng.choice(["en", "de", None]), "x"))
    rows += [(200 + i, rows[i // 3][1], "fr", "y") for i in range(60)]
    return rows + [(300, None, "en", "z"), (301, "", None, "z"), (302, " \t\x0b", "en", "z"), (None, rows[0][1], "en", "z"), (303, "A" * 70_000, "en", "z"), (7, rows[8][1], "en", "z"), (7, "own text", "en", "z")]


def audited(rows, labels):
    least, masks = {}, []
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, part, _ in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i]
        masks.append((part or "", fails, (i, "good") in labels, (i, "toxic") in labels))
    out, shares = {}, {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in itertools.permutations(range(5)):
            left, name = own, "".join("ABCDE"[k] for k in order)
            for step, k in enumerate(order, 1):
                hit = [m for m in left if m[1][k]]
                gone = [m for m in own if m[1][k] and m not in hit]
                redundant = sum(m[1][k] for m in own) - len(hit)
                assert len(gone) <= redundant
                left = [m for m in left if not m[1][k]]
                alone = sum(m[1][k] and sum(m[1]) == 1 for m in own)
                out[part, name, step] = [len(left), len(hit), redundant, alone, sum(m[2] for m in hit), sum(m[3] for m in hit)]
                shares[part, k] = shares.get((part, k), 0) + len(hit)
    return {k: (*v, shares[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


@pytest.mark.parametrize("counters", [1 << 27, 64])
def test_filter_audit(spark, counters, monkeypatch):
    """With 64 counters the sketch clears next to nothing, and the result is the same."""
    monkeypatch.setattr(filter_audit, "MOST_COUNTERS", counters)
    rows = odd_documents()
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 260, 2)] + [(4, 1, None), (None, 1, 1)]
    marks = {(i, "good") for i, q, _ in labels if q == 1 and i is not None} | {(i, "toxic") for i, _, t in labels if t == 1 and i is not None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string").repartition(3).withColumns({c: F.lit("clash") for c in ("h", "own", "least", "id", "part")})
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == audited(rows, marks)
    assert len(got) == 600 * len({r[2] for r in rows})


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r.kept for r in one if r.step == 5} == {0}


def test_sketch_clears_unique_texts_only(spark):
    rows = spark.range(3000).select((F.col("id") % 2900).alias("k")).select(F.xxhash64("k").alias("h"))
    size, held = filter_audit.sketch(rows.repartition(5), 3000)
    hashes = np.array([r.h for r in rows.collect()])
    counters = filter_audit.unpack(held.tobytes())
    crowded = np.all([counters[at] >= 2 for at in filter_audit.probes(hashes, size)], axis=0)
    again = np.isin(hashes, hashes[2900:])
    assert size == 32768 and crowded[again].all() and crowded[~again].mean() < 0.1
    assert (np.all([counters[at] >= 1 for at in filter_audit.probes(hashes, size)], axis=0)).all()


def rearranged(i, text):
    text = text or ""
    h = hashlib.sha256(b"7:%s" % (b"" if i is None else str(i).encode())).hexdigest()
    draws = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    if draws[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def fim_rows():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a b", "\n", "é日", "<S", "\r", "<P", "<", "S>", " "]) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    return rows + [(500, None), (501, ""), (502, "\n"), (503, "\n\n\n"), (504, "one"), (505, "has <M> in\nit"), (None, "no id\nat all\n"), (3, "again\n3\n"), (506, "line\n" * 200_000), (507, "x" * 3_000_000)]


def test_fill_in_middle(spark):
    rows = fim_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("id", "a", "b", "changes", "form")})
    out = fim.fill_in_middle(docs).withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, *r[1:6]) for r in out), key=str) == sorted(((i, *rearranged(i, t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_of_a_share_of_the_rows(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(docs, rate=30, suffix_first=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and abs(forms["psm"] - 600) < 90


def test_units_keep_every_character():
    texts = pa.array(["", "a", "a\n", "\n", "a\n\nb", "日\n本"])
    flat, row = fim.units(texts)
    assert [[f for f, r in zip(flat.to_pylist(), row) if r == i] for i in range(6)] == [[], ["a"], ["a\n"], ["\n"], ["a\n", "\n", "b"], ["日\n", "本"]]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_fill_in_middle"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
