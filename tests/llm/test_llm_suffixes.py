"""The difference-cover sort against brute force, and its defined results for odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import suffixes


def removed(rows):
    """(n_bytes, spans, sha256 of the rest) of every row, by a dictionary of all strings of 50 bytes."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first, out = {}, []
    for i, b in data:
        if i is not None:
            for j in range(len(b) - 49):
                k = b[j : j + 50]
                first[k] = min(first.get(k, i), i)
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        if i is not None:
            for j in range(len(b) - 49):
                if first[b[j : j + 50]] < i:
                    gone[j + 1 : j + 51] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        spans = [(int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256) for r in suffixes.suffix_dedup(df, **more).collect()), key=str)


def corpus():
    rng = random.Random(4)
    text = lambda n, letters="abcdefgh  日é": "".join(rng.choice(letters) for _ in range(n))
    passage, base = text(70), [text(rng.randrange(0, 900)) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(40, 70):  # near copies
        t = list(base[i - 40 if i < 60 else 3])
        for _ in range(1 + len(t) // 120):
            if t:
                t[rng.randrange(len(t))] = "X"
        rows.append((i, "".join(t)))
    rows += [(i, text(30) + passage[: rng.choice([30, 48, 52, 70])] + text(20)) for i in range(70, 95)]
    rows += [(100, base[1]), (101, base[1] + "\0"), (102, text(3000, "ab")), (103, text(3000, "ab")), (104, "a" * 700), (105, "a" * 300 + "b"), (106, "\0" * 120), (107, "\0" * 51), (108, "ab" * 90), (109, "ba" * 60)]
    rows += [(110, None), (111, ""), (112, "x" * 49), (113, "x" * 49), (114, "x" * 50), (115, "x" * 50), (None, base[5]), (None, base[5]), (6, base[7]), (6, base[8] + base[9]), (6, base[7])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part, chunk, block", [(1 << 20, 4 << 20, 1 << 18), (2000, 3000, 256)])
def test_against_all_strings(spark, monkeypatch, part, chunk, block):
    """Also in parts, chunks and blocks that cut texts' windows in many places."""
    for name, value in (("PART", part), ("CHUNK", chunk), ("BLOCK", block)):
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("id", "mark", "chunk", "copy", "n_bytes")})
    assert found(df) == removed(rows)


def test_bytes_that_are_left(spark):
    rows = [(1, "é" * 30 + "one"), (2, "xé" + "é" * 30 + "two"), (3, "alone")]
    got = {r.doc_id: r for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=True).collect()}
    assert got[1].kept is None and got[3].kept is None and bytes(got[2].kept) == b"xtwo" and [tuple(s) for s in got[2].spans] == [(1, 62)]


def test_nothing_and_nothing_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(empty) == []
    rows = [(1, "short"), (2, None), (3, "z" * 60)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == removed(rows)


def test_a_long_text(spark):
    """6 MB that holds a passage of another document twice, and repeats itself."""
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    body = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2_000_000))
    rows = [(1, line), (2, body + line[:1000] + "|" + body + "|" + line[1500:1600] + "|" + body)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [s for s in got[1][3]] == [(2_000_000, 1000), (4_001_002, 100)] and got[0][3] == []


def test_merged_order_compares_classes_by_difference_cover():
    """Windows over few bytes: the least id of equal ones, whatever their places modulo 3."""
    rng = np.random.default_rng(3)
    text = rng.integers(0, 2, 900).astype(np.uint8)
    strings = [text[i : i + 50].tobytes() for i in range(800)]
    middle = {s: k for k, s in enumerate(sorted({text[i : i + 48].tobytes() for i in range(852)}))}
    name = np.array([middle[text[i : i + 48].tobytes()] for i in range(852)])
    at = rng.permutation(np.concatenate([np.arange(800), rng.integers(0, 800, 300)]))
    kind = rng.integers(0, 3, len(at))
    who = rng.permutation(len(at))
    columns = [kind.astype(np.uint8), *(text[at + k] for k in (0, 1, 48, 49)), name[at + (kind == 0)], name[at + np.array([2, 1, 2])[kind]], who]
    least = {}
    for a, w in zip(at, who):
        least[strings[a]] = min(least.get(strings[a], w), w)
    assert suffixes.merged(columns).tolist() == [least[strings[a]] for a in at]


@pytest.mark.parametrize("hot", [0, 300, 1 << 18])
def test_anchors_of_many_pieces_and_of_few(spark, monkeypatch, hot):
    """All, some or none of the anchors are sorted across parts; long runs of one letter are cut into pieces."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(13)
    rows = corpus() + [(200, "a" * 9000), (201, "b" + "a" * 5000 + "b"), (199, "ab" * 4500), (202, "c" * 60 + "ab" * 2100)]
    rows += [(300 + i, "the same line that very many of the texts hold, with an end of its own " + rng.choice("xyz") * rng.randrange(30)) for i in range(60)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == removed(rows)


def test_ordinary_anchors_are_not_sent_across_ranges(spark, monkeypatch):
    """Each part sent rows to each range in four exchanges, which took disk with the square of the input; the anchors' exchange is the only one left."""
    calls, exchange = [], suffixes.exchange
    monkeypatch.setattr(suffixes, "exchange", lambda *a, **k: calls.append(1) or exchange(*a, **k))
    rows = corpus()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == removed(rows)
    assert len(calls) == 1


def test_repeats_of_pieces():
    """Runs of windows that a smaller id has in any piece, against a dictionary."""
    rng = np.random.default_rng(7)
    text = rng.integers(0, 2, 400).astype(np.uint8)
    at, n, id = rng.integers(0, 300, 120), rng.integers(50, 100, 120), rng.integers(-5, 30, 120)
    pieces = [text[a : a + k].tobytes() for a, k in zip(at, n)]
    first = {}
    for p, i in zip(pieces, id):
        for j in range(len(p) - 49):
            first[p[j : j + 50]] = min(first.get(p[j : j + 50], i), i)
    want = {(k, j) for k, (p, i) in enumerate(zip(pieces, id)) for j in range(len(p) - 49) if first[p[j : j + 50]] < i}
    runs = [x.tolist() for x in suffixes.repeats(np.frombuffer(b"".join(pieces), np.uint8), n, id)]
    got = [(p, j) for p, a, k in zip(*runs) for j in range(a, a + k)]
    assert len(got) == len(set(got)) and set(got) == want
    none = suffixes.repeats(np.frombuffer(pieces[0], np.uint8), n[:1], id[:1])
    assert [len(x) for x in none] == [0, 0, 0]


def test_long_runs_are_cut(monkeypatch):
    raw, ends = np.frombuffer(b"a" * 1000 + b"xyz" * 50, np.uint8), np.array([0, 1000, 1150])
    begin, n, key = suffixes.anchors(raw, ends, 4)
    monkeypatch.setattr(suffixes, "RUN", 100)
    cut, m, less = suffixes.anchors(raw, ends, 4)
    spread = lambda b, k, v: {x + j: y for x, c, y in zip(b.tolist(), k.tolist(), v.tolist()) for j in range(c)}
    assert n.max() == 951 and m.max() == 100 and spread(begin, n, key) == spread(cut, m, less) and n.sum() == m.sum()
