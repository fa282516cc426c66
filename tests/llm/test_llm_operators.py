"""Each training-corpus operator against brute force, and its defined results for odd rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import embeddings, exact_dedup, fmindex, minhash, packing, sampling, sharding, substring, toxicity, url_filter, warc
from tracewright.llm.queries import SHARDS, SLOTS, tokenizer_path

WHITE = " \t\n\x0b\x0c\r"
RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage, base = prose(70, rng), [prose(rng.randrange(3, 260), rng) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 60):
        words = base[i - 40].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words)))
    rows += [(i, prose(20, rng) + "\n" + passage + "\t" + prose(30, rng)) for i in range(60, 72)]
    rows += [(80, base[1]), (81, base[1] + "  "), (82, " " + base[1]), (83, ""), (84, None), (85, " \n\t"), (86, "a"), (87, "be " * 400), (88, "be " * 300), (89, prose(4000, rng))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in corpus()], "doc_id long, text string, id string, rep int").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("capacity, bits", [(4096, 64), (4, 64), (4, 5)])
def test_exact_dedup(docs, nothing, capacity, bits):
    """With 5 bits of hash most chains hold several texts."""
    groups = defaultdict(list)
    for i, t in corpus():
        groups["".join(c for c in (t or "") if c not in WHITE)].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}
    got = rows_of(exact_dedup.exact_dedup(docs.withColumns({c: F.lit("clash") for c in ("h", "norm", "chain", "depth")}), capacity=capacity, bits=bits))
    assert {i: tuple(r[1:]) for i, r in got.items()} == want
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (3, "ab"), (3, "other"), (None, "lone"), (None, " lone"), (3, "ab")]
    got = sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_sha256").collect()), key=str)
    assert got == sorted([(None, None, 2, True), (None, None, 2, True), (None, None, 3, True), (3, None, 3, False), (3, None, 3, False), (3, 3, 1, True)], key=str)


def test_exact_dedup_shuffles_texts_of_repeated_hashes_only(spark):
    """300 texts alone, 5 in copies: the owners get the bytes of those five, and what they say is the result."""
    rows = [(i, f"text {i} " * 50) for i in range(300)] + [(1000 + i, f"copy {i % 5} " * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = exact_dedup.Index(df, "doc_id", "text", 4096, 64)
    assert index.repeated.count() == 5 and index.owned.agg(F.sum("group_size")).first()[0] == 40
    index.index = index.index.where("size(chain) > 1")  # without the owners' entries there is no result
    assert index.look_up().count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    """5,000 hashes spread, and 300 more under one prefix of 20 bits, deeper than a round of doublings."""
    from tracewright.session import Scratch

    deep = F.expr("shiftleft(cast(5 as bigint), 44) + shiftleft(id, 30)")
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h")).union(spark.range(300).select(deep)).distinct()
    scratch = Scratch(spark, "t")
    leaves = scratch.save(exact_dedup.grow_directory(hashes, scratch, 100), "leaves")
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]
    held = exact_dedup.routed(hashes, leaves, depths).groupBy("bucket", "depth").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in held) == 5300 and max(r.n for r in held) <= 100
    assert max(depths) > 20 and min(depths) >= 5 and len(held) < 4 * 53


def windows_removed(rows):
    first, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j : j + 50]), i)
    for i, w in words.items():
        cover = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                cover[j : j + 50] = [True] * 50
        kept = [x for x, c in zip(w, cover) if not c]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_dedup(docs, nothing, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    got = rows_of(substring.substring_dedup(docs))
    assert {i: tuple(r[1:]) for i, r in got.items()} == windows_removed(corpus())
    assert substring.substring_dedup(nothing).count() == 0


@pytest.mark.parametrize("window", [3, 50])
def test_matching_statistics_by_backward_search(window):
    """Against brute force: texts over few codes, streamed texts with codes that the index doesn't have."""
    rng = np.random.default_rng(window)
    draw = lambda n, top: [np.repeat(rng.integers(1, top, 40), rng.integers(1, 9, 40))[: rng.integers(1, 160)] for _ in range(n)]
    held = draw(25, 4)
    asked = draw(10, 5) + [np.concatenate([h[3:], [9], h[:90], held[0][5:70]]) for h in held[:12]]
    codes, weight = np.concatenate([np.append(t, 0) for t in held]), np.repeat(rng.permutation(25), [len(t) + 1 for t in held])
    least = {}
    for t, w in zip(held, np.unique(np.repeat(np.arange(25), [len(t) + 1 for t in held]), return_index=True)[1]):
        for j in range(len(t) - window + 1):
            k = tuple(t[j : j + window].tolist())
            least[k] = min(least.get(k, 99), int(weight[w]))
    want = {(i, j): least[k] for i, t in enumerate(asked) for j in range(len(t) - window + 1) if (k := tuple(t[j : j + window].tolist())) in least}
    flat = np.concatenate([np.append(np.where(t < 4, t, 0), 0) for t in asked])
    size = np.array([len(t) for t in asked])
    got = fmindex.FMIndex(codes, weight, window).matches(flat, np.cumsum(size + 1) - size - 1, size)
    assert {(int(i), int(j)): int(w) for text, at, low in got for i, j, w in zip(text, at, low)} == want and want


def test_without_repeats_keeps_columns_and_untouched_texts(docs):
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    removed = windows_removed(corpus())
    texts = dict(corpus())
    got = rows_of(out)
    assert set(got) == {i for i, (n, gone, _) in removed.items() if not gone or gone < n}
    assert all(got[i]["text"] == texts[i] for i in got if not removed[i][1])


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("crowded", [2048, 3])
def test_minhash_dedup(docs, nothing, crowded):
    sets = {i: shingles(t) for i, t in corpus()}
    want = linked(sets)
    got = rows_of(minhash.minhash_dedup(docs, crowded=crowded))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert minhash.minhash_dedup(nothing).count() == 0


def test_minhash_near_copies_without_a_hub(spark):
    """Copies of one text, each with edits of its own: only some pairs are links."""
    rng = random.Random(11)
    base, rows = prose(300, rng).split(), []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([4, 8, 12])):
            words[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = rows_of(minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == linked({i: shingles(t) for i, t in rows})


def test_minhash_of_repeated_ids(spark):
    """One id with two texts, each with a near copy: the id joins all, whatever the order of the rows."""
    rng = random.Random(21)
    a, b = prose(200, rng), prose(200, rng)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a), (4, b), (5, "alone among them all"), (7, a + " more"), (7, "alone among them all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "mark", "node", "n")})
    for parts in (1, 5):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.minhash_dedup(df.repartition(parts)).collect() if r.doc_id)
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False), (7, 1, False), (7, 1, False)]
    assert [(r.component_id, r.kept) for r in minhash.minhash_dedup(df).where("doc_id is null").collect()] == [(None, True)]


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole, want = Tokenizer.from_file(path), {}
    for i, t in corpus():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = packing.pack(docs, path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= math.ceil(sum(r.length for r in rows) / 2048) + 2
    assert packing.pack(nothing, path).count() == 0


def test_packing_sends_on_a_bounded_number_of_bins(spark):
    """Texts of about 1,100 tokens that never pair, and one short one: what goes on doesn't grow with the rows."""
    from pathlib import Path

    from tracewright.session import shared_dir

    rows = [(i, "be " * (1100 + i % 2)) for i in range(2400)] + [(9000, "be")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    out = packing.pack(df, tokenizer_path(), group=200).collect()
    assert len({r.sequence_id for r in out}) == 2400 and len(out) == 2401
    newest = max(Path(shared_dir(spark).removeprefix("file:")).glob("tracewright/packing-*"), key=lambda p: p.stat().st_mtime)
    held = [spark.read.parquet(str(p)).count() for p in sorted(newest.glob("*-open"))]
    assert held[0] <= 13 * (3 * 16 + 1) and held[1] <= 2 * (3 * 8 + 1)


@pytest.mark.parametrize("parts", [1, 200])
def test_packing_takes_as_many_sequences_from_many_partitions(spark, parts):
    """10,000 documents: within half a percent of the fewest that could do."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(parts)
    total, used = packing.pack(docs, tokenizer_path()).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used <= 1.005 * math.ceil(total / 2048)


def test_packing_of_null_ids(spark):
    rows = [(None, "one two"), (None, "three"), (4, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit("clash")), tokenizer_path(), group=1).collect()
    assert sorted((r.doc_id is None, r.piece) for r in out) == [(False, 0), (True, 0), (True, 0)] and len({r.sequence_id for r in out}) == 1


def test_rounds_pack_as_well_as_if_all_bins_went_on(spark):
    """Many bins that only other groups can complete."""
    rng = random.Random(8)
    rows = [(i, "be " * (rng.choice([1300, 1500, 2000, 5, 40, 540, 740]) - 1)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(20, F.length("text"))
    out = packing.pack(df, tokenizer_path(), group=45).collect()
    groups = defaultdict(list)
    for r in df.select(F.spark_partition_id().alias("p"), F.length("text").alias("n")).collect():
        groups[r.p].append(r.n // 3 + 1)
    for fan_in in (1, 8, 8):
        merged = defaultdict(list)
        for p, sizes in groups.items():
            merged[p // fan_in] += sizes
        groups = {p: packing.best_fit(np.array(sizes), 2048)[2].tolist() for p, sizes in merged.items()}
    assert len(groups) == 1 and len({r.sequence_id for r in out}) <= len(groups[0]) + 2


def test_tokens_of_odd_words_match_whole_texts():
    from tokenizers import Tokenizer

    rng, path = random.Random(1), tokenizer_path()
    texts = ["".join(chr(rng.choice([rng.randrange(1, 0x260), rng.randrange(0x20, 0x7F), rng.randrange(1, 0xD000)])) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += ["don't stop's 12 3 <|endoftext|>x", "\xa0 a \x85", "İstanbul ǅ ŉ \u0301a"]
    ids, at = packing.WordTokens(path).encode([t.encode() for t in texts])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_tokens_are_the_same_after_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 60)
    words, rng = packing.WordTokens(tokenizer_path()), random.Random(3)
    texts = [prose(40, rng).encode() for _ in range(50)]
    whole = packing.WordTokens(tokenizer_path()).encode(texts)[0]
    assert np.concatenate([words.encode([t])[0] for t in texts]).tolist() == whole.tolist() and len(words.codes) < 150


def test_best_fit_is_valid():
    sizes = np.array([RNG.randrange(1, 101) for _ in range(500)])
    bins, offsets, fills = packing.best_fit(sizes, 100)
    assert fills.max() <= 100 and fills.sum() == sizes.sum()
    assert len(fills) <= math.ceil(sizes.sum() / 100 * 1.05) + 1


def test_warc_round_trip(spark):
    pages = [(3, "http://a.b/c?d=1", "<p>é</p>"), (1, "http://x.y/", "same"), (2, None, "same"), (9, "u\r\nv", None), (8, "http://e.f", ""), (None, "http://n", "same"), (5, "http://w", "WARC/1.0\r\n\r\nbody\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("size", F.lit("clash"))
    want = {}
    first = {}
    for p, _, h in sorted((x for x in pages if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", p)
    for p, _, h in pages:
        data = (h or "").encode()
        again = p is not None and first[h or ""] < p
        want[p] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
    got = rows_of(warc.round_trip(df.repartition(2)), "page_id")
    assert {p: tuple(r[1:]) for p, r in got.items()} == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_archives_are_bounded_by_bytes_and_keep_repeated_pages(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "x" * n) for i, n in enumerate([10, 70_000, 70_001, 2_000_000, 3_000_000, 20])] + [(5, "http://h/5", "x" * 20)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.round_trip(df.repartition(2)).collect())
    assert got == sorted((i, len(h), "response") for i, _, h in rows)
    warc.write_warc(df.coalesce(1), f"{tmp_path}/w", archive_bytes=2 << 20)
    sizes = [[r.payload_bytes for r in warc.read_warc(spark, str(f)).where("type = 'response'").collect()] for f in tmp_path.glob("w/*/*.gz")]
    assert sum(map(len, sizes)) == len(rows) and all(sum(x) <= 2 << 20 or len(x) == 1 for x in sizes)


def test_warc_capture_holds_the_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.b/c", "one"), (2, "http://a.b/d", "one")], "page_id long, url string, html string")
    warc.write_warc(df, f"{tmp_path}/w")
    rows = {r.uri: r for r in warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect()}
    assert bytes(rows["http://a.b/c"].response.payload) == b"one"
    assert rows["http://a.b/d"].response.type == "revisit" and rows["http://a.b/d"].stored.payload_bytes == 3
    assert rows["http://a.b/c"].metadata.fields["page-id"] == "1"


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "RESIDENTS", 8)
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(24)
        for _ in range(6):
            rows.append((len(rows), (centre + rng.standard_normal(24) * rng.choice([0.05, 0.3])).astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[0][1]) for k in range(50)]
    n = len(rows)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [1.0, None]), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    want = {i: (int(near[i].sum()), int(label[i])) for i in range(n)} | {n + k: (0, n + k) for k in range(5)} | {n + 5: (1, n + 5), n + 6: (1, n + 5)}
    got = rows_of(embeddings.embedding_dedup(df), "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert embeddings.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_of_repeated_ids(spark):
    """Ids 1 and 9 each have two vectors; both vectors' links count, and the id joins their components."""
    rows = [(1, [1.0, 0, 0, 0]), (1, [0, 1.0, 0, 0]), (2, [1.0, 0.1, 0, 0]), (3, [0.1, 1.0, 0, 0]), (4, [0, 0, 1.0, 0]), (9, [0, 0, 1.0, 0]), (9, [0, 0, 0, 1.0]), (8, [0, 0, 0, 1.0]), (None, [1.0, 0, 0, 0])]
    rows = [(i, list(map(float, v))) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "mark", "node", "size")})
    for parts in (1, 4):
        got = sorted(tuple(r) for r in embeddings.embedding_dedup(df.repartition(parts)).collect() if r.vec_id is not None)
        assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (8, 1, 4, False), (9, 1, 4, False), (9, 1, 4, False)]
    assert [tuple(r) for r in embeddings.embedding_dedup(df).where("vec_id is null").collect()] == [(None, 0, None, True)]


def test_toxicity_learns_without_held_out_labels(spark, nothing):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        text = prose(30, rng) + (" " + rng.choice(["vile", "nasty", "rotten"]) if toxic else "")
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(toxic)))
    docs += [(9001, None), (9002, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = rows_of(toxicity.toxicity(d, lab))
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i].predicted == t for i, t in labels if got[i].held_out]
    assert sum(right) / len(right) > 0.97
    flipped = lab.withColumn("toxic", F.when(toxicity.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = rows_of(toxicity.toxicity(d, flipped))
    assert all(abs(again[i].score - got[i].score) < 1e-9 for i in got)
    assert toxicity.toxicity(nothing, lab).count() == 0
    assert {r.predicted for r in toxicity.toxicity(d, lab.limit(0)).collect()} == {0}


def test_sharding_table_is_balanced_and_stable():
    table = sharding.fill(SHARDS, SLOTS)
    held = Counter(table)
    assert max(held.values()) - min(held.values()) <= 1
    fewer = sharding.fill(SHARDS[:-1], SLOTS)
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(SHARDS) - 1)
    assert moved < 0.15 * SLOTS
    with pytest.raises(ValueError):
        sharding.fill(SHARDS, 3200)


def test_sharding_places_every_row(docs):
    out = sharding.place(docs.select("doc_id", F.lit("x").alias("slot")), "doc_id", SHARDS, SLOTS)
    assert out.count() == docs.count() and out.where("shard is null").count() == 0


def test_sharding_of_null_and_repeated_keys(spark, nothing):
    rows = [(None,), (None,), (4,), (4,), (5,)]
    got = [(r.doc_id, r.slot, r.shard) for r in sharding.place(spark.createDataFrame(rows, "doc_id long"), "doc_id", SHARDS, SLOTS).collect()]
    assert len(got) == 5 and len({x for x in got if x[0] is None}) == 1 and len({x for x in got if x[0] == 4}) == 1
    assert sharding.place(nothing.select("doc_id"), "doc_id", SHARDS, SLOTS).count() == 0


def test_url_filter_uses_entries_in_force(spark):
    captures = spark.createDataFrame(
        [(1, "http://A.b.com:80/x", 10), (2, "https://b.com/", 20), (3, "http://b.com/", 35), (4, None, 10), (5, "http://c.org", None), (6, "http://ab.com", 15), (6, "http://ab.com", 15)], "id long, url string, s long"
    ).withColumn("t", F.timestamp_seconds("s"))
    entries = spark.createDataFrame([(1, "b.com", 5, "block"), (2, "b.com", 30, "allow"), (3, "a.b.com", 10, "allow"), (4, "c.org", 0, "block"), (5, None, 0, "block")], "entry_id long, host string, s long, action string")
    entries = entries.withColumn("at", F.timestamp_seconds("s"))
    got = [(r.id, r.entry_id, r.allowed) for r in url_filter.filter_urls(captures, entries, "id", "url", "t").collect()]
    assert sorted(got, key=str) == sorted([(1, 3, True), (2, 1, False), (3, 2, True), (4, None, True), (5, None, True), (6, None, True), (6, None, True)], key=str)


def test_url_filter_of_entries_at_one_time_and_a_hot_host(spark):
    """Against a loop: 400 captures of one host among others, entries of one host at one time, null and repeated captures."""
    rng = random.Random(12)
    hosts = ["a.b.c", "b.c", "c", "x.y", "y"]
    caps = [(i, f"http://{'a.b.c' if i < 400 else rng.choice(hosts)}/{i}", rng.randrange(60)) for i in range(500)] + [(None, "http://x.y", 30), (None, "http://x.y", 30), (7, None, None)]
    listed = [(k, rng.choice([*hosts, None]), rng.choice([None, *range(60)]), rng.choice(["block", "allow"])) for k in range(90)]
    want = []
    for i, u, t in caps:
        host = u.split("/")[2] if u else ""
        names = [host.split(".", k)[k] for k in range(host.count(".") + 1)] if host and t is not None else []
        live = [max(((at, k, a) for k, h, at, a in listed if h == n and at is not None and at <= t), default=None) for n in names]
        hit = next(((n, e) for n, e in zip(names, live) if e), None)
        want.append((i, t, hit and hit[0], hit and hit[1][1], not hit or hit[1][2] != "block"))
    c = spark.createDataFrame(caps, "id long, url string, s long").withColumn("t", F.timestamp_seconds("s")).repartition(4)
    e = spark.createDataFrame(listed, "entry_id long, host string, s long, action string").withColumn("at", F.timestamp_seconds("s")).withColumn("listed", F.lit("clash"))
    got = url_filter.filter_urls(c, e, "id", "url", "t").select("id", F.unix_seconds("fetched_at"), "listed_host", "entry_id", "allowed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_url_filter_of_empty_tables_and_clashing_columns(spark):
    captures = spark.createDataFrame([(1, "http://a.com", 10, "x")], "id long, url string, s long, listed string").withColumn("t", F.timestamp_seconds("s"))
    entries = spark.createDataFrame([(1, "a.com", 5, "block", 3)], "entry_id long, host string, s long, action string, period int").withColumn("at", F.timestamp_seconds("s"))
    run = lambda c, e: [(r.id, r.entry_id, r.allowed) for r in url_filter.filter_urls(c, e, "id", "url", "t").collect()]
    assert run(captures, entries) == [(1, 1, False)] and run(captures, entries.limit(0)) == [(1, None, True)]
    assert run(captures.limit(0), entries) == [] and run(captures.limit(0), entries.limit(0)) == []


def test_sampling_is_exact_on_short_texts():
    voc = sampling.vocabulary(tokenizer_path("piece_bpe_32k.model"), 0.3)

    def segmentations(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            h = np.zeros(1, np.uint64)
            for c in s[:n]:
                h = voc.step(h, np.array([ord(c)]))
            if (i := int(voc.find(h)[0])) >= 0:
                for rest, w in segmentations(s[n:]):
                    yield (i, *rest), w + voc.weight[i]

    every = list(segmentations(" the on"))
    total = np.logaddexp.reduce([w for _, w in every])
    p = {s: math.exp(w - total) for s, w in every}
    n = 20_000
    found = sampling.sample_texts(voc, ["the on"] * n, np.arange(n), 2)
    pairs = Counter(tuple(tuple(r[0].tolist()) for r in x) for x in found)
    assert all(a != b for a, b in pairs)
    assert max(abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b) < 0.012
    assert abs(np.mean([sum(math.exp(r[1] - r[2]) for r in x) for x in found]) - 1) < 0.03  # inverse inclusion weights are unbiased


def test_sampling_of_five_matches_gumbel_top_k():
    voc = sampling.vocabulary(tokenizer_path("piece_bpe_32k.model"), 0.3)
    n, rng = 8_000, np.random.default_rng(4)
    every = sampling.sample_texts(voc, ["an on"], np.zeros(1, int), 400)[0]
    p, shown = np.array([r[1] for r in every]), {tuple(r[0].tolist()): i for i, r in enumerate(every)}
    assert abs(np.exp(p).sum() - 1) < 1e-9  # every segmentation, each once
    found = sampling.sample_texts(voc, ["an on"] * n, np.arange(n), 5)
    held = np.array([[shown[tuple(r[0].tolist())] for r in x] for x in found])
    assert all(len(set(row)) == 5 for row in held.tolist())
    drawn = np.argsort(-(p + rng.gumbel(size=(60_000, len(p)))), axis=1)[:, :5]
    for place in range(5):
        assert np.abs(np.bincount(held[:, place], minlength=len(p)) / n - np.bincount(drawn[:, place], minlength=len(p)) / len(drawn)).max() < 0.02
    weights = [sum(math.exp(r[1] - r[2]) for r in x) for x in found]
    assert abs(np.mean(weights) - 1) < 0.02


def test_sampling_walks_long_texts_in_parts():
    voc, rng = sampling.vocabulary(tokenizer_path("piece_bpe_32k.model"), 1.0), random.Random(9)
    texts = [prose(4000, rng).replace("be", "  日本 ").strip() + "  end", "", " ".join("ab" * rng.randrange(1, 9) for _ in range(2000))]
    whole = sampling.sample_texts(voc, texts, np.array([5, 6, 7]), 4)
    parts = sampling.sample_texts(voc, texts, np.array([5, 6, 7]), 4, size=1500)
    for a, b in zip(whole, parts):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
        assert np.allclose([x[1:] for x in a], [x[1:] for x in b])
    wide = "x" * 5000 + " y"
    assert all(voc.decode(ids) == wide.encode() for ids, _, _ in sampling.sample_texts(voc, [wide], np.array([1]), 3, size=999)[0])


def test_sampling_of_a_very_long_text_is_bounded(spark):
    """20 MB in one row, in a worker that may hold far less than a lattice of it (about 150 bytes a character)."""
    path = tokenizer_path("piece_bpe_32k.model")
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words that stand here and there, ', 525000)").alias("text"))
    out = sampling.sample_segmentations(rows, path, with_ids=False).collect()
    assert len(out) == 2 and all(r.round_trip for r in out)


def test_sampling_round_trips_and_decodes(docs, spark, nothing):
    path = tokenizer_path("piece_bpe_32k.model")
    extra = spark.createDataFrame([(500, "日本 😀 x\ty  z "), (501, "x" * 3000)], "doc_id long, text string")
    rows = sampling.sample_segmentations(docs.select("doc_id", "text").union(extra), path)
    out = sampling.decode(rows, path).collect()
    texts = dict(corpus()) | {500: "日本 😀 x\ty  z ", 501: "x" * 3000}
    assert all(r.round_trip and r.text == (texts[r.doc_id] or "") for r in out)
    again = {(r.doc_id, r.sample): r.ids_crc32 for r in sampling.sample_segmentations(docs.select("doc_id", "text").repartition(7), path).collect()}
    assert all(again[k] == v for k, v in (((r.doc_id, r.sample), r.ids_crc32) for r in out) if k in again)
    assert sampling.sample_segmentations(nothing, path).count() == 0
