"""Odd inputs on which queries once differed from their SQL."""

import duckdb
from pyspark.sql import functions as F

from tracewright.plans import registry


def both(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL on small tables, sorted; DuckDB adds in one thread, in the order of the rows."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for table, df in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        df.coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    found = registry.queries()[name](spark, str(tmp_path))
    told = con.execute(registry.oracles()[name])
    names = [d[0] for d in told.description]
    return sorted(map(repr, (tuple(r[n] for n in names) for r in found.collect()))), sorted(map(repr, told.fetchall()))


def test_html_text_like_its_sql_on_odd_markup(spark, tmp_path):
    pages = [
        "a &amp b &ampx &copy c &amp;lt; d &eacute; &#233; &lt;p&gt; &AMP;", None, "", "<scripts>x</script>y<STYLE a>b</style >c</style>d", "<style><script></style>e</script>f", "a</p/>b</p\n>c</P\x0b>d<br\x0b>e",
        "<div <br> >x<>y< z", "<script>never closed <script> a > b", "x</script>y<script </script> z", "<ſcript>1</SCRIPT>2<İ>", "a\r\r\r\rb\n\n\n\nc", "<noscript><script>a</noscript>b</script>c</noscript>d", "</h7>a</H3 >b</h1x>",
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    found, told = both(spark, tmp_path, "html_text", pages=rows)
    assert found == told


def test_lag_rate_like_its_sql_on_short_times(spark, tmp_path):
    # seconds since 1970 as doubles are off by up to 1e-7 s; 0.0000125 is half of the sixth digit
    micros = [0, 7, 13, 1_000_013, 1_000_013, 1_020_014, 1_020_017, 9_020_017, 9_020_017 + 80_000]
    rows = spark.createDataFrame([(i, 1_704_067_200_172_425 + m, 1, round(0.01 * i * i, 2)) for i, m in enumerate(micros)] + [(100, 1_704_067_200_000_000, 1, 0.0), (101, 1_704_067_280_000_000, 2, 0.001), (102, 1_704_067_360_000_000, 2, 0.002)], "event_id long, us long, user_id long, value double")
    rows = rows.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "value")
    found, told = both(spark, tmp_path, "lag_rate", events=rows)
    assert found == told


def test_rerank_merge_like_its_sql_on_sums_that_differ_in_the_last_bit(spark, tmp_path):
    # (0.1 + 0.2) + 0.3 is more than 0.6, 0.1 + (0.2 + 0.3) is not; files are tasks of their own
    orders = spark.createDataFrame([(1, 2, 0.1), (2, 1, 0.6)], "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1)
    orders.write.parquet(f"{tmp_path}/orders.parquet/a")
    more = spark.createDataFrame([(3, 2, 0.2), (4, 2, 0.3), (5, 3, 0.6)], orders.schema).coalesce(1)
    more.write.parquet(f"{tmp_path}/orders.parquet/b")
    spark.createDataFrame([(1,), (2,), (3,), (4,)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for part in "ab":
        for file in (tmp_path / "orders.parquet" / part).glob("*.parquet"):
            file.rename(tmp_path / "orders.parquet" / f"{part}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    found = registry.queries()["rerank_merge"](spark, str(tmp_path)).collect()
    assert sorted((r.c_custkey, r.place) for r in found) == sorted(con.execute(registry.oracles()["rerank_merge"]).fetchall()) == [(1, 2), (2, 1), (3, 3), (4, 1000000)]


def test_shared_tokens_like_the_plain_loop():
    import random

    from tracewright.functions.evidence import shared

    def plain(own, wanted):
        left, n = list(wanted), 0
        for t in own:
            alike = lambda x: x == t or (min(len(x), len(t)) >= 6 and abs(len(x) - len(t)) <= 2 and (x.startswith(t) or t.startswith(x)))  # noqa: E731,B023
            match = next((x for x in left if alike(x)), None)
            if match is not None:
                left.remove(match)
                n += 1
        return n

    rng = random.Random(5)
    words = lambda: sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 10))) for _ in range(60)})
    for _ in range(200):
        a, b = words(), words()
        assert shared(a, b) == plain(a, b)


def test_addresses_that_are_canonical_are_told_by_one_pattern(spark):
    """The same forms as by taking each apart, which a blank in front forces, and in less than half of its time."""
    import random
    import time

    from tracewright.functions.urls import canonical

    rng = random.Random(12)
    some = ["http://", "https://", "HTTP://", "ftp://", "h", "x.org", "x..org", "X.org", "a-b.c", "é.org", ".", ":80", ":443", ":8080", "u@", "/", "/", "p", "P%20", " ", "\n", "?", "a=1", "utm_x=2", "&", "#f", "_"]
    odd = ["".join(rng.choice(some[:4]) * (k == 0 and rng.random() < 0.9) + rng.choice(some[4:]) for k in range(rng.randint(1, 6))) for _ in range(3000)]
    odd += [None, "", " ", "http://x.org", "http://x.org/", "http://x.org/a\n", "http://x.org/a \n", "http://x.org/a/ ", "https://1.2.3.4/a//b", "http://x.org./a"]
    rows = spark.createDataFrame([(u,) for u in odd], "u string").select(canonical(F.col("u")).alias("a"), canonical(F.concat(F.lit(" "), F.coalesce("u", F.lit("")))).alias("b"))
    assert rows.where("not (a <=> b)").count() == 0

    def seconds(front):
        page = F.concat(F.lit(f"{front}http://x.org/a/"), F.col("id").cast("string"))
        took = []
        for _ in range(3):
            began = time.time()
            spark.range(0, 150_000, 1, 1).select(canonical(page).alias("u")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    assert 2 * seconds("") < seconds(" ")
