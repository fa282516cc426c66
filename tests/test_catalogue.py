"""The catalogue's rounds against a loop, and named domains against regular expressions."""

import random
import re
from urllib.parse import unquote

from pyspark.sql import functions as F

from tracewright.functions import urls
from tracewright.operators import catalogue


def in_order(rows):
    seen, out = set(), []
    for i, rank, *keys in sorted(rows, key=lambda r: (r[1], r[0])):
        own = {k.strip() for k in keys if k and k.strip()}
        if not own & seen:
            seen |= own
            out.append(i)
    return sorted(out)


def test_rows_that_stay_are_those_of_the_loop(spark):
    """Chains of shared keys, one namespace for both, and a digest that half of the rows share."""
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.choice([None, "", "hot", "hot", "hot", f"d{rng.randrange(40)}"]), rng.choice([" ", f"e{i // 3}", f"d{rng.randrange(40)}", f"e{rng.randrange(200)}"])) for i in range(300)]
    rows += [(1000 + i, 0, f"c{i}", f"c{i + 1}") for i in range(25)]
    df = spark.createDataFrame(rows, "id long, rank int, a string, b string").repartition(4)
    got = catalogue.first_free(df, [F.col("rank"), F.col("id")], [F.col("a"), F.col("b")])
    assert sorted(r.id for r in got.collect()) == in_order(rows) and got.columns == df.columns
    assert catalogue.first_free(df.limit(0), [F.col("id")], [F.col("a")]).count() == 0


def test_named_domains(spark):
    names = ["example.org", "ample.org", "en.example.org", "b.co"]
    texts = ["see Example.ORG now", "notexample.org", "x.en.example.org/", "en.example.org.uk", "example.org.", "(b.co)", "b.com", "b%2Eco here", "100% example.org", "a+b.co", None, "", "-b.co", "www.b.co and example.org", "ample.org", "日example.org本"]

    def named(text):
        try:
            bad = re.search(r"%(?![0-9a-fA-F]{2})", text or "")
            flat = (text or "") if bad else unquote(text or "")
        except UnicodeDecodeError:
            flat = text or ""
        for d in sorted(names, key=lambda d: (-len(d), d)):
            if re.search(rf"(?<![a-z0-9.-])(?:[a-z0-9-]+\.)*{re.escape(d)}(?![a-z0-9.-])", flat.lower()):
                return d
        return ""

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.d for r in rows.select("i", urls.named_domain(F.col("t"), names).alias("d")).collect()} == {i: named(t) for i, t in enumerate(texts)}


def test_domains_of_pages(spark, sf):
    from tracewright.plans import registry

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r.page_id: r.blocked_by for r in registry.queries()["blocked_domain_in_text"](spark, sf).collect()}
    names = ["en.example.org", "example.com", "example.org"]
    want = {i: next((d for d in names if re.search(rf"(?<![a-z0-9.-])(?:[a-z0-9-]+\.)*{re.escape(d)}(?![a-z0-9.-])", (t or "").lower())), "") for i, t in rows.items()}
    assert found == want and any(want.values())
