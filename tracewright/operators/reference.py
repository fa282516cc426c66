"""How far traces recover reference facts and the evidence chains behind them.

Tables are long: facts, evidence, references and their links are rows keyed by case, so that a case of any size is many
rows and no case is one row, group or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions import evidence as ev
from tracewright.functions.text import compress, fact_tokens
from tracewright.session import Scratch

# Fixed values
BRIDGES = ["pixel_observation", "same_capture"]
DIRECTIONS = ["support", "refute"]
COMPLEMENTS = {"source_assertion": "same_capture", "same_capture": "source_assertion"}


def source_contexts(evidence: DataFrame, discoveries: DataFrame) -> DataFrame:
    """(case, fact, context): what the pages said from which selected same-capture evidence was taken.

    evidence (case, evidence, place, task, url, facts, binding, same_capture, other_capture, selected), discoveries (case,
    task, url, facts, place, title, candidate_url, snippet). An item counts that is selected, bound to the same capture and not
    likely of another; a discovery gives its context where task and canonical url are the item's and their facts overlap,
    to all facts of the item. Contexts of a fact are told once each, in the order of item and discovery. Items without url, task
    or facts and discoveries that say nothing give none.
    """
    held = evidence.where(F.col("selected") & (F.col("binding") == "same_capture") & F.col("same_capture") & ~F.coalesce("other_capture", F.lit(False)))
    held = held.where("task <> '' and url <> '' and size(facts) > 0").select("case", "task", ev.canonical(F.col("url")).alias("url"), F.col("place").alias("item"), "evidence", F.col("facts").alias("own"))
    said = [F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("title", "candidate_url", "snippet")]
    told = discoveries.select("case", "task", ev.canonical(F.col("url")).alias("url"), "facts", F.col("place").alias("found"), F.concat_ws(" ", *said).alias("context")).where("context <> ''")
    met = held.join(told, ["case", "task", "url"]).where(F.arrays_overlap("own", "facts"))
    each = met.select("case", F.explode(F.array_distinct("own")).alias("fact"), "context", F.struct("item", "evidence", "found").alias("at"))
    once = each.groupBy("case", "fact", "context").agg(F.min("at").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "context")))
    return once.groupBy("case", "fact").agg(F.concat_ws(" ", F.transform(listed, lambda x: x["context"])).alias("context"))


def token_keys(rows: DataFrame, id: str, tokens: list[str]) -> DataFrame:
    """(case, id, view, n, letters, k) for each token of each of several arrays, the views.

    Equivalent tokens are equal or share their first letters, so those are the key; a key that a view has again is numbered.
    """
    keys = rows.select("case", id, F.posexplode(F.array(*tokens)).alias("view", "tokens")).select("case", id, "view", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    keys = keys.select("case", id, "view", "n", F.substring("t", 1, ev.LEAST_PREFIX).alias("letters"))
    return keys.groupBy("case", id, "view", "n", "letters").agg(F.count("*").alias("times")).select("case", id, "view", "n", "letters", F.explode(F.sequence(F.lit(1), "times")).alias("k"))


def fact_matches(gold: DataFrame, runtime: DataFrame, least: float) -> DataFrame:
    """(case, gold, fact, similarity) of matched gold facts: each in turn takes the most similar runtime fact left.

    gold (case, gold, place, statement, kind) with a place of its own for each gold fact of a case; runtime (case, fact, statement, kind,
    context). Ties take the smaller id. ``least`` has no default, and must exceed what the same kind alone is worth. Candidates
    meet through rare keys: an F1 of d with n tokens takes d n / (2 - d) of them, so of keys in one order for all rows the first
    n - ceil(d n / (2 - d)) + 1 hold one that both sides have. Taking turns is the outcome of proposals: every gold fact proposes to the best it may still
    have, a runtime fact holds the earliest proposer, and later ones lose it for good. Each round is a
    written table of pairs, so a case is as many rows and tasks as it needs; rounds end when nobody loses.
    """
    if least <= ev.KIND_BONUS:
        raise ValueError(f"a match needs a similarity above {ev.KIND_BONUS}")
    scratch = Scratch(gold.sparkSession, "facts")
    whole = F.concat_ws(" ", F.nullif(F.trim(F.coalesce("statement", F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce("context", F.lit(""))), F.lit("")))
    g = scratch.save(gold.select("case", "gold", "place", fact_tokens(F.col("statement")).alias("g0"), F.coalesce("kind", F.lit("")).alias("g_kind")), "gold")
    f = runtime.where("fact is not null").select("case", "fact", fact_tokens(F.col("statement")).alias("f0"), fact_tokens(whole).alias("f1"), F.coalesce("kind", F.lit("")).alias("f_kind"))
    f = scratch.save(f, "runtime")
    d = least - ev.KIND_BONUS
    told, asked = token_keys(f, "fact", ["f0", "f1"]), token_keys(g, "gold", ["g0"])
    often = told.select("case", "letters").unionByName(asked.select("case", "letters")).groupBy("case", "letters").agg(F.count("*").alias("often"))

    def first(rows, id):
        place = F.row_number().over(Window.partitionBy("case", id, "view").orderBy("often", "letters", "k"))
        most = F.col("n") - F.ceil(F.col("n") * d / (2 - d)) + 1
        return rows.join(often, ["case", "letters"]).withColumn("at", place).where(F.col("at") <= most).select("case", id, "letters", "k").distinct()

    met = first(asked, "gold").join(first(told, "fact"), ["case", "letters", "k"]).select("case", "gold", "fact").distinct()
    best = F.greatest(ev.token_f1(F.col("f0"), F.col("g0")), ev.token_f1(F.col("f1"), F.col("g0")))
    score = F.when(F.col("f_kind") == F.col("g_kind"), F.least(F.lit(1.0), best + ev.KIND_BONUS)).otherwise(best)
    pairs = met.join(g, ["case", "gold"]).join(f, ["case", "fact"]).select("case", "gold", "place", "fact", score.alias("s")).where(F.col("s") >= least)
    pairs = scratch.save(pairs, "pairs")
    while True:
        wish = pairs.groupBy("case", "gold", "place").agg(F.min_by(F.struct("fact", "s"), F.struct(-F.col("s"), F.col("fact"))).alias("b")).select("case", "gold", "place", "b.fact", "b.s")
        held = wish.groupBy("case", "fact").agg(F.min("place").alias("by"))
        left = scratch.save(pairs.join(held, ["case", "fact"], "left").where("by is null or place <= by").select(*pairs.columns), "pairs")
        settled = left.count() == pairs.count()
        scratch.drop(pairs)
        pairs = left
        if settled:
            break
    return pairs.groupBy("case", "gold").agg(F.min_by(F.struct("fact", "s"), F.struct(-F.col("s"), F.col("fact"))).alias("b")).select("case", "gold", "b.fact", F.col("b.s").alias("similarity"))


def tier(item: Column, reference: Column) -> Column:
    """(rank, method, confidence) of an evidence item and a reference: the reference itself, else what ``relaxed_match`` says of qualified items."""
    same = lambda c, d: F.coalesce(item[c], F.lit("")) == F.coalesce(reference[d], F.lit(""))
    text = ev.holds_either_way(compress(item["text"]), compress(reference["text"]))
    exact = (ev.canonical(item["url"]) == ev.canonical(reference["url"])) & text & same("stance", "stance") & (F.lower(F.coalesce(item["digest"], F.lit(""))) == F.lower(F.coalesce(reference["digest"], F.lit(""))))
    exact = F.coalesce(exact, F.lit(False)) & (ev.family(item["family"]) == ev.family(reference["family"]))
    found = ev.relaxed_match(item, reference)
    told = lambda rank, method, confidence: F.struct(F.lit(rank).alias("rank"), method.alias("method"), confidence.alias("confidence"))
    return F.when(exact, told(0, F.lit("canonical_reference"), F.lit(1.0))).when(item["qualified"] & found.isNotNull(), told(1, found["method"], found["confidence"]))


def evidence_matches(related: DataFrame, references: DataFrame) -> DataFrame:
    """(case, gold, evidence, source, method, confidence) of the evidence that recovers a gold fact's references.

    related (case, gold, evidence, item): the evidence behind the runtime fact that a gold fact is matched with; references (case,
    gold, place, source, reference). An item takes the first reference that it is, else the first that it matches. Then selected, qualified
    items that took none count too where an item that did has their family, one has their stance, and one is
    of the binding that completes theirs: capture and assertion of one source are one chain.
    """
    a = related.withColumn("_f", ev.family(F.col("item.family"))).withColumn("_s", F.coalesce("item.stance", F.lit("")))
    b = references.select("case", "gold", "place", "source", "reference", ev.family(F.col("reference.family")).alias("_f"), F.coalesce("reference.stance", F.lit("")).alias("_s"))
    # every tier needs family and stance to be the same, so they are keys of the join
    tried = a.join(b, ["case", "gold", "_f", "_s"]).withColumn("t", tier(F.col("item"), F.col("reference"))).where("t is not null")
    first = tried.groupBy("case", "gold", "evidence").agg(F.min_by(F.struct("source", "t"), F.struct("t.rank", "place", "source")).alias("m"))
    direct = first.select("case", "gold", "evidence", "m.source", "m.t.method", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "m.t.confidence")), 6).alias("confidence"))
    recovered = a.join(direct.select("case", "gold", "evidence"), ["case", "gold", "evidence"], "left_semi")
    rest = a.join(direct.select("case", "gold", "evidence"), ["case", "gold", "evidence"], "left_anti").where("item.selected and item.qualified")
    families = recovered.where("_f <> ''").select("case", "gold", "_f").distinct()
    stances = recovered.select("case", "gold", "_s").distinct()
    bindings = recovered.select("case", "gold", F.col("item.binding").alias("_b")).distinct()
    needed = F.create_map(*(F.lit(x) for pair in COMPLEMENTS.items() for x in pair))[F.col("item.binding")]
    rest = rest.withColumn("_b", needed).join(families, ["case", "gold", "_f"], "left_semi").join(stances, ["case", "gold", "_s"], "left_semi").join(bindings, ["case", "gold", "_b"], "left_semi")
    chained = rest.select("case", "gold", "evidence", F.lit("").alias("source"), F.lit("same_source_chain_complement").alias("method"), F.lit(1.0).alias("confidence"))
    return direct.unionByName(chained)


def bridges(item: Column, supported: Column) -> Column:
    """Whether an item ties a fact to the picture: of a supported fact by pixels or the same capture, of a refuted one also directly by a source."""
    clean = ~F.coalesce(item["risky"], F.lit(False))
    direct = item["binding"].isin([*BRIDGES, "source_assertion"]) & (item["directness"] == "direct") & item["quality"].isin("strong", "moderate")
    return F.coalesce(clean & F.when(supported, item["binding"].isin(BRIDGES)).otherwise(direct), F.lit(False))


def reference_chains(gold: DataFrame, runtime: DataFrame, matches: DataFrame, links: DataFrame, evidence: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each gold fact, the evidence matches): what of the decisive chain a trace recovered.

    gold (case, gold, expected_status, anchored), runtime (case, fact, status), matches of ``fact_matches``, links (case, fact,
    evidence) of findings that hold, evidence (case, evidence, item), references as in ``evidence_matches``. A chain is recovered when
    the fact, its status, its tie to the picture where one is asked for, and some of its evidence are.
    """
    known = matches.select("case", "gold", "fact", "similarity")
    related = known.join(links, ["case", "fact"]).join(evidence, ["case", "evidence"]).select("case", "gold", "fact", "evidence", "item").dropDuplicates(["case", "gold", "evidence"])
    found = evidence_matches(related.select("case", "gold", "evidence", "item"), references)
    status = runtime.select("case", "fact", F.col("status").alias("runtime_status"))
    tied = related.join(status, ["case", "fact"]).groupBy("case", "gold").agg(F.max(bridges(F.col("item"), F.col("runtime_status") != "refuted")).alias("bridged"))
    held = found.groupBy("case", "gold").agg(F.count("*").alias("n_evidence"))
    rows = gold.join(known, ["case", "gold"], "left").join(status, ["case", "fact"], "left").join(tied, ["case", "gold"], "left").join(held, ["case", "gold"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    fact = F.col("fact").isNotNull()
    same = fact & (F.coalesce("runtime_status", F.lit("")) == F.coalesce("expected_status", F.lit("")))
    anchor = fact & (~yes(F.col("anchored")) | yes(F.col("bridged")))
    n = F.coalesce("n_evidence", F.lit(0))
    told = [F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"), same.alias("status_match"), anchor.alias("anchor_recovered"), n.alias("n_evidence"), (same & anchor & (n > 0)).alias("chain_recovered")]
    return rows.select("case", "gold", "fact", *told), found


def chain_metrics(cases: DataFrame, rows: DataFrame, found: DataFrame, selected: DataFrame) -> DataFrame:
    """(case, four rates): facts, chains and evidence recovered of a case's gold facts, and selected (case, evidence) that recover some.

    Without gold facts the recalls are 1; without selected evidence the precision is 1 where there are none to recover, else 0.
    """
    per = rows.groupBy("case").agg(F.count("*").alias("n"), F.count("fact").alias("facts"), F.count_if("chain_recovered").alias("chains"), F.count_if(F.col("n_evidence") > 0).alias("with"))
    hits = found.select("case", "evidence", F.lit(1).alias("hit")).distinct()
    basis = selected.select("case", "evidence").distinct().join(hits, ["case", "evidence"], "left").groupBy("case").agg(F.count("*").alias("picked"), F.count("hit").alias("hits"))
    out = cases.select("case").distinct().join(per, "case", "left").join(basis, "case", "left")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(1.0)), 6)
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("picked")), F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(0.0))
    return out.select("case", share("facts").alias("fact_recall"), share("chains").alias("chain_recall"), share("with").alias("evidence_recall"), F.round(precision, 6).alias("basis_precision"))
