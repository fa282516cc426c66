"""Evidence expressions: token similarity with prefix equivalence, policies on queries and records, boxes, probabilities."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

from tracewright.functions.schema import let
from tracewright.functions.text import fact_tokens, normalise
from tracewright.functions.urls import canonical

# Fixed values
LEAST_PREFIX, MOST_LONGER = 6, 2
SLICE = 256  # rows of tokens that a worker holds as Python strings
KIND_BONUS = 0.1
AS_OF_MARKER = "As-of constraint: evaluate this claim as of "
READY_VERDICTS = [
    r"\bfact\s*check(?:er|ing|ed)?\b",
    r"\b(?:fake|false|misleading|debunk(?:ed|ing)?|hoax)\s+(?:news|claim|report|image|photo|video|story)\b",
    r"\b(?:claim|report|image|photo|video|story)\s+(?:fake|false|misleading|debunked|hoax)\b",
]
MEDIA_ORIGINS = [
    r"\b(?:ai\s+generated|generated\s+by\s+ai|computer\s+generated|digitally\s+generated|generative\s+ai)\b",
    r"\b(?:midjourney|dall\s*e|stable\s+diffusion|image\s+generator|generation\s+source|creation\s+method)\b",
    r"\b(?:real\s+or\s+fake|fake\s+or\s+real|image\s+authenticity|photo\s+authenticity|photograph\s+authenticity|authenticity\s+of\s+(?:the\s+)?image|image\s+generation|photo\s+generation|image\s+manipulation|digitally\s+manipulated)\b",
]
TEXT_MATCH, RECALL_MATCH, URL_MATCH, CAPTURE_CONFIDENCE = 0.72, 0.85, 0.45, 0.9
ARCHIVE_ALIASES = {"tool": "tool_name", "tools": "tool_name"}
ARCHIVE_ARGUMENTS = {"task_id": ("__question_id",)}
UNUSABLE = r"^RuntimeError: Chat Completions returned an unusable response: choices=1, finish_reason=(?:tool_calls|stop|length), content_chars=0, reasoning_chars=[0-9]+, reasoning_fallback_requested=False$"
MODEL_STAGES = ["unified_react", "unified_judgment"]
SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0}


def equivalent(a: Column, b: Column) -> Column:
    """Equal, or one of six or more letters begins the other, which is at most two longer."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((short >= LEAST_PREFIX) & (long - short <= MOST_LONGER) & (F.startswith(a, b) | F.startswith(b, a)))


def shared(own: list[str], wanted: list[str]) -> int:
    """How many of ``own`` find an ``equivalent`` in ``wanted`` that none before took; those that begin alike are looked at alone."""
    left, n = {}, 0
    for t in wanted:
        left.setdefault(t[:LEAST_PREFIX], []).append(t)
    for t in own:
        some = left.get(t[:LEAST_PREFIX], ())
        match = next((x for x in some if x == t or (abs(len(x) - len(t)) <= MOST_LONGER and (x.startswith(t) or t.startswith(x)))), None)
        if match is not None:
            some.remove(match)
            n += 1
    return n


def overlap(a: Column, b: Column) -> Column:
    """How many of the sorted tokens of ``a`` find, one after the other, the first token of ``b`` left that is equivalent."""

    @F.arrow_udf("int")
    def both(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(x), SLICE):
            pairs = zip(x.slice(i, SLICE).to_pylist(), y.slice(i, SLICE).to_pylist())
            out += [None if s is None or t is None else shared(s, t) for s, t in pairs]
        return pa.array(out, pa.int32())

    return both(a, b)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two sorted arrays of distinct tokens under ``equivalent``; 0 where either is empty."""
    both = overlap(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def fact_similarity(statement: Column, gold: Column, same_kind: Column, context: Column) -> Column:
    """The better of two F1s, of a statement alone and with its source's context, a tenth more for the same kind, at most 1."""
    whole = F.concat_ws(" ", F.nullif(F.trim(F.coalesce(statement, F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce(context, F.lit(""))), F.lit("")))
    best = F.greatest(token_f1(fact_tokens(statement), fact_tokens(gold)), token_f1(fact_tokens(whole), fact_tokens(gold)))
    return F.when(same_kind, F.least(F.lit(1.0), best + KIND_BONUS)).otherwise(best)


def family(value: Column) -> Column:
    """The first label of a source family."""
    return F.substring_index(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "^domain:", ""), ".", 1)


def reference_key(url: Column, stance: Column, digest: Column, source_family: Column) -> Column:
    """What an evidence item and its reference have in common beside their texts."""
    return F.struct(canonical(url).alias("url"), F.coalesce(stance, F.lit("")).alias("stance"), F.lower(F.coalesce(digest, F.lit(""))).alias("digest"), family(source_family).alias("family"))


def holds_either_way(a: Column, b: Column) -> Column:
    """Whether one of two non-empty texts holds the other, white space compressed."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def relaxed_match(item: Column, reference: Column) -> Column:
    """(method, confidence) of an evidence item and a reference of the same stance and source family; null without a match.

    Both are structs: of url, stance, family and text, the item's with kind, binding, same_capture, other_capture and
    confidence beside them. In this order: texts that say the same, a comparison of the same capture, the same page with a
    similar text.
    """
    a, b = normalise(item["text"]), normalise(reference["text"])
    own, wanted = fact_tokens(a), fact_tokens(b)
    recall = F.coalesce(F.try_divide(F.size(F.array_intersect(own, wanted)), F.size(wanted)), F.lit(0.0))
    allied = (family(item["family"]) == family(reference["family"])) & (family(item["family"]) != "") & item["stance"].eqNullSafe(reference["stance"])
    capture = (item["kind"] == "reference_comparison") & (item["binding"] == "same_capture") & F.coalesce(item["same_capture"], F.lit(True)) & ~F.coalesce(item["other_capture"], F.lit(False))
    result = lambda method, confidence: F.struct(F.lit(method).alias("method"), confidence.alias("confidence"))

    def judged(x: Column) -> Column:
        f1, recall = x["f1"], x["recall"]
        alike = (a != "") & (b != "") & (holds_either_way(a, b) | (f1 >= TEXT_MATCH) | (recall >= RECALL_MATCH))
        page = canonical(item["url"]).eqNullSafe(canonical(reference["url"])) & (f1 >= URL_MATCH)
        found = F.when(alike, result("same_source_text_equivalent", F.greatest(F.lit(TEXT_MATCH), f1, recall)))
        found = found.when(capture, result("same_source_same_capture", F.coalesce(F.nullif(item["confidence"], F.lit(0.0)), F.lit(CAPTURE_CONFIDENCE))))
        return F.when(allied, found.when(page, result("same_url_semantic_span", f1)))

    return let(F.struct(token_f1(own, wanted).alias("f1"), recall.alias("recall")), judged)


def targets_ready_verdict(query: Column, origins: bool = False) -> Column:
    """Whether a query looks for a ready-made verdict, or also for how a picture was made."""
    flat = F.lower(F.regexp_replace(F.coalesce(query, F.lit("")), "[-_]+", " "))
    return reduce(lambda a, b: a | b, (flat.rlike(p) for p in READY_VERDICTS + MEDIA_ORIGINS * origins))


def temporally_eligible(alignment: Column, goal: Column) -> Column:
    """A goal with a cutoff takes only records aligned before it or at it."""
    bound = F.contains(F.coalesce(goal, F.lit("")), F.lit(AS_OF_MARKER))
    return ~bound | (F.lower(F.trim(F.coalesce(alignment, F.lit("")))) == "before_or_at_cutoff")


def matches_any(actual: list[Column], wanted: list[str]) -> Column:
    """An archive filter: the first place that holds a value must hold one of those wanted, whatever their case; no wish always holds."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.lower(F.coalesce(*actual)).isin([w.lower() for w in wanted]), F.lit(False))


def archive_matches(item: Column, filters: dict[str, object]) -> Column:
    """Whether an archive item, a VARIANT object, has what every filter wants.

    A filter's key, or the key it stands for, is looked up in the item, then in its ``metadata``, then in its ``tool_args``, where a
    task also goes by another name; a JSON null is none. One of the values found, if it is a list, must be one of those wanted, compared as text whatever
    the case. Empty wishes always hold; a place that nowhere is holds the word none.
    """
    out = F.lit(True)
    for key, wanted in filters.items():
        if wanted in (None, "", []):
            continue
        name = ARCHIVE_ALIASES.get(key, key)
        places = [f"$.{name}", f"$.metadata.{name}", f"$.tool_args.{name}", *(f"$.tool_args.{x}" for x in ARCHIVE_ARGUMENTS.get(name, ()))]
        told = [F.try_variant_get(item, place, "variant") for place in places]
        found = F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in told))
        texts = F.coalesce(F.try_variant_get(found, "$", "array<string>"), F.array(F.try_variant_get(found, "$", "string")))
        texts = F.transform(texts, lambda x: F.lower(F.coalesce(x, F.lit("none"))))
        values = [str(x).lower() for x in (wanted if isinstance(wanted, list) else [wanted])]
        out &= F.arrays_overlap(texts, F.array(*map(F.lit, values)))
    return out


def retryable(status: Column, verdict: Column, error: Column, code: Column, transport: list[str], http_error: str, codes: list[int]) -> Column:
    """Work in progress, and pending errors that say they may be retried or, where they say nothing, that are of a transport kind."""
    kind = error.isin(transport) | ((error == http_error) & code.isin(codes))
    return F.when(status == "in_progress", True).when(status == "pending_error", F.coalesce(verdict, kind, F.lit(False))).otherwise(False)


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2) given as arrays; both empty 1, one empty 0, no area 0."""
    none = lambda x: x.isNull() | (F.size(x) == 0)
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    both = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda x: side(x[0], x[2]) * side(x[1], x[3])
    union = area(a) + area(b) - both
    return F.when(none(a) & none(b), 1.0).when(none(a) | none(b), 0.0).when(union > 0, both / union).otherwise(0.0)


def valid_probabilities(entries: Column, k: int) -> Column:
    """Whether an array of (id, prob) has exactly k entries of distinct ids whose probabilities sum to one."""
    total = F.aggregate(entries, F.lit(0.0), lambda s, x: s + x["prob"])
    return (F.size(entries) == k) & (F.size(F.array_distinct(F.transform(entries, lambda x: x["id"]))) == k) & (F.abs(total - 1.0) <= 1e-5)


def sparse_cross_entropy(logits: Column, entries: Column) -> Column:
    """mass * logsumexp(logits) minus the weighted logits of an array of (id, prob)."""
    top = F.array_max(logits)
    spread = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    mass = F.aggregate(entries, F.lit(0.0), lambda s, x: s + x["prob"])
    return mass * spread - F.aggregate(entries, F.lit(0.0), lambda s, x: s + x["prob"] * F.get(logits, x["id"]))


def elapsed_seconds(text: Column) -> Column:
    """Seconds of a text like 1h 2m 3.5s; null where it names no amount."""
    amounts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*[hms]"), 1)
    units = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?\s*([hms])"), 1)
    factor = lambda u: F.when(u == "h", SECONDS["h"]).when(u == "m", SECONDS["m"]).otherwise(SECONDS["s"])
    total = F.aggregate(F.zip_with(amounts, units, lambda a, u: a.cast("double") * factor(u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(amounts) > 0, total)
