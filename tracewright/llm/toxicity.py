"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model over hashed lower-case words (present or not, whole text) is trained in numpy from
confirmed toxic rows and unlabelled rows, by the risk estimator that corrects for the class prior: with
prior p, risk = p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)]); where the bracket turns
negative, its gradient is taken ``step_back`` times in reverse. The prior is the share of toxic labels among the rows labels may be
learnt from. Those are the rows whose crc32(id as text) mod ``folds`` is not 0.

The training sample is bounded by ``most_positive`` and ``most_unlabelled`` rows, taken in the order of a
hash of the id. Words have weights that are found in at least ``least_rows`` of them and whose share of toxic rows exceeds that of
unlabelled rows by some standard errors. How many, of those in ``least_z``, is chosen inside the training rows: a model is trained
without one of the first ``choosing`` folds of them, and the number with the least estimated risk of zero-one loss on the
fold left out is taken. Rows that are held out never take part. Every text is scored whole, in the
tasks that read it; nothing is shuffled. Defined results: null and empty texts score as the bias alone;
labels with a null, or of ids without text, teach nothing; without a confirmed toxic row every score is 0; rows that repeat an id, or
lack one, are scored each by its own text, and those that repeat an id all teach under its label; texts above ``longest`` bytes are
scored whole and teach nothing; further columns, whatever their names, are ignored.
Label, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.words import U64, Words, slices

BITS = 20


@dataclass(frozen=True)
class Settings:
    most_positive: int = 6000
    most_unlabelled: int = 12000
    least_rows: int = 4
    least_z: tuple[float, ...] = (1.5, 2.0, 3.0, 5.0)
    choosing: int = 2
    trial_epochs: int = 80
    folds: int = 5
    epochs: int = 250
    batches: int = 1
    step_back: float = 0.1
    longest: int = 1 << 15  # bytes: longer texts are scored like all others, but not learned from, which bounds the sample
    rate: float = 0.1
    shrink: float = 2e-3
    seed: int = 11


def fold(id: str, folds: int) -> Column:
    return F.crc32(F.col(id).cast("string")) % folds


def word_ids(array: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    w = Words(array, lower=True)
    return w, np.repeat(np.arange(len(array)), w.counts), (w.hash >> U64(64 - BITS)).astype(np.int64)


def _features(batches):
    for batch in slices(batches, "text"):
        _, doc, word = word_ids(batch.column(batch.schema.get_field_index("text")))
        pair = np.unique(doc << BITS | word)
        at = np.searchsorted(pair >> BITS, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array((pair & ((1 << BITS) - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("positive", "fold")), lists], ["positive", "fold", "words"])


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings, id: str, text: str, label: str) -> tuple[list, float]:
    """Flags, folds and words of the sampled rows, at most most_positive + most_unlabelled of them, and the class prior."""
    marked = labels.where((fold(id, s.folds) != 0) & F.col(label).isNotNull())
    prior = marked.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0] or 0.0
    order = F.xxhash64(F.col(id), F.lit(s.seed))
    docs = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= s.longest)
    toxic = marked.where(F.col(label) == 1).select(id).distinct().join(docs.select(id), id, "left_semi")
    positive = toxic.orderBy(order).limit(s.most_positive).select(id, F.lit(True).alias("positive"))
    unlabelled = docs.where(F.col(id).isNotNull() & (fold(id, s.folds) != 0)).select(id).orderBy(order).limit(s.most_unlabelled).select(id, F.lit(False).alias("positive"))
    # both sides of the union are limited, so the broadcast is bounded by the settings
    wanted = docs.select(F.col(id), F.col(text).alias("text")).join(F.broadcast(positive.unionByName(unlabelled)), id)
    wanted = wanted.select("positive", fold(id, s.folds).cast("int").alias("fold"), "text")
    rows = wanted.mapInArrow(_features, "positive boolean, fold int, words array<int>").toArrow()
    words = [x.values.to_numpy() for chunk in rows.column(2).chunks for x in chunk]
    return [np.asarray(rows.column(0).to_numpy(), bool), rows.column(1).to_numpy(), words], prior


def counted(ids: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """How often each hashed word occurs; in slices, as numpy counts a copy of eight bytes a number."""
    return sum((np.bincount(ids[i : i + step], minlength=1 << BITS) for i in range(0, len(ids), step)), np.zeros(1 << BITS, int))


def summed(words: list[np.ndarray], weights: np.ndarray, step: int = 1 << 10) -> np.ndarray:
    """The sum of each row's weights, some rows at a time."""
    out = np.zeros(len(words))
    for i in range(0, len(words), step):
        part = words[i : i + step]
        out[i : i + step] = np.bincount(np.repeat(np.arange(len(part)), [len(x) for x in part]), weights[np.concatenate(part)], len(part))
    return out


def telling(flat: np.ndarray, of_positive: np.ndarray, flags: np.ndarray, least_z: float, s: Settings) -> np.ndarray:
    """Words whose share of toxic rows exceeds that of unlabelled rows by ``least_z`` standard errors."""
    n_pos, n_unl = max(flags.sum(), 1), max((~flags).sum(), 1)
    pos, unl = counted(flat[of_positive]), counted(flat[~of_positive])
    p, u = (pos + 0.5) / (n_pos + 1), (unl + 0.5) / (n_unl + 1)
    z = (p - u) / np.sqrt(p * (1 - p) / n_pos + u * (1 - u) / n_unl)
    return np.flatnonzero((z >= least_z) & (pos + unl >= s.least_rows))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Both terms of the estimated risk of logistic loss: prior * E_pos[loss(+)], and E_unl[loss(-)] - prior * E_pos[loss(-)]."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float, step_back: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step follows: the gradient of both terms by the rows' scores, or ``-step_back`` times that of a negative second term."""
    sp, su = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (zp, zu))
    second = -prior * sp / len(zp), su / len(zu)
    if risk(zp, zu, prior)[1] < 0:
        return -step_back * second[0], -step_back * second[1]
    return second[0] + prior * (sp - 1) / len(zp), second[1]


def chosen(flags: np.ndarray, folds: np.ndarray, words: list[np.ndarray], prior: float, s: Settings) -> float:
    """Of ``least_z``, what has the least estimated zero-one risk on folds of the training rows that its model has not seen."""
    held = [f for f in np.unique(folds)[: s.choosing] if all((flags[folds == f] == side).any() and (flags[folds != f] == side).any() for side in (True, False))]
    if len(s.least_z) == 1 or not held:
        return s.least_z[0]
    found = []
    for least in s.least_z:
        total = 0.0
        for f in held:
            seen = np.flatnonzero(folds != f)
            weights, bias = train(flags[seen], [words[i] for i in seen], prior, replace(s, least_z=(least,), epochs=s.trial_epochs))
            hit = bias + summed(words, weights) >= 0
            caught, alarms = hit[flags & (folds == f)].mean(), hit[~flags & (folds == f)].mean()
            total += prior * (1 - caught) + max(0.0, alarms - prior * caught)
        found.append(total)
    return s.least_z[int(np.argmin(found))]


def train(flags: np.ndarray, words: list[np.ndarray], prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights of the hashed words and the bias, by minibatch Adam with soft shrinkage; words are cut at the first of ``least_z``."""
    weights = np.zeros(1 << BITS)
    prior = min(max(prior, 1e-3), 0.9)
    if not flags.any() or flags.all():
        return weights, -np.inf if not flags.any() else np.log(prior / (1 - prior))
    sizes = np.array([len(x) for x in words])
    flat = np.concatenate(words) if sizes.sum() else np.zeros(0, int)
    known = telling(flat, np.repeat(flags, sizes), flags, s.least_z[0], s)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    col, row = place[flat], np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    kept = col >= 0
    row, col = row[kept], col[kept]
    del flat, kept
    begin = np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32)
    rng = np.random.default_rng(s.seed)
    theta, m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    sides = [np.flatnonzero(flags), np.flatnonzero(~flags)]
    step = 0
    for _ in range(s.epochs):
        parts = [np.array_split(rng.permutation(x), s.batches) for x in sides]
        for pos, unl in zip(*parts):
            if not len(pos) or not len(unl):
                continue
            step += 1
            ids = np.concatenate([pos, unl])
            take = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in ids])
            own = np.repeat(np.arange(len(ids), dtype=np.int32), begin[ids + 1] - begin[ids])
            z = theta[-1] + np.bincount(own, theta[col[take]], len(ids))
            slope = np.concatenate(slopes(z[: len(pos)], z[len(pos) :], prior, s.step_back))
            grad = np.append(np.bincount(col[take], slope[own], len(known)), slope.sum())
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            move = s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            theta -= move
            theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - s.shrink, 0)
    weights[known] = theta[:-1]
    return weights, float(theta[-1])


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    (flags, folds, words), prior = training_rows(docs, labels, settings, id, text, label)
    least = chosen(flags, folds, words, min(max(prior, 1e-3), 0.9), settings)
    weights, bias = train(flags, words, prior, replace(settings, least_z=(least,)))
    used = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((used, weights[used], bias))

    def score(batches):
        used, values, bias = model.value
        table = np.zeros(1 << BITS)
        table[used] = values
        for batch in slices(batches, "text"):
            _, doc, word = word_ids(batch.column(1))
            hit = np.flatnonzero(table[word])
            pair = np.unique(doc[hit] << BITS | word[hit])
            z = bias + np.bincount(pair >> BITS, table[pair & ((1 << BITS) - 1)], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["id", "score"])

    kind = docs.schema[id].dataType.simpleString()
    scored = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, score double")
    held = F.coalesce(fold("id", settings.folds) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
