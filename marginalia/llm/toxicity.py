"""Toxic passages as maximal-scoring segments of token log-odds.

Training counts in how many toxic and clean labelled texts each word and each word beginning (of BEGINNINGS bytes)
occurs; what stands between the same neighbours in several toxic texts, as in near copies, counts once. A token's
log-odds has a chain of Dirichlet priors: the corpus's own rate is the prior of the shortest beginning, each
beginning (without the texts of the longer one) that of the next, the last one that of the word, each worth at most
`beginning_weight` texts. Standard errors are taken off, so that rare words say little. From each token's log-odds a
drift is taken, and one linear scan finds all maximal-scoring segments of a text (Ruzzo and Tompa).

Scores of the best segment in clean labelled texts that were not counted follow an extreme-value law with the
text's length; its two parameters turn a segment's score into a p-value. A segment below `alpha` is a passage.
The text's score is a logistic function, fitted on the same texts, of the evidence of its passages.

Labels are drawn to at most about `max_train` texts (documented bound, by hash of the id). The model is the scores of
the words and beginnings of these texts that differ from what their shorter beginning says; the rest is left out because it
changes nothing, and the model, bounded by the drawn texts, is broadcast. Scoring is one pass over whole texts of any length,
without a shuffle. Null and empty texts have no tokens and get the score of no evidence. Without labels of both
kinds all scores are 0. Labels other than 0 and 1 are left out; a document with both is toxic. Equal labelled texts count
once for each label, however the rows are dealt to tasks; repeated rows are scored alike. Ties of segments with equal scores
do not matter to a text's score. Columns of other names are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.word_hashes import hash_runs, parts, slices
from marginalia.workspace import written

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lengths in bytes of the word beginnings, rising; a word is one more level after them.
BEGINNINGS = (3, 5, 7)
WORD = len(BEGINNINGS)


@dataclass(frozen=True)
class ToxicityRules:
    max_train: int = 60_000
    counted_share: float = 0.75
    drift: float = 0.6
    alpha: float = 0.01
    prior: float = 2.0
    beginning_weight: float = 8.0
    beginning_share: float = 0.3
    errors: float = 1.25


@dataclass
class Tokens:
    """levels: the hashes of the tokens' beginnings, shortest first, and of the tokens themselves."""

    levels: list[np.ndarray]
    owner: np.ndarray
    start: np.ndarray  # code points
    end: np.ndarray


def tokens_of(texts: Sequence[str | None]) -> Tokens:
    levels: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(WORD + 1)]
    pieces: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(3))]
    base: dict[int, int] = {}
    for joined, ends, first in slices([t.encode("utf-8", "replace") if t else b"" for t in texts]):
        raw = np.frombuffer(joined, np.uint8)
        runs = hash_runs(_LOWER[raw], _TOKEN[raw], BEGINNINGS)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        owner = first + np.searchsorted(ends, runs.starts, side="right")
        offset = points[np.minimum(np.concatenate([[0], ends[:-1]]), len(raw))]
        shift = offset[owner - first] - base.get(first, 0) * (owner == first)
        for level, hashes in zip(levels, [*runs.prefixes, runs.hashes], strict=True):
            level.append(hashes)
        pieces.append((owner, points[runs.starts] - shift, points[runs.stops] - shift))
        if len(ends) == 1:  # a long text comes in several slices
            base[first] = base.get(first, 0) + int(points[-1])
    return Tokens([np.concatenate(x) for x in levels], *(np.concatenate(x) for x in zip(*pieces, strict=True)))


@dataclass
class Model:
    """By level: sorted hashes and the log-odds of a token that has this one and no longer known one; extreme-value parameters; logistic coefficients."""

    levels: list[tuple[np.ndarray, np.ndarray]]
    rules: ToxicityRules
    lam: float = 1.0
    log_k: float = 0.0
    intercept: float = 0.0
    slope: float = 0.0

    def token_scores(self, t: Tokens) -> np.ndarray:
        out = np.zeros(len(t.owner))
        for keys, (known, value) in zip(t.levels, self.levels, strict=True):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, value[at], out)
        return out - self.rules.drift

    def log_p(self, score: np.ndarray | float, length: np.ndarray | int) -> np.ndarray:
        """log10 of the probability that a clean text of that length has a segment of that score."""
        expected = np.exp(np.minimum(self.log_k + np.log(np.maximum(length, 1)) - self.lam * np.asarray(score, float), 50.0))
        return np.log10(np.maximum(-np.expm1(-expected), 1e-60))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first, end, score), in order; linear in the number of positive scores."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # Candidates: start, end, sum before, sum through, and the nearest earlier candidate with a lesser sum before.
    held: list[tuple[int, int, float, float, int]] = []
    for i in positive.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right, j))
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, right - left) for a, b, left, right, _ in held]


#: A segment of a text: start and end in code points, score, and a number that stands for its words.
Segment = tuple[int, int, float, int]


def _per_text(texts: Sequence[str | None], model: Model) -> Iterator[tuple[int, list[Segment]]]:
    """For each text: number of tokens, and its segments."""
    t = tokens_of(texts)
    scores = model.token_scores(t)
    edges = np.searchsorted(t.owner, np.arange(len(texts) + 1)).tolist()
    positive = np.concatenate([[0], np.cumsum(scores > 0)])
    with np.errstate(over="ignore"):
        words = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t.levels[WORD])])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found = maximal_segments(scores[a:b]) if positive[b] > positive[a] else []
            yield b - a, [(int(t.start[a + i]), int(t.end[a + j - 1]), s, int(words[a + j] - words[a + i])) for i, j, s in found]


def evidence(length: int, segments: Sequence[Segment], model: Model) -> float:
    """Evidence of a text. In clean texts the different segments of at least a score are a Poisson number, whose mean the extreme-value
    law gives; the evidence is the best -log10 of the probability of r segments at least as good as the r-th, weighted by 2 ** -r."""
    if not segments:
        return 0.0
    scores = np.sort(list({which: score for _, _, score, which in segments}.values()))[::-1]
    rank = np.arange(1, len(scores) + 1)
    log_mean = model.log_k + math.log(max(length, 1)) - model.lam * scores
    mean = np.exp(np.minimum(log_mean, 50.0))
    factorial = np.cumsum(np.log(rank))
    small = mean < rank  # else r of them are no surprise
    tail = np.where(small, rank * log_mean - mean - factorial - np.log1p(-np.where(small, mean / (rank + 1), 0.0)), 0.0)
    return float(max(0.0, np.max(-tail / math.log(10) - rank * math.log10(2))))


def _fold(value: Column, name: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.concat(F.lit(name), value.cast("string"))), F.lit(parts))


def _counts(rows: DataFrame) -> DataFrame:
    """rows: text, toxic. Texts by level and key, with the key of the level above: combined in each part before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 0):
                toxic = np.array(part.column(1).to_pylist(), np.int64)
                t = tokens_of(texts)
                for level, keys in enumerate(t.levels):
                    above = t.levels[level - 1] if level else np.zeros_like(keys)
                    order = np.lexsort((keys, t.owner))
                    k, o, up = keys[order], t.owner[order], above[order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                    found, first, which = np.unique(k[new], return_index=True, return_inverse=True)
                    bad = np.bincount(which, weights=toxic[o[new]], minlength=len(found)).astype(np.int64)
                    every = np.bincount(which, minlength=len(found))
                    columns = [np.full(len(found), level, np.int8), found.view(np.int64), up[new][first].view(np.int64), bad, every - bad]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "key", "above", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(count, "level tinyint, key bigint, above bigint, toxic bigint, clean bigint")
    return counted.groupBy("level", "key").agg(F.min("above").alias("above"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(rows: DataFrame) -> DataFrame:
    """rows: text. In how many different pairs of neighbours each of the words and beginnings stands."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in parts(batch, 0):
                t = tokens_of(texts)
                words = t.levels[WORD]
                before, after = np.zeros_like(words), np.zeros_like(words)
                same = t.owner[1:] == t.owner[:-1]
                before[1:][same], after[:-1][same] = words[:-1][same], words[1:][same]
                with np.errstate(over="ignore"):
                    place = before * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xD6E8FEB86659FD93)
                for level, x in enumerate(t.levels):
                    found = np.unique(np.column_stack([x, place]), axis=0).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), level, np.int8)), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["level", "key", "place"])

    return rows.select("text").mapInArrow(places, "level tinyint, key bigint, place bigint").distinct().groupBy("level", "key").agg(F.count(F.lit(1)).alias("places"))


def _log_odds(a: Column, b: Column, rate: float, rules: ToxicityRules) -> Column:
    """Of texts with (a, prior included) and without the label to their log-odds, less what chance explains."""
    value = F.log(a / b) - math.log(rate / (1 - rate))
    return F.signum(value) * F.greatest(F.abs(value) - rules.errors * F.sqrt(1 / a + 1 / b), F.lit(0.0))


def _scores(counts: DataFrame, rate: float, rules: ToxicityRules) -> DataFrame:
    """level, key, score of each word and beginning whose score differs from that of the level above.

    Each level is a written table (of no more rows than the drawn texts have words) with the prior (a, b) that the level above
    hands down: what its other texts say, within a bounded weight.
    """
    prior = rules.prior * rate, rules.prior * (1 - rate)
    out, above = None, None
    for level in range(WORD + 1):
        own = counts.where(F.col("level") == level).select("key", "above", F.col("toxic").alias("t"), F.col("clean").alias("n"))
        if above is None:
            own = own.select("key", "t", "n", F.lit(prior[0]).alias("a"), F.lit(prior[1]).alias("b"), F.lit(0.0).alias("other"))
        else:
            theirs = above.select(F.col("key").alias("above"), F.col("t").alias("t_above"), F.col("n").alias("n_above"), F.col("a").alias("a_above"), F.col("b").alias("b_above"), F.col("score").alias("other"))
            others = lambda c: F.col(f"{'a' if c == 't' else 'b'}_above") + F.greatest(F.col(f"{c}_above") - F.col(c), F.lit(0))
            joined = own.join(theirs, "above").select("key", "t", "n", others("t").alias("a"), others("n").alias("b"), "other")
            share = F.least(F.lit(rules.beginning_share), rules.beginning_weight / F.greatest(F.col("a") + F.col("b"), F.lit(1.0)))
            own = joined.withColumn("share", share).select("key", "t", "n", (F.col("share") * F.col("a") + prior[0]).alias("a"), (F.col("share") * F.col("b") + prior[1]).alias("b"), "other")
        above = written(own.withColumn("score", _log_odds(F.col("a") + F.col("t"), F.col("b") + F.col("n"), rate, rules)), "toxicity-level")
        scored = above.select(F.lit(level).alias("level"), "key", "score", "other").where("abs(score - other) > 1e-9").drop("other")
        out = scored if out is None else out.unionByName(scored)
    return out


def training_texts(docs: DataFrame, labels: DataFrame, rules: ToxicityRules) -> DataFrame:
    """text, toxic, counted: the drawn labelled texts, equal ones once a label; counted ones are for the counts, others for calibration."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rules.max_train / max(1, labels.count()))
    drawn = labels.where(_fold(F.col("doc_id"), "train:", 1 << 20) < int(share * (1 << 20)))
    # At most about max_train rows of two numbers.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    return rows.withColumn("hash", F.md5("text")).dropDuplicates(["hash", "toxic"]).select("text", "toxic", (_fold(F.col("hash"), "fold:", 1000) < int(1000 * rules.counted_share)).alias("counted"))


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0, 1; others are left out). The caller decides which labels may be seen."""
    rows = written(training_texts(docs, labels, rules), "toxicity-texts")
    counted = rows.where("counted")
    n = {r["toxic"]: r["n"] for r in counted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    none = [(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(WORD + 1)]
    if not n_toxic or not n_clean:
        return Model(none, rules, intercept=-math.inf)
    rate = n_toxic / (n_toxic + n_clean)
    leaning = (F.col("toxic") > 1) & (F.col("toxic") * n_clean > F.col("clean") * n_toxic)
    counts = _counts(counted).join(_contexts(counted.where("toxic = 1")), ["level", "key"], "left")
    counts = counts.withColumn("toxic", F.when(leaning, F.least("toxic", F.coalesce("places", "toxic"))).otherwise(F.col("toxic"))).drop("places")
    # Bounded by the words of the drawn texts.
    table = _scores(written(counts, "toxicity-counts"), rate, rules).toArrow()
    level, key, score = (table.column(c).to_numpy() for c in ("level", "key", "score"))
    levels = []
    for k in range(WORD + 1):
        keys, values = key[level == k].view(np.uint64), score[level == k]
        order = np.argsort(keys)
        levels.append((keys[order], values[order]))
    return _calibrate(Model(levels, rules), rows.where("NOT counted"), rate)


def _measured(rows: DataFrame, model: Model, what: Callable[[int, list[Segment]], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text, in no order: its label, its tokens and a number of its segments."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 0):
                found = list(_per_text(texts, shared.value))
                columns = [part.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([what(n, s) for n, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "n", "value"])

    # At most about max_train rows of three numbers; sorted, so that sums do not hang on how rows are dealt to tasks.
    got = rows.select("text", "toxic").mapInArrow(measure, "toxic int, n bigint, value double").toArrow().sort_by([("toxic", "ascending"), ("n", "ascending"), ("value", "ascending")])
    return tuple(got.column(c).to_numpy() for c in ("toxic", "n", "value"))


def _calibrate(model: Model, rows: DataFrame, rate: float) -> Model:
    toxic, length, best = _measured(rows, model, lambda n, segments: max((s[2] for s in segments), default=0.0))
    held = (toxic == 0) & (length > 0)
    if held.sum() >= 20:
        x, log_n = best[held], np.log(length[held])
        low, high = 1e-3, 50.0
        for _ in range(60):  # the scale at which the scores, freed of length, vary as the law says
            mid = math.sqrt(low * high)
            low, high = (mid, high) if np.var(mid * x - log_n) < math.pi**2 / 6 + np.var(log_n) else (low, mid)
        model.lam = min(max(low, 0.2), 3.0)
        model.log_k = float(np.mean(model.lam * x - log_n) - 0.5772)
    toxic, _, strength = _measured(rows, model, lambda n, segments: evidence(n, segments, model))
    model.intercept, model.slope = _logistic(strength, toxic, rate)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a weak prior; the slope is not negative."""
    x, y = np.append(x, [0.0, 4.0]), np.append(y, [0, 1])
    w = np.array([math.log(rate / (1 - rate)), 0.5])
    design = np.column_stack([np.ones(len(x)), x])
    ridge, mean = np.diag([0.01, 0.1]), w.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ (w - mean))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


PASSAGES = "array<struct<start:bigint,`end`:bigint,score:double>>"


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id, score, predicted, and the significant passages in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in parts(batch, 1):
                scores, passages = [], []
                for n, found in _per_text(texts, m):
                    x = m.intercept + m.slope * evidence(n, found, m) if m.intercept > -math.inf else -math.inf
                    scores.append(1 / (1 + math.exp(-x)) if x > -700 else 0.0)
                    sure = -m.log_p(np.array([s[2] for s in found]), n) >= -math.log10(m.rules.alpha) if found else []
                    passages.append([{"start": i, "end": j, "score": s} for (i, j, s, _), ok in zip(found, sure, strict=True) if ok])
                columns = [part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(passages, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "score", "predicted", "passages"])

    return source.mapInArrow(scan, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double, predicted int, passages {PASSAGES}")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels training never sees."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, passages. Labels of held-out rows are not used."""
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out()), rules)
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "passages")
