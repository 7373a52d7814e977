"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades are ordered severities 0..3. A document's score is the sum, over its words, of shared feature weights; the chance of
a grade above j is sigmoid(score - threshold[j]) with ordered thresholds. Features are words and their prefixes of 4 to
6 letters (bad words are inflected), kept where at least `SUPPORT` labelled toxic rows have them and their log odds are over `ODDS`
and over `SIGNIFICANT` standard errors.

Labels only say toxic or not, so severities of the training rows are made by cross-fitting: labelled rows are halved by
a hash of doc_id, each half gives a lexicon of whole words that its toxic rows use more, and a toxic row's dose is
how many of its words are in the *other* half's lexicon. Tertiles of the dose are grades 1 to 3: no row's grade comes from
features that were chosen on that row.

Fitting uses at most `SAMPLE` labelled rows (a documented bound; chosen by a hash of doc_id, every labelled row where there
are fewer), so that all that reaches the driver is bounded. Scoring reads every whole text of every row.

Defined cases: null or wordless text has no features and so the least severity; labels without a document, and null
labels, teach nothing; without both kinds of label every severity is 0; a doc_id labelled twice counts twice; other
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frame, read_table, worker_state

SAMPLE = 20_000
SUPPORT = 3
ODDS = 2.0
SIGNIFICANT = 2.0
LEVELS = 3
CACHED = 300_000  #: words whose weights a worker keeps

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def sigmoid(x):
    return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -40, 40))))


@dataclass
class Ordinal:
    """P(grade > j) = sigmoid(score - thresholds[j])."""

    weights: dict[str, float]
    thresholds: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, text: str | None) -> float:
        known = worker_state("toxicity", self.key, dict)
        total = 0.0
        for w in words(text):
            got = known.get(w)
            if got is None:
                if len(known) >= CACHED:
                    known.clear()
                got = known[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
            total += got
        return total

    def above(self, score: float) -> np.ndarray:
        return sigmoid(score - self.thresholds)


def fit(rows: list[Counter], grades: np.ndarray, features: list[str], levels: int = LEVELS, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam; the weights are shared by all thresholds, which stay ordered (first + positive gaps)."""
    index = {f: i for i, f in enumerate(features)}
    r = np.array([i for i, c in enumerate(rows) for f in c], np.int64)
    c = np.array([index[f] for x in rows for f in x], np.int64)
    x = np.array([n for q in rows for n in q.values()], float)
    k, n = len(features), len(rows)
    params = np.concatenate((np.full(k, 0.1), [1.0], np.zeros(levels - 1)))
    m, v = np.zeros_like(params), np.zeros_like(params)

    for t in range(1, steps + 1):
        gaps = np.exp(params[k + 1 :])
        th = params[k] + np.concatenate(([0], np.cumsum(gaps)))
        s = np.bincount(r, weights=params[c] * x, minlength=n)
        p = np.column_stack((np.ones(n), sigmoid(s[:, None] - th[None, :]), np.zeros(n)))
        row = np.arange(n)
        like = np.maximum(p[row, grades] - p[row, grades + 1], 1e-9)
        slope = p[:, 1:-1] * (1 - p[:, 1:-1])  # of sigmoid(s - th_j)
        sign = (np.arange(levels)[None, :] == grades[:, None] - 1) * 1.0 - (np.arange(levels)[None, :] == grades[:, None]) * 1.0
        d = sign * slope / like[:, None]  # d log-likelihood / d (s - th_j)
        ds, dth = d.sum(1), -d.sum(0) / n
        gw = np.bincount(c, weights=ds[r] * x, minlength=k) / n - ridge * params[:k]
        tail = np.cumsum(dth[::-1])[::-1]
        g = np.concatenate((gw, [tail[0]], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    gaps = np.exp(params[k + 1 :])
    return Ordinal({f: float(w) for f, w in zip(features, params[:k])}, params[k] + np.concatenate(([0], np.cumsum(gaps))))


def grade(hits: np.ndarray, toxic: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """0 for rows that aren't toxic; toxic rows by the quantiles of their dose."""
    out = np.zeros(len(hits), np.int64)
    if toxic.any():
        edges = np.quantile(hits[toxic], np.arange(1, levels) / levels)
        out[toxic] = 1 + (hits[toxic, None] > edges[None, :]).sum(1)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    total = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(total, 1)))
    known = known.where(share)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(share)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    rows = scratch.table(texts.join(known, "doc_id").select("text", "toxic", half.alias("half")), "sample")

    def presence(batches):
        for pdf in batches:
            seen = [Counter() for _ in range(4)]
            for t, toxic, h in zip(pdf["text"], pdf["toxic"], pdf["half"]):
                seen[2 * h + toxic].update({f for w in set(words(t)) for f in word_features(w)})
            every = list(set().union(*seen))
            yield frame({"f": every, **{f"n{k}": [c[f] for f in every] for k, c in enumerate(seen)}})

    size = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    of = lambda toxic, *halves: sum(size.get((h, toxic), 0) for h in halves)
    if not of(True, 0, 1) or not of(False, 0, 1):
        return Ordinal({}, np.full(LEVELS, np.inf))
    counts = rows.mapInPandas(presence, "f string, n0 long, n1 long, n2 long, n3 long").groupBy("f").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    counts = scratch.table(counts.where("n1 + n3 > 0"), "counts")

    def telling(*halves):
        yes, no = (sum((F.col(f"n{2 * h + k}") for h in halves), F.lit(0.5)) for k in (1, 0))
        odds = F.log(yes / max(of(True, *halves), 1)) - F.log(no / max(of(False, *halves), 1))
        return (yes > SUPPORT) & (odds > ODDS) & (odds > SIGNIFICANT * F.sqrt(1 / yes + 1 / no))

    chosen = counts.select("f", telling(0, 1).alias("all"), telling(0).alias("one"), telling(1).alias("two")).where("all or one or two").collect()
    features = sorted(r["f"] for r in chosen if r["all"])
    if not features:
        return Ordinal({}, np.full(LEVELS, np.inf))
    lexicons = [frozenset(r["f"] for r in chosen if r[half] and not r["f"].endswith("*")) for half in ("two", "one")]  # of the other half
    inside = docs.sparkSession.sparkContext.broadcast((frozenset(features), lexicons))

    def examples(batches):
        for pdf in batches:
            kept, other = inside.value
            held, dose = [], []
            for t, h in zip(pdf["text"], pdf["half"]):
                n = Counter(words(t))
                found = Counter()
                for w, k in n.items():
                    for f in word_features(w):
                        if f in kept:
                            found[f] += k
                held.append(found)
                dose.append(sum(k for w, k in n.items() if w in other[h]))
            yield frame({"toxic": pdf["toxic"].to_numpy(), "f": [list(x) for x in held], "n": [list(x.values()) for x in held], "dose": dose})

    held = rows.mapInPandas(examples, "toxic boolean, f array<string>, n array<long>, dose long").groupBy("toxic", "f", "n", "dose").count().collect()
    held.sort(key=lambda r: (r["toxic"], r["dose"], r["f"], r["n"]))
    held = [(Counter(dict(zip(r["f"], r["n"]))), r["toxic"], r["dose"]) for r in held for _ in range(r["count"])]
    toxic, dose = np.array([t for _, t, _ in held], bool), np.array([d for _, _, d in held])
    return fit([c for c, _, _ in held], grade(dose, toxic), features)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade (most severe grade with a chance of a half), toxic, p_toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pandas as pd

        m = shared.value
        for pdf in batches:
            p = np.array([m.above(m.score(t)) for t in pdf["text"]]).reshape(len(pdf), len(m.thresholds))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "severity": p.sum(1), "grade": (p >= 0.5).sum(1).astype(np.int32), "toxic": p[:, 0] >= 0.5, "p_toxic": p[:, 0]})

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, severity double, grade int, toxic boolean, p_toxic double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
