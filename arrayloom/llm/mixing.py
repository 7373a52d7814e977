"""Mixing to target weights with soft domain membership.

A classifier trained from a labelled table gives every document a posterior over domains. Document rates r >= 0 are
then fitted so that the expected domain totals, sum of r * tokens * posterior, match the targets: projected gradient
on the squared residual, where each step is one distributed pass. The gradient for a document is its posterior times the
residual (in the metric that weighs documents by tokens), so a document's rate follows from its posterior and the
list of steps taken; only domain totals and one domains x domains matrix reach the driver. The
matrix, over the documents whose rate is above 0, preconditions the step.

The classifier is softmax regression over sparse features: style of the text, words and word prefixes; a word that
occurs k times weighs 1 + ln k. It is fitted on at most `SAMPLE` labelled rows (a documented bound), with every feature that at least
`SUPPORT` of these rows have and whose log odds for a domain are over 1 and over `SIGNIFICANT` standard errors.

Decision: copies = floor(rate), plus one where a hash of doc_id falls under the fraction.

Defined cases: null text is empty; a text without tokens has posteriors like any other and a rate, but carries no
weight; without labels there is one domain; targets for domains without tokens can't be met and are left out, the
others are rescaled; rows that repeat a doc_id get the same rate; null doc_ids get rates too; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field
from math import log
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frame, read_table, worker_state

SAMPLE = 10_000
SUPPORT = 5
SIGNIFICANT = 4.0
STEPS = 60
TOLERANCE = 1e-6
TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}

CACHED = 300_000  #: words whose weights a worker keeps

# Byte tables: ASCII characters that aren't letters part words; capitals and marks are counted by deleting all other bytes.
_PARTS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))
_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_MARK = bytes(c for c in range(256) if c <= 32 or c >= 127 or chr(c).isalnum())


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the labelled table: toxic, low (quality 0) or high."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") > 0, "high")
    return labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("domain is not null")


def measure(text: str | None) -> tuple[int, Counter, list[str]]:
    """Number of tokens, the words with their counts, and the style features of a text."""
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    words = text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).decode("utf-8", "surrogatepass").split()
    counts = Counter(words)
    if not n:
        return 0, counts, []
    letters, raw = len("".join(words)), text.encode("utf-8", "surrogatepass")
    shares = {
        "letters": letters / len(text),
        "capital": len(raw.translate(None, _NOT_CAPITAL)) / max(1, letters),
        "distinct": len(counts) / n,
        "next": sum(map(eq, tokens, tokens[1:])) / n,
        "marks": len(raw.translate(None, _NOT_MARK)) / n,
    }
    return n, counts, [f"={k}:{min(9, int(10 * x))}" for k, x in shares.items()]


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k)]


def features(text: str | None) -> dict[str, float]:
    _, counts, style = measure(text)
    out = dict.fromkeys(style, 1.0)
    for w, k in counts.items():
        for f in word_features(w):
            out[f] = out.get(f, 0.0) + 1 + log(k)
    return out


@dataclass
class Softmax:
    domains: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def posterior(self, counts: Counter, style: list[str]) -> np.ndarray:
        light, heavy = worker_state("mixing", self.key, lambda: (set(), {}))  # words without weight; words with the weights of all their features
        z = self.bias.copy()
        for f in style:
            if f in self.weights:
                z += self.weights[f]
        if len(light) + len(heavy) > CACHED:
            light.clear()
            heavy.clear()
        for word in counts.keys() - light:
            w = heavy.get(word)
            if w is None:
                held = [self.weights[f] for f in word_features(word) if f in self.weights]
                if not held:
                    light.add(word)
                    continue
                w = heavy[word] = np.sum(held, axis=0)
            z += w * (1 + log(counts[word]))
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_softmax(rows: list[tuple[list[str], list[float]]], y: np.ndarray, domains: list[str], names: list[str], steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> Softmax:
    index = {f: i for i, f in enumerate(names)}
    r = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    c = np.array([index[f] for fs, _ in rows for f in fs], np.int64)
    x = np.array([k for _, ks in rows for k in ks], float)
    d, n, k = len(domains), len(rows), len(names)
    share = np.bincount(y, minlength=d) / n
    w, b = np.zeros((k, d)), np.log(share + 1e-9)
    hot = np.eye(d)[y]
    m, v = [np.zeros((k + 1, d)) for _ in range(2)]
    for t in range(1, steps + 1):
        z = np.column_stack([np.bincount(r, weights=w[c, j] * x, minlength=n) for j in range(d)]) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (hot - p) / n
        g = np.vstack((np.column_stack([np.bincount(c, weights=e[r, j] * x, minlength=k) for j in range(d)]) - ridge * w, e.sum(0)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    return Softmax(domains, {f: w[i] for f, i in index.items()}, b)


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Softmax:
    """From labelled(doc_id, domain)."""
    scratch = Scratch(docs.sparkSession, "mixing-classifier")
    total = labelled.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(total, 1)))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(share)
    rows = scratch.table(texts.join(labelled.where(share), "doc_id").select("text", "domain"), "sample")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if len(domains) < 2:
        return Softmax(domains or ["all"], {}, np.zeros(1))

    def presence(batches):
        import pandas as pd

        for pdf in batches:
            seen: dict[str, Counter] = {}
            for t, d in zip(pdf["text"], pdf["domain"]):
                seen.setdefault(d, Counter()).update(features(t).keys())
            for d, c in seen.items():
                yield pd.DataFrame({"f": list(c), "domain": d, "k": list(c.values())})

    counts = rows.mapInPandas(presence, "f string, domain string, k long").groupBy("f").agg(F.sum("k").alias("all"), *[F.sum(F.when(F.col("domain") == d, F.col("k")).otherwise(0)).alias(f"k{i}") for i, d in enumerate(domains)])
    counts = scratch.table(counts.where(F.col("all") >= SUPPORT), "counts")
    everything = sum(sizes.values())
    names = set()
    for i, d in enumerate(domains):
        inside, outside = F.col(f"k{i}") + 0.5, F.col("all") - F.col(f"k{i}") + 0.5
        odds = F.log(inside / sizes[d]) - F.log(outside / (everything - sizes[d]))
        telling = (odds > 1) & (odds > SIGNIFICANT * F.sqrt(1 / inside + 1 / outside))
        names |= {r["f"] for r in counts.where(telling | F.col("f").startswith("=")).select("f").collect()}
    kept = docs.sparkSession.sparkContext.broadcast(frozenset(names))

    def held(batches):
        for pdf in batches:
            found = [{f: k for f, k in features(t).items() if f in kept.value} for t in pdf["text"]]
            yield frame({"domain": pdf["domain"].to_numpy(), "f": [list(x) for x in found], "k": [list(x.values()) for x in found]})

    examples = rows.mapInPandas(held, "domain string, f array<string>, k array<double>").collect()
    examples.sort(key=lambda r: (r["domain"], r["f"], r["k"]))
    y = np.array([domains.index(r["domain"]) for r in examples])
    return fit_softmax([(r["f"], r["k"]) for r in examples], y, domains, sorted(names))


def posteriors(docs: DataFrame, model: Softmax) -> DataFrame:
    """doc_id, n_tokens, p: the posterior over model.domains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            n_tokens, p = [], []
            for t in pdf["text"]:  # a text's words go before the next text's come
                n, counts, style = measure(t)
                n_tokens.append(n)
                p.append(shared.value.posterior(counts, style).tolist())
            yield frame({"doc_id": pdf["doc_id"], "n_tokens": n_tokens, "p": p})

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, n_tokens long, p array<double>")


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps: from 1, along the posterior, never under 0."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r + p @ g)
    return r


def fit_rates(members: DataFrame, targets: np.ndarray, most_steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Steps of projected gradient for members(n_tokens, p) towards the domain totals."""
    d = len(targets)

    def totals(steps):
        def run(batches):
            import pandas as pd

            t, h = np.zeros(d), np.zeros((d, d))
            for pdf in batches:
                p, n = np.array(pdf["p"].tolist()).reshape(-1, d), pdf["n_tokens"].to_numpy(float)
                r = rates_of(p, steps)
                t += (r * n) @ p
                h += (p * (n * (r > 0))[:, None]).T @ p
            yield pd.DataFrame({"at": np.arange(d + d * d), "x": np.concatenate((t, h.ravel()))})

        got = members.select("n_tokens", "p").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()["x"].to_numpy()
        return (got[:d], got[d:].reshape(d, d)) if len(got) else (np.zeros(d), np.zeros((d, d)))

    steps: list[np.ndarray] = []
    before, damp = np.inf, 1.0
    while True:
        t, h = totals(steps)
        rest = targets - t
        size = float(np.linalg.norm(rest) / max(np.linalg.norm(targets), 1e-12))
        if size > before and steps:  # too far: half of the last step
            damp /= 2
            steps[-1] = steps[-1] / 2
            if damp < 1e-6:
                return steps
            before = before if len(steps) < most_steps else np.inf
            continue
        if size <= tolerance or len(steps) >= most_steps or abs(before - size) < tolerance / 10:
            return steps
        before, damp = size, 1.0
        steps.append(np.linalg.solve(h + np.eye(d) * (1e-9 * np.trace(h) + 1e-9), rest))


def copies_of(rate: Column, doc_id: Column) -> Column:
    chance = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] = TARGETS) -> tuple[list[str], DataFrame]:
    """The domains, and doc_id, n_tokens, p, rate, copies for each document; the tokens' total stays as it is."""
    scratch = Scratch(docs.sparkSession, "mixing")
    model = train(docs, labelled)
    members = scratch.table(posteriors(docs, model), "members")
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    share = np.array([weights.get(x, 0.0) for x in model.domains])
    share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / len(share))
    steps = fit_rates(members, total * share) if total else []

    def run(batches):
        for pdf in batches:
            pdf["rate"] = rates_of(np.array(pdf["p"].tolist()).reshape(len(pdf), -1), steps)
            yield pdf

    rated = members.mapInPandas(run, "doc_id long, n_tokens long, p array<double>, rate double")
    return model.domains, rated.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] = TARGETS) -> DataFrame:
    """The documents, each as often as its rate says."""
    _, rated = mix(docs, labelled, weights)
    rated = Scratch(docs.sparkSession, "mixing-rates").table(rated.where("copies > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")), "rates")
    found = docs.join(rated, docs["doc_id"].cast("long").eqNullSafe(rated["_id"]))
    return found.withColumn("_copy", F.explode(F.expr("sequence(1, _copies)"))).select(*[docs[c] for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    domains, rated = mix(docs, domain_labels(read_table(spark, sf_dir, "labels")))
    return rated.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")
