"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A letter trigram (word borders are a symbol of
their own) is bound as the product of its letters' vectors, each rotated by its place. A text's vector is the sum of its
trigrams' vectors; a language's prototype bundles the texts that carry its label, each with the same total weight. A
text gets the language whose prototype has the largest cosine with it (ties: the least name); the score is that cosine,
cut at 0.

Training sums are whole numbers, so the model doesn't depend on partitioning. The model (languages x dimensions) is all
that reaches the driver.

Defined cases: null text and text without a letter give `und` and 0.0, as does every text when nothing was learned; a
null doc_id is not held out; null labels teach nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, worker_state

DIMENSIONS = 1024
SEED = 11
WEIGHT = 1 << 24  #: of one text in its language's bundle
CACHED = 40_000  #: trigram vectors kept in each worker (1 byte a dimension)
LETTERS = 4_096  #: letter vectors kept in each worker
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams of a text, and how often each occurs."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(cp) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cp = np.where(_is_letter()[cp], cp, np.uint64(0))
    cp = np.concatenate(([0], cp, [0])).astype(np.uint64)
    cp = cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))]
    if len(cp) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = (cp[:-2] << np.uint64(42) | cp[1:-1] << np.uint64(21) | cp[2:])[cp[1:-1] != 0]
    code.sort()
    edge = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
    return code[edge[:-1]], np.diff(edge)


class Space:
    """Vectors of letters and trigrams. Trigram vectors are kept in a buffer that doubles; `codes` is sorted, `at` has their places in it."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.codes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = np.empty((1024, self.d), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            rng = np.random.Generator(np.random.PCG64([self.seed, cp]))
            self.letters[cp] = rng.integers(0, 2, self.d, dtype=np.int8) * np.int8(2) - np.int8(1)
        return self.letters[cp]

    def bind(self, codes: np.ndarray, out: np.ndarray) -> None:
        low = (1 << 21) - 1
        for i, c in enumerate(codes.tolist()):
            out[i] = np.roll(self.letter(c >> 42), 2) * np.roll(self.letter(c >> 21 & low), 1) * self.letter(c & low)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """int8 rows of the sorted, distinct codes."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) + len(new) > CACHED:
                self.clear()
                new = codes
            n, m = len(self.codes), len(self.codes) + len(new)
            if m > len(self.rows):
                grown = np.empty((max(m, min(CACHED, 2 * len(self.rows))), self.d), np.int8)
                grown[:n] = self.rows[:n]
                self.rows = grown
            self.bind(new, self.rows[n:m])
            place = np.searchsorted(self.codes, new)
            self.codes, self.at = np.insert(self.codes, place, new), np.insert(self.at, place, np.arange(n, m))
        return self.rows[self.at[np.searchsorted(self.codes, codes)]]

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self.d)
        for i in range(0, len(codes), 4096):
            total += weights[i : i + 4096].astype(np.float64) @ self.vectors(codes[i : i + 4096]).astype(np.float64)
        return total

    def text(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.d, np.float32)
        for i in range(0, len(codes), 4096):
            total += counts[i : i + 4096].astype(np.float32) @ self.vectors(codes[i : i + 4096]).astype(np.float32)
        return total


def space(dimensions: int, seed: int) -> Space:
    return worker_state("language_id", (dimensions, seed), lambda: Space(dimensions, seed))


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray  #: unit rows
    dimensions: int = DIMENSIONS
    seed: int = SEED

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = trigrams(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        v = space(self.dimensions, self.seed).text(codes, counts)
        cosine = (self.prototypes * v).sum(axis=1) / max(float(np.linalg.norm(v)), 1e-12)  # row by row, so that equal prototypes tie
        best = int(np.argmax(cosine))
        return self.languages[best], float(min(1.0, max(0.0, cosine[best])))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text: str = "text", label: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> Model:
    """Prototypes from all rows that have a label and a letter."""

    def bundles(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        out: dict[str, np.ndarray] = {}

        def flush(lang):
            codes, weights = held.pop(lang)
            out[lang] = out.get(lang, 0) + space(dimensions, seed).bundle(codes, weights)

        for pdf in batches:
            for lang, rows in pdf.groupby("label"):
                parts = [held[lang]] if lang in held else []
                for t in rows["text"]:
                    codes, counts = trigrams(t)
                    if len(codes):
                        parts.append((codes, counts * WEIGHT // counts.sum()))
                if parts:
                    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    held[lang] = codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(np.float64))
                    if len(codes) > 200_000:
                        flush(lang)
        for lang in list(held):
            flush(lang)
        if out:
            yield pd.DataFrame({"label": list(out), "v": [v.astype(np.int64) for v in out.values()]})

    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("label is not null and text is not null")
    sums = rows.mapInPandas(bundles, "label string, v array<long>").select("label", F.posexplode("v").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    found = sums.toPandas()
    languages = sorted(found["label"].unique())
    table = np.zeros((len(languages), dimensions))
    table[[languages.index(x) for x in found["label"]], found["at"].to_numpy(dtype=np.int64)] = found["v"].to_numpy(dtype=np.float64)
    norms = np.linalg.norm(table, axis=1, keepdims=True) if languages else np.ones((0, 1))
    return Model(languages, (table / np.where(norms == 0, 1, norms)).astype(np.float32), dimensions, seed)


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> (lang_pred, score). Only the text goes to Python, and only the answer comes back."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score."""
    found = predictor(docs.sparkSession, model)(docs[text].cast("string"))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], found.alias("found"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "found.lang_pred", "found.score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is known; trained on their own labels. A document without a letter is rejected.

    Without a label to learn from, all documents with a letter stay.
    """
    model = train(docs.where(~held_out(docs["doc_id"])))
    if model.languages:
        return docs.where(predictor(docs.sparkSession, model)(docs["text"].cast("string"))["lang_pred"] != UNKNOWN)

    @F.pandas_udf("boolean")
    def lettered(text: pd.Series) -> pd.Series:
        return pd.Series([len(trigrams(t)[0]) > 0 for t in text], dtype=bool)

    return docs.where(lettered(docs["text"].cast("string")))
