"""Packing of token sequences with a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens. Pieces are dealt evenly into blocks of about `block` pieces; each
block is a bin-packing instance of its own, evolved by several islands (one task each). An individual is a grouping
(list of bins). Crossover injects whole well-filled bins of one parent into the other, removes every bin that holds a
duplicate, and best-fits the displaced pieces; mutation empties the least-filled bins and best-fits their pieces.
After each epoch every island's elite migrates to the next island of its block. A block stops as soon as its elite
needs no more bins than ceil(tokens / capacity). Pieces of bins that end up badly filled are pooled over blocks and packed
once more.

Defined cases: null text is empty; an empty document is one piece holding the final id alone; rows that repeat a
doc_id are packed as rows of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read_table, worker_state

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 10
POPULATION = 4
CACHED = 700_000  #: words whose ids a worker keeps from one batch to the next
WELL_FILLED = 0.98  #: pieces of bins under this are pooled over blocks once


# ---------------------------------------------------------------- tokens
class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks between ASCII
    white space, one after another, and marks after letters are a word of their own. Chunks are told apart, cut into a word and its
    marks and lowered by Arrow; only different words reach Python, and what is known of them is kept from batch to batch. Unknown
    words of small letters in normal form are encoded many at a time, without the normaliser that would leave them as
    they are, and told apart by their word-end tokens; where the numbers of words and ends differ each is encoded alone by
    the full tokenizer, as is every chunk that isn't letters and marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Ids lie in one pool. words, wholes: number of a word in small letters (-1: not plain), of any other chunk or run of marks."""
        self.words: dict[str, int] = {}
        self.wholes: dict[str, int] = {}
        self.pool, self.starts, self.sizes = array("I"), array("q"), array("q")
        self.wholes[""] = self._add(b"")

    def _add(self, raw: bytes) -> int:
        self.starts.append(len(self.pool))
        self.sizes.append(len(raw) // 4)
        self.pool.frombytes(raw)
        return len(self.starts) - 1

    def _alone(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _many(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words) or stop[-1] != len(ids):
            return [self._alone(w) for w in words]
        raw, at = ids.tobytes(), [0, *(4 * stop).tolist()]
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _word_numbers(self, words: list[str]) -> np.ndarray:
        known = list(map(self.words.get, words))
        if None in known:
            new = [w for w, k in zip(words, known) if k is None]
            plain = [w for w in new if w.isalpha() and (w.isascii() or w == w.lower() and is_normalized("NFC", w))]
            self.words.update(dict.fromkeys(new, -1))
            for i in range(0, len(plain), 512):
                part = plain[i : i + 512]
                self.words.update(zip(part, map(self._add, self._many(part))))
            known = list(map(self.words.get, words))
        return np.array(known, dtype=np.int64)

    def _whole_numbers(self, chunks: list[str]) -> np.ndarray:
        wholes = self.wholes
        for c in chunks:
            if c not in wholes:
                wholes[c] = self._add(self._alone(c))
        return np.array(list(map(wholes.__getitem__, chunks)), dtype=np.int64)

    def _numbers(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk of a large_string array the numbers of its word (or of the whole chunk) and of its marks."""
        import pyarrow as pa
        import pyarrow.compute as pc

        strings = lambda a: a.to_numpy(zero_copy_only=False).tolist()
        words = pc.utf8_rtrim(chunks, characters=_MARKS)
        letters = pc.ascii_is_alpha(words)
        low = pc.if_else(letters, pc.ascii_lower(words), words)
        maybe = pc.or_(letters, pc.invert(pc.string_is_ascii(words))).to_numpy(zero_copy_only=False)
        coded = low.filter(pa.array(maybe)).dictionary_encode()
        first = np.full(len(chunks), -1, np.int64)
        first[maybe] = self._word_numbers(strings(coded.dictionary))[coded.indices.to_numpy()]
        # the marks: what follows the word in the chunk's bytes
        edge = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        ahead = pc.binary_length(words).to_numpy()
        rest = np.where(first >= 0, edge[1:] - edge[:-1] - ahead, 0)
        stop = np.concatenate(([0], np.cumsum(rest)))
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[np.repeat(edge[:-1] + ahead - stop[:-1], rest) + np.arange(stop[-1])] if stop[-1] else np.zeros(0, np.uint8)
        marks = pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(stop), pa.py_buffer(data)).dictionary_encode()
        second = self._whole_numbers(strings(marks.dictionary))[marks.indices.to_numpy()]
        odd = np.flatnonzero(first < 0)
        first[odd] = self._whole_numbers(strings(chunks.take(pa.array(odd))))
        return first, second

    def encode_all(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        for c in "\t\n\x0b\x0c\r":
            texts = [t.replace(c, " ") if c in t else t for t in texts]
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        if len(self.starts) > CACHED:
            self._clear()
        both = np.stack(self._numbers(coded.dictionary), axis=1)[coded.indices.to_numpy()].ravel()
        many = np.frombuffer(self.sizes, dtype=np.int64)[both]
        stop = np.concatenate(([0], np.cumsum(many)))
        start = np.frombuffer(self.starts, dtype=np.int64)[both] - stop[:-1]
        out = np.frombuffer(self.pool, dtype="<u4")[np.repeat(start, many) + np.arange(stop[-1])] if stop[-1] else np.zeros(0, "<u4")
        edge = stop[2 * lists.offsets.to_numpy().astype(np.int64)].tolist()
        return [out[x:y].tobytes() for x, y in zip(edge, edge[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: ASCII marks but ' and <: after letters they are a word of their own (' starts contractions, < special tokens).
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<")

def encoder(path: str) -> Encoder:
    return worker_state("packing", path, lambda: Encoder(path))


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, deal (an even random number)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        enc, n = encoder(tokenizer), 0
        seed = TaskContext.get().partitionId() << 32
        for pdf in batches:
            out, texts, doc_ids = [], pdf["text"].tolist(), pdf["doc_id"].tolist()
            for i in range(0, len(texts), 4096):
                for doc_id, ids in zip(doc_ids[i : i + 4096], enc.encode_all([t or "" for t in texts[i : i + 4096]])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                made["doc_id"] = made["doc_id"].astype("Int64")
                made["deal"] = np.arange(n, n + len(made)) + seed
                n += len(made)
                yield made

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


# ---------------------------------------------------------------- grouping genetic algorithm
class Bins:
    """Best fit over whole-number sizes: open bins by free space, the free spaces in use as bits of one number."""

    def __init__(self, capacity: int):
        self.capacity, self.bits, self.by_free = capacity, 0, [[] for _ in range(capacity + 1)]
        self.bins: list[list[int]] = []

    def open(self, items: list[int], free: int) -> None:
        self.by_free[free].append(len(self.bins))
        self.bits |= 1 << free
        self.bins.append(items)

    def add(self, item: int, size: int) -> None:
        fits = self.bits >> size
        if not fits:
            self.open([item], self.capacity - size)
            return
        free = size + (fits & -fits).bit_length() - 1
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.bins[at].append(item)
        self.by_free[free - size].append(at)
        self.bits |= 1 << (free - size)


def best_fit(sizes: list[int], items, capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    b = Bins(capacity)
    for x in start:
        b.open(list(x), capacity - sum(sizes[i] for i in x))
    for i in items:
        b.add(i, sizes[i])
    return b.bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller and emptier ones rather than even ones."""
    return -len(bins), sum((sum(sizes[i] for i in x) / capacity) ** 2 for x in bins)


def crossover(mother, father, sizes: list[int], capacity: int, rng) -> list[list[int]]:
    filled = np.array([sum(sizes[i] for i in x) for x in father])
    good = np.flatnonzero(filled >= np.quantile(filled, 0.5))
    chosen = rng.choice(good, size=max(1, len(good) // 4), replace=False)
    injected = [father[k] for k in chosen.tolist()]
    inside = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in mother:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in inside]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, capacity, kept + injected)


def mutate(bins, sizes: list[int], capacity: int, rng) -> list[list[int]]:
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    n = max(2, len(bins) // 50)
    out = set(order[:n]) | set(rng.integers(0, len(bins), n).tolist())
    freed = [i for k in out for i in bins[k]]
    freed.sort(key=lambda i: -sizes[i] - rng.integers(0, 1 + capacity // 64))
    return best_fit(sizes, freed, capacity, [x for k, x in enumerate(bins) if k not in out])


def least_bins(sizes, capacity: int) -> int:
    return -(-int(sum(sizes)) // capacity)


def encode_bins(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, x in enumerate(bins):
        for i in x:
            out[i] = k
    return out


def decode_bins(of: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(of):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


def evolve(sizes: list[int], population: list[list[list[int]]], capacity: int, generations: int, rng) -> list[list[list[int]]]:
    """The population after some generations, best first."""
    score = lambda b: fitness(b, sizes, capacity)
    population = sorted(((score(b), b) for b in population), key=lambda x: x[0], reverse=True)
    least = least_bins(sizes, capacity)
    for _ in range(generations):
        if -population[0][0][0] <= least:
            break
        a, b = rng.choice(len(population), 2, replace=len(population) < 2).tolist()
        child = crossover(population[min(a, b)][1], population[max(a, b)][1], sizes, capacity, rng)
        child = mutate(child, sizes, capacity, rng)
        s = score(child)
        if s > population[-1][0]:
            population[-1] = (s, child)
            population.sort(key=lambda x: x[0], reverse=True)
    return [b for _, b in population]


def first_population(sizes: list[int], capacity: int, many: int, rng) -> list[list[list[int]]]:
    """Best fit by falling size, then the same with sizes slightly disturbed; alone if that is optimal."""
    out = [best_fit(sizes, range(len(sizes)), capacity)]
    while len(out) < many and len(out[0]) > least_bins(sizes, capacity):
        noise = rng.integers(0, capacity // 16, len(sizes))
        out.append(best_fit(sizes, np.argsort(-(np.array(sizes) + noise), kind="stable").tolist(), capacity))
    return out


# ---------------------------------------------------------------- distribution
_STATE = "block long, island int, sizes array<int>, people array<array<int>>, bins long, fill double, done boolean"
_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _sorted(pdf):
    return pdf.sort_values(_ORDER, ascending=[False, True, True, True, True], kind="stable", na_position="first", ignore_index=True)


def _row(block, island, sizes, people, capacity):
    n, f = fitness(people[0], sizes, capacity)
    return block, island, sizes, [encode_bins(b, len(sizes)) for b in people], -n, f, -n <= least_bins(sizes, capacity)


def pack_pieces(pieces: DataFrame, scratch: Scratch, name: str, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """The pieces (a written table) with block, bin, offset and fill."""
    import pandas as pd

    blocks = max(1, math.ceil(pieces.count() / block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("deal"), F.lit(blocks)))
    columns = ["block", "island", "sizes", "people", "bins", "fill", "done"]

    def start(key, pdf):
        sizes = _sorted(pdf)["length"].astype(int).tolist()
        rows = []
        for k in range(islands):
            people = first_population(sizes, capacity, population, np.random.default_rng([key[0], k]))
            rows.append(_row(key[0], k, sizes, people, capacity))
            if rows[-1][-1]:
                break
        return pd.DataFrame(rows, columns=columns)

    state = scratch.table(dealt.select("block", *_ORDER).groupBy("block").applyInPandas(start, _STATE), f"{name}-0")
    finished = state.where("done").select("block", "bins", "fill", F.col("people")[0].alias("best"))
    open_ = state.where("not done")

    def epoch_step(epoch):
        def step(key, pdf):
            own = pdf[pdf["own"]]
            if own.empty:  # an elite came to an island that had already ended
                return pd.DataFrame([], columns=columns)
            own = own.iloc[0]
            sizes = [int(x) for x in own["sizes"]]
            people = [decode_bins(p) for x in ([own["people"]], pdf[~pdf["own"]]["people"]) for ps in x for p in ps]
            people = people[: population + 1]
            people = evolve(sizes, people, capacity, generations, np.random.default_rng([key[0], key[1], epoch]))
            return pd.DataFrame([_row(key[0], key[1], sizes, people[:population], capacity)], columns=columns)

        return step

    for epoch in range(epochs):
        moved = open_.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.lit(None).cast("array<int>").alias("sizes"), F.slice("people", 1, 1).alias("people"), "bins", "fill", "done", F.lit(False).alias("own"))
        both = open_.withColumn("own", F.lit(True)).union(moved) if epoch else open_.withColumn("own", F.lit(True))
        open_ = scratch.table(both.groupBy("block", "island").applyInPandas(epoch_step(epoch), _STATE), f"{name}-{epoch + 1}")
    elite = open_.select("block", "bins", "fill", F.col("people")[0].alias("best")).union(finished)
    elite = elite.groupBy("block").agg(F.max_by("best", F.struct(-F.col("bins"), F.col("fill"))).alias("best"))

    def place(left, right):
        pdf = _sorted(left)
        pdf["bin"] = np.asarray(right["best"].iloc[0], dtype=np.int64)
        groups = pdf.groupby("bin")["length"]
        pdf["offset"] = groups.cumsum() - pdf["length"]
        pdf["filled"] = groups.transform("sum")
        return pdf

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long, block long, bin long, offset long, filled long"
    return dealt.groupBy("block").cogroup(elite.groupBy("block")).applyInPandas(lambda a, b: place(a, b)[[f.split()[0] for f in fields.split(", ")]], fields)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(tokenize(docs, tokenizer, capacity), "pieces")
    first = scratch.table(pack_pieces(pieces, scratch, "blocks", capacity, block), "first")
    poor = F.col("filled") < int(WELL_FILLED * capacity)
    pool = scratch.table(first.where(poor).select("doc_id", "piece", "start", "length", "ids_crc32", "deal"), "pool")
    second = pack_pieces(pool, scratch, "pool-blocks", capacity, block)
    number = lambda df, half: df.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("block") * 1_048_576 + F.col("bin") * 2 + half).alias("sequence_id"), "offset")
    return number(first.where(~poor), 0).union(number(second, 1))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())


def pieces_of(encoder_: Encoder, text: str | None, capacity: int = CAPACITY) -> Iterator[bytes]:
    """The pieces of one text, for checks."""
    ids = encoder_.encode(text or "") + b"\0\0\0\0"
    for at in range(0, len(ids), 4 * capacity):
        yield ids[at : at + 4 * capacity]
