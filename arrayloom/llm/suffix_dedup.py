"""Removal of long repeated substrings by distributed prefix doubling over sampled suffixes.

Which bytes are covered by a `least`-byte string that also starts anywhere else? Classic prefix doubling ranks every
position by its first byte, then re-ranks (rank, rank at the offset) pairs at growing offsets until ranks are unique or
the threshold is passed. Doing so for every byte position would shuffle tens of bytes per byte of text in each of nine
rounds, so this operator keeps the scheme but thins out positions without losing any repeat:

* Ranks are fingerprints of the substring (equal substrings have equal ranks), so that re-ranking needs no global order,
  only grouping: a rank that occurs once is unique and leaves.
* Positions start as *anchors*. Of the `gram`-byte strings in a `least`-byte window, the one with the least
  fingerprint (the last of equal ones) is the window's anchor. Equal windows have their anchors at the same distance,
  so a window can only be repeated if its anchor's string is. Anchors are about one in 140 bytes.
* Round 0 ranks anchors by `gram` bytes. Anchors with a unique rank leave. Then windows are ranked in blocks of
  distances from the anchor that get narrower each round (whole, 91, 13, 1): a block's *common* part lies in all its
  windows and grows each round from `gram` towards `least` bytes; its *whole* part covers all of them. A unique common
  part means that none of the windows is repeated; a repeated whole part means that all are. Only blocks that are
  neither go to the next, longer ranks; at width 1 both parts are the window itself, which decides.

Groups are only ever counted (map-side combined) and joined with counts; a passage that a third of all documents share
is one key of those counts. Texts that have any repeated anchor are read once more behind a fixed-size filter.

Beside the removal at `least` bytes, which the contract fixes, the operator tells which documents hold a passage of more than
`PASSAGE` words that another document holds too (whatever its bytes: short words make such passages shorter than 400 bytes).
The same scheme runs over words instead of bytes: anchors are word grams, ranked by gram, then by all windows of an anchor
together, then, for texts that these leave undecided, window by window.

Defined cases: null text is empty; texts under `least` bytes lose nothing; equal texts, also under one doc_id, count as
separate occurrences; invalid surrogates are kept as bytes; other columns are ignored; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frame, hasher, id_filter, in_filter, mix, read_table, text_or_empty

LEAST = 400
GRAM = 128
WIDTHS = (91, 13, 1)
PASSAGE = 50  #: words; longer passages that documents share are told
WORD_GRAM = 16

KEY = ["fp", "n"]


def sampled(data: np.ndarray, sums: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: position, fingerprint of its gram, first and last window it stands for."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none.view(np.uint64), none, none
    h = hasher().every(sums, gram)
    low = h & np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(h), -1, dtype=np.uint64)
    width, have = least - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    pos = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    last = np.concatenate((first[1:], [len(pos)])) - 1
    q = pos[first]
    return q, h[q], first, last


def blocks(sums: np.ndarray, n: int, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, least: int, gram: int):
    """For each anchor and range of distances: the width-blocks that meet it, with common and whole ranks (whole 0: leaves the text)."""
    reach = least - gram
    j0, j1 = lo // width, hi // width
    many = j1 - j0 + 1
    of = np.repeat(np.arange(len(q)), many)
    j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + j0[of]
    u = j * width
    v = np.minimum(u + width - 1, reach)
    a, b = q[of] - v, q[of] - u + least
    inside = (a >= 0) & (b <= n)
    h, tag = hasher(), mix((j + 1).astype(np.uint64) * np.uint64(2 * width + 1))
    whole = np.where(inside, mix(h.span(sums, np.maximum(a, 0), np.minimum(b, n)) ^ tag), np.uint64(0))
    # windows of this block that lie in the text have the common part in the text; clip it for the others
    common = mix(h.span(sums, np.maximum(q[of] - u, 0), np.minimum(q[of] - v + least, n)) ^ tag)
    return of, common.view(np.int64), whole.view(np.int64), np.maximum(lo[of], u), np.minimum(hi[of], v)


_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_or_empty().alias("text")).select(F.xxhash64("text").alias("fp"), F.octet_length("text").cast("long").alias("n"), "text")


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _stacked(parts: list[tuple], once: tuple[str, ...], each: tuple[str, ...]):
    """One frame for many parts: a tuple of values that hold for all rows of a part, and a tuple of its columns."""
    import pandas as pd

    sizes = [len(x[0]) for _, x in parts]
    columns = {c: np.repeat(np.array([x[i] for x, _ in parts], bool if c in ("word", "open") else np.int64), sizes) for i, c in enumerate(once)}
    return pd.DataFrame(columns | {c: np.concatenate([np.zeros(0, np.int64), *(x[i] for _, x in parts)]) for i, c in enumerate(each)})


def _anchors(docs: DataFrame, least: int, gram: int, words: int, word_gram: int) -> DataFrame:
    """One pass over the texts: anchors of byte windows and (word) of windows of words; common: rank of the gram, whole: of all its windows together."""
    texts = _texts(docs).withColumn("doc", F.monotonically_increasing_id()).where(F.col("n") >= min(least, 2 * words - 1))

    def run(batches):
        for pdf in batches:
            parts: list[tuple] = []
            for fp, n, text, doc in zip(pdf["fp"], pdf["n"], pdf["text"], pdf["doc"]):
                data = _bytes(text)
                h = hasher()
                sums = h.sums(data)
                for word, s, size, k in ((False, sums, least, gram), (True, word_sums(data, sums), words, word_gram)):
                    q, common, first, last = sampled(s[1:], s, size, k)
                    if len(q):
                        whole = h.span(s, first, last + size)
                        if word:  # windows at other distances are other windows
                            whole = mix(whole ^ (q - first).astype(np.uint64))
                        parts.append(((word, fp, n, doc), (common.view(np.int64), whole.view(np.int64), q, q - last, q - first)))
            yield _stacked(parts, ("word", "fp", "n", "doc"), ("common", "whole", "q", "lo", "hi"))

    return texts.mapInPandas(run, "word boolean, fp long, n long, doc long, common long, whole long, q int, lo int, hi int")


def _next(rows: DataFrame, scratch: Scratch, name: str, last: bool) -> tuple[DataFrame, DataFrame]:
    """Ranks once: runs that are repeated, and the blocks that go on. rows: a table of common, whole, fp, n, q, lo, hi, m, open."""
    same = scratch.table(rows.where("whole <> 0").groupBy("whole").agg(F.sum("m").alias("w")).where("w > 1").select("whole", F.lit(True).alias("again")), f"{name}-whole")
    judged = scratch.table(rows.join(same, "whole", "left").withColumn("again", F.coalesce("again", F.lit(False))), f"{name}-judged")
    runs = judged.where("open and again").select(*KEY, "q", "lo", "hi")
    if last:
        return runs, None
    judged = judged.withColumn("open", F.col("open") & ~F.col("again"))
    live = judged.groupBy("common").agg(F.sum("m").alias("c"), F.max("open").alias("any")).where("c > 1 and any").select("common")
    live = scratch.table(live, f"{name}-live")
    return runs, scratch.table(judged.join(live, "common", "left_semi").select(*KEY, "q", "lo", "hi", "m", "open"), f"{name}-open")


def _narrow(blocks_: DataFrame, texts: DataFrame, width: int, least: int, gram: int) -> DataFrame:
    grouped = blocks_.groupBy(*KEY).agg(F.collect_list(F.struct("q", "lo", "hi", "m", "open")).alias("b"))
    grouped = grouped.select(*KEY, *[F.col("b")[c].alias(c) for c in ("q", "lo", "hi", "m", "open")])

    def run(batches):
        for pdf in batches:
            parts: list[tuple] = []
            for r in pdf.itertuples(index=False):
                data = np.frombuffer(r.data, np.uint8)
                q, lo, hi = (np.asarray(x, np.int64) for x in (r.q, r.lo, r.hi))
                of, common, whole, lo, hi = blocks(hasher().sums(data), len(data), q, lo, hi, width, least, gram)
                parts.append(((r.fp, r.n), (common, whole, q[of], lo, hi, np.asarray(r.m, np.int64)[of], np.asarray(r.open, np.int64)[of])))
            out = _stacked(parts, KEY, ("common", "whole", "q", "lo", "hi", "m", "open"))
            out["open"] = out["open"].astype(bool)
            yield out

    return grouped.join(texts, KEY).mapInPandas(run, "fp long, n long, common long, whole long, q int, lo int, hi int, m long, open boolean")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching intervals."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return start[new], stop[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(stop) - 1]))]


def repeated_spans(docs: DataFrame, anchors: DataFrame, scratch: Scratch, least: int = LEAST, gram: int = GRAM, widths=WIDTHS) -> tuple[DataFrame, DataFrame]:
    """(fp, n, starts, stops) of each distinct text that has removed runs, and the texts (fp, n, data) these need."""
    rows = anchors.where("not word")
    again = scratch.table(rows.groupBy("common").count().where("count > 1").select("common"), "again")
    rows = rows.join(again, "common").groupBy("common", "whole", *KEY, "q", "lo", "hi").agg(F.count(F.lit(1)).alias("m")).withColumn("open", F.lit(True))
    rows = scratch.table(rows, "rank-0")
    scratch.drop("again")
    wanted = scratch.table(rows.select(*KEY).distinct(), "wanted")
    table = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "fp"))

    def read(batches):
        for pdf in batches:
            pdf = pdf[in_filter(table.value, pdf["fp"].to_numpy())]
            yield frame({"fp": pdf["fp"].to_numpy(), "n": pdf["n"].to_numpy(), "data": [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]})

    texts = _texts(docs).where(F.col("n") >= least).mapInPandas(read, "fp long, n long, data binary")
    texts = scratch.table(texts.groupBy(*KEY).agg(F.first("data").alias("data")).join(wanted, KEY, "left_semi"), "texts")
    found, blocks_ = _next(rows, scratch, "rank-0", False)
    for i, width in enumerate(widths, 1):
        rows = scratch.table(_narrow(blocks_, texts, width, least, gram), f"rank-{i}")
        runs, blocks_ = _next(rows, scratch, f"rank-{i}", width == 1)
        scratch.drop(f"rank-{i}", f"rank-{i - 1}-open")
        found = found.union(runs)

    spans = found.select(*KEY, (F.col("q") - F.col("hi")).alias("s"), (F.col("q") - F.col("lo") + least).alias("e")).groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("x"))
    return spans.select(*KEY, F.col("x.s").alias("starts"), F.col("x.e").alias("stops")), texts


def word_sums(data: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Prefix sums over the fingerprints of a text's words."""
    edge = np.flatnonzero(np.diff(_white[data], prepend=True, append=True))
    h = hasher()
    words = h.span(sums, edge[0::2], edge[1::2])
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * h.power[: len(words)], out=out[1:])
    return out


def sharing(docs: DataFrame, anchors: DataFrame, scratch: Scratch, words: int = PASSAGE + 1, gram: int = WORD_GRAM) -> DataFrame:
    """fp: the distinct texts with a run of `words` words or more that another document has too."""

    def several(df, key):
        return df.groupBy(key).agg(F.min("doc").alias("lo"), F.max("doc").alias("up")).where("lo <> up").select(key)

    rows = anchors.where("word").select(F.col("common").alias("gram"), "whole", "doc", "fp")
    rows = scratch.table(rows.join(scratch.table(several(rows, "gram"), "word-grams"), "gram", "left_semi"), "word-rank-0")
    found = scratch.table(rows.join(scratch.table(several(rows, "whole"), "word-wholes"), "whole", "left_semi").select("fp").distinct(), "word-found")
    left = scratch.table(rows.join(found, "fp", "left_anti").select("gram").distinct(), "word-left")
    wanted = scratch.table(rows.select("gram", "fp").distinct().join(left, "gram", "left_semi"), "word-wanted")
    table = docs.sparkSession.sparkContext.broadcast((id_filter(wanted, "fp"), id_filter(left, "gram")))
    texts = _texts(docs).withColumn("doc", F.monotonically_increasing_id()).where(F.col("n") >= 2 * words - 1)

    def windows(batches):
        for pdf in batches:
            pdf, parts = pdf[in_filter(table.value[0], pdf["fp"].to_numpy())], []
            for doc, fp, text in zip(pdf["doc"], pdf["fp"], pdf["text"]):
                data = _bytes(text)
                sums = word_sums(data, hasher().sums(data))
                q, name, first, last = sampled(sums[1:], sums, words, gram)
                open_ = in_filter(table.value[1], name.view(np.int64))
                many = last[open_] - first[open_] + 1
                at = np.arange(many.sum()) + np.repeat(first[open_] - np.cumsum(many) + many, many)
                parts.append(((doc, fp), (hasher().span(sums, at, at + words).view(np.int64),)))
            yield _stacked(parts, ("doc", "fp"), ("window",))

    last = scratch.table(texts.mapInPandas(windows, "doc long, fp long, window long"), "word-windows")
    again = last.join(scratch.table(several(last, "window"), "word-again"), "window", "left_semi").select("fp").distinct()
    return scratch.table(found.union(again).distinct(), "word-sharing")


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, widths=WIDTHS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed runs (starts, stops) and shares_passage (1 or 0) of each document."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    anchors = scratch.table(_anchors(docs, least, gram, PASSAGE + 1, WORD_GRAM), "anchors")
    spans, texts = repeated_spans(docs, anchors, scratch, least, gram, widths)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                s, e = merged(np.asarray(r.starts, np.int64), np.asarray(r.stops, np.int64))
                edges = [0, *np.column_stack((s, e)).ravel().tolist(), len(r.data)]
                kept = hashlib.sha256()
                for a, b in zip(edges[0::2], edges[1::2]):
                    kept.update(r.data[a:b])
                out.append((r.fp, r.n, int((e - s).sum()), len(s), kept.hexdigest(), s.tolist(), e.tolist()))
            yield pd.DataFrame(out, columns=["fp", "n", "n_removed", "n_spans", "kept", "starts", "stops"])

    cut = scratch.table(spans.join(texts, KEY).mapInPandas(run, "fp long, n long, n_removed long, n_spans long, kept string, starts array<long>, stops array<long>"), "cut")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    each = each.select("doc_id", F.xxhash64("text").alias("fp"), F.octet_length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("all"))
    none = F.array().cast("array<long>")
    zero = F.lit(0).cast("long")
    shared = sharing(docs, anchors, scratch).withColumn("shares_passage", F.lit(1))
    each = each.join(cut, KEY, "left").join(shared, "fp", "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(0)))
    return each.select("doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "all").alias("kept_sha256"), F.coalesce("starts", none).alias("starts"), F.coalesce("stops", none).alias("stops"), "shares_passage")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")
