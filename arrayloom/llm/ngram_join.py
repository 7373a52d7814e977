"""Exact n-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles, as 64-bit fingerprints. Documents with one token set form a class;
classes are what is joined, and copies are never expanded into pairs. A set of n tokens can link at threshold t
only if at most e = n - ceil(t n) of its tokens are missing from the other set.

* Sieve. A fixed share of all tokens (the least fingerprints, twice 1 - t of them) is counted exactly over all documents,
  with map-side minima and maxima of class ids. A class with more than e tokens that no other class holds can't link
  and leaves. Most documents of a varied corpus do.
* Exact counts of all tokens are then taken among the classes that are left. Tokens are ordered by count. Those held by
  at most `RARE` classes make the rare class; the others are frequent and are dealt, by fingerprint, into sub-classes.
* Prefixes. A rare token in the prefix is a signature of its own; of a frequent sub-class every pair of
  prefix tokens is one. The prefix is extended until
  unshared + rare + sum over sub-classes of (tokens - 1) >= e + 1, so two sets that link share a signature.
  The number of sub-classes depends on the size band; sets close to a band's lower edge emit for both bands.
* Candidates. Within a signature all holders are first verified against one hub, the holder with the smallest share of
  rare tokens; then the hub is done. Classes linked so far are merged, and signatures whose other holders are still in several
  components get a new hub among them, round after round, until the pairs left between components are few for the size of the
  index, or a round doesn't halve them. What is left then is paired within bands of size, so no link is lost and pairs
  inside a component are never made. Sizes, the numbers of unshared tokens and parity bits rule out pairs before they are verified.
* Verification compares whole token sets.

Hot signatures are only met in grouped minima and in joins of written tables, which adaptive execution can split.
Fingerprints of 64 bits name tokens, and class ids are the first 8 of 16 digest bytes; `classes` fails loudly should two
digests share an id.

Defined cases: null text is empty; a text with fewer words than a shingle is one token; empty token sets link with
nothing; rows that repeat a doc_id or have a null one are documents each; a component without any doc_id has a null id;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, frame, hasher, id_filter, in_filter, mix, numbered, own_columns, read_table, row_per_id

WORDS = 16  #: 64-bit words of parity bits for each class
RARE = 16  #: tokens that more classes hold are indexed in pairs
SMALL = 128  #: pairs between components, for each row of the index, up to which all are compared by size and bits at once

_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted fingerprints of the distinct k-word shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_lower), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _white[data], [True])).astype(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    h = hasher()
    words = h.span(h.sums(data), start, stop)
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(out)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def missable(n, percent: int):
    """How many of n tokens may be outside the other set at most."""
    return n - (percent * n + 99) // 100


def links(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def signatures(tokens: np.ndarray, counts: np.ndarray, n: int, cut: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of single rare tokens, and of pairs of frequent ones. tokens: those of n that other sets hold too."""
    none = np.zeros(0, np.int64)
    e = missable(n, percent)
    need = e + 1 - (n - len(tokens))
    if need <= 0 or n < 2 or e == 0 and missable_other(n, percent) <= n:  # it can't link, or only with itself
        return none, none
    few = counts <= cut
    rare, c = tokens[few], counts[few]
    if len(rare) >= need:
        return rare[np.lexsort((rare, c))[:need]].view(np.int64), none
    often, c = tokens[~few], counts[~few]
    often = often[np.lexsort((often, c))]
    pairs = []
    for b in {size_band(n), size_band(max(1, -(-percent * n // 100)))}:
        sub = (mix(often + np.uint64(b + 1)) % np.uint64(1 << b)).astype(np.int64)
        gain, groups = len(rare), {}
        for x, s in zip(often.tolist(), sub.tolist()):
            if gain >= need:
                break
            gain += s in groups
            groups.setdefault(s, []).append(x)
        for members in groups.values():
            if len(members) > 1:
                v = np.sort(np.array(members, np.uint64))
                i, j = np.triu_indices(len(v), 1)
                pairs.append(mix(mix(v[i] + np.uint64(b)) * np.uint64(3) + v[j]).view(np.int64))
    return rare.view(np.int64), np.concatenate(pairs) if pairs else none


def missable_other(n: int, percent: int) -> int:
    """The largest size of a set that can link with one of n tokens."""
    return 100 * n // percent


def size_band(n: int) -> int:
    """log2 of the number of sub-classes: at most an eighth of the tokens, so that the prefix can always be extended far enough."""
    return max(0, (n // 8).bit_length() - 1)


# ---------------------------------------------------------------- passes over the texts
def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, hi, lo: size and digest of each document's token set."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(len(s), *digest(s)) for s in (shingles(t, k) for t in pdf["text"])]
            out = pd.DataFrame(rows, columns=["n", "hi", "lo"], dtype=np.int64)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return _texts(docs).mapInPandas(run, "doc_id long, n int, hi long, lo long")


def _unshared(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """cls, alone: how many of a class's counted tokens no other class holds (none: no row)."""
    limit = np.uint64(min(2 * (100 - percent), 100) * ((1 << 64) // 100) - 1)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            made = [shingles(t, k) for t in pdf["text"]]
            counted = [s[: np.searchsorted(s, limit, "right")] for s in made]
            cls = np.repeat(np.array([digest(s)[0] for s in made], np.int64), [len(c) for c in counted])
            yield pd.DataFrame({"token": np.concatenate([np.zeros(0, np.uint64), *counted]).view(np.int64), "cls": cls})

    tokens = _texts(docs).mapInPandas(run, "token long, cls long")
    held = tokens.groupBy("token").agg(F.min("cls").alias("cls"), F.max("cls").alias("up"))
    return held.where("cls = up").groupBy("cls").agg(F.count(F.lit(1)).alias("alone"))


def classes(scan: DataFrame) -> DataFrame:
    """One row per distinct token set: cls, rep (least doc_id), n."""
    found = scan.where("n > 0").groupBy(F.col("hi").alias("cls")).agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("lo").alias("hi_lo"), F.min("n").alias("least"))
    return found.withColumn("cls", F.when((F.col("lo") == F.col("hi_lo")) & (F.col("n") == F.col("least")), F.col("cls")).otherwise(F.raise_error(F.lit("two token sets share a class id")).cast("long"))).select("cls", "rep", "n")


def _token_sets(docs: DataFrame, open_: DataFrame, k: int) -> DataFrame:
    """cls, n, tokens and parity bits: whole token sets of the open classes (cls, rep), from the texts behind a fixed-size filter."""
    table = docs.sparkSession.sparkContext.broadcast(id_filter(open_, "rep"))

    def run(batches):
        for pdf in batches:
            pdf = pdf[in_filter(table.value, pdf["doc_id"].to_numpy(dtype=np.int64))]
            made = [shingles(t, k) for t in pdf["text"]]
            bits = np.array([parities(s) for s in made], np.int64).reshape(-1, WORDS)
            columns = {f"b{i}": bits[:, i] for i in range(WORDS)}
            yield frame({"rep": pdf["doc_id"].to_numpy(), "cls": np.array([digest(s)[0] for s in made], np.int64), "tokens": [s.view(np.int64) for s in made], **columns})

    words = [f"b{i}" for i in range(WORDS)]
    found = _texts(docs).mapInPandas(run, "rep long, cls long, tokens array<long>, " + ", ".join(f"{w} long" for w in words)).join(open_.select("rep", "cls"), ["rep", "cls"], "left_semi")
    return found.dropDuplicates(["cls"]).select("cls", F.size("tokens").alias("n"), "tokens", *words)


def _emit(sets: DataFrame, scratch: Scratch, percent: int, rare: int) -> DataFrame:
    """sig, cls, n, alone, rare: signatures of the open classes, from exact counts among them."""
    each = sets.select("cls", "n", F.explode("tokens").alias("token"))
    shared = scratch.table(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    lists = each.join(shared, "token").groupBy("cls", "n").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("dfs"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            sig, made = [np.zeros(0, np.int64)], []
            for c, n, tokens, counts in zip(pdf["cls"], pdf["n"], pdf["tokens"], pdf["dfs"]):
                one, two = signatures(np.asarray(tokens, np.int64).view(np.uint64), np.asarray(counts, np.int64), n, rare, percent)
                for x in (one, two):
                    sig.append(x)
                    made.append((c, n, n - len(tokens), len(one), len(x)))
            m = np.array(made, np.int64).reshape(-1, 5)
            m = np.repeat(m[:, :4], m[:, 4], axis=0)
            yield pd.DataFrame({"sig": np.concatenate(sig), "cls": m[:, 0], "n": m[:, 1], "alone": m[:, 2], "rare": m[:, 3]})

    return lists.select("cls", "n", "tokens", "dfs").mapInPandas(run, "sig long, cls long, n int, alone int, rare int")


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of tokens falls into slot i. Two sets differ in at least as many tokens as these differ in bits."""
    odd = np.bincount((mix(tokens) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _possible(percent: int):
    """Whether sizes, tokens that no other class holds, and parity bits leave a link possible. All three are exact bounds."""
    top = F.least(F.col("n") - F.col("alone"), F.col("o_n") - F.col("o_alone"))
    both = F.col("n") + F.col("o_n")
    bits = reduce(add, [F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}"))) for i in range(WORDS)])
    return (F.col("cls") != F.col("o_cls")) & (F.lit(100) * top >= F.lit(percent) * (both - top)) & (F.lit(100 + percent) * bits <= F.lit(100 - percent) * both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"]):
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                ok.append(links(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent))
            yield pd.DataFrame({"a": pdf["a"][ok], "b": pdf["b"][ok]})

    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _bands(percent: int):
    """Sets that can link are in the same band of sizes or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")


def _rest(held: DataFrame, linked: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Holders of signatures whose holders are in several components, with their root; how many pairs lie between components."""
    comp = _components(linked, scratch, f"{name}-cc", rounds=2, partial=True)  # merged further at the end
    label = held.join(comp.withColumnRenamed("v", "cls"), "cls", "left").select("sig", "cls", "share", F.coalesce("root", "cls").alias("root"))
    label = scratch.table(label, f"{name}-label")
    several = scratch.table(label.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("up")).where("lo <> up").select("sig"), f"{name}-several")
    rest = scratch.table(label.join(several, "sig", "left_semi"), f"{name}-rest")
    each = rest.groupBy("sig", "root").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("sig").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return rest, int(each.agg(F.sum((F.col("t") * F.col("t") - F.col("q")) / 2).alias("pairs")).first()["pairs"] or 0)


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, rare: int = RARE, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id for each document; two documents link at Jaccard >= percent / 100."""
    if row_per_id(docs):
        return _near_copies(docs, k, percent, rare, small)
    scratch = Scratch(docs.sparkSession, "ngram-rows")
    rows = numbered(docs, scratch)
    found = _near_copies(rows.select(F.col("row").alias("doc_id"), "text"), k, percent, rare, small).withColumnsRenamed({"doc_id": "row", "component_id": "group"})
    found = scratch.table(found.join(rows.select("row", "doc_id"), "row"), "found")
    least = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "group").select("doc_id", "n_shingles", "component_id")


def _near_copies(docs: DataFrame, k: int, percent: int, rare: int = RARE, small: int = SMALL) -> DataFrame:
    """The same where every row has a doc_id of its own."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    scan = scratch.table(_scan(docs, k), "scan")
    cls = scratch.table(classes(scan), "classes")
    alone = scratch.table(_unshared(docs, k, percent), "unshared")
    e = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    linkable = (F.floor(F.col("n") * 100 / percent) > F.col("n")) | (e > 0)
    open_ = scratch.table(cls.join(alone, "cls", "left").where((F.coalesce("alone", F.lit(0)) <= e) & linkable).select("cls", "rep"), "open")
    sets = scratch.table(_token_sets(docs, open_, k), "sets")
    held = scratch.table(_emit(sets, scratch, percent, rare), "emitted")
    scratch.drop("shared")
    # The hub: the least share of rare tokens, then the least class id, as one number so that it is a plain grouped minimum.
    two64, half = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")
    share = F.least(F.lit(127), F.floor((F.col("rare") + F.col("alone")) * 127 / F.col("n"))).cast("int")
    held = scratch.table(held.select("sig", "cls", "n", "alone", share.alias("share")), "shares")
    scratch.drop("emitted")

    def hubs(of: DataFrame) -> DataFrame:
        first = of.groupBy("sig").agg(F.min(F.col("share").cast("decimal(3,0)") * two64 + (F.col("cls").cast("decimal(20,0)") + half)).alias("h"), F.min("cls").alias("lo"), F.max("cls").alias("up")).where("lo <> up")
        return first.select("sig", (F.col("h") % two64 - half).cast("long").alias("hub"))

    held = scratch.table(held.join(scratch.table(hubs(held), "hubs"), "sig"), "held")
    scratch.drop("shares")
    facts = scratch.table(held.groupBy("cls").agg(F.max("n").alias("n"), F.max("alone").alias("alone")).join(sets.drop("n", "tokens"), "cls"), "facts")
    others = facts.select(*[F.col(c).alias(f"o_{c}") for c in facts.columns])
    pair = (F.least("cls", "o_cls").alias("a"), F.greatest("cls", "o_cls").alias("b"))

    def spokes(of: DataFrame, name: str) -> DataFrame:
        """The pairs (cls, hub) that can link."""
        of = scratch.table(of.select("cls", "hub").distinct(), f"{name}-spokes")
        return scratch.table(of.join(facts, "cls").join(others, F.col("hub") == F.col("o_cls")).where(_possible(percent)).select(*pair).distinct(), name)

    made = spokes(held.where("cls <> hub"), "star")
    linked = scratch.table(_verify(made, sets, percent), "linked")
    todo, before, few = held.where("cls <> hub").select("sig", "cls", "share"), math.inf, small * held.count()
    for i in itertools.count(1):
        rest, pairs = _rest(todo, linked, scratch, f"rest-{i}")
        if not pairs:
            break
        last = pairs <= few or pairs > before / 2
        if last:
            band = _bands(percent)
            near = rest.select("sig", "cls", "root").join(facts, "cls").withColumn("band", band)
            far = scratch.table(rest.select("sig", F.col("cls").alias("o_cls"), F.col("root").alias("o_root")).join(others, "o_cls"), f"far-{i}")
            near = scratch.table(near.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))), f"near-{i}")
            far = far.withColumn("band", F.floor(F.log(F.col("o_n").cast("double")) / math.log(100 / percent)).cast("int"))
            new = near.join(far, ["sig", "band"]).where((F.col("cls") < F.col("o_cls")) & (F.col("root") != F.col("o_root")) & _possible(percent))
            new = scratch.table(new.select(*pair).distinct(), f"cross-{i}")
        else:
            hub = scratch.table(hubs(rest), f"hubs-{i}").join(rest.select("sig", F.col("cls").alias("hub"), F.col("root").alias("hub_root")), ["sig", "hub"])
            of = scratch.table(rest.join(hub, "sig"), f"hubs-of-{i}")
            new = spokes(of.where("cls <> hub and root <> hub_root"), f"star-{i}")
            todo, before = of.where("cls <> hub").select("sig", "cls", "share"), pairs
        more = scratch.table(_verify(new.join(made, ["a", "b"], "left_anti"), sets, percent), f"more-{i}")
        linked, made = linked.union(more), made.union(new)
        if last:
            break
    comp = _components(linked, scratch, "cc-b")
    rooted = scratch.table(cls.join(comp.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")), "rooted")
    least = scratch.table(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.table(rooted.join(least, "root").select("cls", "component_id"), "named")
    each = scan.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("hi")).alias("cls"))
    return each.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(linked: DataFrame, scratch: Scratch, name: str, **how) -> DataFrame:
    if linked.limit(1).count() == 0:
        return linked.sparkSession.createDataFrame([], "v long, root long")
    return scratch.table(components(linked, scratch, name, **how), f"{name}-roots")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the row with the least doc_id stays. Empty documents stay.

    Rows with a null doc_id or a repeated one are documents each; a row with a null doc_id stays if no other of its component has one.
    """
    if not row_per_id(docs):
        rows = numbered(docs, Scratch(docs.sparkSession, "keep-one"))
        found = _near_copies(rows.select(F.col("row").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("row"), "component_id")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        kept = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
        return own_columns(rows.join(kept, "row", "left_semi"), docs)
    found = _near_copies(docs, k, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    return docs.join(found, docs["doc_id"].cast("long") == found["_id"], "left_semi")


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_copies(read_table(spark, sf_dir, "documents"), k=4, percent=85)
