"""The text operators against brute force, and on awkward rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("arrayloom.llm")

from arrayloom.llm import exact_dedup, html_extract, language_id, mixing, ngram_join, packing, sharding, suffix_dedup, topk_search, toxicity  # noqa: E402
from arrayloom.llm.common import Scratch, components  # noqa: E402

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, sig long, fp long, n long, norm string, sha string, keep long, p double, block long, _t string, lang_pred string"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, ("en", "de", None)[k % 3], f"s{k % 2}", len(t or ""), 1, 2, 3, 4, "x", "y", 5, 0.5, 6, "z", "q") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(2)
    base = " ".join(words)
    near = words.copy()
    near[200] = "changed"
    passage = " ".join(words[100:220])
    texts = [None, "", " \t\n", "one", "One", "same text here now", "same  text here\tnow", "same text here now", base, base, " ".join(near), "start " + passage + " end", "other " + passage + " words after", "a" * 3000, "ab " * 900, "!!! 123 ...", "é ü ñ – naïve Ünïcode", " ".join(rng.choice(words, 3000))]
    return table(spark, texts), texts


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# ---------------------------------------------------------------- exact dedup
def brute_exact(texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_dedup(spark, awkward, real):
    for docs, texts in ((awkward[0], dict(enumerate(awkward[1]))), real):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.find_copies(docs).collect()}
        assert got == brute_exact(texts)


def test_exact_dedup_columns_and_empty(spark, awkward):
    kept = exact_dedup.drop_copies(awkward[0])
    assert kept.columns == awkward[0].columns and kept.count() == len({re.sub(r"\s", "", t or "") for t in awkward[1]})
    assert exact_dedup.find_copies(awkward[0].limit(0)).count() == 0
    null_ids = table(spark, ["a", "a", None], [None, 7, None])
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.find_copies(null_ids).collect()} == {(None, 7, 2), (7, 7, 2), (None, None, 1)}


def test_drop_copies_of_repeated_and_null_ids(spark):
    docs = table(spark, ["a", "a", "b", "a b", "b", "b", "c", "c", None, ""], [1, 1, 2, 1, 7, None, None, None, None, None])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    found = sorted((re.sub(r"\s", "", r.text or ""), str(r.doc_id)) for r in kept.collect())
    assert found == [("", "None"), ("a", "1"), ("ab", "1"), ("b", "2"), ("c", "None")]


# ---------------------------------------------------------------- suffix dedup
def brute_spans(texts, least):
    data = {i: (t or "").encode() for i, t in texts.items()}
    counts = Counter(b[k : k + least] for b in data.values() for k in range(len(b) - least + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - least + 1):
            if counts[b[k : k + least]] > 1:
                gone[k] += 1
                gone[k + least] -= 1
        mask = np.cumsum(gone)[: len(b)] > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int), [0]))) == 1).sum())
        out[i] = (len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest())
    return out


def spans(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_dedup(spark, awkward):
    assert spans(suffix_dedup.remove_repeats(awkward[0])) == brute_spans(dict(enumerate(awkward[1])), 400)


def test_suffix_dedup_random_overlaps(spark):
    """Random texts stitched from shared pieces, a short threshold: all kinds of ends."""
    rng = np.random.default_rng(5)
    pieces = ["".join(rng.choice(list("abcd"), rng.integers(5, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(60)] + ["ab" * 100, "b" * 70, "b" * 41, "c" * 40]
    docs = table(spark, texts)
    assert spans(suffix_dedup.remove_repeats(docs, 40, 12, (7, 1))) == brute_spans(dict(enumerate(texts)), 40)


def brute_sharing(texts, n):
    held = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - n + 1):
            held.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {i for at in held.values() if len(at) > 1 for i in at}


def test_shared_passages(spark, awkward, real):
    rng = np.random.default_rng(11)
    pieces = [rng.choice(list("abcdefgh"), rng.integers(2, 40)).tolist() for _ in range(14)]
    stitched = {i: "  ".join(w for k in rng.integers(0, 14, rng.integers(1, 5)) for w in pieces[k]) for i in range(60)}
    stitched |= {60: " ".join(["x"] * 40), 61: " ".join(["x"] * 19), 62: " ".join(["x"] * 20), 63: None}
    docs = table(spark, list(stitched.values()))
    for d, texts, n, gram in ((docs, stitched, 20, 6), (awkward[0], dict(enumerate(awkward[1])), 51, 16), (real[0], real[1], 51, 16)):
        scratch = Scratch(spark, "t")
        anchors = scratch.table(suffix_dedup._anchors(d, 400, 128, n, gram), "anchors")
        fps = {r.fp for r in suffix_dedup.sharing(d, anchors, scratch, n, gram).collect()}
        named = {r.doc_id for r in d.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp")).collect() if r.fp in fps}
        assert named == brute_sharing(texts, n)
    rows = {r.doc_id: r.shares_passage for r in suffix_dedup.remove_repeats(awkward[0]).collect()}
    assert {i for i, x in rows.items() if x} == brute_sharing(dict(enumerate(awkward[1])), 51)


def test_suffix_dedup_empty(spark, awkward):
    assert suffix_dedup.remove_repeats(awkward[0].limit(0)).count() == 0


# ---------------------------------------------------------------- n-gram join
def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, awkward, k, percent):
    assert found(ngram_join.near_copies(awkward[0], k, percent)) == brute_components(dict(enumerate(awkward[1])), k, percent)


def test_ngram_join_chains(spark):
    """A large group of near copies with different numbers of changes: links are missing inside it, chains join it."""
    rng = np.random.default_rng(8)
    words = [f"x{i}" for i in range(120)]
    texts = []
    for i in range(160):
        w = list(words[: rng.integers(110, 121)])
        for at in rng.integers(0, len(w), rng.integers(0, 8)):
            w[at] = f"y{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"x{j}" for j in range(n)) for n in range(1, 14)]
    expected = brute_components(dict(enumerate(texts)), 4, 85)
    for small in (ngram_join.SMALL, 0):  # 0: a new hub in each round
        assert found(ngram_join.near_copies(table(spark, texts), 4, 85, small=small)) == expected


def test_signatures_meet():
    """Sets that link share a signature, whatever the classes of their tokens."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for _ in range(300):
            n = int(rng.integers(4, 200))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = x.copy()
            change = rng.integers(0, len(x), int(rng.integers(0, max(1, len(x) // 8))))
            y[change] = rng.integers(0, 2**63, len(change)).astype(np.uint64)
            y = np.unique(y)
            both = len(np.intersect1d(x, y))
            if np.array_equal(x, y) or not ngram_join.links(both, len(x), len(y), percent):
                continue
            count = lambda s: (s % np.uint64(50)).astype(np.int64)
            cut = int(rng.integers(0, 60))
            keep = lambda s, t: s[np.isin(s, t) | (rng.random(len(s)) < 0.5)]  # noqa: E731  some of the others are known to be unshared
            p, q = keep(x, y), keep(y, x)
            a, b = ngram_join.signatures(p, count(p), len(x), cut, percent), ngram_join.signatures(q, count(q), len(y), cut, percent)
            assert any(set(p.tolist()) & set(q.tolist()) for p, q in zip(a, b))


def test_keep_one(spark, awkward):
    kept = ngram_join.keep_one(awkward[0])
    assert kept.columns == awkward[0].columns
    expected = brute_components(dict(enumerate(awkward[1])), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert ngram_join.near_copies(awkward[0].limit(0)).count() == 0
    odd = table(spark, ["a b c d e f", None], [None, 3])
    assert found(ngram_join.near_copies(odd)) == {None: (2, None), 3: (0, 3)}


def test_keep_one_rows_without_own_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["alone and clean here today", long, long + " more", long, "only null ids hold this text", "only null ids hold this text", None, "", "repeated row of the table", "repeated row of the table"]
    docs = table(spark, texts, [None, None, 5, 4, None, None, None, None, 9, 9])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    expected = [(None, ""), (None, "alone and clean here today"), (None, "only null ids hold this text"), (4, long), (9, "repeated row of the table"), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, expected))


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (7, 7), (2, 1), (10, 9)], "a long, b long")
    got = {r.v: r.root for r in components(links, Scratch(spark, "t")).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 2: 1, 1: 1, 9: 8, 8: 8, 10: 8}


# ---------------------------------------------------------------- packing
def test_encoder_equals_tokenizer(real):
    enc = packing.encoder(packing.default_tokenizer())
    odd = ["", " ", "Don't STOP it's I'LL", "İ Å ΑΣ. éa", "<|endoftext|>. x", "a\x1cb", "3.14, x.y. ...", "ﬁ ½"]
    for t in [*list(real[1].values())[:60], *odd]:
        assert np.frombuffer(enc.encode(t or ""), "<u4").tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    enc = packing.encoder(packing.default_tokenizer())
    expected = sorted((i, k, capacity * k, len(b) // 4, zlib.crc32(b)) for i, t in texts for k, b in enumerate(packing.pieces_of(enc, t, capacity)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert all(n <= capacity for n in at.values())
    return len(at), sum(at.values())


def test_packing(spark, awkward, real):
    docs, texts = awkward
    n, total = check_packing(packing.pack(docs, packing.default_tokenizer(), 64, 40).collect(), list(enumerate(texts)), 64)
    assert n <= -(-total // 64) + 8
    n, total = check_packing(packing.pack(real[0], packing.default_tokenizer()).collect(), list(real[1].items()), 2048)
    assert n <= 1.02 * -(-total // 2048) + 1
    twice = docs.union(docs)
    check_packing(packing.pack(twice, packing.default_tokenizer()).collect(), list(enumerate(texts)) * 2, 2048)
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_genetic_steps_keep_groupings():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 80, 200).tolist()
    people = packing.first_population(sizes, 100, 3, rng)
    child = packing.crossover(people[0], people[-1], sizes, 100, rng)
    for bins in (*people, child, packing.mutate(child, sizes, 100, rng), *packing.evolve(sizes, people, 100, 20, rng)):
        assert sorted(i for b in bins for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(packing.evolve(sizes, people, 100, 20, rng)[0]) <= len(people[0])


def test_genetic_steps_beat_best_fit():
    """Triplets that fill bins exactly: best fit by falling size needs more bins than the genetic steps."""
    rng = np.random.default_rng(0)
    sizes = []
    for _ in range(40):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        sizes += [a, b, 1000 - a - b]
    sizes = rng.permutation(sizes).tolist()
    plain = len(packing.best_fit(sizes, sorted(range(120), key=lambda i: -sizes[i]), 1000))
    people = packing.first_population(sizes, 1000, packing.POPULATION, np.random.default_rng(1))
    evolved = packing.evolve(sizes, people, 1000, packing.GENERATIONS * packing.EPOCHS, np.random.default_rng(2))[0]
    assert 40 <= len(evolved) < plain
    assert sorted(i for b in evolved for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 1000 for b in evolved)


# ---------------------------------------------------------------- search
def test_topk(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (305, [1.0]), (350, vectors[3][1]), (400, vectors[3][1]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in vectors], "vec_id long, embedding array<float>, id int, v string")
    rows = topk_search.whole_numbers(df)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.search(rows.where("id % 50 = 0"), rows, block=64, query_block=4).collect())
    usable = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in usable:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(usable[q], usable[c])), c) for c in usable if c != q)[:5]
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(expected)
    assert topk_search.search(rows.limit(0), rows).count() == 0
    # Two vectors under one id are one query; columns of other tables with the names used inside don't matter.
    two = spark.createDataFrame([(0, [1.0, 0.0], 1, 2, 3), (0, [0.0, 1.0], 1, 2, 3), (1, [3.0, 0.0], 1, 2, 3), (2, [0.0, 2.0], 1, 2, 3), (2, [0.0, 2.0], 1, 2, 3)], "vec_id long, embedding array<float>, cb long, qg long, kind int")
    pair = topk_search.whole_numbers(two)
    found = [(r.rank, r.vec_id, r.score) for r in topk_search.search(pair.where("id = 0").distinct(), pair, k=3).orderBy("rank").collect()]
    assert found == [(1, 1, 3 * 65536), (2, 2, 2 * 65536), (3, 2, 2 * 65536)]
    assert topk_search.search(rows.where("id = 0"), rows.where("id in (0, 1)")).count() == 1


# ---------------------------------------------------------------- language
def test_language_id(spark, real):
    docs = real[0].select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    rows = language_id.identify(docs, model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in docs.where(language_id.held_out(F.col("doc_id"))).collect()} == {i for i in real[1] if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_awkward(spark, awkward):
    docs, texts = awkward
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_without_labels(spark, awkward):
    docs, texts = awkward
    kept = language_id.accepted(docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]


def brute_language(learned, text):
    """Every trigram by hand: the product of its letters' rolled vectors, summed; cosines with the bundles."""
    space = language_id.Space()

    def vector(t):
        out, total = np.zeros(space.d), 0
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            padded = ["\0", *word, "\0"]
            for x, y, z in zip(padded, padded[1:], padded[2:]):
                codes = [0 if c == "\0" else ord(c) for c in (x, y, z)]
                out += np.roll(space.letter(codes[0]), 2).astype(int) * np.roll(space.letter(codes[1]), 1) * space.letter(codes[2])
                total += 1
        return out, total

    bundles = {}
    for t, lang in learned:
        v, n = vector(t)
        if n:
            bundles[lang] = bundles.get(lang, 0) + v / n
    v, n = vector(text or "")
    if not n:
        return "und", 0.0
    cosines = {k: float(b @ v / np.linalg.norm(b) / np.linalg.norm(v)) for k, b in bundles.items()}
    best = max(sorted(cosines), key=lambda k: cosines[k])
    return best, min(1.0, max(0.0, cosines[best]))


def test_language_against_brute_force(spark):
    learned = [("the cat and the dog", "en"), ("this is that thing", "en"), ("der hund und die katze", "de"), ("das ist ein ding", "de"), ("le chien et la chatte", "fr"), (None, "en"), ("1 2 3", "de"), ("text", None)]
    asked = ["that dog", "ein hund", "la chatte et le chien", None, "", "42 !?", "x", "the cat " * 50_000, "the cat", "the cat"]
    model = language_id.train(spark.createDataFrame(learned, "text string, lang string"))
    docs = spark.createDataFrame([(i, t, "c", "f") for i, t in enumerate(asked)], "doc_id long, text string, found string, lang_pred string")
    rows = language_id.identify(docs.select("doc_id", "text", "found"), model, ["doc_id", "found"]).collect()
    for r in rows:
        lang, score = brute_language([x for x in learned if x[0] and x[1]], asked[r.doc_id])
        assert r.lang_pred == lang and r.found == "c" and abs(r.score - score) < 1e-3
    tie = language_id.train(spark.createDataFrame([("same words", "zz"), ("same words", "aa"), ("same words", "mm")], "text string, lang string"))
    assert tie.predict("same words")[0] == "aa"


# ---------------------------------------------------------------- toxicity and mixing
@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    words, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)], ["nastything", "uglything", "vilething"]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(words, rng.integers(20, 60)).tolist()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.integers(2, 12)):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(bad)))
        elif i % 4 == 1:
            w = [f"{x}!!" for x in w]
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, int(i % 4 != 1), int(toxic)))
    docs = spark.createDataFrame([*rows, (400, None), (401, ""), (402, "..."), (None, "nastything")], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect() if r.doc_id is not None}
    held = [rows[i] for i in range(300, 400)]
    assert np.mean([r.toxic == (r.doc_id % 4 == 0) for r in held]) > 0.97
    dose = {i: len(re.findall("thing", t or "")) for i, t in docs.collect()}
    few, many = ([r.severity for r in held if r.toxic and (dose[r.doc_id] > 7) == k] for k in (False, True))
    assert np.mean(many) > np.mean(few)
    assert not rows[400].toxic and not rows[401].toxic and not rows[402].toxic
    nothing = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert nothing.where("toxic or severity > 0").count() == 0


def test_toxicity_against_brute_force(spark, labelled):
    docs, labels = labelled
    clash = docs.union(docs).union(spark.createDataFrame([(500, "nastything " * 60_000)], docs.schema)).withColumns({"toxic": F.lit("x"), "half": F.lit(1), "severity": F.lit(2.0), "f": F.lit("y")})
    model = toxicity.train(clash, labels)
    for r in toxicity.score(clash, model).join(clash.select(F.col("doc_id").alias("i"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        z = sum(model.weights.get(f, 0.0) for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()) for f in [w, *(f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k)])
        above = [1 / (1 + np.exp(-np.clip(z - t, -40, 40))) for t in model.thresholds]
        assert abs(r.severity - sum(above)) < 1e-9 and r.grade == sum(a >= 0.5 for a in above) and r.toxic == (above[0] >= 0.5)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_ordinal_fit_is_the_likelihood_maximum():
    """Small changes of any parameter don't make the graded examples more likely."""
    rng = np.random.default_rng(14)
    x = rng.integers(0, 4, (300, 2))
    grades = np.digitize(1.5 * x[:, 0] + 0.5 * x[:, 1] + rng.logistic(size=300), [1.5, 3.5, 5.0])
    model = toxicity.fit([Counter({"a": int(a), "b": int(b)}) for a, b in x], grades, ["a", "b"], steps=3000, ridge=0.0)

    def likelihood(weights, thresholds):
        z = x @ weights
        p = np.column_stack((np.ones(300), 1 / (1 + np.exp(-(z[:, None] - thresholds[None, :]))), np.zeros(300)))
        return np.log(np.maximum(p[np.arange(300), grades] - p[np.arange(300), grades + 1], 1e-12)).sum()

    w, t = np.array([model.weights["a"], model.weights["b"]]), model.thresholds
    best = likelihood(w, t)
    for i, d in itertools.product(range(5), (-0.05, 0.05)):
        step = np.eye(5)[i] * d
        assert likelihood(w + step[:2], t + step[2:]) < best + 1e-3
    assert (np.diff(t) > 0).all()


def test_mixing_against_brute_force(spark, labelled):
    docs, labels = labelled
    clash = docs.union(spark.createDataFrame([(3, "wordaa wordba"), (700, "word " * 100_000)], docs.schema)).withColumns({"p": F.lit(1), "rate": F.lit(2), "copies": F.lit(3), "domain": F.lit("x"), "_id": F.lit(9)})
    domain = mixing.domain_labels(labels)
    weights = {"high": 0.5, "low": 0.3, "toxic": 0.2}
    model = mixing.train(clash, domain)
    members = [(r.doc_id, r.n_tokens, np.array(r.p)) for r in mixing.posteriors(clash, model).collect()]
    texts = [r.text for r in clash.collect()]
    for (_, n, p), t in zip(members, texts):
        assert n == len((t or "").split())
        z = model.bias + sum((model.weights[f] * k for f, k in mixing.features(t).items() if f in model.weights), np.zeros(len(model.domains)))
        e = np.exp(z - z.max())
        assert np.allclose(p, e / e.sum())
    n, p = np.array([m[1] for m in members], float), np.array([m[2] for m in members])
    target = n.sum() * np.array([weights[d] for d in model.domains])
    # The same descent with the whole matrix at hand: rates never under 0, steps along the weighted residual.
    frame = spark.createDataFrame([(i, int(k), [float(v) for v in q]) for i, k, q in members], "doc_id long, n_tokens long, p array<double>")
    rates = mixing.rates_of(p, mixing.fit_rates(frame, target))
    assert (rates >= 0).all() and np.allclose((rates * n) @ p, target, rtol=1e-4)
    out = mixing.mixed(clash, domain, weights)
    assert out.columns == clash.columns and out.where("doc_id is null").count() >= 0


def test_mixing(spark, labelled):
    docs, labels = labelled
    domains, rated = mixing.mix(docs, mixing.domain_labels(labels), {"high": 0.6, "low": 0.3, "toxic": 0.1})
    rows = rated.collect()
    n, p, r = np.array([x.n_tokens for x in rows], float), np.array([x.p for x in rows]), np.array([x.rate for x in rows])
    assert (r >= 0).all() and len(rows) == docs.count()
    share = (r * n) @ p / n.sum()
    assert np.allclose(share, [{"high": 0.6, "low": 0.3, "toxic": 0.1}[d] for d in domains], atol=1e-4)
    assert all(abs(x.copies - x.rate) < 1 for x in rows)
    out = mixing.mixed(docs, mixing.domain_labels(labels), {"high": 0.6, "low": 0.3, "toxic": 0.1})
    assert out.columns == docs.columns
    counts = Counter(x.doc_id for x in out.collect())
    assert all(counts[x.doc_id] == x.copies for x in rows)
    assert mixing.mixed(docs.limit(0), mixing.domain_labels(labels)).count() == 0
    assert mixing.mix(docs, mixing.domain_labels(labels.limit(0)))[0] == ["all"]


def test_rates_meet_targets_where_some_are_zero():
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.2, 0.2, 0.2], 500)
    steps = [np.array([-3.0, 0.5, 0.2])]
    assert (mixing.rates_of(p, steps) >= 0).all() and (mixing.rates_of(p, steps) == 0).any()


# ---------------------------------------------------------------- sharding
def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_sharding(spark, awkward):
    docs, texts = awkward
    names = docs.withColumns({"shard": F.lit("own"), "tier": F.lit(9), "version": F.lit(1), "path": F.lit("p")})
    many = names.union(names).repartition(24)
    store, rows = sharding.shard(many, target=1 << 20, small=1 << 10, arrivals=3)
    assert sorted(r.doc_id for r in rows.collect()) == sorted([*range(len(texts))] * 2)
    version, runs = store.manifest()
    assert version >= 5 and len(runs) < 24 and sum(r["rows"] for r in runs) == 2 * len(texts)
    assert rows_of(store.read(runs)) == rows_of(many)
    held = Counter(r.shard for r in rows.collect())
    assert {r.shard: (r.shard_rows, r.tier) for r in rows.collect()} == {r["path"]: (r["rows"], store.tier(r)) for r in runs} and all(held[r["path"]] == r["rows"] for r in runs)
    before = store.versions()
    with pytest.raises(sharding.VersionTaken):  # another writer has taken that version
        store.commit(version - 1, [])
    assert store.versions() == before and store.manifest() == (version, runs)
    store.append(names.limit(3))
    assert sum(r["rows"] for r in store.manifest()[1]) == 2 * len(texts) + 3
    ids = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in sharding.shard(ids)[1].collect()) == [(False, 1), (False, 1), (True, 0), (True, 0)]
    empty = sharding.shard(docs.limit(0))[1]
    assert empty.count() == 0 and empty.columns == rows.columns


def test_sharding_merges_by_size(spark):
    """Tiers by brute force: as long as a tier under the target has as many runs as the fan-out, it is merged."""
    store = sharding.ShardStore(spark, f"{sharding.shared_dir(spark)}/tiers", target=1 << 14, small=1 << 9)
    docs = spark.createDataFrame([(i, hashlib.sha256(str(i).encode()).hexdigest() * 3) for i in range(400)], "doc_id long, text string")
    for k in range(9):
        store.append(docs.where(F.col("doc_id") % 9 == k).coalesce(1))
        store.compact()
        left = Counter(store.tier(r) for r in store.manifest()[1] if r["bytes"] < store.target / 2)
        assert all(n < store.fanout for n in left.values())
    version, runs = store.manifest()
    assert version > 10 and rows_of(store.read(runs)) == rows_of(docs)  # nine appends, and at least two merges


def test_sharding_writers_at_the_same_time(spark):
    """Appenders, a compactor and a vacuum on one store: no row is lost, and older versions stay readable within the grace period."""
    from concurrent.futures import ThreadPoolExecutor

    root = f"{sharding.shared_dir(spark)}/together"
    open_ = lambda: sharding.ShardStore(spark, root, target=1 << 20, small=1 << 10)
    open_().append(spark.range(0, 10, 1, 1))

    def append(k):
        store = open_()
        for i in range(3):
            lo = 10 + 30 * k + 10 * i
            store.append(spark.range(lo, lo + 10, 1, 2))

    def compact(_):
        for _ in range(4):
            open_().compact()
            open_().vacuum()

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(append, k) for k in range(3)] + [pool.submit(compact, 0)]
        [j.result() for j in jobs]
    store = open_()
    store.compact()
    assert sorted(r.id for r in store.read(store.manifest()[1]).collect()) == list(range(100))
    for v in store.versions():
        assert store.read(store.manifest(v)[1]).count() == sum(r["rows"] for r in store.manifest(v)[1])
    # The sequence that loses data where a merge deletes what it doesn't know: written, vacuumed by another, committed.
    late = store._write(spark.range(100, 110, 1, 1))
    open_().vacuum()
    store._add(late[0])
    assert store.read(store.manifest()[1]).count() == 110
    assert store.vacuum(grace_s=0, keep=1) > 0
    assert sorted(r.id for r in store.read(store.manifest()[1]).collect()) == list(range(110))


# ---------------------------------------------------------------- HTML
PAGES = [
    ("http://a.example/1", "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/x>X</a></li><li>Y</li></ul></nav><article><h1>Head</h1><p>One &amp;  two\n three<p>Four <b>bold<br>line</article><footer>&copy; foot</footer>"),
    ("http://a.example/2", "<html><body><nav><ul><li>Y</li></ul></nav><div class='cookie-notice'>We use</div><article><h1>Other</h1><p>Five</p><aside>Side</aside><div class='comments'><p>Reader</p></div></article></body></html>"),
    ("http://A.example:80/3", "<body><nav></nav><article><p>Six<form><p>Field</form> seven</p><script>var t='</p>';</script></article>"),
    ("http://b.example/1", "<body><header>H</header><div><p>Main</p><p>text</p></div><div id=sidebar>S</div></body>"),
    ("http://b.example/2", "just words &lt;here&gt;"),
    (None, None),
    ("odd", ""),
    ("http://c.example", "<p>unclosed <i>tags</p></div></p><p>end"),
]
TEXTS = ["Head\nOne & two three\nFour bold line", "Other\nFive", "Six\nseven", "Main\ntext", "just words <here>", "", "", "unclosed tags\nend"]


def test_html(spark):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, host string, text string")
    rows = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert [rows[i].text for i in range(len(PAGES))] == TEXTS
    assert all(r.n_chars == len(r.text) and r.url == PAGES[i][0] for i, r in rows.items())
    assert html_extract.extract(df.limit(0)).count() == 0


def shape(nodes):
    """A wrapper as text: tags, # for text, (...)+ for groups, ? for optional nodes."""
    out = ""
    for n in nodes:
        kids = "" if n.head == "#" and type(n) is html_extract.Text else shape(n.kids)
        out += "#" if type(n) is html_extract.Text else f"({kids})+" if type(n) is html_extract.Group else f"{'.'.join((n.head[0], *n.head[1]))}[{kids}]"
        out += "?" if n.opt else ""
    return out


def wrapper(*pages):
    return html_extract.merged([html_extract.page_tree(p) for p in pages])


def test_wrapper_shapes():
    items = lambda n: "<ul>" + "<li>x</li>" * n + "</ul>"
    assert shape(wrapper(items(2))) == shape(wrapper(items(5))) == shape(wrapper(items(1), items(3))) == shape(wrapper(items(3), items(1), items(4))) == "ul[(li[#])+]"
    plain, headed = "<div><p>x</p></div>", "<div><h2>y</h2><p>x</p></div>"
    assert shape(wrapper(plain, headed)) == shape(wrapper(headed, plain, headed)) == "div[h2[#]?p[#]]"
    terms = lambda n: "<dl>" + "<dt>a</dt><dd>b</dd>" * n + "</dl>"
    assert shape(wrapper(terms(3))) == shape(wrapper(terms(1), terms(2))) == "dl[(dt[#]dd[#])+]"
    assert shape(wrapper("<p>a <b>c</b> d</p><p>e</p>")) == "(p[#b[#]?#?])+"
    w = wrapper("<p class='x y'>a</p><p>b</p>", "<p class='y x'>c</p>")
    assert shape(w) == "p.x.y[#]p[#]?" and html_extract.dump(html_extract.load(html_extract.dump(w))) == html_extract.dump(w)


def test_matches_are_longest():
    rng = np.random.default_rng(12)
    for _ in range(200):
        x, y = (rng.integers(0, 4, rng.integers(0, 14)).tolist() for _ in range(2))
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in itertools.product(range(len(x)), range(len(y))):
            best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
        found = html_extract.matches(x, y)
        assert len(found) == best[-1, -1] and all(x[i] == y[j] for i, j in found) and all(p < q and r < t for (p, r), (q, t) in zip(found, found[1:]))


def test_wide_groups_and_long_and_deep_pages(spark):
    wide = "".join(f"<div class=c{i}><p>{i}</p></div>" for i in range(700))  # a group of 700 nodes
    w = html_extract.page_tree(wide * 3)
    assert len(w) == 1 and type(w[0]) is html_extract.Group and len(w[0].kids) == 700
    long, half = ("".join(f"<div class=c{i}><p>{i}</p></div>" for i in range(n)) for n in (3000, 1500))
    assert sum(n.opt for n in wrapper(long, half)) == 1500
    deep = "<div>" * 20_000 + "<p>Bottom" + "</div>" * 20_000
    table_ = "<table>" + "<tr><td>x</td><td>y</td></tr>" * 5000 + "</table>"
    rows = [("http://d.example/1", deep), ("http://d.example/2", deep.replace("Bottom", "Other")), ("http://l.example/1", long), ("http://l.example/2", half), ("http://t.example", table_), ("http://t.example", "a" * 500_000), ("http://t.example", "<")]
    df = spark.createDataFrame([(1, u, h, "x", "y", "z") for u, h in rows], "page_id long, url string, html string, tags string, models string, template string").coalesce(1)
    found = sorted(r.text for r in html_extract.extract(df).collect())
    assert found == sorted(["Bottom", "Other", "\n".join(map(str, range(3000))), "\n".join(map(str, range(1500))), "\n".join(["x", "y"] * 5000), "a" * 500_000, "<"])


def test_boilerplate_without_telling_names(spark):
    """Classes say nothing and no tag does: menus, notices and teasers go by their slots. The rule for single pages keeps them all."""
    rng = np.random.default_rng(13)
    say = lambda n: " ".join(rng.choice([f"word{i}" for i in range(300)], n))
    page = "<body><div class=k1><ul>{0}</ul></div><div class=k2>All the news. Read our terms.</div><div class=k3><h1>{1}</h1></div><div class=k4>{2}<p>Ask us for more</p></div><div class=k5>{3}</div></body>"
    made = []
    for _ in range(8):
        head, paragraphs = say(4), [say(40) for _ in range(rng.integers(1, 5))]
        links = "".join(f"<li><a href=/{i}>{say(2)}</a></li>" for i in range(rng.integers(1, 6)))
        made.append((page.format(links, head, "".join(f"<p>{p}</p>" for p in paragraphs), say(3)), "\n".join([head, *paragraphs])))
    df = spark.createDataFrame([(i, "http://k.example/", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract(df.repartition(3)).collect()}
    for i, (html, text) in enumerate(made):
        assert found[i] == text
        assert "All the news" in html_extract.main_text(html, None)


def test_template_texts(spark):
    page = "<html><body><div class=intro><p>Read us daily</p></div><article><h1>Head {0}</h1><p>Text {0} <b>of</b> it</p>{1}<p>All rights kept</p></article></body></html>"
    rows = [("http://t.example/a", page.format(i, f"<p>More {i}</p>" * (i % 3))) for i in range(6)]
    rows.append(("http://t.example/m", "<body><div class=intro><p>Read us daily</p></div><div>Around</div><main><p>Inside</p></main></body>"))
    rows += [("http://w.example/b", f"<body><div class=intro><p>Read us daily</p></div><div class=c><p>Words {i}</p></div></body>") for i in range(4)]
    rows += [("http://few.example/c", f"<body><div><p>Shared</p></div><div class=c><p>Own {i}</p></div></body>") for i in range(2)]
    rows += [("http://copies.example/d", "<body><div><p>Same</p></div></body>")] * 4
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract(df.repartition(3)).collect()}
    for i in range(6):
        assert found[i].split("\n") == [f"Head {i}", f"Text {i} of it", *[f"More {i}"] * (i % 3)]
    assert found[6] == "Inside"
    assert [found[7 + i] for i in range(4)] == [f"Words {i}" for i in range(4)]
    assert [found[11], found[12]] == ["Shared\nOwn 0", "Shared\nOwn 1"]
    assert {found[13 + i] for i in range(4)} == {"Same"}
