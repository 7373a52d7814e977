"""The pipeline's stages, one after another, and the registry."""

import pytest

pytest.importorskip("arrayloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = docs.persist()
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] and counts[4] > 0
    packed = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("piece = 0").count() == counts[4]


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, row long, c0 string, _id long, keep_id long, found string"


def words(n, seed):
    import numpy as np

    return " ".join(np.random.default_rng(seed).choice([f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)], n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls, empty and repeated rows, copies and near copies, and columns whose names the stages use inside."""
    base = [words(80, k) for k in range(30)]
    texts = [*base, base[0], base[0].replace(" ", "  "), base[1] + " more", "start " + base[1], base[2] + " x y", None, "", "123 ...", "  ", "solo", base[3], base[3]]
    ids = [*range(30), 30, 31, 32, 33, 34, 35, 36, 37, 38, None, 39, 39]
    rows = [(i, t, ("en", "de", None)[k % 3], "s", len(t or ""), 1, 2, "c", 4, 5, "f") for k, (i, t) in enumerate(zip(ids, texts))]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 4 != 1), int(k % 4 == 0)) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_against_brute_force(spark, tables):
    import re

    from test_text_operators import brute_components, check_packing

    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, schema, stages = docs.columns, docs.schema, dict(pipeline.STAGES)
    run = lambda name, rows: stages[name](spark, spark.createDataFrame(rows, schema), folder)

    known = run("language_id", rows)
    assert known.columns == columns
    kept = [tuple(r) for r in known.collect()]
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in rows if re.search(r"[^\W\d_]", r[1] or ""))

    once = run("exact_dedup", kept)
    assert once.columns == columns
    groups = {}
    for r in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append((r[0] is None, -len(r[1]), r[0] or 0))
    kept = [tuple(r) for r in once.collect()]
    assert sorted((re.sub(r"\s", "", r[1]), r[0]) for r in kept if r[0] is not None) == sorted((k, min(v)[2]) for k, v in groups.items() if not min(v)[0])
    assert len(kept) == len(groups)

    far = run("near_dedup", kept)
    assert far.columns == columns
    order = {i: r[1] for i, r in enumerate(sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)))}
    first = [i for i, (_, c) in brute_components(order, 5, 80).items() if i == c]
    kept = [tuple(r) for r in far.collect()]
    assert sorted(r[1] for r in kept) == sorted(order[i] for i in first)

    mixed = run("mixing", kept)
    assert mixed.columns == columns and {tuple(r) for r in mixed.collect()} <= set(kept)
    mixed = [tuple(r) for r in mixed.collect()]
    check_packing(run("packing", mixed).collect(), [(r[0], r[1]) for r in mixed], 2048) if all(r[0] is not None for r in mixed) else None
    assert run("packing", mixed).where("piece = 0").count() == len(mixed)


def test_run_and_empty_tables(spark, tables, tmp_path):
    folder, rows = tables
    assert pipeline.run(spark, folder).where("piece = 0").count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
