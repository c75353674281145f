import os
import random

import pytest

import corpus_pipeline
from ledgerline.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_stage_keeps_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()


EDGES = "doc_id long, text string, lang string, source string, n_chars long, `x.y` string, spans string, row string"


def edge_rows():
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(n))
    texts = [text(80) for _ in range(6)]
    texts += [texts[0], texts[0], None, "", " \n ", "a b", "x " * 400, text(30_000)]
    rows = [(i, t, "en", ("s1", None, "s2")[i % 3], None if t is None else len(t), "dot", "s", "r") for i, t in enumerate(texts)]
    return [*rows, (None, texts[1], "en", "s1", len(texts[1]), "dot", "s", "r"), rows[3]]


@pytest.mark.parametrize("rows", [edge_rows(), []])
def test_stages_on_edges(spark, tmp_path, rows):
    """Nulls, empty and very long texts, repeats, names that clash or hold a dot, and no rows at all."""
    hit = rows[4][1].split()[20:45] if rows else ["w"] * 12
    spark.createDataFrame([(1, " ".join(hit)), (2, None), (None, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, EDGES)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: (lambda out: (out.columns == df.columns, [tuple(r) for r in out.collect()]))(stages[name](spark, df, str(tmp_path)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")

    same, kept = run("quality_rules", docs)
    good = [r for r in rows if r[1] and len(set(r[1].split())) > 50]
    assert same
    assert sorted(kept, key=key) == sorted(good, key=key)
    same, first = run("ngram_join", docs)
    assert same
    seen = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        seen.setdefault(r[1] if (r[1] or "").split() else r[0], r)
    assert {r[0] for r in first} == {r[0] for r in seen.values()} | ({None} if rows else set())
    same, clean = run("decontamination", docs)
    assert same
    want = [(r[0], r[1].replace(" ".join(hit) + " ", ""), *r[2:]) if r[1] and " ".join(hit) in r[1] else r for r in rows]
    want = [(*r[:4], r[1] if r[1] is None else len(r[1]), *r[5:]) for r in want]
    assert sorted(clean, key=key) == sorted(want, key=key)
    same, mixed = run("mixing", docs)
    assert same
    assert {r[0] for r in mixed} <= {r[0] for r in rows if (r[1] or "").split()}
    assert all(r[4] == len(r[1]) for r in mixed)
    same, files = run("token_files", docs)
    assert len(files) == len(rows)


def test_pipeline_is_repeatable(spark):
    a, b = (sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_queries_are_named_by_number():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
