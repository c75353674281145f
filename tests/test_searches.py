"""Stems against the published sample, the term index against plain search, and the vector index against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.stems import porter2, stems
from ledgerline.operators import term_index, text, vectors

#: The published sample of the algorithm's vocabulary, word and stem.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
MORE = {
    "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "feed": "feed", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "bed": "bed", "say": "say", "by": "by", "dying": "die",
    "skies": "sky", "generously": "generous", "communal": "communal", "sensational": "sensat", "relational": "relat", "herrings": "herring", "succeeded": "succeed", "controlling": "control", "rolled": "roll", "o'neil's": "o'neil", "naïve": "naïve", "b2b": "b2b", "": "",
}


def test_porter2(spark):
    assert {w: porter2(w) for w in SAMPLE[::2]} == dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
    assert {w: porter2(w) for w in MORE} == MORE
    got = spark.createDataFrame([(["knights", "x"],), ([],), (None,)], "w array<string>").select(stems("w").alias("s")).collect()
    assert [r.s for r in got] == [["knight", "x"], [], None]


def test_term_index(spark):
    rng = random.Random(2)
    words = ["bond", "bonds", "bonded", "the", "of", "issuer", "issuers", "redeem", "redeemed", "note"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(200)] + [(900, None), (901, ""), (902, "the of the"), (None, "bond issuer")]
    index = term_index.build_index(spark.createDataFrame(docs, "id int, body string"), "id", "body", folders=5)
    tokens = {i: (t or "").split() for i, t in docs if i is not None}
    stem = {i: [porter2(w) for w in ws] for i, ws in tokens.items()}
    for q in ("issuers of bonds", "redeeming the note", "bond", "bond bonds", "bonds of the issuer redeemed"):
        qs = [(i, porter2(w)) for i, w in enumerate(q.split()) if w not in text.STOP_WORDS]
        all_terms = {i for i, s in stem.items() if all(any(a == t and w not in text.STOP_WORDS for a, w in zip(s, tokens[i], strict=True)) for _, t in qs)}
        assert {r.key for r in term_index.search(spark, index, q).collect()} == all_terms
        times = {i: sum(all(p + k < len(s) and s[p + k] == t for k, t in qs) for p in range(-qs[0][0], len(s)) if p + qs[0][0] >= 0) for i, s in stem.items()}
        assert {r.key: r.times for r in term_index.phrase(spark, index, q).collect()} == {i: n for i, n in times.items() if n}
    for q in ("the", "unknown", ""):
        assert term_index.search(spark, index, q).count() == term_index.phrase(spark, index, q).count() == 0


def test_a_search_reads_its_folders_only(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)], "id int, body string")
    index = term_index.build_index(docs, "id", "body", folders=40)
    plan = index.postings(spark, ["wordab"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan)
    files = index.postings(spark, ["wordab"]).inputFiles()
    assert 0 < len({f.rsplit("/", 2)[1] for f in index.postings(spark, ["wordab"]).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) == 1
    assert len(files) <= len(spark.read.parquet(index.path).inputFiles())


def clustered(rng, n, dim=24, centres=40):
    c = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in c[rng.integers(centres)] + rng.normal(scale=0.35, size=dim)]) for i in range(n)]


def test_vector_index(spark):
    rows = clustered(np.random.default_rng(4), 3000)
    odd = [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (None, rows[0][1]), (9005, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>").repartition(4)
    index = vectors.build_index(df)
    m = np.array([v for _, v in rows] + [rows[0][1]])
    ids = [i for i, _ in rows] + [9005]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {q: sorted(range(len(ids)), key=lambda j: (-round(float(m[j] @ m[q]), 12), ids[j]))[:10] for q in range(0, 3000, 100)}
    queries = df.where("vec_id % 100 = 0 and vec_id < 3000 or vec_id in (9000, 9002)")
    exact, near = ({(r.query, r.rank): r.key for r in vectors.search_each(index, queries, 10, p).collect()} for p in (None, 6))
    assert exact == {(q, n + 1): ids[j] for q, js in want.items() for n, j in enumerate(js)}
    recall = len({(q, k) for (q, _), k in near.items()} & {(q, k) for (q, _), k in exact.items()}) / len(exact)
    assert recall >= 0.9  # 6 of 55 lists
    one = vectors.search_one(spark, index, rows[100][1], 10, probes=6)
    assert [r.key for r in one.collect()] == [near[100, n] for n in range(1, 11)]
    assert re.search(r"PartitionFilters: \[[^\]]*list", one._jdf.queryExecution().executedPlan().toString())
    for bad in ([], [0.0] * 24, [float("nan")] * 24):
        with pytest.raises(ValueError, match="query vector"):
            vectors.search_one(spark, index, bad, 3)
    with pytest.raises(ValueError, match="no vectors"):
        vectors.build_index(df.where("vec_id = 9000"))


def test_recall_on_vectors_without_clusters(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vectors.build_index(rows)
    queries = rows.where("vec_id % 25 = 0")
    exact, near = ({(r.query, r.key) for r in vectors.search_each(index, queries, 10, p).collect()} for p in (None, len(index.centroids) * 2 // 3))
    assert len(exact & near) / len(exact) >= 0.9


def test_blocks_keep_ties_by_key():
    """Copies of a vector have one score, in one block or several, and only rows of probed lists count."""
    rows = np.random.default_rng(5).normal(size=(40, 8))
    rows[[3, 17, 30]] = rows[9]
    place, lists = np.arange(40)[::-1].copy(), np.arange(40) % 4
    probed = np.array([[True] * 4, [True, False, True, False]])[:, lists]
    q, r, score = vectors.best_of(rows[[9, 3]], rows, probed, place, 4)
    assert list(r[q == 0][:4]) == [30, 17, 9, 3]
    assert len(set(score[q == 0][:4])) == 1
    assert list(r[q == 1][:1]) == [30] and all(lists[r[q == 1]] % 2 == 0)


def test_an_index_is_built_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(term_index, "PART_WORDS", 7)
    docs = spark.createDataFrame([(str(i % 50), f"bond {'issuer ' * (i % 4)}note") for i in range(60)] + [("the", "of the"), ("none", None)], "id string, body string").repartition(3)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    docs = docs.localCheckpoint()
    before = stages().size()
    index = term_index.build_index(docs, "id", "body", folders=5)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    after = stages()
    assert sum(after.apply(i).shuffleWriteBytes() for i in range(after.size() - before)) == 0
    assert index.documents(spark) == 50
    # rows of one key are parts of one document
    want = {str(k): sorted([p for i in range(k, 60, 50) for p in range(1, 1 + i % 4)]) for k in range(50)}
    got = {r.key: (r.tf, r.positions, r.words) for r in index.whole_postings(spark, ["issuer"]).collect()}
    assert got == {k: (len(p), p, max(2 + i % 4 for i in range(int(k), 60, 50))) for k, p in want.items() if p}
