"""The fuzzy join against all pairs."""

import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.names import bare_name
from ledgerline.operators import matching
from ledgerline.plans import catalog

SF = "/root/testdata/sf0.001"


def best(left, right, least):
    """key -> (score, right name) by trying every pair; rows are (key, group, bare name, name)."""
    found = {}
    for key, group, bare, _ in left:
        scored = [(-SequenceMatcher(None, bare, other).ratio(), name) for g, other, name in right if g == group and bare is not None and other is not None]
        if scored and -min(scored)[0] >= least:
            found[key] = (round(-min(scored)[0], 9), min(scored)[1])
    return found


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95])
def test_fuzzy_join_finds_every_pair(spark, least):
    rng = random.Random(5)
    words = ["american", "airlines", "group", "bank", "steel", "a", "of", "energie", "first", "aaaa", "\U0001f600 co"]
    known = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)] + ["", "x", "ab", "Inc.", None]
    changed = []
    for name in known * 2:
        letters = list(name or "")
        for _ in range(rng.randint(0, 4)):
            if letters and rng.random() < 0.6:
                letters.pop(rng.randrange(len(letters)))
            else:
                letters.insert(rng.randint(0, len(letters)), rng.choice("aeirst x"))
        changed.append("".join(letters) if name is not None else None)
    left = spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(changed)], "id int, company int, left_name string")
    right = spark.createDataFrame([(i % 2, n) for i, n in enumerate(known)], "company int, right_name string")
    ours = [tuple(r) for r in left.select("id", "company", bare_name(F.col("left_name")), "left_name").collect()]
    theirs = [tuple(r) for r in right.select("company", bare_name(F.col("right_name")), "right_name").collect()]
    got = matching.fuzzy_join(left, right, "left_name", "right_name", "id", least, ("company",))
    assert {r.id: (round(r.score, 9), r.right_name) for r in got.collect()} == best(ours, theirs, least)
    alone = matching.fuzzy_join(left, right.drop("company"), "left_name", "right_name", "id", least)
    assert {r.id: (round(r.score, 9), r.right_name) for r in alone.collect()} == best([(k, 0, b, n) for k, _, b, n in ours], [(0, b, n) for _, b, n in theirs], least)


def test_fuzzy_join_bounds(spark):
    a = spark.createDataFrame([(1, "Amercan Airlines Group")], "id int, left_name string")
    b = spark.createDataFrame([("American Airlines Group, Inc.",)], "right_name string")
    assert matching.fuzzy_join(a, b, "left_name", "right_name", "id").count() == 1
    assert matching.fuzzy_join(a.limit(0), b, "left_name", "right_name", "id").count() == 0
    with pytest.raises(ValueError):
        matching.fuzzy_join(a, b, "left_name", "right_name", "id", 0.6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_changed_names_against_all_pairs(spark):
    got = {r.p_partkey: (r.changed_name, r.known_name, r.score) for r in catalog.QUERIES["fuzzy_names_changed"](spark, SF).collect()}
    names = sorted(r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().collect())
    for key, (changed, known, score) in sorted(got.items())[::10]:
        scores = {n: SequenceMatcher(None, changed.lower(), n.lower()).ratio() for n in names}
        assert known == min(names, key=lambda n: (-scores[n], n)) and score == round(scores[known], 4)
    assert any(changed != known for changed, known, _ in got.values())
