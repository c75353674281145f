"""Each corpus operator against brute force on small tables, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

import ledgerline.llm.decontaminate as dc
from ledgerline.llm import context_tree, line_dedup, mixing, ngram_join, quality_model, rans, repetition, token_counts, token_store, warc
from ledgerline.llm.common import ASCII_LOWER, run_dir, word_codes

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(40)]


def table(spark, rows, extra=False):
    """documents rows, with columns whose names operators might use themselves."""
    df = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOCS)
    if extra:
        for name in ("n", "spans", "items", "size", "block", "key", "kind", "chunk", "value", "rep", "comp", "t", "bits", "row", "x.y"):
            df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(1, 90)), f"s{rng.randint(0, 4)}") for i in range(60)]
    base = sentence(rng, 60).split()
    for i in range(60, 90):  # near copies of one text
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(words), "s0"))
    rows += [(90, rows[3][1], None), (91, rows[3][1].upper(), "s1"), (92, None, "s2"), (93, "", None), (94, " \n\t ", "s1"), (95, "a b", "s1"), (96, "A  b", "s2"), (97, "é À ü\n" * 30, "s2"), (98, "z" * 5000, "s3")]
    return rows


def words_of(text):
    return (text or "").encode().translate(ASCII_LOWER).split()


def test_ngram_join(spark, corpus):
    rows = [*corpus, (None, corpus[0][1], "s1"), corpus[5]]
    sets = collections.defaultdict(set)
    for d, t, _ in rows:
        w = words_of(t)
        if d is not None and w:
            sets[d] |= {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d, _, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = ngram_join.similar_components(table(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
        if r.doc_id is not None:
            assert r.n_shingles == len(sets[r.doc_id])
    kept = {r.doc_id for r in ngram_join.one_per_group(table(spark, rows)).collect()}
    assert kept == {d for d in root if find(d) == d} | {None}


def test_ngram_join_of_families_above_a_piece(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(200):  # one word changed: linked to the base, not to each other
        words = list(base)
        words[rng.randrange(40)] = f"v{rng.randint(0, 10**9)}"
        rows.append((i + 10, " ".join(words), "s"))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(table(spark, [*rows, (1, " ".join(base), "s")])).collect()}
    assert set(got.values()) == {1}
    assert ngram_join.similar_components(table(spark, []).limit(0)).count() == 0


def similar_by_brute_force(rows):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, words_of(t)) for d, t, _ in rows) if w}
    root = {d: d for d, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


@pytest.mark.parametrize("bounds", [{"FAMILY": 16, "CHAIN": 2, "HEADS": 2}, {"FAMILY_HASHES": 300, "HEADS": 1}, {"SALT_AT": 8, "FAMILY": 16}, {"LONG_RUN": 20, "PIECE": 4}])
def test_ngram_join_in_parts(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(44)]
    rows = [(1, " ".join(base), "s")]
    for i in range(120):  # a star: linked to the base, not to each other
        words = list(base)
        words[rng.randrange(44)] = f"v{rng.randint(0, 10**9)}"
        rows.append((i + 10, " ".join(words), "s"))
    walk = [f"c{i}" for i in range(60)]
    for i in range(60):  # a chain of small changes: its ends share little
        walk[i] = f"d{i}"
        rows.append((300 + i, " ".join(walk), "s"))
    rows += [(500 + i, " ".join(base[:30] + [f"e{i}.{j}" for j in range(14)]), "s") for i in range(40)]  # share much, linked with none
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(table(spark, rows)).collect()}
    assert got == similar_by_brute_force(rows)


def test_reaching_skips_nothing():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 30, rng.integers(0, 20))) for _ in range(rng.integers(1, 9))]
        ends = np.cumsum([0, *map(len, lists)]).tolist()
        member = array("i", np.concatenate(lists).astype(np.int32).tobytes())
        least = int(rng.integers(1, 6))
        want = [(int(v), int(n)) for v, n in zip(*np.unique(np.concatenate(lists), return_counts=True), strict=True) if n >= least]
        assert list(ngram_join.reaching(member, list(zip(ends, ends[1:])), least)) == want


def test_divide_skip_counts_overlaps():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sets = sorted((np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(rng.integers(2, 9))), key=len)
        links = ngram_join.block_links(list(range(len(sets))), sets)
        want = {(a, b) for b in range(len(sets)) for a in range(b) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))}
        assert set(links) <= want
        group = list(range(len(sets)))
        for pairs in (links, want):
            g = list(range(len(sets)))
            for _ in range(len(sets)):
                for a, b in pairs:
                    g[a] = g[b] = min(g[a], g[b])
            group = g if pairs is links else group if group == g else pytest.fail("components differ")


def brute_hits(text, items, window=10):
    w, hit, found = dc.normal_words((text or "").encode()), set(), set()
    for name, t in items:
        if name is None or t is None:
            continue
        item = dc.normal_words(t.encode())
        k = min(window, len(item))
        for i in range(len(item) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == item[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_decontamination(spark, corpus, block):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.choice([0, 2, 9, 10, 11, 30]))) for i in range(15)] + [(15, corpus[2][1]), (16, None), (None, "w1 w2"), (3, corpus[7][1])]
    docs = [*corpus, (200, f"start {items[6][1]}! mid, {corpus[2][1].upper()} end", "s"), (None, items[5][1], None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.contamination_report(table(spark, docs, extra=True), bench, block_bytes=block).collect())
    want = collections.Counter()
    for d, t, _ in docs:
        n, hit, found = brute_hits(t, items)
        want[d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    assert got == want
    clean = {r.doc_id: r for r in dc.decontaminate(table(spark, docs, extra=True), bench, block_bytes=block).collect()}
    for d, t, _ in docs:
        n, hit, _ = brute_hits(t, items)
        assert (d in clean) == (2 * hit <= n)
        if d in clean and not hit:
            assert clean[d].text == t
        if d in clean and hit:
            assert len(dc.normal_words(clean[d].text.encode())) == n - hit and clean[d].n_chars == len(clean[d].text)
    assert dc.contamination_report(table(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def test_repeat_spans_by_suffix_array():
    rng = random.Random(1)
    for _ in range(60):
        docs = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 22))] for _ in range(rng.randint(1, 4))]
        codes, counts, _ = word_codes(docs)
        want = []
        for w in docs:
            for i in range(len(w)):
                best = 0
                for j in range(len(w)):
                    k = 0
                    while i != j and i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                        k += 1
                    best = max(best, k if k >= 3 else 0)
                want.append(best)
        assert repetition.repeat_lengths(codes, counts).tolist() == want


def test_quality_rules(spark, corpus):
    rows = [*corpus, (300, "one two three four\n" * 40, "s"), (301, sentence(random.Random(1), 80) + " # $ |", "s"), (None, "x", None)]
    got = {r.doc_id: r for r in repetition.repetition_report(table(spark, rows, extra=True)).collect()}
    for d, t, _ in rows:
        w, r = (t or "").encode().split(), got[d]
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(inside), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert repetition.repetition_report(table(spark, rows).limit(0)).count() == repetition.quality_filter(table(spark, rows).limit(0)).count() == 0
    kept = {r.doc_id for r in repetition.quality_filter(table(spark, rows, extra=True)).collect()}
    assert kept == {d for d, r in got.items() if r.kept} and 301 in kept and 300 not in kept


def test_line_dedup_sorts_and_streams(spark):
    docs = table(spark, [(i, "a line that is long enough to count as one of many\n" * 3, "s") for i in range(9)])
    line_dedup.written, kept = lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, name), line_dedup.written
    plans = []
    try:
        line_dedup.keep_bitmaps(docs).collect()
    finally:
        line_dedup.written = kept
    plan = dict(plans)["line-drops"]
    assert plan.index("Window") < plan.index("Sort [h1") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("part", [50_000, 2, 300])
def test_line_dedup(spark, monkeypatch, part):
    monkeypatch.setattr(line_dedup, "PART", part)  # 2: all keys are hot, 300: some are
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if part == 300 else "10485760")
    long, other = "A long line that many of the documents hold, indeed!", "é" * 40
    rows = [(i, f"first {i}\n  {long.upper() if i % 2 else long}\t\nlast\n{long}", "s") for i in range(6)] + [(i, f"{other}\n{other}", "s") for i in range(10, 14)]
    rows += [(20, None, "s"), (21, "", "s"), (None, long, "s"), (22, "\n\n", "s"), (23, long[:39] + "\n" + long, "s")]
    rows += [(24, "\n".join(f"line {i % 3000}, as long as it must be to have a key at all" for i in range(20_000)) + "\n" + long, "s"), rows[2]]
    rows += [(30 + i, f"{other}\n" * 200 + "end", "s") for i in range(3)]
    docs = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 40:
                docs[key(x)].add(d)
    got = {r.doc_id: r for r in line_dedup.deduplicate_lines(table(spark, rows, extra=True)).collect()}
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(docs.get(key(x), ())) >= 5 and d != max(docs[key(x)]) for x in lines]
        assert (got[d].n_lines, got[d].n_dropped) == (len(lines), sum(gone))
        assert got[d].text == "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert line_dedup.deduplicate_lines(table(spark, rows).limit(0)).count() == 0


def test_mixing(spark, corpus):
    rows = [*corpus, *[(1000 + i, sentence(random.Random(i), 40), "big") for i in range(80)], (None, "a b c", "s1")]
    got = mixing.mixing_report(table(spark, rows, extra=True)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    target |= {s: weight[s] * level for s in free}
    source, taken = {d: s for d, _, s in rows}, collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted((r.doc_id or -1, r.taken) for r in mixing.mixing_report(table(spark, rows)).collect()) == sorted((r.doc_id or -1, r.taken) for r in got)
    mixed = mixing.mix(table(spark, rows, extra=True), words_per_shard=700)
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
        assert r.n_chars == len(r.text)
    assert {d: n for d, n in words.items() if n} == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.mixing_report(table(spark, rows).limit(0)).count() == 0
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0


def test_mix_with_many_documents_without_words(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice((None, "", " \n ")) if rng.random() < 0.6 else sentence(rng, rng.randint(1, 9)), "abc"[i % 3]) for i in range(300)]
    taken = {r.doc_id: r.taken for r in mixing.mixing_report(table(spark, rows)).collect()}
    words = collections.Counter()
    for r in mixing.mix(table(spark, rows), words_per_shard=100).collect():
        words[r.doc_id] += len(r.text.split())
    assert len(taken) == len(rows) and dict(words) == {d: n for d, n in taken.items() if n}


def test_mixing_report_is_of_the_dealt_draws(spark, corpus, monkeypatch):
    runs = mixing.shard_runs
    monkeypatch.setattr(mixing, "shard_runs", lambda *args: runs(*args).where("shard <> 1"))  # a fault in the deal
    docs = table(spark, corpus)
    words = collections.Counter()
    for r in mixing.mix(docs, words_per_shard=700).collect():
        words[r.doc_id] += len(r.text.encode().split())
    report = mixing.mixing_report(docs, words_per_shard=700).collect()
    assert len(report) == len(corpus) and {r.doc_id: r.taken for r in report if r.taken} == dict(words)


def test_mixing_by_a_brute_force_draw(spark, corpus, monkeypatch):
    """Small blocks and shards, the tree in several levels: the mix is what the draws say, each once."""
    monkeypatch.setattr(mixing, "FANOUT", 3)
    monkeypatch.setattr(mixing, "STRETCHES", 4)
    docs, bounds = table(spark, corpus), {"block_bytes": 300, "words_per_shard": 200}
    plan = mixing.planned(docs, ["doc_id"], mixing.WEIGHTS, 1.5, 2.0, 300, 7)
    draws = mixing.dealt(plan, 7, 200).collect()
    blocks = {(r.key, r.block): r for r in plan.blocks.collect()}
    assert len({r.shard for r in draws}) > 20 and len(blocks) > 40
    assert len({(r.key, r.block, r.epoch) for r in draws}) == len(draws)
    for r in blocks.values():  # the run of each source by hand: whole epochs, then leading blocks
        lead = sum(b.words for b in blocks.values() if b.key == r.key and b.nth < r.nth)
        want = [r.words] * r.epochs + [x for x in [max(0, min(r.words, r.rest - lead))] if x]
        assert sorted(d.extra for d in draws if (d.key, d.block) == (r.key, r.block)) == sorted(want if r.words else [])
    inside = collections.defaultdict(list)
    for r in plan.placed.collect():
        inside[r.key, r.block].append((r.place, r.id or "", r.row.doc_id, len((r.text or "").encode().split())))
    taken = collections.Counter()
    for d in draws:
        left = d.extra
        for _, _, doc, size in sorted(inside[d.key, d.block]):
            taken[doc] += min(size, left)
            left -= min(size, left)
    report = mixing.mixing_report(docs, **bounds).collect()
    assert {r.doc_id: r.taken for r in report if r.taken} == {d: n for d, n in taken.items() if n}
    words = collections.Counter()
    for r in mixing.mix(docs, **bounds).collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert words == +taken


def test_splitting_tree_is_exact():
    draws = np.array([10, 0, 7, 123])
    parts = mixing.split(draws, 9, np.random.default_rng(1))
    assert (parts.sum(axis=1) == draws).all() and (parts >= 0).all() and np.ptp(parts.sum(axis=0)) <= 1


def test_token_files(spark, corpus, monkeypatch):
    path = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = [*corpus, (-5, "a  b \n\n c.\nD e,\r\n<|endoftext|> it's", "s"), (None, "null id", "s"), corpus[4], (7000, "one two. three\nfour", "s")]
    folder = run_dir(spark, "tokens")
    token_store.write_tokens(table(spark, rows, extra=True), folder, path).collect()
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.token_report(spark, folder).collect())
    start = 0
    for (d, t), (at, doc, n, crc) in zip(sorted(((d, t or "") for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (at, doc, n, crc) == (start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 1000)
    many = run_dir(spark, "tokens")  # a file rolls with every slice
    token_store.write_tokens(table(spark, [(0, "x" * 3_000_000, "s"), (1, "a b " * 900_000, "s"), *rows], extra=True), many, path, keep=False, roll_bytes=1).collect()
    assert token_store.read_tokens(spark, many, ids=False).agg(F.count_distinct("file")).first()[0] > 2
    again = [(r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in token_store.token_report(spark, many).orderBy("start").collect()]
    assert collections.Counter(x[:3] for x in again if x[1] < 100_000) == collections.Counter(x[1:] for x in got)
    assert all(a[3] + a[1] == b[3] for a, b in zip(again, again[1:]))
    back = {r.position: list(r.ids) for r in token_store.read_tokens(spark, folder).where("file = 0").collect()}
    assert back and all(x[-1] == 2 for x in back.values())
    empty = run_dir(spark, "tokens")
    token_store.write_tokens(table(spark, rows).limit(0), empty, path).collect()
    assert token_store.token_report(spark, empty).count() == 0


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (255, 3), (65_536, 2), (70_000, 50_257), (131_073, 900)):
        ids = rng.integers(0, k, n).astype(np.uint32)
        packed, blocks = rans.encode_segment(ids)
        assert (np.concatenate(rans.decode_blocks(rans.Table(packed), blocks)) == ids).all()
    one = rans.decode_blocks(rans.Table(packed), blocks[1:2])[0]  # a block decodes alone
    assert (one == ids[65_536:131_072]).all()
    broken = bytearray(blocks[0])
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks(rans.Table(packed), [bytes(broken)])


def test_warc_round_trip_and_salvage(spark):
    big = "<p>" + "x" * 200 + "</p>"
    pages = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "é" * 100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = run_dir(spark, "warc")
    warc.write_archives(df.repartition(1), folder).collect()
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    for p, _, h in pages:
        raw = (h or "").encode()
        revisit = p == 2
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[p].record_type, got[p].refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert (got[p].payload or b"") == (b"" if revisit else raw)
    members = [warc.member(warc.record(i, "u", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), 9, None)) for i in range(5)]
    broken = members[0] + members[1][:40] + b"\x00" * 7 + members[1][47:] + members[2] + b"junk" + members[3][:-9] + members[4]
    found = list(warc.salvaged(broken))
    assert [h["x-page-id"] for _, _, h, _, _ in found if h] == ["0", "2", "4"]
    gaps = [(s, n) for s, n, h, _, _ in found if h is None]
    assert len(gaps) == 2 and sum(n for _, n, *_ in found) == len(broken)
    plain = b"".join(warc.record(i, "u", b"p", hashlib.sha256(b"p").hexdigest(), 1, None) for i in range(3))
    damaged = plain[:20] + b"?" + plain[21:]
    assert [bool(h) for _, _, h, _, _ in warc.salvaged(damaged.replace(b"WARC/1.1", b"WARK/1.1", 1))] == [False, True, True]
    assert not list(warc.salvaged(b""))


def warc_records(n):
    blocks = [hashlib.sha256(b"%d" % i).hexdigest().encode() * 40 for i in range(n)]
    return [warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), len(b), None) for i, b in enumerate(blocks)]


def warc_ids(data):
    return [int(h["x-page-id"]) for _, _, h, _, _ in warc.salvaged(data) if h]


def test_warc_salvage_inside_a_member():
    recs = warc_records(6)
    spoilt = [*recs[:2], recs[2].replace(b"Content-Length", b"Content-Langth"), *recs[3:]]
    found = list(warc.salvaged(warc.member(b"".join(spoilt)) + warc.member(recs[0])))
    assert [int(h["x-page-id"]) if h else None for _, _, h, _, _ in found] == [0, 1, None, 3, 4, 5, 0]
    assert f"bytes {len(recs[0] + recs[1])} to {len(b''.join(spoilt[:3]))} " in found[2][4]


def test_warc_salvage_before_the_damage_of_a_member():
    random.seed(3)
    bodies = [random.randbytes(3000) for _ in range(6)]
    one = warc.member(b"".join(warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), len(b), None) for i, b in enumerate(bodies)))
    cut = one[: len(one) // 2]
    after = warc.member(warc_records(10)[9])
    assert warc_ids(cut) == [0, 1] and warc_ids(cut + after) == [0, 1, 9]
    broken = bytearray(one)
    broken[-4] ^= 1  # its length field
    assert warc_ids(bytes(broken) + after) == [0, 1, 2, 3, 4, 5, 9]
    for data in (cut, cut + after, bytes(broken) + after):
        gaps = [(s, n) for s, n, h, _, r in warc.salvaged(data) if h is None and r == "damaged member"]
        assert len(gaps) == 1 and sum(gaps[0]) <= len(data)


def test_warc_plain_archive_with_gzip_body():
    body = zlib.compress(b"x" * 50, wbits=31)
    first = warc.record(0, "u", body, hashlib.sha256(body).hexdigest(), len(body), None)
    plain = first + b"".join(warc_records(4)[1:])
    assert warc_ids(plain) == [0, 1, 2, 3]
    assert warc_ids(plain.replace(b"WARC/1.1", b"WARK/1.1", 1)) == [1, 2, 3]


def foreign(body, *headers):
    head = [b"WARC/1.0", b"WARC-Type: response", *headers, b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_of_other_writers(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    sha1, sha256 = hashlib.sha1(body), hashlib.sha256(body)
    kind = b"Content-Type: application/http"
    good = [
        foreign(body, kind, b"WARC-Block-Digest: sha1:" + base64.b32encode(sha1.digest())),
        foreign(body, kind, b"WARC-Block-Digest: sha1:" + sha1.hexdigest().encode()),
        foreign(body, kind, b"WARC-Block-Digest: SHA-256:" + sha256.hexdigest().upper().encode()),
        foreign(body, kind, b"WARC-Block-Digest: blake3:abc", b"WARC-Target-URI: http://a/\r\n b"),
        foreign(body, kind, b"X-Page-Id: 12x", b"X-Refers-To-Page-Id: \xc2\xb2"),
        foreign(body, kind, b"X-Page-Id: 99999999999999999999"),
    ]
    bad = [
        foreign(body, b"WARC-Block-Digest: sha1:" + base64.b32encode(b"x" * 20)),
        good[0].replace(b"Content-Length: ", b"Content-Length: \xc2\xb2"),
        good[0].replace(b"Content-Length: ", b"Content-Length: -"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join([good[0], bad[0], good[1], bad[1], good[2], bad[2], *good[3:]]))
    (tmp_path / "zipped.warc.gz").write_bytes(b"".join(map(warc.member, [good[0], bad[0], good[4]])))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert collections.Counter((r.path.rsplit("/")[-1], r.kind) for r in rows) == {("plain.warc", "record"): 6, ("plain.warc", "gap"): 3, ("zipped.warc.gz", "record"): 2, ("zipped.warc.gz", "gap"): 1}
    assert all(bytes(r.payload) == b"hello" and r.page_id is None for r in rows if r.kind == "record")


def test_warc_repeats_long_pages_and_no_pages(spark):
    long = "é" * 3_000_000
    pages = [(1, "u", long), (1, "u", long), (2, "u", long), (2, "u", long), (3, "v", "x" * 99), (4, "v", "x" * 99)]
    folder = run_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, roll_bytes=1000).collect()
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder, payloads=False).collect())
    assert got == [(1, "response", None, 6_000_000)] * 2 + [(2, "revisit", 1, 6_000_000)] * 2 + [(3, "response", None, 99), (4, "response", None, 99)]
    folder = run_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder).collect()
    assert warc.read_archives(spark, folder).count() == 0


def test_context_tree(spark):
    texts = ["the cat sat on the mat", "The cat  sat on a mat 7", "", "xyz", "é ü the cat", "aaaaaaaa bbb aaaa"] * 3
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "the mat"), (40, None)]
    depth, count, kids = context_tree.DEPTH, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def steps(t):
        b = b"\0" * depth + (t or "").encode().translate(ASCII_LOWER) + b"\xff"
        return [(b[i - depth : i], b[i]) for i in range(depth, len(b))]

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    known = collections.Counter()
    for d, t in docs:
        if not held(d):
            known.update([*words_of(t), "END"])
            for c, s in steps(t):
                for k in range(depth + 1):
                    for j in range(8):
                        u = (1 << j) | (s >> (8 - j))
                        count[c[depth - k :], u][(s >> (7 - j)) & 1] += 1
                        if k < depth:
                            kids[c[depth - k :], u].add(c[depth - k - 1 :])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, u):
        pe = kt(*count[c, u])
        if len(c) == depth:
            return pe
        return float(np.logaddexp(pe, sum(weighted(k, u) for k in kids[c, u]))) - math.log(2)

    def p(c, u, bit, k=0):
        here = c[depth - k :]
        if (here, u) not in count:
            return 0.5
        n = count[here, u]
        one = (n[bit] + 0.5) / (sum(n) + 1)
        if k == depth:
            return one
        w = 0.5 * math.exp(kt(*n) - weighted(here, u))
        return w * one + (1 - w) * p(c, u, bit, k + 1)

    total, distinct = sum(known.values()), len(known)
    got = {r.doc_id: r for r in context_tree.scored(spark.createDataFrame(docs, "doc_id long, text string").withColumn("chunk", F.lit(1)).repartition(3)).collect()}
    for d, t in docs:
        r, w = got[d], [*words_of(t), "END"]
        score = sum(math.log10(p(c, (1 << j) | (s >> (8 - j)), (s >> (7 - j)) & 1)) for c, s in steps(t) for j in range(8))
        base = sum(math.log10((known.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(x in known for x in w), total)
        assert r.score == pytest.approx(score, abs=1e-8) and r.base_score == pytest.approx(base, abs=1e-8)
    assert context_tree.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_model_separates(spark):
    rng = random.Random(3)
    good = [(i, "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau"]) + rng.choice(["", "s", "ing"]) + str(rng.choice(["", "x", "y", "zed"])) for _ in range(12)) + "." for _ in range(6)), "s") for i in range(60)]
    bad = [(100 + i, " ".join(f"{rng.choice('abc') * 4}###" for _ in range(80)), "s") for i in range(10)] + [(200 + i, " ".join("BUY NOW!!".split()[rng.randrange(2)] for _ in range(90)), "s") for i in range(10)]
    got = {r.doc_id: r for r in quality_model.quality_scores(table(spark, [*good, *bad, (300, None, None), (None, "", "s")], extra=True)).collect()}
    assert all(got[d].kept for d, _, _ in good) and not any(got[d].kept for d, _, _ in bad)
    assert not got[300].kept and not got[None].kept and len(got) == 82
    assert quality_model.quality_scores(table(spark, good).limit(0)).count() == 0


def plain_em(ballots):
    """Document by document: (prior, table[labeller][class][vote], posterior of each)."""
    n = len(ballots[0])
    q = [0.1 if quality_model.BAD in b else 0.98 for b in ballots]
    for _ in range(200):
        table = []
        for j in range(n):
            classes = []
            for c in (0, 1):
                sums = [quality_model.PSEUDO * quality_model.EXPECTED[c][v] for v in range(3)]
                for b, x in zip(ballots, q, strict=True):
                    sums[b[j]] += x if c else 1 - x
                classes.append([x / sum(sums) for x in sums])
            table.append(classes)
        prior = min(0.99, max(0.01, sum(q) / len(q)))
        q = []
        for b in ballots:
            good, bad = prior, 1 - prior
            for j, v in enumerate(b):
                good, bad = good * table[j][1][v], bad * table[j][0][v]
            q.append(good / (good + bad))
    return prior, table, q


def plain_scorer(texts, target, rounds=60, rate=2.0, decay=1e-6):
    """The same logistic regression on a dense matrix."""
    x = np.zeros((len(texts), quality_model.BUCKETS))
    for i, t in enumerate(texts):
        for pair in quality_model.word_buckets(t.split()):
            for k in pair:
                x[i, k] += 1 / len(t.split())
    used = np.flatnonzero(x.any(axis=0))
    x, w, b = x[:, used], np.zeros(len(used)), 0.0
    share = min(0.98, max(0.02, target.mean()))
    gain = target / share + (1 - target) / (1 - share)
    g2, b2 = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-(x @ w + b))) - target) * gain / len(texts)
        g = x.T @ e + decay * w
        g2, b2 = g2 + g * g, b2 + e.sum() ** 2
        w, b = w - rate * g / np.sqrt(g2), b - rate * e.sum() / math.sqrt(b2)
    return 1 / (1 + np.exp(-(x @ w + b)))


def test_quality_model_is_plain_em_and_regression(spark):
    rng = random.Random(8)
    junk = lambda n: " ".join(rng.choice(("$$$", "##a", "BUY", "NOW", "&|&", "word")) for _ in range(n))
    docs = [(i, sentence(rng, rng.randint(6, 90)) + ".", "s") for i in range(40)] + [(50 + i, junk(rng.randint(6, 70)), "s") for i in range(12)]
    docs += [(70, "one two", "s"), (71, sentence(rng, 30_000), "s")]
    rows = [*docs, docs[3], docs[45], (80, None, "s"), (None, "", "s")]  # repeats, no text
    got = [(r.doc_id, r.weak_label, r.score) for r in quality_model.quality_scores(table(spark, rows, extra=True)).collect()]
    ballots = [quality_model.votes((t or "").encode()) for _, t, _ in rows]
    posterior = plain_em(ballots)[2]
    weak = {d: p for (d, _, _), p in zip(rows, posterior, strict=True)}
    texts = [t.encode() for _, t, _ in docs]
    score = dict(zip([d for d, _, _ in docs], plain_scorer(texts, np.array([weak[d] for d, _, _ in docs])), strict=True)) | {80: 0.0, None: 0.0}
    assert len(got) == len(rows)
    for d, p, s in got:
        assert p == pytest.approx(weak[d], abs=1e-6) and s == pytest.approx(score[d], abs=1e-4)
    few = quality_model.sampled_texts(table(spark, rows).select("doc_id", "text"), len(rows), 30, 2000)
    assert 0 < len(few) <= 30 and sum(map(len, few)) <= 2000


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(6)
    n, k = 60_000, len(quality_model.LABELLERS)
    planted = np.stack([np.stack([rng.dirichlet((6, 4, 1)), rng.dirichlet((6, 0.3, 5))]) for _ in range(k)])
    good = rng.random(n) < 0.8
    ballot = np.stack([(rng.random((n, 1)) > np.cumsum(planted[j], axis=1)[good.astype(int)]).sum(axis=1).clip(max=2) for j in range(k)], axis=1)
    patterns, counts = np.unique(ballot @ 3 ** np.arange(k), return_counts=True)
    model = quality_model.fit_labels(patterns, counts)
    assert abs(model.prior - good.mean()) < 0.02 and np.abs(model.table - planted).max() < 0.04
    assert ((model.posterior[ballot @ 3 ** np.arange(k)] > 0.5) == good).mean() > 0.95
    never = ballot.copy()
    never[:, 0][never[:, 0] == quality_model.GOOD] = quality_model.ABSTAIN  # a labeller that never votes good
    patterns, counts = np.unique(never @ 3 ** np.arange(k), return_counts=True)
    assert quality_model.fit_labels(patterns, counts).table[0, :, quality_model.GOOD].max() < 0.002


def test_held_out_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = pytest.importorskip("pandas") is not None and spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_model.quality_scores(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95


def test_token_counts(spark, corpus):
    pieces = token_counts.vocabulary(public.path("piece_bpe_32k.model"))
    trie = token_counts.TrieCounter(pieces)

    def brute(word):
        w, best = token_counts.SPACE + word.decode(), [(0.0, 0)]
        for end in range(1, len(w) + 1):
            size = len(w[end - 1].encode())
            found = [(best[end - 1][0] + token_counts.BYTE_SCORE * size, best[end - 1][1] - size)]
            found += [(best[b][0] + pieces[w[b:end]], best[b][1] - 1) for b in range(end) if w[b:end] in pieces]
            best.append(max(found))
        return -best[-1][1]

    words = [b"the", b"there", b"thereby", b"zzqx", "漢字".encode(), "😀a".encode(), b"a" * 300, b"tion"]
    assert trie.counts(words).tolist() == [brute(w) for w in words]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(table(spark, corpus, extra=True), public.path("piece_bpe_32k.model")).collect()}
    for d, t, _ in corpus:
        w = (t or "").encode().split()
        assert got[d] == (len(w), sum(brute(x) for x in w) if d != 98 else got[d][1])
    path = public.path("piece_bpe_32k.model")
    rows = [(None, "the cat", "s"), (1, "the " * 200_000, "s"), (1, "the cat", "s")]
    again = sorted((r.doc_id or 0, r.n_pretokens) for r in token_counts.token_counts(table(spark, rows), path).collect())
    assert again == [(0, 2), (1, 2), (1, 200_000)]
    assert token_counts.token_counts(table(spark, rows).limit(0), path).count() == 0


def test_segments_of_token_files_are_bounded(spark):
    folder = run_dir(spark, "tokens")
    rows = [(i, f"{i} " + "some words of a text " * 5000, "s") for i in range(40)]
    token_store.write_tokens(table(spark, rows).coalesce(1), folder, public.path("byte_bpe_50k.json"), keep=False, segment_ids=1).collect()
    segments = [docs for r in spark.read.format("binaryFile").load(folder).collect() for docs, _, _ in token_store.unpacked(bytes(r.content))]
    assert sum(map(len, segments)) == 40 and max(map(len, segments)) <= 10  # of 105,000 bytes a text, a slice of 1 MB at most
    assert token_store.token_report(spark, folder).count() == 40
