import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import common, neardup
from spanloom.llm.common import connected_components
from spanloom.llm.queries import op1_simhash_pivots


def plain_fp(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows, r=3):
    ids, fps = [d for d, _ in rows], [f for _, f in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= r:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: least[root(i)] for i in range(len(rows))}


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_pivots(spark, sf).collect()}
    fps = [(r.doc_id, plain_fp(r.text)) for r in docs]
    want = plain_components(fps)
    assert got == {d: (f"{f:016x}", want[d]) for d, f in fps}


def test_buckets_split_without_losing_links(spark):
    rnd = random.Random(5)
    fps = []
    for _ in range(40):
        base = rnd.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(10)]
    refs = neardup.pivots()
    rows = [(int(np.uint64(f).astype(np.int64)), bytes(int(f ^ int(p)).bit_count() for p in refs)) for f in dict.fromkeys(fps)]
    frame = spark.createDataFrame(rows, "fp long, pivots binary")
    want = plain_components([(r[0], r[0] & (2**64 - 1)) for r in rows])
    for cap in (4096, 5, 1):
        roots = {r.node: r.root for r in connected_components(neardup.links(frame, 3, cap)).collect()}
        groups, expected = {}, {}
        for f, _ in rows:
            groups.setdefault(roots.get(f, f), set()).add(f)
            expected.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_edges_stay_linear_in_a_dense_bucket():
    fps = np.array([sum(1 << i for i in range(n)) for n in range(60)], np.uint64)
    tables = np.bitwise_count(fps[:, None] ^ neardup.pivots()[None, :]).astype(np.uint8)
    u, v = neardup.bucket_forest(np.zeros(60, np.int64), fps, tables, 3)
    assert len(u) == 59 and len(set(v)) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, None), (3, " \t"), (None, ""), (1, "")]])
def test_nulls_empty_texts_and_repeats(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all(r.fp == 0 and r.component == 1 for r in got)


def test_long_text_and_words_between_other_blanks():
    text = "a b c " * 200_000
    assert neardup.text_fingerprint(text) == plain_fp(text)
    assert neardup.text_fingerprint("Ä b\x1fc É d") == plain_fp("Ä b\x1fc É d")


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_groups_find_edited_copies(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 10)))
    rows, want = [], {}
    for i in range(30):
        words = [word() for _ in range(400)]
        rows.append((i * 10, " ".join(words)))
        want[i * 10] = i * 10
        for j in range(1, 4):
            edited = list(words)
            for _ in range(j):
                edited[rnd.randrange(400)] = word()
            rows.append((i * 10 + j, " ".join(edited)))
            want[i * 10 + j] = i * 10
        rows.append((i * 10 + 9, " ".join(words[:200] + [word() for _ in range(200)])))
        want[i * 10 + 9] = i * 10 + 9
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (0, rows[0][1])]
    want |= {1000: 1000, 1001: 1000, None: 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as fps")
    for cap in (4096, 3):
        got = {r.doc_id: r.component for r in neardup.similar_groups(docs, bucket_cap=cap).collect()}
        assert got == want
    assert neardup.similar_groups(docs.limit(0)).count() == 0


def test_similar_groups_link_every_pair_at_the_similarity(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9)))
    rows = [(1, "a b"), (2, "A  b"), (3, "a c")]
    for n in (50, 100, 300):
        for i in range(40):
            words = [word() for _ in range(n)]
            more = round(n * rnd.uniform(0.12, 0.32))
            block = [word() for _ in range(more)]
            copy = [words + block, block + words, words[:-more], words[: n // 2] + block + words[n // 2 :]][i % 4]
            rows += [(len(rows) + 10, " ".join(words)), (len(rows) + 11, " ".join(copy))]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: grams(t) for k, t in rows}
    alike = lambda a, b: len(a & b) / len(a | b)
    found = {r.doc_id: r.component for r in neardup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a, b) for i, (a, _) in enumerate(rows) for b, _ in rows[:i] if alike(sets[a], sets[b]) >= 0.8]
    assert len(pairs) > 50 and all(found[a] == found[b] for a, b in pairs)
    assert all(alike(sets[k], sets[c]) > 0.65 for k, c in found.items())


def test_crossing_parts_do_not_grow_with_a_bucket():
    n = 1500  # texts of one token: 1,124,250 pairs, which were one array before
    at = np.arange(n)
    parts = list(neardup.crossing_parts(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 9), at, at, 0.8, 10_000))
    assert max(map(len, parts)) <= 10_000 + n
    assert len(np.unique(np.concatenate(parts), axis=0)) == sum(map(len, parts)) == n * (n - 1) // 2


def test_crossing_pairs_against_all_pairs():
    rnd = np.random.default_rng(2)
    common = np.sort(rnd.choice(2**40, 60, replace=False).astype(np.uint64))
    sets = []
    for _ in range(150):
        base = np.unique(np.r_[rnd.choice(common, rnd.integers(5, 40), replace=False), rnd.integers(0, 2**63, rnd.integers(0, 12)).astype(np.uint64)])
        sets += [base, np.unique(np.r_[base[: len(base) - rnd.integers(0, 4)], rnd.integers(0, 2**63, rnd.integers(0, 4)).astype(np.uint64)])]
    root = rnd.integers(0, 60, len(sets))
    for late in (common, common[:0]):
        first = [neardup.prefix(s, late, 0.8) for s in sets]
        at = np.repeat(np.arange(len(sets)), [len(f) for f in first])
        place = np.concatenate([np.arange(len(f)) for f in first])
        size = np.array([len(s) for s in sets])
        got = set(zip(*(x.tolist() for x in neardup.crossing_pairs(np.concatenate(first), place, size[at], at, root[at], 0.8, 1000))))
        want = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and neardup.jaccard(sets[i], sets[j]) >= 0.8}
        assert len(want) > 30 and want <= got and all(root[i] != root[j] for i, j in got)


def test_sketches_never_rule_out_a_similar_pair():
    rnd = np.random.default_rng(4)
    ruled = 0
    for _ in range(3000):
        n = int(rnd.integers(0, 400))
        base = rnd.integers(0, 2**63, n).astype(np.uint64)
        other = np.unique(np.r_[base[: int(n * rnd.uniform(0.6, 1))], rnd.integers(0, 2**63, int(n * rnd.uniform(0, 0.4))).astype(np.uint64)])
        base = np.unique(base)
        may = neardup.may_be_similar(neardup.sketch(base), neardup.sketch(other), len(base), len(other), 0.8)
        assert may or neardup.jaccard(base, other) < 0.8
        ruled += not may
    assert ruled > 1000


def test_similar_groups_on_the_tables(spark):
    """Every pair of distinct texts at 0.8 by exact five-word shingles is linked, and few others are."""
    texts = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        texts.setdefault(tuple((r.text or "").lower().split()), []).append(r.doc_id)
    keys = sorted(texts, key=lambda w: min(texts[w]))
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} or {w} for w in keys]
    post = {}
    for i, s in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(i)
    met = {(i, j) for p in post.values() for j in p for i in p if i < j}
    pairs = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in met}
    found = {r.doc_id: r.component for r in neardup.similar_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    of = [found[min(texts[w])] for w in keys]
    assert all(found[d] == of[i] for i, w in enumerate(keys) for d in texts[w])
    close = [p for p, x in pairs.items() if x >= 0.8]
    assert len(close) >= 5 and all(of[i] == of[j] for i, j in close)
    best = [max([pairs.get((min(i, j), max(i, j)), 0) for j in range(len(keys)) if j != i and of[j] == of[i]], default=1) for i in range(len(keys))]
    assert min(best) > 0.65 and np.mean([b < 0.8 for b in best]) < 0.02


def test_hot_keys_are_joined_whole(spark):
    many = common.written(spark.range(5000).selectExpr("if(id % 3 = 0, 7L, id) as k", "id as x").union(spark.createDataFrame([(None, 1)], "k long, x long")), "many")
    one = spark.range(0, 5000, 2).selectExpr("id as k", "id * 10 as y").union(spark.createDataFrame([(7, 70)], "k long, y long"))
    want = sorted(map(tuple, many.join(one, "k").select("k", "x", "y").collect()))
    assert sorted(map(tuple, common.looked_up(many, one, "k").select("k", "x", "y").collect())) == want
    assert sorted(map(tuple, common.salted(many, one, "k").select("k", "x", "y").collect())) == want
    left = many.join(one, "k", "left").select("k", "x", "y").collect()
    assert sorted(map(tuple, common.looked_up(many, one, "k", "left").select("k", "x", "y").collect()), key=str) == sorted(map(tuple, left), key=str)


def test_tables_on_the_way_are_deleted(spark):
    made = []
    before = {k: spark.conf.get(k, None) for k in common.WRITING}

    def build(fail=False):
        made.append(common.written(spark.range(3), "step"))
        if fail:
            raise ValueError
        return made[-1].selectExpr("id + 1 as id")

    out = common.settled(spark, "done", build)
    with pytest.raises(ValueError):
        common.settled(spark, "done", lambda: build(True))
    assert sorted(r.id for r in out.collect()) == [1, 2, 3] and {k: spark.conf.get(k, None) for k in common.WRITING} == before
    for m in made:
        assert not Path(m.inputFiles()[0].removeprefix("file://")).exists()
    assert Path(out.inputFiles()[0].removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere"
            getConf = staticmethod(lambda: {})

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_dir(Session)
