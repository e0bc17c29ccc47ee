import datetime
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import decontam, fingerprint, langid, quality, queries, spans, toxicity, urlfilter
from spanloom.llm.common import fold
from spanloom.llm.simhash import likeness

MID = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


# -- op8


def plain_simhash(text):
    """256 signed votes, one word pair after the other, in Python integers."""
    words = (text or "").lower().encode().split()
    cut = []
    for w in words:
        cut += [w[i : i + 8] for i in range(0, len(w), 8)] if len(w) > 24 else [w]
    terms = [(cut[0], min(len(cut[0]), 12))] if len(cut) == 1 else [(a + b" " + b, min(len(a), 12) + min(len(b), 12)) for a, b in zip(cut, cut[1:])]
    votes, full = [0] * 256, 2**64 - 1
    for term, weight in terms:
        h = xxhash.xxh64_intdigest(term)
        for k in range(4):
            x = h * (xxhash.xxh64_intdigest(f"word {k}", 7) | 1) & full
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & full
            x ^= x >> 32
            for b in range(64):
                votes[64 * k + b] += weight if x >> b & 1 else -weight
    return sum(1 << b for b in range(256) if votes[b] > 0)


def test_op8_fingerprints_against_plain_votes(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:40] + [None, "", "one", "x" * 100, "a a a a"]
    for t in texts:
        assert "".join(f"{int(w):016x}" for w in fingerprint.text_fingerprint(t)[::-1]) == f"{plain_simhash(t):064x}"


def test_op8_counts_against_all_pairs(spark):
    got = queries.op8_simhash_edits(spark, MID).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    asked = [r for r in got if r.doc_id % 20 == 0]
    assert all(r.n_within is None for r in got if r.doc_id % 20) and len(asked) == 50
    for r in asked:
        assert r.n_within == sum((int(r.fingerprint, 16) ^ f).bit_count() <= fingerprint.NEAR for f in prints)


def test_op8_counts_in_a_dense_bucket(spark):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 4).astype(np.uint64)
    rows = []
    for i in range(3000):
        w = base.copy()
        for b in rnd.choice(40, rnd.integers(0, 6), replace=False):
            w[3] ^= np.uint64(1) << np.uint64(b)
        rows.append((i, *w.view(np.int64).tolist()))
    rows += [(5000, None, 0, 0, 0), (None, *rows[0][1:])]
    frame = spark.createDataFrame(rows, "doc_id long, w0 long, w1 long, w2 long, w3 long")
    got = {r.doc_id: r.n_within for r in fingerprint.with_counts(frame, F.col("doc_id") % 20 == 0).collect()}
    words = np.array([r[1:] for r in rows if r[1] is not None]).astype(np.int64).view(np.uint64)
    assert len(got) == len(rows) and got[5000] is None and got[None] is None
    for i in range(0, 3000, 20):
        assert got[i] == int((np.bitwise_count(words ^ words[i]).sum(axis=1) <= fingerprint.NEAR).sum())


def test_op8_against_a_plain_walk(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op8_simhash_edits(spark, sf).collect()}
    assert len(got) == len(docs)
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        n = len(t) // 3
        other = t[: len(t) - n] + nxt[:n]
        a, b, c = (fingerprint.text_fingerprint(x) for x in (t, other, nxt))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{int(w):016x}" for w in a[::-1]) and r.edited_fingerprint == "".join(f"{int(w):016x}" for w in b[::-1])
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))
    long = [r for r in got.values() if r.n_chars > 600]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_op8_odd_rows(spark):
    rows = [(5, "one two three four five six"), (5, "one"), (None, "z y x"), (3, None), (1, ""), (2, "x" * 500_000), (5, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as s", "true as extra")
    got = fingerprint.edit_probe(docs).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    lone = fingerprint.edit_probe(docs.limit(1)).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    none = fingerprint.edit_probe(docs.limit(0))
    assert none.count() == 0 and fingerprint.with_counts(none, F.lit(True)).count() == 0


def test_block_tables_find_all_within_radius(spark):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, (8, 4)).astype(np.uint64)
    rows = []
    for i in range(120):
        w = base[i % 8].copy()
        for b in rnd.choice(256, rnd.integers(0, 20), replace=False):
            w[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append((i, *w.view(np.int64).tolist()))
    frame = spark.createDataFrame(rows, "doc_id long, w0 long, w1 long, w2 long, w3 long")
    got = {(r.q_doc_id, r.doc_id): r.distance for r in fingerprint.search(frame, frame.where("doc_id % 20 = 0"), radius=12).collect()}
    words = np.array([r[1:] for r in rows]).astype(np.int64).view(np.uint64)
    d = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    assert got == {(i, j): int(d[i, j]) for i in range(0, 120, 20) for j in range(120) if d[i, j] <= 12}


# -- op3


def test_op3_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{MID}/pages.parquet'")
    want = sorted(con.execute(queries.OP3_SQL).fetchall(), key=str)
    got = queries.op3_temporal_list(spark, MID)
    assert got.columns == ["page_id", "host", "fetched", "blocked", "entry", "since"]
    assert sorted(map(tuple, got.collect()), key=str) == want and {r[3] for r in want} == {True, False}


def test_op3_intervals_and_odd_rows(spark):
    day = datetime.date
    entries = [("A.com", "add", day(2024, 1, 5)), ("a.com", "add", day(2024, 1, 7)), ("a.com", "remove", day(2024, 1, 9)), ("a.com", "add", day(2024, 1, 9)), ("b.a.com", "remove", day(2024, 1, 1)), ("b.a.com", "add", day(2024, 1, 8)), ("x", "add", None), (None, "add", day(2024, 1, 1))]
    lst = spark.createDataFrame(entries, "entry string, action string, day date").withColumn("since", F.lit(1))
    got = {(r.entry, r.since, str(r.until)) for r in urlfilter.intervals(lst.drop("since")).collect()}
    assert got == {("a.com", day(2024, 1, 5), "2024-01-09"), ("a.com", day(2024, 1, 9), "9999-12-31"), ("b.a.com", day(2024, 1, 8), "9999-12-31")}
    caps = [(1, "http://u:p@c.B.a.com:80/x", day(2024, 1, 8)), (2, "https://a.com", day(2024, 1, 4)), (3, None, day(2024, 1, 8)), (4, "no url", day(2024, 1, 8)), (5, "http://a.com./", day(2024, 1, 6)), (5, "http://a.com./", day(2024, 1, 6)), (6, "http://za.com", day(2024, 1, 6)), (7, "http://a.com", None)]
    frame = spark.createDataFrame(caps, "page_id long, url string, fetched date").withColumn("list", F.lit("clash"))
    got = sorted((r.page_id, r.blocked, r.entry) for r in urlfilter.active_entries(frame, lst.drop("since")).collect())
    assert got == [(1, True, "b.a.com"), (2, False, None), (3, False, None), (4, False, None), (5, True, "a.com"), (5, True, "a.com"), (6, False, None), (7, False, None)]
    assert urlfilter.active_entries(frame.limit(0), lst.drop("since")).count() == 0
    assert urlfilter.active_entries(frame, lst.drop("since").limit(0)).where("blocked").count() == 0


# -- op4, op5, op7


def test_op4_held_out(spark):
    got = queries.op4_nnpu_toxicity(spark, MID)
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert got.count() == 1000 and auc([r.toxic for r in held], [r.score for r in held]) > 0.75
    wrong = [r for r in rows if r.predicted == 1 and r.toxic == 0]
    assert len(wrong) <= 3 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_op4_scores_against_a_plain_sum(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{MID}/labels.parquet"), learn=fold(F.col("k"), 5) != 0)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    got = {r.doc_id: r.score for r in queries.op4_nnpu_toxicity(spark, MID).collect()}
    for r in docs.collect():
        words = set(re.findall(r"\w+", (r.text or "").lower()))
        z = model.bias + sum(weight.get(h, 0.0) for h in {zlib.crc32(w.encode()) for w in words})
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)))


def test_op4_samples_are_bounded_by_rows(spark):
    docs = spark.range(5000).selectExpr("id % 3 as doc_id", "concat('words of ', id) as text")
    rows = spark.createDataFrame([(0,), (1,), (2,)], "k long")
    assert len(toxicity._sample(docs, rows, "doc_id", "text", 2, 3)) == 2


def test_op4_odd_rows(spark):
    rows = [(i, "plain words here and there") for i in range(300)] + [(1000 + i, "vile words here") for i in range(20)] + [(None, "vile"), (7, None), (8, ""), (1000, "vile words here"), (9, "plain " * 200_000), (9, "plain " * 200_000 + "vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "'clash' as score")
    labels = spark.createDataFrame([(i, 0) for i in range(90)] + [(1000 + i, 1) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == ("vile" in (r.text or "")) for r in got)
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs, empty).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_nnpu_handles_hidden_positives():
    rnd = np.random.default_rng(0)
    hidden = rnd.random(4000) < 0.3
    x_unl = np.column_stack([np.where(hidden, rnd.random(4000) < 0.9, rnd.random(4000) < 0.05), rnd.random(4000) < 0.5]).astype(float)
    x_pos = np.column_stack([rnd.random(500) < 0.9, rnd.random(500) < 0.5]).astype(float)
    w, b = toxicity.nnpu(x_pos, x_unl, 0.3)
    assert w[0] + b > 0 > b and abs(w[1]) < abs(w[0])


def test_op5_against_labels_it_never_read(spark):
    got = queries.op5_weak_quality(spark, MID)
    rows = got.join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    assert got.count() == 1000 and auc([r.quality for r in rows], [r.score for r in rows]) > 0.9
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.95


def plain_votes(text):
    """The labellers' rules, character by character."""
    tokens = (text or "").split()
    if not tokens:
        return "-------00"
    chars = [c for t in tokens for c in t]
    letters = [c for c in chars if re.fullmatch(r"[^\W\d_]", c)]
    words = [w for t in tokens for w in re.findall(r"[^\W\d_]+", t)]
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(tokens)
    digits, upper = sum(c.isdigit() for c in chars), sum(c.isupper() for c in chars)
    stops, size = sum(t[-1] in ".!?" for t in tokens) / n, len(letters) / max(1, len(words))
    say = lambda x, good, poor: "1" if x <= good else "0" if x >= poor else "-"
    return "".join([
        say(1 - len(letters) / len(chars) - digits / len(chars), 0.12, 0.25), say(upper / max(1, len(letters)), 0.15, 0.4),
        say(sum(t[-2:] in ("!!", "??") for t in tokens) / n, 0.02, 0.2), say(1 - len(set(zip(tokens, tokens[1:]))) / max(1, n - 1), 0.2, 0.45) if n >= 8 else "-",
        say(1 - len(set(lines)) / max(1, len(lines)), 0.1, 0.4) if text.count("\n") >= 2 else "-", say(tokens.count("|") / n, 0.02, 0.3), say(digits / len(chars), 0.03, 0.15),
        "1" if 0.02 <= stops <= 0.4 else "0" if stops == 0 and n >= 60 else "-", "1" if 2.5 <= size <= 9 else "0" if size < 1.5 or size > 15 else "-",
    ])


def plain_features(text):
    made, kind = Counter(), lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    tokens = (text or "").split()
    for t in tokens:
        for i in range(0, len(t), 24):
            made["s " + re.sub(r"(.)\1+", r"\1", "".join(map(kind, t[i : i + 24])), flags=re.S)] += 1
        if len(t) <= 4:
            made["w " + t.lower()] += 1
    made["one time"] += sum(n == 1 for n in Counter(tokens).values())
    return {k: n for k, n in made.items() if n}


def test_op5_against_a_plain_scorer(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    texts |= {-1: None, -2: " \n ", -3: "Ab1!! " + "x" * 100 + "Y7" * 40, -4: "ÄÖ ǅ ½ Ⅷ ²\n\na\na\na", -5: "𝐀𝐁 b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labelled = quality.written(quality.weak_labels(docs), "t")
    assert {r.k: r.pattern for r in labelled.collect()} == {k: plain_votes(t) for k, t in texts.items()}
    model = quality.train(labelled)
    got = {r.k: r for r in quality.scored(labelled, model).collect()}
    for k, t in texts.items():
        made = Counter()
        for name, n in plain_features(t).items():
            made[zlib.crc32(name.encode()) % quality.BUCKETS] += n
        z = model.bias + sum(model.weights[b] * math.sqrt(n / sum(made.values())) for b, n in made.items()) if made else -60
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), abs=1e-5)
        assert got[k].weak == model.posterior[plain_votes(t)]


def test_op5_sample_is_bounded_by_rows(spark):
    docs = spark.range(3000).selectExpr("id % 500 as doc_id", "if(id % 2 = 0, 'A plain sentence with words. Another one follows it here.', '### ||| 9999 !!!!') as text")
    seen = []
    fit, quality.fit_scorer = quality.fit_scorer, lambda rows, soft: seen.append(len(rows)) or (np.zeros(quality.BUCKETS), 0.0)
    try:
        quality.train(quality.written(quality.weak_labels(docs), "t"), 7)
    finally:
        quality.fit_scorer = fit
    assert seen == [14]


def test_op5_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "A fine text. It has words."), (4, "x " * 100_000), (4, "x " * 100_000), (5, "!!! ### %%%")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit(1))
    got = quality.quality(docs).collect()
    assert len(got) == 6 and all(r.predicted == 0 for r in got if r.doc_id in (1, 2))
    assert quality.quality(docs.limit(0)).count() == 0


def test_em_finds_good_labellers():
    rnd = np.random.default_rng(1)
    good = rnd.random(20_000) < 0.8
    votes = [np.where(rnd.random(20_000) < p, good, ~good).astype(int) for p in (0.95, 0.9, 0.6)]
    patterns = {}
    for v in zip(*votes):
        patterns[tuple(map(int, v))] = patterns.get(tuple(map(int, v)), 0) + 1
    share, prob = quality.estimate(patterns)
    assert abs(share - 0.8) < 0.05 and abs(prob[1, 0, 2] - 0.95) < 0.03 and abs(prob[0, 1, 1] - 0.9) < 0.06


def test_op7_held_out(spark):
    got = queries.op7_subword_langid(spark, MID)
    rows = got.join(spark.read.parquet(f"{MID}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000 and np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_op7_against_a_plain_mean(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = langid.train(docs, learn=fold(F.col("k"), 3) != 1)
    got = {r.doc_id: r for r in queries.op7_subword_langid(spark, MID).collect()}
    for r in docs.limit(60).collect():
        data = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {r.text.lower()} ".encode()] if r.text else []
        if not any(unicodedata.category(c)[0] == "L" for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        total, count = np.zeros(len(model.langs)), 0
        for n in langid.GRAMS:
            for i in range(len(data) - n + 1):
                h = sum(c * m for c, m in zip(data[i : i + n], langid._MULT[n])) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                total += model.table[h >> 18]
                count += 1
        z = (total / count + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id].lang_pred == model.langs[int(p.argmax())] and got[r.doc_id].score == pytest.approx(p.max(), abs=1e-4)


def test_op7_letters_and_bounds(spark):
    assert not any(map(langid.has_letter, (None, "", "½", "²", "Ⅷ", "٣", "_ 9 !"))) and all(map(langid.has_letter, ("中", "ª", "ǅ", "1 é")))
    docs = spark.range(4000).selectExpr("id % 1000 as doc_id", "concat('words of row ', id, repeat(' and more text', 400)) as text", "concat('l', id % 1000 % 8) as lang")
    rows = []
    fit, langid.fit = langid.fit, lambda parts, langs: rows.append((parts, langs))
    try:
        langid.train(docs, per_language=50, max_rows=80, max_segments=3)
    finally:
        langid.fit = fit
    parts, langs = rows[0]
    assert 8 <= len(langs) <= 80 and max(map(len, parts)) == 3 and all(len(x) <= langid.SEGMENT for p in parts for x in p) and max(Counter(langs).values()) <= 10


def test_op7_odd_rows(spark):
    train = [(i, "the and of with that from words", "en") for i in range(40)] + [(100 + i, "der die und mit ein von nicht", "de") for i in range(40)] + [(1, None, "en"), (2, "x", None), (None, "y", "en")]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "und nicht " * 50_000), (5, "Ω"), (5, "Ω")], "doc_id long, text string").withColumn("accepted", F.lit(1))
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und", "und", "und", "de"] and got[5] in ("de", "en")
    assert langid.predict(odd, langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd.limit(0), model).count() == 0


def test_long_text_in_parts_is_the_same():
    model = langid.Model(["a", "b"], np.random.default_rng(0).random((langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    data = langid.folded("some words and others " * 900)
    assert np.allclose(model.logits(data), model.logits(data, rows=777))


# -- op9


def plain_units(t):
    """(begin, end, words) of sentence units, word by word."""
    spots = [m.span() for m in re.finditer(r"\S+", t)]
    lists, now = [], []
    for i, (_, end) in enumerate(spots):
        now.append(i)
        gap = t[end : spots[i + 1][0]] if i + 1 < len(spots) else "\n"
        if "\n" in gap or t[end - 1] in ".!?…":
            lists.append(now)
            now = []
    pieces = []
    for s in lists:
        ends = {s[-1]}
        if len(s) > 12:
            h = [xxhash.xxh32_intdigest(t[slice(*spots[i])].lower().encode()) for i in s]
            for w in range(len(s) - 7):
                ends.add(s[w + min(range(8), key=lambda j: (h[w + j], j))])  # noqa: B023
        now = []
        for i in s:
            now.append(i)
            if i in ends:
                pieces.append(now)
                now = []
    begins = [0] + [spots[p[0]][0] for p in pieces[1:]] + [len(t)]
    return [(a, b, [t[slice(*spots[i])] for i in p]) for a, b, p in zip(begins, begins[1:], pieces)]


def plain_spans(t):
    """(words in lower case, first unit, last unit) of the shortest run of two units and 20 words from each unit on."""
    cut = plain_units(t) if t else []
    for a in range(len(cut)):
        for b in range(a + 1, len(cut)):
            words = [w.lower() for _, _, u in cut[a : b + 1] for w in u]
            if len(words) >= 20:
                yield " ".join(words), a, b
                break


def plain_repeats(rows):
    """(key, text) to cleaned text, by the definition, one span at a time."""
    version = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & (1 << 31) - 1
    place = lambda k, t: (k is None, k or 0, version(t))
    first = {}
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: place(*r)):
        for span, _, _ in plain_spans(t):
            first.setdefault(span, place(k, t))
    out = []
    for k, t in rows:
        gone, seen = set(), set()
        for span, a, b in plain_spans(t):
            if first[span] != place(k, t) or span in seen:
                gone.update(range(a, b + 1))
            seen.add(span)
        out.append("".join(t[a:b] for i, (a, b, _) in enumerate(plain_units(t)) if i not in gone) if gone else t)
    return out


def test_op9_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in queries.op9_sentence_spans(spark, MID).collect()}
    assert got == dict(zip([k for k, _ in rows], plain_repeats(rows)))
    assert sum(got[k] != t for k, t in rows) > 20


def test_op9_planted_passages_and_odd_rows(spark):
    rnd = np.random.default_rng(4)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 7))
    passage = ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(7)) + "."
    mine = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = [(9, f"{mine[0]} {passage} {mine[1]}"), (2, f"{mine[2]}. {passage}\n{mine[3]}"), (5, mine[4]), (None, f"{passage} {mine[5]}"), (6, None), (7, ""), (5, mine[4]), (8, "word " * 60_000), (11, passage + " " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as first")
    got = spans.drop_repeats(docs).collect()
    assert [c for c in spans.drop_repeats(docs).columns] == ["doc_id", "text", "h", "first", "removed_units", "removed_chars"]
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[2].text == rows[1][1] and by[5].text == mine[4] and by[6].text is None and by[7].text == ""
    for k in (9, None, 11):
        assert by[k].removed_units > 0 and len(set(by[k].text.split()) & set(passage.split())) < 20
    assert all(w in by[9].text for w in mine[0].split()[:40])
    assert spans.drop_repeats(docs.limit(0)).count() == 0
    assert dict(zip([id(r) for r in rows], plain_repeats(rows)))[id(rows[1])] == by[2].text


def test_op9_null_and_repeated_keys(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    passage = ". ".join(" ".join(word() for _ in range(9)) for _ in range(7)) + "."
    own = [" ".join(word() for _ in range(30)) + ". " for _ in range(6)]
    rows = [(None, own[0] + passage), (None, own[1] + passage), (4, "\n " + own[2]), (4, own[3]), (7, own[4] + passage.upper()), (7, own[5] + passage), (4, own[3])]
    frames = [rows, [r for r in rows if r[0] is None], [r for r in rows if r[0] == 7]]
    for some in frames:
        docs = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "'x' as removed_units", "1 as removed_chars", "2 as k", "3 as at")
        got = spans.drop_repeats(docs)
        assert got.columns == ["doc_id", "text", "k", "at", "removed_units", "removed_chars"]
        assert sorted((r.text for r in got.collect())) == sorted(plain_repeats(some))
        kept = [r.text for r in got.collect() if passage[:200].lower() in r.text.lower()]
        assert len(kept) == 1


def test_shared_runs_of_50_words_hold_a_common_span():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 8))) for _ in range(3000)]

    def text(n, stops):
        out = rnd.choices(words, k=n)
        at = rnd.randint(1, 30)
        while stops and at < n:
            out[at] += "."
            at += rnd.randint(1, stops)
        return out

    def inside(passage, before, after):
        cut = spans.units(" ".join(before + passage + after))
        begins = [0]
        for _, _, w in cut:
            begins.append(begins[-1] + len(w))
        low, high = len(before), len(before) + len(passage)
        found = [(begins[a], begins[b + 1]) for a, b in spans.spans(cut)]
        return {(a - low, b - low) for a, b in found if low <= a and b <= high}

    for stops in (0, 6, 16, 40):
        for _ in range(400):
            passage = text(50, stops)
            one, two = (inside(passage, text(rnd.randrange(200), s), text(rnd.randrange(200), s)) for s in (0, rnd.choice([0, 16])))
            assert one & two, passage


def test_units_cover_the_text():
    for t in ("\n\nfoo\n", "", "a", " a. b!\n\nc? d...e f.", "x " * 100, "\n\n", "A b c. " * 30 + "tail"):
        cut = spans.units(t)
        assert "".join(t[a:b] for a, b, _ in cut) == (t if t.strip() else "")


# -- op10


def test_op10_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect()}
    import regex

    words = lambda t: regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", t.lower()).split()
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    from collections import Counter

    want = {}
    for i, t in items.items():
        g = Counter(grams(words(t)))
        m = sum(g.values())
        for d, x in docs.items():
            w = grams(words(x))
            if len(set(w) & set(g)) < 0.8 * len(g):
                continue
            for s in range(max(1, len(w) - m + 1)):
                c = Counter(w[s : s + m])
                both = sum((c & g).values())
                if both / sum((c | g).values()) >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), both / sum((c | g).values()))
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op10_simhash_windows(spark, MID).collect()}
    assert got == pytest.approx(want) and len(want) > 5


@pytest.mark.parametrize("changes", [2, 3])
def test_op10_loses_no_edited_item(spark, changes):
    rnd = random.Random(changes)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 8)))
    items = [[word() for _ in range(100)] for _ in range(8)]
    rows, want = [], set()
    for i in range(200):
        item = items[i % 8]
        copy = list(item)
        for at in rnd.sample(range(100), changes):
            copy[at] = word()
        g, c = (Counter(tuple(x[j : j + 5]) for j in range(96)) for x in (item, copy))
        rows.append((i, " ".join([word() for _ in range(rnd.randrange(50))] + copy + [word() for _ in range(rnd.randrange(50))])))
        if sum((g & c).values()) / sum((g | c).values()) >= 0.8:
            want.add((i, i % 8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == want and (changes == 3 or len(want) == 200)


def test_op10_fingerprints_have_no_overflow(spark):
    rnd = np.random.default_rng(3)
    h = rnd.integers(-(2**63), 2**63 - 1, 501)
    want = 0
    for b in range(64):
        want |= int(((h.view(np.uint64) >> np.uint64(b)) & np.uint64(1)).sum() * 2 > len(h)) << b
    frame = spark.createDataFrame([(h.tolist(), [-1] * 70_000)], "h array<long>, ones array<long>")
    got = frame.select(decontam.simhash(F.col("h"), 501).alias("a"), decontam.simhash(F.col("h"), 70_000).alias("b"), decontam.simhash(F.col("ones"), 70_000).alias("c")).first()
    assert got.a & (2**64 - 1) == want == got.b & (2**64 - 1) and got.c == -1


def test_op10_odd_rows(spark):
    item = "One two three, four five six seven eight nine ten eleven twelve thirteen fourteen."
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, ""), (None, "lonely words of a null item here"), (1, item)], "item_id long, text string")
    other = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, "a b " + item.upper() + " c d"), (2, None), (3, ""), (4, other + " " + item), (5, "one two three four five"), (None, item), (6, "this short item is there"), (1, "a b " + item.upper() + " c d"), (7, "lonely words of a null item here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item", "2 as n")
    got = {(r.doc_id, r.item_id, r.start_word) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1, 2), (4, 1, 50_000), (None, 1, 0), (6, 2, 1), (7, None, 0)}
    assert decontam.contaminated(docs.limit(0), items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_op10_plan_has_no_python(spark, sf):
    found = queries.op10_simhash_windows(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in found and "Arrow" not in found and "Cartesian" not in found


@pytest.mark.parametrize("key", [None, 0, 7, -3, 10**15])
def test_fold_is_crc32_of_the_key(spark, key):
    import zlib

    got = spark.createDataFrame([(key,)], "k long").select(fold(F.col("k"), 5)).first()[0]
    assert got == (0 if key is None else zlib.crc32(str(key).encode()) % 5)
