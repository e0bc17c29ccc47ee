import random
import re
from collections import Counter

import corpus_pipeline
import regex
from test_text_ops import plain_repeats
from test_tokens import check_packing, plain

from spanloom.llm import neardup, toxicity

WORDS = lambda t: regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", t.lower()).split()


def holds(text, item):
    g, w = Counter(_grams(WORDS(item))), _grams(WORDS(text))
    m = sum(g.values())
    return any(sum((c & g).values()) / sum((c | g).values()) >= 0.8 for s in range(max(1, len(w) - m + 1)) if (c := Counter(w[s : s + m])))


def _grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similarities(docs):
    """Exact similarity of the five-word shingles of all pairs (least doc_id first)."""
    ids, sets = sorted(docs), {}
    for d in ids:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), docs[d] or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return {(b, a): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0 for i, a in enumerate(ids) for b in ids[:i]}


def test_pipeline_against_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, labels)
    texts = {d: t for d, t in texts.items() if model.score(t) < 0.5}
    pairs = similarities(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = {r.doc_id: r.component for r in neardup.similar_groups(frame).collect()}
    assert all(group[a] == group[b] for (a, b), x in pairs.items() if x >= 0.8) and sum(x >= 0.8 for x in pairs.values()) > 1
    for d, c in group.items():
        assert d == c or max(x for (a, b), x in pairs.items() if d in (a, b) and group[a] == group[b]) > 0.65
    texts = {d: t for d, t in texts.items() if group[d] == d}
    texts = dict(zip(texts, plain_repeats(list(texts.items()))))
    texts = {d: t for d, t in texts.items() if not any(holds(t, i) for i in items)}
    ids = {d: [*x, 2] for d, x in zip(texts, plain(list(texts.values())))}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing([tuple(r) for r in got.collect()], ids)


def test_stages_keep_columns_and_take_odd_rows(spark, sf):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(80))
    rows = [(1, text, "en", "s", len(text)), (2, text, None, None, None), (None, text, "en", "s", 3), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (1, text, "en", "s", len(text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == docs.columns, name
            kept = out.collect()
            assert len(kept) == (len(rows) if name in ("toxicity", "substring_dedup", "decontamination") else 4) or frame is not docs
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
