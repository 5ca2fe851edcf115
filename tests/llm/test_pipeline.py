"""The pipeline against a brute-force version of its stages."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from hindcast.llm import packing, quality

from .test_operators import TEXTS, brute_groups, sets_of, words


def test_stages(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    frames = {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = corpus_pipeline.written(docs, name)
        frames[name] = docs
    for name in ("quality_rules", "near_copy_join", "substring_dedup", "pii"):
        assert frames[name].columns == frames["in"].columns
    kept = {(r.doc_id, r.text) for r in quality.judged(frames["in"]).where("kept").collect()}
    good = [(r.doc_id, r.text) for r in frames["quality_rules"].collect()]
    assert set(good) == kept
    sets = [(i, sets_of(t, 5)) for i, t in good if i is not None]
    group = brute_groups([(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)])
    alone = [r.doc_id for r in frames["near_copy_join"].collect()]
    assert collections.Counter(alone) == collections.Counter([*{i for i, _ in sets if group.get(i, i) == i}, *[i for i, _ in good if i is None]])
    rest = [(r.doc_id, r.text) for r in frames["near_copy_join"].collect()]
    seen = collections.defaultdict(lambda: 1 << 60)
    for i, t in rest:
        for k in range(len(words(t)) - 12):
            if i is not None:
                g = tuple(words(t)[k : k + 13])
                seen[g] = min(seen[g], i)
    want = {}
    for i, t in rest:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and seen[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    assert {r.doc_id: r.text for r in frames["substring_dedup"].collect()} == want
    assert frames["pii"].where(F.length("text") != F.col("n_chars")).count() == 0
    tok = packing.word_ids(packing.public_tokenizer()).tokenizer
    ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 2] for r in frames["pii"].collect()}
    pieces = collections.defaultdict(list)
    for r in frames["packing"].collect():
        pieces[r.doc_id].append((r.start, r.ids))
    assert {i: [x for p in sorted(v) for x in p[1]] for i, v in pieces.items()} == ids
