"""LM scoring against brute force: counts, base scores, a distribution that sums to 1, both ways of probing."""

import collections
import math
import pathlib
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logmill.llm import lm_scoring

TEXTS = ["a b a b a c", "a c b b b b", "b b c", None, "", " \n\t", "A B\x0bc \u00e9 \u00c9 na\u00efve", "zz top", " ".join(f"w{i % 31} w{i % 7}" for i in range(3000)), "a b a b a c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1.5, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "a b", None, None), (0, TEXTS[0], 1.5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, chunk string").repartition(3)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def test_counts_and_base_scores_equal_brute_force(docs):
    rows = docs.collect()
    held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    c = collections.Counter(w for r in rows if not held[r.doc_id] for w in words(r.text))
    n, v = sum(c.values()), len(c)
    assert any(held.values())
    for options in ({}, {"model_bytes": 0}, {"model_bytes": 0, "chunk_bytes": 200}):
        got = lm_scoring.score(docs, **options).collect()
        assert len(got) == len(rows)
        texts = {r.doc_id: r.text for r in rows}
        for r in got:
            w = words(texts[r.doc_id])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
            assert r.score <= 0


def test_probabilities_sum_to_one(spark):
    """After every token, over all known tokens and one unknown; with so many bits that no probe is false."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    counts = lm_scoring.count_ngrams(df)
    bloom, table = lm_scoring.build_filter(counts, lm_scoring.segment_bits(counts, 4000)), lm_scoring.gather_tokens(counts.rows.where("kind <> 2").collect())
    known = table.n > 0
    vocabulary, norm = np.append(table.h[known], np.uint64(12345)), table.n.sum() + lm_scoring.ADDED * (known.sum() + 1)
    for h in table.h:
        before = np.full(len(vocabulary), h)
        q = lm_scoring.MIDDLE5[bloom.levels(before, lm_scoring.bigrams(before, lm_scoring.tails(before, vocabulary)))]
        _, p = lm_scoring.probabilities(table.find(vocabulary)[0], q, table.find(before)[1], norm)
        assert abs(p.sum() - 1) < 1e-9
    assert (table.q > 0).sum() > 20


def test_levels_are_those_of_the_counts(spark):
    """Every bigram, those seen once as well, is in the filter with its level."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    seen = collections.Counter()
    for t in TEXTS:
        h, at = lm_scoring.tokens(pa.array([t], pa.string()))
        seen.update(zip(lm_scoring.history(h, at).tolist(), h.tolist(), strict=True))
    first, second = (np.array(x, np.uint64) for x in zip(*seen, strict=True))
    level = np.floor(np.log2(list(seen.values()))) + 1
    f = lm_scoring.bigrams(first, lm_scoring.tails(first, second))
    for hot in (1 << 22, 0):  # dealt by first token, by bigram
        counts = lm_scoring.count_ngrams(df, lm_scoring.layout(df, hot_sample=hot))
        assert (lm_scoring.build_filter(counts, lm_scoring.segment_bits(counts, 4000)).levels(first, f) == level).all()
        assert (lm_scoring.build_filter(counts).levels(first, f) >= level).all()
    assert min(seen.values()) == 1 and max(level) >= 5


def test_scores_do_not_depend_on_the_way_of_probing(docs):
    want = sorted(lm_scoring.score(docs).collect(), key=str)
    for chunk in (8 << 20, 100):
        got = sorted(lm_scoring.score(docs, model_bytes=0, chunk_bytes=chunk).collect(), key=str)
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-12)


def test_bigrams_make_a_difference(spark):
    counts = lm_scoring.count_ngrams(spark.createDataFrame([(0, "a b c d e f")], "doc_id long, text string"))
    both = spark.createDataFrame([(1, "a b c d e f"), (2, "b a d c f e")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(both, counts).collect()}
    assert got[1] > got[2] + 1


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for options in ({}, {"model_bytes": 0}):
        assert lm_scoring.score(none, **options).count() == 0
    counts = lm_scoring.count_ngrams(none)  # a model of nothing knows nothing
    for options in ({}, {"model_bytes": -1}):
        got = lm_scoring.score_texts(docs, counts, **options).collect()
        assert len(got) == docs.count() and all(r.n_known == r.train_tokens == 0 and r.score == r.base_score for r in got)


COUNTING = """
import numpy as np, pyarrow as pa
from logmill.llm import lm_scoring as lm

def anonymous():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) >> 10

r = np.random.default_rng(1)
batches = [pa.RecordBatch.from_pydict({"text": [" ".join(map(str, r.integers(0, 50_000, 2000))) for _ in range(400)]}) for _ in range(8)]
count = lm._count(lm.Layout(10, np.array([lm._START])))
for _ in count(iter([batches[0].slice(0, 9)])):
    pass
open("/proc/self/clear_refs", "w").write("5")
before = anonymous()
peak = next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmHWM")) >> 10
rows = sum(out.num_rows for out in count(iter(batches)))
print(rows, next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmHWM")) // 1024 - peak, anonymous() - before)
"""


def test_counting_gives_memory_back():
    """6.4 million tokens: MB above the start at the peak, and afterwards, in a worker that lives on."""
    done = subprocess.run([sys.executable, "-c", COUNTING], capture_output=True, text=True, check=True, cwd=pathlib.Path(__file__).parents[2])
    rows, peak, after = map(int, done.stdout.split())
    assert rows >= 2 * 1024 and peak < 390 and after < 60
