"""The pipeline's stages against brute force on a small corpus, with nulls, repeated rows and clashing column names."""

import os
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from logmill.llm import common, language_id, token_output

WORDS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LANGUAGES = {"aa": [f"l{x}rem{y}" for x in "aeiou" for y in "bdgklm"], "bb": [f"zw{x}rt{y}" for x in "aeiou" for y in "jkqvxz"]}
#: Names that operators call their own columns, or once did.
CLASHES = ["score", "rejected", "lang_pred", "_text_", "items", "n_hit", "contaminated", "_d", "_n", "_th", "th", "d", "h", "s", "n", "again", "copy", "c0", "c1", "key", "row", "alike", "taken", "start"]


def words(text):
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    text = lambda lang, n: " ".join(r.choice(LANGUAGES[lang]) for _ in range(n))
    rows = []
    for i in range(240):
        lang = "ab"[i % 2] * 2
        rows.append((i, text(lang, r.choice([12, 30, 60, 150])), lang, f"s{i % 3}" if i % 7 else None))
    for i in range(240, 260):  # near copies
        w = rows[i - 240][1].split()
        rows.append((i, " ".join([*w[:-1], "other"]), rows[i - 240][2], "s1"))
    bench = [(k, text("aa", 20)) for k in range(5)] + [(5, "short one"), (6, None), (7, "")]
    rows += [(300 + k, text("aa", 25) + " " + bench[k][1] + " " + text("aa", 25), "aa", "s0") for k in range(5)]
    rows += [(310, "Short, ONE", "aa", "s0"), (400, None, "aa", "s0"), (401, "", "bb", "s1"), (402, "12 34 !", None, None), (403, text("bb", 3_000), "bb", "s2"), (None, text("aa", 40), None, None)]
    rows += [rows[7], rows[7], rows[-1]]  # repeated rows
    path = tmp_path_factory.mktemp("tables")
    full = [(*row, *range(len(CLASHES))) for row in rows]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES)
    spark.createDataFrame(full, schema).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "token_output":
            assert docs.columns == columns
        docs = docs.cache()
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != "token_output":
            assert all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in seen[name])
    before = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    at = lambda rows: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows)

    # language ID: texts without letters go
    assert at(seen["language_id"]) == at(r for r in before if language_id.has_letter(r["text"]))

    # one of each group of near copies
    rows = seen["language_id"]
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    heads = {}
    for r, g in zip(rows, group, strict=True):
        heads.setdefault(g, []).append((r["doc_id"] is None, r["doc_id"] or 0))
    assert at(seen["ngram_join"]) == sorted(-1 if null else i for null, i in map(min, heads.values()))
    assert len(seen["ngram_join"]) < len(rows) - 15

    # contaminated texts go
    bench = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in bench if w for i in range(max(1, len(w) - 12))}
    clean = []
    for r in seen["ngram_join"]:
        w = words(r["text"])
        hit = {p for k in {len(x) for x in windows} for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows for p in range(i, i + k)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r)
    assert at(seen["decontamination"]) == at(clean) and len(clean) == len(seen["ngram_join"]) - 6

    # copies: none above 2, words near their targets
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    total = sum(map(size, clean))
    mixed = seen["mixing"]
    assert abs(sum(map(size, mixed)) / (1.5 * total) - 1) < 0.02 and set(at(mixed)) <= set(at(clean))
    assert max(at(mixed).count(i) for i in set(at(mixed))) <= 2

    # tokens: what the library says, in order
    t = token_output.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*t.encode(r["text"], add_special_tokens=False).ids, 2]))) for r in mixed)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["ids_crc32"]) for r in seen["token_output"]) == want
    assert len(stages) == 5 and sum(r["n_tokens"] for r in seen["token_output"]) == max(r["start"] + r["n_tokens"] for r in seen["token_output"])


def test_run_writes_every_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) > 200 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(rows[0].asDict())


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_hold_no_freed_memory_for_later_stages(spark):
    """A worker outlives its stage; what the stage freed, in pieces between others that stay, goes back to the system."""

    def crumbled(batch):
        large, small = [], []
        for i in range(4000):
            large.append(bytearray(64 << 10))
            small.append(bytearray(2000))
        common.kept_by_test = small
        return pa.RecordBatch.from_pydict({"pid": [os.getpid()]})

    [pid] = [r.pid for r in common.arrow_map(spark.range(1).coalesce(1), crumbled, "pid long").collect()]
    with open(f"/proc/{pid}/status") as status:
        held = next(int(x.split()[1]) for x in status if x.startswith("RssAnon")) >> 10
    assert pid != os.getpid() and held < 150
