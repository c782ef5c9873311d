"""The pipeline's stages against brute force over what each stage is given."""

import re
from collections import Counter

import numpy as np

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import language_id, simhash_dedup, stages, tokens

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.materialise(stage(spark, tables[-1], SF_DIR), name))
    assert all(t.columns == docs.columns for t in tables[1:-1])
    first, spoken, single, cut, mixed = [{r["doc_id"]: r for r in t.collect()} for t in tables[:-1]]
    told = language_id.predict(docs.select("doc_id", "text"), *language_id.fitted(docs)).collect()
    sure = {r["doc_id"] for r in told if r["score"] >= stages.SURE}
    assert set(spoken) == {i for i, r in first.items() if i in sure and r["text"] and re.search(r"[^\W\d_]", r["text"])}

    prints = dict(zip(spoken, simhash_dedup.fingerprints([r["text"] for r in spoken.values()]).tolist()))
    parent = {i: i for i in prints}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(single) == {i for i in prints if root(i) == i}

    seen, kept = set(), {}
    for i in sorted(single):
        words = re.findall(r"[^\x20\x09-\x0D]+", single[i]["text"])
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        left = " ".join(w for w, g in zip(words, gone) if not g)
        if left:
            kept[i] = left if any(gone) else single[i]["text"]
    assert {i: r["text"] for i, r in cut.items()} == kept
    assert all(r["n_chars"] == len(r["text"]) for i, r in cut.items() if r["text"] != single[i]["text"])

    copies = Counter(r["doc_id"] for r in tables[4].collect())
    assert max(copies.values()) <= 3 and all(mixed[i]["text"] == cut[i]["text"] for i in mixed)

    packed = tables[5].collect()
    coder = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).tokenizer
    expected = Counter()
    for i, n in copies.items():
        size = len(coder.encode(mixed[i]["text"], add_special_tokens=False).ids) + 1
        for k in range(-(-size // 2048)):
            expected[i, k, min(2048, size - 2048 * k)] += n
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == expected
    fill = np.array([r["length"] for r in packed]).sum() / 2048
    assert len({r["sequence_id"] for r in packed}) <= 1.1 * fill + 2


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, did long, th string, rows int, kept string, copies int, score double, lang_pred string, row string, times int, `left` string, first boolean, copy int"


def _odd(spark):
    """Null ids and texts, repeated rows, ties, a very long text and columns named like the stages' own."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, None), (2, None), (3, ""), (4, long), (5, "seven eight nine ten eleven twelve"), (5, "another text under the same id")]
    made = [(i, t, "en" if k % 2 else None, None if k == 3 else "ab"[k % 2], len(t or ""), 7, "t", 8, "k", 9, 0.5, "xx", "r", 10, "l", True, 11) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, CLASHING)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], _odd(spark)
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    got = stage(spark, docs, SF_DIR)
    rows = got.collect()
    if name != "best_fit_packing":
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert {tuple(r[c] for c in extra) for r in rows} == {(7, "t", 8, "k", 9, 0.5, "xx", "r", 10, "l", True, 11)}
    if name == "language_id":
        assert all(r["text"] and re.search("[a-z]", r["text"]) for r in rows)
    if name == "simhash_dedup":
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == [(True, 1), (True, 2), (True, 4), (True, 5), (True, 5)]
    if name == "substring_dedup":
        assert len(rows) == 9 and all(r["text"] == "one two three four five six" for r in rows if r["doc_id"] == 1)
        cut = next(r for r in rows if r["doc_id"] == 4)
        assert cut["text"] == " ".join(f"w{i}" for i in range(977)) and cut["n_chars"] == len(cut["text"])
    if name == "source_mixing":
        assert all((r["text"] or "").strip() for r in rows)
    if name == "best_fit_packing":
        assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5} and len(rows) >= 9
    empty = stage(spark, docs.limit(0), SF_DIR)
    assert empty.count() == 0 and empty.columns == got.columns


def test_language_stage_rejects_what_is_no_language_it_is_sure_of(spark):
    import random

    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(30)), ("aa", "bb")[i % 2 == 0]) for i in range(400)]
    rows += [(1000 + i, " ".join(word("abcde") for _ in range(32)) + " " + " ".join(word("vwxyz") for _ in range(32)), None) for i in range(20)] + [(2000, "12 34 !!", None), (2001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    kept = {r["doc_id"] for r in stages.keep_languages(docs).collect()}
    assert len(kept & set(range(400))) >= 396 and not kept & {2000, 2001} and len(kept & set(range(1000, 1020))) <= 4
