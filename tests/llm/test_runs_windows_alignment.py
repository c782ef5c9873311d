"""Operators 11 to 13 through their registered queries against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ledgerline.llm import differencing, periodic_runs, token_alignment, tokens
from ledgerline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every lag; its smallest period by trying all smaller ones."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(6, 4 * q) and not any(all(own[k] == own[k + d] for k in range(len(own) - d)) for d in range(1, q)):
                found.append((i, len(own), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force_on_random_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words: list[int] = []
        while len(words) < rng.randint(0, 400):
            root = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, rng.choice([3, 12, 40, 90])))]
            words += (root * rng.randint(1, 7))[: rng.randint(1, 300)]
        assert periodic_runs.find_runs(np.array(words, np.int64), len(words)) == brute_runs(words)


def expected_runs(key, text) -> tuple:
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_op11_registered(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[k] for k in names) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    short = {k for k, t in texts.items() if len(WORD.findall(t or "")) <= 600}
    assert set(got) == set(texts) and len(short) > 100 and sum(got[k][0] > 0 for k in short) > 5
    assert {k: got[k] for k in short} == {k: expected_runs(k, texts[k]) for k in short}


def test_runs_of_odd_tables(spark):
    long = "x y " * 300_000
    rows = spark.createDataFrame([(1, "a b " * 4, 1), (1, "a b " * 4, 1), (None, None, 2), (2, "", 3), (3, long, 4), (4, "a\x1cb  " * 9, 5)], "doc_id long, text string, runs int")
    got = sorted((r["did"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(rows).collect())
    assert got == [
        (-(2**63), 0, [], ""), (1, 8, [(0, 8, 2)], "a b"), (1, 8, [(0, 8, 2)], "a b"), (2, 0, [], ""),
        (3, 600_000, [(0, 600_000, 2)], "x y"), (4, 9, [(0, 9, 1)], "a\x1cb "),
    ]
    assert periodic_runs.periodic_runs(rows.limit(0)).count() == 0


def test_op12_registered(spark):
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in QUERIES["op12_differencing"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in documents(spark).collect():
        ids, at = np.array([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces.pop(d["doc_id"]), key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(own.tobytes()), len(ids)) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    for own in places.values():
        own.sort()
        total = sum(n for _, n in own)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert total <= 2048 and total & (total - 1) == 0


def test_differencing_is_near_equal_and_counts_rise():
    rng = np.random.default_rng(4)
    lengths = np.minimum(2047, rng.lognormal(5.8, 0.9, 800)).astype(np.int64) + 1
    sums = np.bincount(differencing.difference(lengths, 150), lengths, 150)
    greedy = np.zeros(150)
    for n in np.sort(lengths)[::-1]:
        greedy[greedy.argmin()] += n
    assert sums.sum() == lengths.sum() and np.ptp(sums) <= np.ptp(greedy)
    #: The textbook case: differencing leaves a difference of two.
    assert sorted(np.bincount(differencing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    window, count = differencing.windows_for(lengths, 2048)
    assert np.bincount(window, lengths, count).max() <= 2048 and count >= -(-lengths.sum() // 2048)
    assert differencing.windows_for(np.array([3, 3, 3]), 4)[1] == 3


def test_level_fills_every_window():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 300):
        lengths = rng.integers(1, 64, n)
        sums, own = Counter(), Counter()
        spans = defaultdict(list)
        for item, start, length, window, offset in differencing.level(lengths, 64):
            sums[window] += length
            own[item] += length
            spans[window].append((offset, length))
        assert [own[i] for i in range(n)] == lengths.tolist()
        assert sum(s == 64 for s in sums.values()) == lengths.sum() // 64 and all(s & (s - 1) == 0 for s in sums.values())
        for parts in spans.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(parts, parts[1:]))


def test_windows_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "word " * 5000)], "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit("s")})
    got = differencing.pack_by_differencing(rows, tokens.vocabulary("word_bpe_49k.json")).collect()
    assert Counter((r["did"], r["doc_tokens"]) for r in got if r["start"] == 0) == {(1, 2): 2, (-(2**63), 1): 1, (2, 5001): 1}
    assert differencing.pack_by_differencing(rows.limit(0), tokens.vocabulary("word_bpe_49k.json")).count() == 0


def brute_alignment(texts: dict) -> dict:
    a, b = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")), SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    back = {c: x for x, c in tokens._CHARACTERS.items()}
    names = {i: bytes(back.get(ord(c), ord(c)) for c in t) for t, i in a.get_vocab().items()}
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    raw = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    found, count = {}, Counter()
    for key, text in texts.items():
        found[key] = ([], Counter(), 0, 0)
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        if b"".join(names[i] for i in x) != whole or b"".join(raw[i] for i in y) != whole:
            continue
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(x):
            own_a, own_b = [x[i]], [y[j]]
            at_a, at_b = at_a + len(names[x[i]]), at_b + len(raw[y[j]])
            i, j = i + 1, j + 1
            while at_a != at_b:
                if at_a < at_b:
                    own_a.append(x[i])
                    at_a, i = at_a + len(names[x[i]]), i + 1
                else:
                    own_b.append(y[j])
                    at_b, j = at_b + len(raw[y[j]]), j + 1
            groups.append((own_a, own_b))
        links = Counter((p, q) for own_a, own_b in groups for p in own_a for q in own_b)
        found[key] = (groups, links, len(x), len(y))
        count.update(links.keys())
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = {}
    for key, (groups, links, n_a, n_b) in found.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[key] = (n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), sha(text) if text else "")
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_op13_registered(spark):
    got = {r["doc_id"]: tuple(r[k] for k in (*NAMES, "groups_sha256")) for r in QUERIES["op13_cross_tokenizer"](spark, SF).collect()}
    assert got == brute_alignment({r["doc_id"]: r["text"] for r in documents(spark).collect()})


def odd_texts() -> dict:
    rng = random.Random(9)
    bits = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " ", "\n", "\t", "a", "don't", "É", "ﬁ", "½", "日本語", "12", " word", "...", "́", " ", "\x1c", "▁", "x" * 40, "Σ", "\r\n", "\U0001f600", "of the"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for i in range(3000)}
    return texts | {5000: None, 5001: "", 5002: " ", 5003: "\n", 5004: "  a  ", 5005: "é" * 3000, 5006: "ก" * 2000 + "x", 5007: "the cat " * 20_000}


def test_alignment_of_odd_texts_in_small_runs(spark, monkeypatch):
    texts = odd_texts()
    rows = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, run string").repartition(3)
    paths = [tokens.vocabulary(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    held = token_alignment.materialise(token_alignment.aligned(rows, *paths, 5), "aligned")
    expected = brute_alignment(texts)
    for fan_in in (1024, 2):
        got = {r["did"]: (*(r[k] for k in NAMES), sha(r["groups"]) if r["groups"] else "") for r in token_alignment.summed(held, 5, fan_in).collect()}
        assert got == expected


def test_alignment_of_an_empty_table_and_of_repeated_rows(spark):
    paths = [tokens.vocabulary(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r["did"], r["n_links"], r["count_sum"]) for r in token_alignment.align_tokenizers(rows, *paths).collect())
    assert got == [(-(2**63), 0, 0), (1, 2, 4), (1, 2, 4)]
    assert token_alignment.align_tokenizers(rows.limit(0), *paths).count() == 0


def test_large_groups_are_formed_from_distinct_ids(monkeypatch):
    paths = [tokens.vocabulary(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    texts = [t for t in odd_texts().values() if t]
    one = token_alignment.Aligner(*paths)
    monkeypatch.setattr(token_alignment, "_LARGE", 0)
    other = token_alignment.Aligner(*paths)
    (f, g, owner, pair, times), (f2, g2, owner2, pair2, times2) = one.align(texts), other.align(texts)
    assert (f == f2).all() and g == g2
    assert Counter(zip(owner, one.pair_keys[pair], times)) == Counter(zip(owner2, other.pair_keys[pair2], times2))


def test_heap_merge_adds_up_and_keeps_the_order():
    rng = np.random.default_rng(3)
    runs, total = [], Counter()
    for _ in range(7):
        keys = np.unique(rng.integers(0, 40, 60) << 20 | rng.integers(0, 5, 60))
        counts = rng.integers(1, 9, len(keys))
        runs.append((keys, counts))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    out = [(k, c) for keys, counts in token_alignment.heap_merge(runs) for k, c in zip(keys.tolist(), counts.tolist())]
    assert out == sorted(total.items())


def test_texts_cut_at_every_blank_have_the_ids_of_the_whole(monkeypatch):
    """op4, op12: runs of blanks, other white space and a full memory change no id; blanks that are no tokens leave no piece."""
    from ledgerline.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 4)
    own = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    texts = ["a  b\n\n c", " lead and trail ", "x\ty z\x85q\x1fr", "", "\n", "a\r\nb C,d", "one two three four five six", "six five four one", "́a ́b Σ Σ"]
    for _ in range(3):
        for k in range(len(texts)):
            assert own.encode(texts[k:]) == [own._whole(t) for t in texts[k:]]
    assert not any(" " in p or "\n" in p for p in own.known)
