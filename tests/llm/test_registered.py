"""The registered queries and whole operators against brute force: tokens, packing, pages, quality, mixing and language."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import html_extraction, language_id, mixing, packing, quality_rules, token_files, tokens
from ledgerline.llm.queries import QUERIES
from ledgerline.session import scratch

SF = "/root/testdata/sf0.001"
VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", VOCABULARIES)
def test_encoder_equals_a_fresh_tokenizer_on_random_texts(name):
    path = tokens.vocabulary(name)
    plain, coder, rng = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "\n", "\t", "a", "don't", "É", "ß", "日本", "12", " word", "...", "\u0301", "\u2003", "\x1c", "<|", "|>", "x" * 40, "Σ", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    expected = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == expected


def test_special_literals_become_their_ids():
    assert np.frombuffer(tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")).encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]
    assert np.frombuffer(tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [320, 49407, 321]


def test_op2_registered(spark):
    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    got, base = {r["doc_id"]: r for r in QUERIES["op2_token_files"](spark, SF).collect()}, 0
    for r in sorted(table(spark, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (base, len(ids), zlib.crc32(ids.tobytes()))
        base += len(ids)


def test_token_files_of_repeated_rows_and_ties(spark):
    path = tokens.vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (1, "a"), (None, "n"), (2, None)], "doc_id long, text string").withColumns({"did": F.lit("x"), "start": F.lit(1)})
    folder = scratch(spark) + "/token-ties"
    manifest = token_files.write_token_files(docs.repartition(3), folder, path)
    rows = sorted((r["start"], r["did"], len(r["ids"]) // 4) for r in token_files.read_token_files(spark, folder).collect())
    assert [r[1] for r in rows] == [-(2**63), 1, 1, 1, 2] and rows[-1][0] + rows[-1][2] == manifest["tokens"]


def test_op4_registered(spark):
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    by, places = {(r["doc_id"], r["piece"]): r for r in rows}, {}
    total = 0
    for d in table(spark, "documents").collect():
        ids = np.array([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k in range(-(-len(ids) // 2048)):
            r, part = by.pop((d["doc_id"], k)), ids[2048 * k : 2048 * k + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(part.tobytes()))
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert not by and len(places) <= -(-total // 2048) + 1
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048


def test_packing_reaches_the_least_number_of_bins():
    rng = np.random.default_rng(2)
    lengths = np.sort(np.minimum(2048, rng.lognormal(6.2, 0.9, 4000)).astype(np.int64) + 1)[::-1]
    least = -(-int(lengths.sum()) // 2049)
    assert packing.sum_of_squares(lengths, 2049, least // 2)[2] <= least + 1 <= packing.sum_of_squares(lengths, 2049)[2]


def test_packing_leaves_clashing_columns_alone(spark):
    cut = spark.createDataFrame([(1, 2, 0, 30, "x"), (1, 3, 0, 30, "y")], "did long, th long, piece int, length long, bins string")
    assert sorted(r["bins"] for r in packing.pack(cut, capacity=64).collect()) == ["x", "y"]


def test_op3_registered(spark):
    """The text of the article element, its markup taken away, block ends and white space aside."""
    from html import unescape

    got = {r["page_id"]: r for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    pages = table(spark, "pages").collect()
    squeeze = lambda t: re.sub(r"\s+", "", t)
    for p in pages:
        inner = re.search(r"(?is)<article[^>]*>(.*?)</article>", p["html"] or "")
        if inner:
            body = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", inner[1])
            assert squeeze(got[p["page_id"]]["text"]) == squeeze(unescape(re.sub(r"<[^>]*>", "", body)))
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"]) and got[p["page_id"]]["url"] == p["url"]
    assert len(got) == len(pages)


def test_extraction_of_odd_tables(spark):
    net = html_extraction.train("lorem ipsum dolor sit amet".split(), steps=60, pages=200)
    page = "<body><article>" + "<p>Some words of text here." * 5000 + "</article>"
    rows = spark.createDataFrame([(1, page, "t"), (1, page, "t"), (None, None, None)], "page_id long, html string, text string").withColumns({"label": F.lit(1), "word": F.lit("w")})
    got = html_extraction.extract(rows, net).collect()
    assert len(got) == 3 and got[0]["text"] == got[1]["text"] and got[0]["text"].count("\n") == 4999 and {r["label"] for r in got} == {1}
    assert html_extraction.extract(rows.limit(0), net).count() == 0 and html_extraction.word_pool(rows.limit(0)) == []


def _base(text: str) -> tuple[int, int, int, int, int, bool]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def test_op6_registered(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_rules"](spark, SF).collect()}
    for d in table(spark, "documents").collect():
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(d["text"] or "")
        assert not (r["base_failed"] and r["kept"])


def test_quality_of_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 30), (1, "a b " * 30), (None, None)], "doc_id long, text string").withColumns({"n_words": F.lit("x"), "kept": F.lit(1)})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats = quality_rules.measured(docs)
    assert len(quality_rules.scored(stats, quality_rules.train(stats, labels)).collect()) == 3
    none = quality_rules.measured(docs.limit(0))
    assert quality_rules.scored(none, quality_rules.train(none, labels)).count() == 0


def _cheapest(offers, members, demands, repeats=3):
    """By brute force over whole words: the most words that can be served, and the least cost of serving them."""
    best = (0, 0)
    ranges = [range(repeats * o + 1) for o in offers]
    for given in product(*ranges):
        left = list(given)
        room = list(demands)
        #: A pattern of one source has no choice; the others fill what is left.
        for single in (True, False):
            for p, own in enumerate(members):
                if (len(own) == 1) == single:
                    for s in own:
                        x = min(left[p], room[s])
                        left[p] -= x
                        room[s] -= x
        if any(left):
            continue
        cost = sum(sum(max(0, min(o, g - r * o)) * r for r in range(repeats)) for o, g in zip(offers, given))
        best = max(best, (sum(given), -cost))
    return best[0], -best[1]


def test_flow_against_brute_force():
    rng = random.Random(8)
    for _ in range(25):
        offers = [rng.randint(1, 4) for _ in range(3)]
        members, demands = [[0], [0, 1], [1]], [rng.randint(1, 12), rng.randint(1, 12)]
        given = mixing.min_cost_flow(offers, members, demands)
        cost = sum(sum(max(0, min(o, g - r * o)) * r for r in range(3)) for o, g in zip(offers, given))
        assert (sum(given), cost) == _cheapest(offers, members, demands)


def test_mixing_of_overlapping_sources(spark):
    rng = random.Random(9)
    own = {i: rng.choice([["a"], ["a", "b"], ["b"], ["b", "c"], ["c"], [None]]) for i in range(900)}
    size = {i: rng.randint(0, 40) for i in own}
    docs = spark.createDataFrame([(i, " ".join(["w"] * size[i]), own[i]) for i in own], "doc_id long, text string, sources array<string>")
    mixed, shares = mixing.mix(mixing.sized(docs, F.col("sources")))
    taken, wanted = Counter(), {r["source"]: (r["source_size"], r["target"]) for r in shares.collect()}
    for r in mixed.collect():
        assert r["size"] == size[r["did"]] and 0 <= r["copies"] <= 3
        taken[tuple(r["pattern"])] += r["size"] * r["copies"]
    patterns = sorted(taken, key=lambda p: [(s is None, s or "") for s in p])
    names = ["a", "b", "c", None]
    assert {s: n for s, (n, _) in wanted.items()} == {s: sum(size[i] for i in own if s in own[i]) for s in names}
    offers = [sum(size[i] for i in own if set(own[i]) == set(p)) for p in patterns]
    flow = mixing.min_cost_flow(offers, [[names.index(s) for s in p] for p in patterns], [round(wanted[s][1]) for s in names])
    assert all(abs(taken[p] - f) <= 20 for p, f in zip(patterns, flow))


def test_op7_registered(spark):
    rows = QUERIES["op7_source_mixing"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in table(spark, "documents").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = (r["source_size"], r["target"])
    assert len(rows) == len(docs) and all(target[s][0] == n for s, n in sizes.items())
    longest = {s: max(r["size"] for r in rows if docs[r["doc_id"]]["source"] == s) for s in sizes}
    assert all(abs(taken[s] - target[s][1]) <= longest[s] for s in sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    assert [target[s][1] for s in names] == pytest.approx(mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]))


def test_mixing_of_an_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None)], "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "pattern": F.lit(1), "edge0": F.lit(2)})
    got = mixing.mix(mixing.sized(docs, F.array("source")))[0].collect()
    assert len(got) == 3 and len({r["copies"] for r in got if r["did"] == 1}) == 1
    assert mixing.mix(mixing.sized(docs.limit(0), F.array("source")))[0].count() == 0


def test_op5_registered(spark):
    docs = {r["doc_id"]: r for r in table(spark, "documents").collect()}
    rows = QUERIES["op5_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    known = {d["lang"] for d in docs.values() if d["lang"]}
    held = []
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        lettered = bool(re.search(r"[^\W\d_]", d["text"] or ""))
        assert (r["lang_pred"] in known) == lettered and (r["lang_pred"] == "und") != lettered
        if r["held_out"] and d["lang"] and lettered:
            held.append(r["lang_pred"] == d["lang"])
    assert sum(held) >= 0.95 * len(held)


def test_language_of_odd_tables(spark):
    rows = [(i, ("abc " if i % 2 else "xyz ") * (40_000 if i < 2 else 5), "ab" if i % 2 else "xy") for i in range(60)] + [(7, "abc " * 5, "ab")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"excerpt": F.lit("e"), "order": F.lit(1), "r": F.lit(2)})
    known = language_id.training_rows(docs)
    assert known == language_id.training_rows(docs.repartition(3)) and all(len(t) <= language_id.EXCERPT for _, t in known)
    languages, net = language_id.train(known, steps=40)
    got = language_id.predict(docs.select("doc_id", "text"), languages, net).collect()
    assert len(got) == 63 and sum(r["lang_pred"] == ("ab" if r["doc_id"] % 2 else "xy") for r in got) >= 60
    assert language_id.fitted(docs.limit(0)) == ([], None)
    assert {r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), [], None).collect()} == {"und"}


def test_op9_registered(spark):
    got = {r["doc_id"]: r for r in QUERIES["op9_simhash_dedup"](spark, SF).collect()}
    prints = {}
    for d in table(spark, "documents").collect():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}
