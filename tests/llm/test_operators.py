"""Operators of the llm subpackage against brute force, on small tables full of edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerline.llm import components, embedding_dedup, html_extraction, language_id, mixing, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_files, tokens
from ledgerline.llm.boosting import Boosted
from ledgerline.llm.html_blocks import blocks
from ledgerline.llm.rows import doc_id
from ledgerline.session import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did string, spans string"


def documents(spark, texts, sources=None):
    """A table with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "αβγ δ " * 200), (5, " nbsp em word\x0bvt\x0cff")]
    for i in range(6, 30):
        own = [word() for _ in range(rng.randint(1, 150))]
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = passage
        out.append((i, " ".join(own)))
    out += [(30, out[9][1]), (31, out[9][1]), (32, "x y z " * 900), (33, " ".join(passage)), (34, "#### $$ && || " * 30)]
    return out


def test_substring_dedup(spark, texts):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(documents(spark, texts)).withColumn("doc_id", doc_id()).collect()}
    seen, expected = set(), {}
    for i, text in sorted(texts):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        expected[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == expected


def test_suffix_dedup(spark, texts):
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(documents(spark, texts)).withColumn("doc_id", doc_id()).collect()}
    counts = Counter(t.encode()[k : k + 400] for _, t in texts if t for k in range(len(t.encode()) - 399))
    for i, text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 399):
            if counts[data[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(data), int(gone.sum()), spans, kept)


def test_difference_cover():
    for period in (7, 50, 57, 100, 273):
        places = np.flatnonzero(suffix_dedup.difference_cover(period))
        assert len({(a - b) % period for a in places for b in places}) == period
    assert suffix_dedup.difference_cover(273).sum() == 17
    assert suffix_dedup.difference_cover(57).sum() == 8


def test_neighbours_across_batches():
    rng = np.random.Generator(np.random.PCG64(1))
    for size in (1, 2, 3, 7):
        seed = np.sort(rng.integers(0, 6, 40))
        batches = [pa.RecordBatch.from_arrays([pa.array(seed[k : k + size])], names=["seed"]) for k in range(0, 40, size)]
        found = list(suffix_dedup._neighbours(iter(batches), ("seed",)))
        assert np.concatenate([t.column("seed").to_numpy() for t, _, _ in found]).tolist() == seed.tolist()
        assert np.concatenate([b[0] for _, b, _ in found]).tolist() == [False, *(seed[1:] == seed[:-1]).tolist()]
        assert np.concatenate([a[0] for _, _, a in found]).tolist() == [*(seed[1:] == seed[:-1]).tolist(), False]


@pytest.mark.parametrize(("length", "period", "fine"), [(400, 273, 57), (60, 40, 10), (60, 20, 20), (30, 7, 3)])
def test_suffix_dedup_random(spark, length, period, fine):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abé") for _ in range(n)) for n in (length - 1, length, 2 * length, 3 * length)]
    texts = [(0, None), (1, ""), (2, "a" * (length + 5)), (3, "ab" * length)]
    for i in range(4, 40):
        own = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, length)))
        texts.append((i, own() + rng.choice(passages)[rng.randint(0, 9) :] + own() + rng.choice(passages) + own()))
    got = {r["did"]: r for r in suffix_dedup.suffix_dedup(documents(spark, texts), length, period, fine).collect()}
    counts = Counter(t.encode()[k : k + length] for _, t in texts if t for k in range(len(t.encode()) - length + 1))
    for i, text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if counts[data[k : k + length]] > 1:
                gone[k : k + length] = True
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(data, np.uint8)[~gone]), i
        assert got[i]["n_removed"] == int(gone.sum())


def test_repeated_and_null_rows(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = documents(spark, [(1, text), (1, text), (None, text), (2, text)], sources={None: None, 1: "a", 2: None})
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).withColumn("doc_id", doc_id()).collect())
    assert got == [(False, None, 0), (True, 1, 90), (True, 1, 90), (True, 2, 90)]
    groups = simhash_dedup.simhash_groups(docs).collect()
    assert len(groups) == 4 and {r["component_id"] for r in groups} == {1}
    assert sum(r["first"] for r in groups) == 2
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_simhash(spark, texts):
    got = {r["did"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.simhash_groups(documents(spark, texts)).collect()}
    prints = {}
    for i, text in texts:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: (p, root(i)) for i, p in prints.items()}


def test_simhash_links_in_a_dense_cloud(spark):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    while len(prints) < 600:
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        prints.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in sorted(prints)]
    table = spark.createDataFrame([(x, x) for x in signed], "fp long, root long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash_dedup.links(table).collect()}
    values = sorted(prints)
    sign = lambda x: x - 2**64 if x >= 2**63 else x
    expected = {tuple(sorted((sign(a), sign(b)))) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3}
    assert got == expected and expected


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 300), (300, 200), (500, 500)] + [(1000 + rng.randint(0, 80), 1000 + rng.randint(0, 80)) for _ in range(60)]
    rows = components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    parent = {x: x for pair in links for x in pair}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {r["id"]: r["root"] for r in rows} == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_files(spark, texts):
    path = tokens.vocabulary("byte_bpe_50k.json")
    folder = scratch(spark) + "/token-test"
    docs = documents(spark, texts).repartition(3)
    manifest = token_files.write_token_files(docs, folder, path)
    got = {r["did"]: (r["start"], bytes(r["ids"])) for r in token_files.read_token_files(spark, folder).collect()}
    plain = tokens.Encoder(path).tokenizer
    base = 0
    for i, text in sorted(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (base, ids.tobytes())
        base += len(ids)
    assert manifest["tokens"] == base and manifest["width"] == 2
    empty = scratch(spark) + "/token-empty"
    token_files.write_token_files(docs.limit(0), empty, path)
    assert token_files.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    coder = tokens.Encoder(tokens.vocabulary(name))
    odd = ["", " ", "a  b", "\n\nx\n y", "don't I'M it' o'clock", "Σας ΟΔΟΣ. ÉÀß", "<|endoftext|> a", "\x1c a\x1db", "日本 1234", "a\r\nb", "x" * 900, "é ́x", "a-b (c) [d]!! ''x"]
    expected = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert coder.encode(odd) == expected and coder.encode(odd[::-1]) == expected[::-1]


def test_packing(spark, texts):
    path = tokens.vocabulary("word_bpe_49k.json")
    docs = documents(spark, [*texts, (3, "one two")])
    cut = packing.pieces(docs, path, capacity=64)
    rows = packing.pack(cut.drop("ids"), capacity=64, group=40).collect()
    plain = tokens.Encoder(path).tokenizer
    ids = {(r["did"], r["piece"]): bytes(r["ids"]) for r in cut.collect()}
    for i, text in texts:
        whole = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(ids[i, k] for k in range(sum(1 for d, _ in ids if d == i))) == whole
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and sum(n for _, n in own) <= 64
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    assert len(rows) == cut.count()
    assert len(places) <= 1.25 * sum(r["length"] for r in rows) / 64 + 3
    assert packing.pack(cut.drop("ids").limit(0)).count() == 0


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 300)
    bins, offsets, made = packing.sum_of_squares(lengths, 20)
    count, room = Counter(), {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        gap = 20 - o

        def cost(g):
            c = Counter(count)
            if g < 20 or g in c:
                c[g] -= g < 20
            if g > s:
                c[g - s] += 1
            return sum(v * v for k, v in c.items() if 0 < k < 20)

        choices = [g for g in range(s, 20) if count[g] > 0] + [20]
        assert cost(gap) == min(cost(g) for g in choices)
        if gap < 20:
            count[gap] -= 1
        if gap > s:
            count[gap - s] += 1
        room[b] = gap - s
    assert made == len(room)


def test_mixing(spark):
    rng = random.Random(5)
    sizes = [rng.randint(0, 60) for _ in range(600)]
    sources = {i: (None if i % 10 == 9 else "abcde"[rng.choice((0, 0, 0, 1, 2, 3, 4))]) for i in range(600)}
    docs = documents(spark, [(i, " ".join(["w"] * n) if n else None) for i, n in enumerate(sizes)], sources)
    from pyspark.sql import functions as F

    runs = []
    for _ in range(2):
        mixed, shares = mixing.mix(mixing.sized(docs, F.array("source")))
        runs.append({r["did"]: (r["size"], r["copies"]) for r in mixed.collect()})
    assert runs[0] == runs[1] and len(runs[0]) == 600
    target = {r["source"]: (r["source_size"], r["target"]) for r in shares.collect()}
    assert abs(sum(t for _, t in target.values()) - sum(sizes)) < 1e-6
    for source, (size, want) in target.items():
        own = [i for i in range(600) if sources[i] == source]
        assert size == sum(sizes[i] for i in own) and want <= 3 * size + 1e-9
        assert abs(sum(sizes[i] * runs[0][i][1] for i in own) - want) <= 30
    assert all(c <= 3 for _, c in runs[0].values())


def test_flow_with_overlapping_sources():
    given = mixing.min_cost_flow([100, 50, 10], [[0], [0, 1], [1]], [120, 60])
    assert sum(given) == 180 and given[0] <= 300 and given[2] <= 30
    assert mixing.min_cost_flow([10], [[0]], [100]) == [30]
    assert mixing.targets([100, 10], [1, 9]) == [80.0, 30.0]


def test_quality_rules(spark):
    rows, labels = [], []
    rng = random.Random(3)
    for i in range(300):
        good = i % 2 == 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words)))
        labels.append((i, int(good) if i % 5 else None, 0))
    rows += [(900, None), (901, "a b"), (902, "same line here\n" * 40)]
    stats = quality_rules.measured(documents(spark, rows))
    model = quality_rules.train(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality_rules.scored(stats, model).collect()}
    assert all(got[i]["kept"] == (i % 2 == 0) for i in range(300))
    assert got[900]["base_failed"] and got[901]["base_failed"] and got[902]["base_failed"]
    assert got[902]["n_dup_lines"] == 39 and got[902]["n_repeat_words"] == 120 and got[1]["n_symbols"] == 180
    assert quality_rules.train(stats, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_boosting_is_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 2))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 0]) + 0.2 * rng.normal(size=2000) < 0.6).astype(float)
    model = Boosted().fit(x, y, np.array([-1, 0]))
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5)], axis=1)
    assert (np.diff(model.probability(grid)) <= 1e-12).all()


def test_language_id(spark):
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rows = []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(rng.randint(1, 40))), lang))
    rows += [(500, None, "aa"), (501, "12 !! 34", "aa"), (502, "", None), (None, "abc abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.training_rows(docs)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i, t, _ in rows if i is not None and any(t == x for _, x in known) and t)
    languages, net = language_id.train(known, steps=60)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs.select("doc_id", "text"), languages, net).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i][0] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert got[500][0] == got[501][0] == got[502][0] == "und" and got[None][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_mixing_fills_until_nothing_fits(spark):
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in np.exp(rng.uniform(0, 7, size=150))]
    rows = [(i, n, f"s{i % 2}") for i, n in enumerate(sizes)] + [(900, 40, "s0")] * 3 + [(901, 300, "s1")] * 4
    docs = spark.createDataFrame([(i, i, n, [s]) for i, n, s in rows], "did long, th long, size long, pattern array<string>")
    for seed in (1, 2, 3):
        mixed, shares = mixing.mix(docs, (5, 1), seed)
        wanted = {r["source"]: round(r["target"]) for r in shares.collect()}
        got = mixed.collect()
        for source, target in wanted.items():
            own = [r for r in got if r["pattern"] == [source]]
            rounds = target // sum(r["size"] for r in own)
            units: dict[int, list[int]] = {}
            for r in own:
                units.setdefault(r["did"], []).append(r["copies"] - rounds)
                assert r["copies"] - rounds in (0, 1)
            assert all(len(set(x)) == 1 for x in units.values())
            total = {d: sum(r["size"] for r in own if r["did"] == d) for d in units}
            owed = target - sum(r["size"] * r["copies"] for r in own)
            assert all(abs(owed) <= abs(owed - t) for d, t in total.items() if not units[d][0])


def test_html_extraction(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class=\"ad\">Buy it now</div>"
        "<article><h1>A &amp; B</h1><p>First  para\n graph with <b>bold</b> &eacute;.<p>Second one.<script>var x='</p>';</script></article>"
        "<div class='comments'><p>Nice reply</p></div><footer>&copy; all</footer></body></html>"
    )
    net = html_extraction.train("lorem ipsum dolor sit amet consectetur elit sed".split(), steps=120, pages=300)
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", "&lt;only text&gt;")]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), net).collect()}
    assert got[1] == "A & B\nFirst para graph with bold é.\nSecond one."
    assert got[2] == got[3] == "" and len(got) == 5


def test_html_blocks():
    made = blocks("<body><ul><li>a<li>b <i>c</i></ul><p>x<br>y<!-- no --><table><tr><td>1<td>2</table>tail</body>")
    assert [b.text for b in made] == ["a", "b c", "x y", "1", "2", "tail"]
    assert [b.path[-1] for b in made] == ["li", "li", "p", "td", "td", "body"]


def test_html_blocks_lose_nothing():
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("<html><head><title>T</title><meta charset=x><article><p>one<p>two</article>") == ["one", "two"]
    assert texts("<head><style>p{}</style><title>T</title>one<p>two") == ["one", "two"]
    assert texts("<head><noscript><p>no</p></noscript><script>'<p>'</script></head><body>one<head><p>two") == ["one", "two"]
    for tag in "svg noscript object video audio canvas math template".split():
        assert texts(f"<p>one<{tag} id=x><p>two</p><p>three") == ["one", "two", "three"]
        assert texts(f"<p>one<{tag}>a<{tag}>b</{tag}>c</{tag}><p>two") == ["one", "two"]
        assert texts(f"<p>one<{tag}>two<{tag}>b</{tag}><p>three") == ["one two", "three"]
        assert texts(f"<p>one<{tag}><!-- </{tag}> --><script>'</{tag}>'</script>b</{tag}><p>two") == ["one", "two"]
    assert texts("<p>one<svg><title>a</svg><p>two") == ["one", "two"]
    assert texts("<p>one<script>a<p>b") == ["one"]
    assert len(blocks("<svg><p>a" * 20_000)) == 20_000


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    near = base[:80] + 0.05 * rng.normal(size=(80, 16))
    vectors = np.concatenate((base, near, base[:5], base[:5])).astype(np.float32).tolist()
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [1.0, 2.0]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(table).collect()}
    good = [i for i, v in enumerate(vectors) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([vectors[i] for i in good], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    parent = {i: i for i in got}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in zip(*np.nonzero(link)):
        a, b = root(good[a]), root(good[b])
        parent[max(a, b)] = min(a, b)
    assert len(got) == len(vectors)
    for k, i in enumerate(good):
        assert got[i]["n_links"] == link[k].sum()
    assert all(r["component_id"] == root(i) and r["kept"] == (root(i) == i) for i, r in got.items())
    assert all(got[i]["n_links"] == 0 for i in got if i not in good)
    assert embedding_dedup.embedding_groups(table.limit(0)).count() == 0


def test_embedding_blocks_count_each_link_once(spark):
    rng = np.random.default_rng(8)
    vectors = np.concatenate((rng.normal(size=(400, 8)), rng.normal(size=8) + 0.1 * rng.normal(size=(200, 8))))
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)], "gid long, m long, embedding array<float>")
    found = embedding_dedup.embedding_links(rows, leaf=50, block=40).groupBy("gid").sum("links").collect()
    m = vectors.astype(np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r[0]: r[1] for r in found}
    assert [got.get(i, 0) for i in range(600)] == link.sum(axis=1).tolist()


def test_names_met_in_many_slices(spark):
    """Batches of three texts are slices of their own, so that tasks meet frequent passages again and again."""
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, copy = own(150), own(300)
    texts = [(i, own(rng.randint(0, 60)) + (common if i % 3 else copy) + own(rng.randint(0, 60)) + (common[20:130] if i % 4 else "")) for i in range(90)] + [(200 + i, copy) for i in range(20)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["did"]: r for r in suffix_dedup.suffix_dedup(documents(spark, texts), 80, 40, 10).collect()}
        words = [(i, " ".join(t[k : k + 3] for k in range(0, len(t), 3))) for i, t in texts]
        cut = {r["did"]: r["kept"] for r in substring_dedup.substring_dedup(documents(spark, words)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    counts = Counter(t[k : k + 80] for _, t in texts for k in range(len(t) - 79))
    for i, text in texts:
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 79):
            gone[k : k + 80] |= counts[text[k : k + 80]] > 1
        assert bytes(got[i]["kept"]).decode() == "".join(c for c, g in zip(text, gone) if not g), i
    seen = set()
    for i, text in words:
        tokens_ = text.split(" ")
        gone = [False] * len(tokens_)
        for k in range(len(tokens_) - 19):
            window = tuple(tokens_[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        assert cut[i] == " ".join(w for w, g in zip(tokens_, gone) if not g), i


def test_registered_suffix_and_substring_queries(spark):
    from ledgerline.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op10_suffix_dedup"](spark, folder).collect()}
    counts = Counter(t.encode()[k : k + 400] for _, t in rows for k in range(len(t.encode()) - 399))
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 399):
            if counts[data[k : k + 400].tobytes()] > 1:
                gone[k : k + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest())
