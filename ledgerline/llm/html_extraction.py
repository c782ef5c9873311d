"""Main text of web pages by a recurrent block labeller (operator 3).

A page becomes the sequence of its leaf blocks. Each block is a vector of its hashed tag
path, its hashed words and a few counts; a bidirectional LSTM reads the whole sequence and
says for each block whether it belongs to the article. The network is trained here, on
TRAINING_PAGES pages that are composed from a fixed grammar of page furniture (menus, notices, adverts,
sidebars, forms, comments, headers, footers) around articles, where every block's role is
known; its words are drawn from the whole of about SAMPLE pages (by a hash of page_id), POOL
of them at most, so that none of them tells the role. Nothing of a page is dropped or capped.

Defined results: null or empty html, and pages without article blocks, give an empty text;
character references are decoded once; a reference that is no reference stays as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textarrays
from ledgerline.llm.html_blocks import Block, blocks
from ledgerline.llm.recurrent import Adam, Bidirectional, LongShortCell
from ledgerline.llm.rows import hash_share
from ledgerline.session import table

PATH_SLOTS, WORD_SLOTS, COUNTS = 192, 32, 8
FEATURES = PATH_SLOTS + WORD_SLOTS + COUNTS
HIDDEN = 16
STEPS = 260
BATCH = 32
TRAINING_PAGES = 900
SAMPLE = 200
POOL = 20_000

_slots: dict[tuple[str, int], int] = {}


def _slot(word: str, size: int) -> int:
    key = (word, size)
    if key not in _slots:
        if len(_slots) > 200_000:
            _slots.clear()
        _slots[key] = zlib.crc32(word.encode()) % size
    return _slots[key]


def vector(block: Block, place: float) -> np.ndarray:
    x = np.zeros(FEATURES, np.float32)
    for i, word in enumerate(reversed(block.path)):
        x[_slot(word, PATH_SLOTS)] = 1.0
        if i < 3:
            x[_slot(f"{i}{word}", PATH_SLOTS)] = 1.0
    words = block.text.lower().split()
    for word in words:
        x[PATH_SLOTS + _slot(word, WORD_SLOTS)] += 1.0
    x[PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] /= max(1.0, np.sqrt(len(words)) * 2)
    text = block.text
    x[-COUNTS:] = (np.log1p(len(words)) / 5, block.linked / len(text), sum(map(text.count, ".,;:!?")) / len(words), place, len(block.path) / 10, text[:1].isupper(), text[-1:] in ".!?", sum(map(text.count, "0123456789")) / len(text))
    return x


def sequence(page: list[Block]) -> np.ndarray:
    return np.stack([vector(b, i / len(page)) for i, b in enumerate(page)]) if page else np.zeros((0, FEATURES), np.float32)


#: Page furniture: (opening tags, item tags, items, longest item in words, usual words).
_FURNITURE = [
    (["nav", "ul"], ["li", "a"], (3, 9), 2, "home about contact products news"), (["div.menu"], ["a"], (3, 8), 2, "home login shop help"),
    (["header", "nav", "ul"], ["li", "a"], (2, 7), 2, "home menu search"), (["ul#navigation"], ["li", "a"], (3, 8), 2, "home start"),
    (["header"], ["p"], (1, 2), 8, "welcome site"), (["div#header"], ["h2"], (1, 2), 5, "welcome"), (["header.masthead"], ["div.logo"], (1, 1), 3, "the daily"),
    (["div.breadcrumbs"], ["a"], (1, 3), 2, "home"), (["div.ad"], [], (1, 1), 20, "buy now sale"), (["div.ads"], ["p"], (1, 3), 15, "offer sale"),
    (["div.advert"], ["p"], (1, 2), 25, "save today"), (["div.sponsored"], ["p", "a"], (1, 2), 12, "sponsored"), (["section.promo"], ["p"], (1, 2), 20, "offer"),
    (["div.banner"], ["p"], (1, 2), 15, "discount"), (["aside"], ["p"], (1, 4), 25, "related more"), (["aside", "ul"], ["li", "a"], (2, 6), 6, "related read"),
    (["aside.sidebar"], ["h3"], (1, 2), 4, "popular"), (["div.sidebar"], ["p"], (1, 4), 25, "popular recent"), (["div#sidebar", "ul"], ["li", "a"], (2, 7), 6, "recent posts"),
    (["div.widget"], ["p"], (1, 2), 15, "archive"), (["div.related"], ["p", "a"], (1, 4), 8, "read also"), (["div.cookie-notice"], ["p"], (1, 2), 25, "cookies accept privacy"),
    (["div.notice"], ["p"], (1, 2), 25, "notice please"), (["div.cookie"], [], (1, 1), 25, "we use cookies"), (["div#gdpr-consent"], ["p"], (1, 1), 20, "consent"),
    (["div.alert"], ["p"], (1, 1), 15, "update browser"), (["div.popup"], ["p"], (1, 2), 15, "subscribe"), (["form"], ["label"], (1, 4), 3, "name email send"),
    (["form"], ["p"], (1, 3), 10, "subscribe newsletter"), (["form.search"], ["button"], (1, 1), 2, "search"), (["div.newsletter", "form"], ["p"], (1, 2), 12, "sign up"),
    (["form", "select"], ["option"], (2, 6), 2, "choose"), (["div.comments"], ["p"], (1, 6), 40, "reply comment"), (["section#comments", "article.comment"], ["p"], (1, 3), 40, "reply"),
    (["div#comments", "div.comment"], ["p"], (1, 4), 40, "posted"), (["ul.comment-list"], ["li", "p"], (1, 5), 40, "wrote"), (["ol.commentlist"], ["li.comment", "p"], (1, 5), 40, "said"),
    (["div.comment-body"], ["p"], (1, 3), 40, "reply"), (["div.share"], ["a"], (1, 4), 2, "share tweet"), (["footer"], [], (1, 1), 20, "© ·"), (["footer"], ["p"], (1, 3), 20, "copyright rights reserved"),
    (["div.footer"], ["p"], (1, 3), 15, "terms privacy"), (["div#footer", "ul"], ["li", "a"], (2, 6), 3, "terms imprint"), (["footer.site-footer", "div"], ["span"], (1, 2), 15, "copyright"),
]
_ARTICLES = [["article"], ["main"], ["main", "article"], ["div.content"], ["div.post"], ["div#main", "div.entry-content"], ["section.article-body"], ["div.article"], ["article", "div.body"], ["div#content"], ["main", "section"], ["div.story"]]
_PARAGRAPHS = [(["p"], 90), (["p"], 30), (["p"], 8), (["p"], 2), (["h2"], 8), (["h3"], 6), (["ul", "li"], 15), (["ol", "li"], 12), (["blockquote", "p"], 40), (["blockquote"], 30), (["pre"], 20), (["table", "tr", "td"], 5), (["figure", "figcaption"], 12), (["div"], 40), (["section", "p"], 50)]


def _path(tags: list[str]) -> tuple[str, ...]:
    out: list[str] = []
    for tag in tags:
        name = tag.replace("#", ".").split(".")
        out += [name[0], *("." + w for part in name[1:] for w in part.split("-"))]
    return tuple(out)


def composed_page(rng: np.random.Generator, pool: list[str]) -> tuple[list[Block], list[int]]:
    """One training page and the label (1: article) of each block."""

    def words(most: int, extra: str = "") -> str:
        n = int(rng.integers(1, most + 1))
        own = [pool[i] for i in rng.integers(len(pool), size=n)]
        if extra and rng.random() < 0.4:
            own += [str(rng.choice(extra.split()))]
        text = " ".join(own)
        return text[:1].upper() + text[1:] + "." if rng.random() < 0.6 else text

    page: list[Block] = []
    labels: list[int] = []
    base = [["html", "body"], ["html", "body", "div"], ["html", "body", "div.wrapper"], ["html", "body", "div#page", "div.container"]][int(rng.integers(4))]

    def furniture(around: list[str]) -> None:
        opening, item, (low, high), most, usual = _FURNITURE[int(rng.integers(len(_FURNITURE)))]
        for _ in range(int(rng.integers(low, high + 1))):
            tags = [t for t in item if t not in ("a", "label", "span", "button")]
            text = words(most, usual)
            page.append(Block(text, _path(around + opening + tags), len(text) if "a" in item else 0))
            labels.append(0)

    for _ in range(int(rng.integers(1, 5))):
        furniture(base)
    main = base + _ARTICLES[int(rng.integers(len(_ARTICLES)))]
    if rng.random() < 0.95:
        if rng.random() < 0.8:
            page.append(Block(words(14), _path([*main, "h1"]), 0))
            labels.append(1)
        for _ in range(int(rng.choice([1, 2, 4, 8, 16, 30]))):
            tags, most = _PARAGRAPHS[int(rng.choice(len(_PARAGRAPHS), p=_PARAGRAPH_WEIGHTS))]
            text = words(most)
            page.append(Block(text, _path(main + tags), int(len(text) * (rng.random() < 0.1) * rng.random())))
            labels.append(1)
            if rng.random() < 0.05:
                furniture(main)
    for _ in range(int(rng.integers(1, 5))):
        furniture(base)
    return page, labels


_PARAGRAPH_WEIGHTS = np.array([6, 6, 3, 2] + [1] * (len(_PARAGRAPHS) - 4)) / (17 + len(_PARAGRAPHS) - 4)


def train(pool: list[str], steps: int = STEPS, pages: int = TRAINING_PAGES) -> Bidirectional:
    rng = np.random.default_rng(3)
    made = [composed_page(rng, pool or ["text"]) for _ in range(pages)]
    made = sorted(((sequence(p), np.array(y)) for p, y in made), key=lambda q: len(q[1]))
    net = Bidirectional(LongShortCell, FEATURES, HIDDEN, 2, symbols=False, seed=3)
    adam = Adam(net.p, 0.01)
    for step in range(steps):
        at = int(rng.integers(max(1, len(made) - BATCH)))
        x, mask, labels = padded(made[at : at + BATCH])
        grads, _ = net.gradients(x, mask, labels)
        adam.step(grads, 0.2 if step > 0.8 * steps else 1.0)
    return net


def padded(group: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(v) for v, _ in group)
    x = np.zeros((longest, len(group), FEATURES), np.float32)
    mask, labels = np.zeros((longest, len(group)), np.float32), np.zeros((longest, len(group)), np.int64)
    for j, (v, y) in enumerate(group):
        x[: len(v), j], mask[: len(v), j], labels[: len(y), j] = v, 1, y
    return x, mask, labels


def label(net: Bidirectional, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page belong to its article."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        #: Pages of like length run together; the room a group takes stays bounded.
        while stop < len(order) and stop - at < 64 and len(pages[order[stop]]) * (stop + 1 - at) <= 4096:
            stop += 1
        group = order[at:stop]
        vectors = [(sequence(pages[i]), np.zeros(0, np.int64)) for i in group]
        x, mask, _ = padded(vectors)
        prob = net.probabilities(x, mask)[..., 1]
        for j, i in enumerate(group):
            out[i] = prob[: len(pages[i]), j] > 0.5
        at = stop
    return out


def _extractor(net: Bidirectional):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textarrays.slices(whole, "html"):
                pages = [blocks(p or "") for p in batch.column("html").to_pylist()]
                kept = label(net, pages)
                texts = ["\n".join(b.text for b, k in zip(p, own.tolist(), strict=True) if k) for p, own in zip(pages, kept, strict=True)]
                others = [i for i, name in enumerate(batch.schema.names) if name != "html"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in others), "text"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textarrays.slices(whole, "html"):
            found = {w for page in batch.column("html").to_pylist() for b in blocks(page) for w in b.text.split()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])


def word_pool(pages: DataFrame) -> list[str]:
    """Distinct words of about SAMPLE pages: POOL at most, in the order of their hash."""
    known = pages.filter("html is not null")
    drawn = known.filter(hash_share(F.xxhash64("page_id"), SAMPLE, known.count())).select("html")
    words = drawn.mapInArrow(_words, "word string").distinct()
    return sorted(r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(POOL).collect())


def extract(pages: DataFrame, net: Bidirectional) -> DataFrame:
    """pages (html and other columns) with text in place of html."""
    others = [(c, t) for c, t in pages.dtypes if c not in ("html", "text")]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*others, ("text", "string")])
    return pages.select(*(c for c, _ in others), "html").mapInArrow(_extractor(net), schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, train(word_pool(pages)))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
