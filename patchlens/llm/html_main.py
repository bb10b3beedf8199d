"""Main text of web pages: a recurrent labeller over the leaf blocks of each page."""

from __future__ import annotations

import functools
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.llm import lstm
from patchlens.llm.bpe import Remembering
from patchlens.llm.common import slices, small_batches
from patchlens.llm.html_blocks import Block, Node, blocks

PATH, WORD, SHAPE = 192, 32, 6
#: Blocks of a page that are labelled at a time; a longer page hands each direction's state on.
STRETCH = 1024
#: Pages made for training, and how often it goes through them.
TRAINING_PAGES, EPOCHS = 6000, 16
#: What `python -m patchlens.llm.html_main` writes.
WEIGHTS = pathlib.Path(__file__).with_name("html_main_weights.npz")
#: What marks a piece of text of the article while a training page is parsed; it is taken out of the text again.
MARK = "\ue001"

_WORDS: Remembering = Remembering({}, lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD, 100_000)
_WORD_SPLIT = re.compile(r"\w+|[^\w\s]")


def _slots(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Three places of a tag or a word of a class, and its signs there."""
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    h2 = zlib.crc32(b"2" + name.encode("utf-8", "surrogatepass"))
    return np.array([h % PATH, (h >> 12) % PATH, h2 % PATH]), np.array([1.0 if x & 1 else -1.0 for x in (h >> 24, h >> 25, h2 >> 24)], np.float32)


_SLOTS: Remembering = Remembering({}, _slots, 50_000)
_NOWHERE = np.zeros(PATH, np.float32)


def _path_vector(node: Node | None) -> np.ndarray:
    """The tags and class words on the way from the root to a node, hashed with signs; each node adds its own to its parent's, so a page costs what its elements do."""
    way = []
    while node is not None and node.vector is None:
        way.append(node)
        node = node.parent
    v = _NOWHERE if node is None else node.vector
    for n in reversed(way):
        names = [x for x in n.names if x not in ("<html>", "<body>")]
        if names:
            v = v.copy()
            for name in names:
                at, sign = _SLOTS[name]
                v[at] += sign
            np.clip(v, -2, 2, out=v)
        n.vector = v
    return v


def _own(node: Node | None) -> str:
    return "last " + (node.names[0] if node else "")


def vectors(page: list[Block]) -> np.ndarray:
    """(block, input): tag path, all words, and shape of each block."""
    n = len(page)
    words = [_WORD_SPLIT.findall(b.text) for b in page]
    counts = np.fromiter(map(len, words), np.int64, n)
    place = np.fromiter((p for w in words for p in map(_WORDS.__getitem__, w)), np.int64, int(counts.sum()))
    bag = np.bincount(np.repeat(np.arange(n), counts) * WORD + place, minlength=n * WORD).reshape(n, WORD).astype(np.float32)
    bag /= np.maximum(1, np.linalg.norm(bag, axis=1, keepdims=True))
    size = np.array([len(b.text) for b in page], np.float32)
    linked = np.array([b.linked for b in page], np.float32)
    shape = np.stack([np.log1p(size) / 8, np.log1p(counts) / 6, np.minimum(1, linked / np.maximum(1, size)), np.arange(n) / max(1, n - 1), np.arange(n)[::-1] / max(1, n - 1), np.array([b.text[-1] in ".!?" for b in page])], 1)
    path = np.stack([_path_vector(b.node) for b in page])
    for row, b in zip(path, page):
        at, sign = _SLOTS[_own(b.node)]
        row[at] += sign
    return np.concatenate([path, bag, shape.astype(np.float32)], 1)


def _page(r: random.Random) -> str:
    """A page of random words; the article's pieces of text begin with MARK.

    What is in a menu, sidebar, comment and so on can be told by its tag or by
    the usual words of classes, and link lists and short notices also by their
    shape and place alone. The article's own wrapper says nothing in half of
    the pages: a class of random letters, or none.
    """
    syllables = [r.choice("bcdfghjklmnpqrstvwz") + r.choice("aeiouéöñ") + r.choice(["", "n", "r", "s", "t"]) for _ in range(40)]
    shout, marks = r.random() < 0.1, r.choice(["", "", "", "", "!!", "###", " |"])

    def words(n: int) -> str:
        t = " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) + marks for _ in range(n)).capitalize() + r.choice([".", ".", ".", "", "?", "!"])
        return t.upper() if shout else t

    def some(items: list[str], chance: float) -> str:
        return "".join(x for x in items if r.random() < chance)

    def odd() -> str:
        """A name that says nothing."""
        letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        return r.choice([letters(r.randint(1, 3)), letters(2), f"css-{r.randint(0, 9)}{letters(r.randint(1, 3))}{r.randint(0, 9)}", f"{letters(2)}-{letters(r.randint(4, 7))}", letters(r.randint(5, 11)), f"{letters(4)}_{letters(5)} {letters(3)}"])

    def attribute(name: str) -> str:
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def classed(tag: str, names: list[str], inner: str, plain: float = 0.0) -> str:
        name = r.choice(names) + r.choice(["", "", "", "-box", "_wrap", f" x{r.randint(0, 99)}", "-1", f" {odd()}"])
        return f"<{tag}{'' if r.random() < plain else attribute(name)}>{inner}</{tag}>"

    def links(n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{i}">{words(r.randint(1, 3))}</a></{item}>' for i in range(n))

    def prose(n: int) -> str:
        return "".join(f"<p>{words(r.randint(1, 30))}</p>" for _ in range(n))

    box = lambda: r.choice(["div", "div", "section", "aside"])
    nav = classed("nav", ["menu", "main-nav", "top"], f"<ul>{links(r.randint(2, 9))}</ul>", 0.6)
    menu = classed(r.choice(["div", "ul"]), ["menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs"], links(r.randint(2, 8)))
    bare_menu = f"<{(t := r.choice(['div', 'ul']))}{r.choice(['', attribute(odd())])}>{links(r.randint(3, 9), r.choice(['li', 'div', 'span']))}</{t}>"
    header = classed("header", ["header", "site-header", "masthead", "top"], f"<h1>{words(2)}</h1>" + some([f"<p>{words(5)}</p>", nav], 0.5), 0.5)
    banner = classed("div", ["header", "masthead", "banner", "logo", "topbar"], f"<{(t := r.choice(['h1', 'h2', 'p', 'span']))}>{words(3)}</{t}>")
    advert = lambda: classed(box(), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], r.choice([words(r.randint(3, 40)), prose(2)]))
    notice = lambda: classed(r.choice(["div", "section", "p"]), ["cookie-notice", "notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "paywall", "cc-window", "cookie-bar", "cookiebar", "privacy", "subscribe"], r.choice(["<span>{}</span>", "{}", "<p>{}</p>"]).format(r.choice([words(r.randint(3, 30)), "We use cookies. Accept", "This website uses cookies to ensure you get the best experience", "Subscribe to our newsletter"])))
    sidebar = lambda: classed(r.choice(["aside", "aside", "div"]), ["sidebar", "side", "widget", "related", "recommended", "popular", "more", "trending"], r.choice([f"<h3>{words(2)}</h3><ul>{links(r.randint(2, 6))}</ul>", prose(r.randint(1, 4)), f"<h4>{words(2)}</h4>" + prose(1)]))
    aside = lambda: f"<aside>{r.choice([prose(r.randint(1, 3)), links(3)])}</aside>"
    form = lambda: f'<form action="/q"{r.choice(["", " class=search", " id=login"])}>{r.choice(["", f"<label>{words(2)}</label>"])}<input name="q"><button>{words(1)}</button>{some([f"<p>{words(r.randint(2, 12))}</p>", f"<div>{words(3)}</div>"], 0.5)}</form>'
    comment = lambda: r.choice(["div", "li", "article", "p"])

    def comments() -> str:
        t = comment()
        own = r.choice(["", ' class="comment"', ' class="reply"', ' class="comment-body"', ' class="review"', ' class="message"'])
        name = lambda: r.choice([words(2), f"<b>{words(2)}</b>", ""])
        each = "".join(f"<{t}{own}>{name()}{words(r.randint(2, 12)) if t == 'p' else r.choice([prose(r.randint(1, 3)), words(r.randint(2, 20))])}</{t}>" for _ in range(r.randint(1, 6)))
        names = ["comments", "comment-list", "discussion", "responses", "replies", "comment", "comment-thread", "thread", "disqus_thread", "disqus", "reviews", "user-reviews", "customer-reviews", "feedback", "reader-comments", "conversation"]
        return classed(r.choice(["section", "div", "ul", "aside"]), names, r.choice(["", f"<h3>{words(2)}</h3>"]) + each)

    share = lambda: classed("div", ["share", "social", "tags", "byline", "meta", "pagination"], r.choice([links(3, "span"), words(3)]))
    footer = classed("footer", ["footer", "site-footer", "bottom"], r.choice([f"&copy; {words(r.randint(2, 20))}", prose(2), f"<ul>{links(4)}</ul><p>&copy; {words(4)}</p>", f"&copy; x &middot; {words(9)}\n{words(3)}"]), 0.7)
    bottom = classed("div", ["footer", "bottom", "copyright", "legal", "foot", "colophon", "imprint", "impressum", "fusszeile", "pied", "pie-de-pagina", "disclaimer"], r.choice([prose(2), links(4), words(r.randint(1, 4))]))

    text = lambda n: MARK + words(n)
    body = [f"<h1>{text(r.randint(1, 9))}</h1>"] if r.random() < 0.8 else []
    count = r.choice([1, 1, 2, 3, 5, 8, 13, 30, 60 if r.random() < 0.3 else 8])
    plain = r.random() < 0.3  # nothing but paragraphs
    for _ in range(count):
        t = text(r.choice([1, 2, 5, 20, 50, 100]))
        forms = [f"<p>{t}</p>"] * 8
        if not plain:
            forms += [
                f"<h2>{text(3)}</h2><p>{t}</p>", f"<ul><li>{t}</li><li>{text(4)}</li></ul>", f"<blockquote>{t}</blockquote>", f"<p><b>{t}<br><p>{text(9)}</p>", f"<div>{t}</div>", f"<div{attribute(odd())}>{t}</div>",
                f"<section{attribute(odd())}><p>{t}</p></section>", f"<div><p>{t}</p></div>", f"<p>{t} <a href=x>{words(2)}</a> {words(4)}</p>", f"<pre>{t}</pre>",
                f"<ul>{''.join(f'<li><a href=x>{text(r.randint(1, 6))}</a></li>' for _ in range(r.randint(2, 8)))}</ul><p>{t}</p>", f"<p>{t}</p><ul>{''.join(f'<li><a href=x>{text(r.randint(1, 6))}</a></li>' for _ in range(r.randint(2, 8)))}</ul>",
                f"<table><tr><td>{t}</td><td>{text(2)}</td></tr></table>", f"<figure><figcaption>{t}</figcaption></figure>", f"<dl><dt>{text(1)}</dt><dd>{t}</dd></dl>",
            ]
        body.append(r.choice(forms))
        if r.random() < 0.06 and not plain:
            body.append(r.choice([advert, notice, sidebar, aside, form, share])())
    if r.random() < 0.25:
        body.append(r.choice([share, comments, sidebar, form])())
    main = "".join(body)
    kind = r.random()
    if kind < 0.3:
        main = classed("article", ["post", "article", "entry", "story"], main, 0.8)
        main = main if r.random() < 0.7 else f"<main>{main}</main>"
    elif kind < 0.38:
        main = classed("main", ["content", "main"], main, 0.6)
    elif kind < 0.52:
        main = classed(r.choice(["div", "section"]), ["content", "article", "post", "entry-content", "post-body", "story", "main", "text", "article-body", "body-content"], main)
    elif kind < 0.85:
        main = f"<{(t := r.choice(['div', 'div', 'section']))}{attribute(odd())}>{main}</{t}>"
    elif kind < 0.93:
        main = f"<div>{main}</div>"
    before = some([header, banner, nav, menu, bare_menu, advert(), notice(), sidebar(), form()], 0.3)
    after = some([sidebar(), aside(), comments(), advert(), form(), notice(), bottom, footer, footer], 0.33)
    if r.random() < 0.2:
        before = after = ""
    inner = before + main + after
    if r.random() < 0.12:  # one, two or three paragraphs and a wrapper that says nothing
        return f"<html><body><div{attribute(odd())}>{''.join(f'<p>{text(r.randint(2, 60))}</p>' for _ in range(r.randint(1, 3)))}</div></body></html>"
    if r.random() < 0.4:
        inner = f'<div{r.choice(["", attribute(odd()), attribute(r.choice(["wrapper", "page", "container", "row"]))])}>{inner}</div>'
    return f"<html><head><title>x</title></head><body>{inner}</body></html>"


def training_blocks(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page of `_page` and whether each is of its article."""
    marked = blocks(page)
    return [b._replace(text=b.text.replace(MARK, "")) for b in marked], np.array([MARK in b.text for b in marked], np.float32)


def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """The labeller, fitted to `pages` pages that a fixed rule makes."""
    r = random.Random(seed)
    made = [training_blocks(_page(r)) for _ in range(pages)]
    return lstm.fit([(vectors(b), y) for b, y in made if b], epochs=epochs)


@functools.lru_cache(1)
def weights() -> dict[str, np.ndarray]:
    """What `trained` gave: some minutes of one core, so it is kept beside this file."""
    with np.load(WEIGHTS) as kept:
        return dict(kept)


def label(w: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability that each block is main text. Pages of similar length run together, those over STRETCH blocks alone."""
    out: list[np.ndarray] = [np.zeros(len(p)) for p in pages]
    short = sorted((i for i, p in enumerate(pages) if 0 < len(p) <= STRETCH), key=lambda i: len(pages[i]))
    for k in range(0, len(short), 64):
        some = short[k : k + 64]
        x, sizes, _ = lstm.padded([(vectors(pages[i]), np.zeros(len(pages[i]))) for i in some])
        p = lstm.probabilities(w, x, sizes)
        for j, i in enumerate(some):
            out[i][:] = p[: len(pages[i]), j]
    for i, page in enumerate(pages):
        if len(page) > STRETCH:
            out[i][:] = lstm.long_probabilities(w, vectors(page), STRETCH)
    return out


def extract_main(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), threshold: float = 0.5) -> DataFrame:
    """The main text of every page.

    A page is parsed whole into leaf blocks: text between block-level tags,
    references decoded, white space inside made one space. A bidirectional
    LSTM reads, block by block and in both directions, the hashed tags, classes,
    ids and roles above it, its hashed words and its shape, and gives each block a
    probability; blocks at or over `threshold` are joined in page order by a
    line feed. Nothing else is dropped or cut, and every block is labelled in
    the context of its whole page: long pages run in stretches that hand the
    state of each direction on. The labeller was trained on pages made by
    a fixed rule (see trained) and is stored, so its size and its result don't
    depend on the data; pages don't meet each other: no shuffle. Parsing and
    labelling are linear in the page.

    Returns id_col, the `keep` columns, text (empty if there is none) and
    n_chars (long). Null or empty html gives an empty text, and so does a page
    without blocks; broken markup is read as `blocks` says; null ids and
    repeated rows are rows like others; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(weights())

    d = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    kind = T.StructType([*[f for f in d.schema.fields if f.name != "html"], T.StructField("text", T.StringType())])

    def main(batches):
        for b in slices(batches, 1):
            found = [blocks(h) if h else [] for h in b.column(1).to_pylist()]
            texts = ["\n".join(x.text for x, p in zip(page, ps) if p >= threshold) for page, ps in zip(found, label(model.value, found))]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(texts, pa.string())], kind.fieldNames())

    d = d.mapInArrow(main, kind)
    return d.select(F.col("id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "text", F.char_length("text").cast("long").alias("n_chars"))


if __name__ == "__main__":
    np.savez(WEIGHTS, **trained())
