"""Operators over whole tables and texts, against brute force."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from patchlens.llm import html_main, lstm
from patchlens.llm.html_blocks import blocks


def test_language_stage_rejects_unlearned_scripts(spark):
    r = random.Random(6)
    sounds = {"en": "th he in er an re on".split(), "de": "sch ei en ch ung ö ß".split(), None: "сло ва на дру гом язы ке".split()}
    text = lambda lang, n: " ".join("".join(r.choices(sounds[lang], k=r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, r.choice([5, 50, 300])), lang) for i, lang in enumerate(["en", "de"] * 40)]
    odd = [(100 + i, text(None, n), None) for i, n in enumerate([1, 10, 100, 1000])] + [(110, text(None, 200) + " " + text("en", 50), None)]
    rows += odd + [(120, text("en", 200) + " " + text(None, 50), None)]
    d = spark.createDataFrame([(*x, "a", len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.languages(spark, d, "").collect()}
    assert kept == {x[0] for x in rows} - {x[0] for x in odd}


def test_silent_elements_without_end_tag():
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("<html><head><title>x</title><body><p>article</p>") == ["article"]
    assert texts("<head><meta charset=a><!-- <p> --><style>p{}</style><script>'<p>no</p>'</script><title>a</title><p>b</p>") == ["b"]
    assert texts("<head><title>t</title></head><body><p>a</p>") == ["a"]
    assert texts("<head>\n<link rel=x>\nplain text") == ["plain text"]
    for tag in ["svg", "select", "canvas", "video", "noscript"]:
        assert texts(f"<article><p>a</p><{tag}><p>b</p></article><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<article><p>a</p><{tag}>no</{tag}><p>b</p></article>") == ["a", "b"]
    for tag in ["script", "style", "textarea", "iframe"]:
        assert texts(f"<p>a</p><{tag}><p>b</p>") == ["a"]


def test_long_pages_are_labelled_in_whole():
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    pages = [blocks("".join(f"<{(t := r.choice(['p', 'div', 'h2', 'li']))}>{words(r.randint(1, 9))}</{t}>" for _ in range(n))) for n in (3000, 1024, 1025, 0, 7)]
    w = {k: v * 2 for k, v in lstm.initial(html_main.PATH + html_main.WORD + html_main.SHAPE, 16, 3).items()}
    w["cf"][:16] = w["cb"][:16] = 8  # a state that lasts
    for page, got in zip(pages, html_main.label(w, pages)):
        assert len(got) == len(page)
        if page:
            x, sizes, _ = lstm.padded([(html_main.vectors(page), np.zeros(len(page)))])
            assert np.allclose(got, lstm.probabilities(w, x, sizes)[:, 0], atol=1e-4)
