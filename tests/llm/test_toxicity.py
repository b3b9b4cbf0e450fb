"""Problem 10: the field against enumeration of all labellings, folding of disguised words, and held-out ratings."""

import itertools

import numpy as np
import pytest

from codemill.llm import toxicity
from codemill.llm.toxicity import APART, forward_backward, offsets, rates, score_texts, scored, tokens, toxic

DATA = "/root/testdata/sf0.1"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([4, 1, 3])
    starts = np.array([0, 4, 5])
    e, to, stay = rng.normal(size=8), -0.7, 1.3
    p = forward_backward(e, starts, sizes, to, stay)[0]
    for s, n in zip(starts, sizes):
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = sum(e[s + i] for i in range(n) if y[i]) + sum(stay if y[i - 1] else to for i in range(1, n) if y[i])
            total += np.exp(w)
            on += np.exp(w) * np.array(y)
        assert np.allclose(p[s : s + n], on / total)


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([])


@pytest.mark.parametrize("text", ["Shut up, you 1d10t.", "you are a worthless p a r a s i t e, imbecile", "You stupid a***ole, go and die somewhere quiet.", "FUCK OFF, YOU WANKER", "Halt die Fr3$$3, du Drecksack", "Eres un іmbéсіl y nadie te soporta.", "Tu es un d​ébile, ferme ta gueule."])
def test_disguised_offences(model, text):
    assert score_texts([text], model, model.lexicon())[0][0] > 0.5


@pytest.mark.parametrize("text", ["Kill the zombie child processes before the parent dies.", "The sex column of the census fixture holds 4 null values.", "I am an idiot, I forgot the semicolon.", "", "   ", "\x01\x02"])
def test_harmless(model, text):
    assert score_texts([text], model, model.lexicon())[0][0] <= 0.5


def test_offsets_point_into_the_text():
    text = "Hi\r\n​th​is  is p a t h e t i c code\nend"
    found = tokens(text)
    places = offsets(text, found)
    assert [text[a:b] for (a, b), t in zip(places, found) if t != "\x01"] == ["Hi", "th​is", "is", "p a t h e t i c", "code", "end"]
    assert APART.search(text)


def test_held_out_ratings_and_spans(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/doc_labels.parquet")
    train, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = {r.doc_id: r for r in scored(documents.join(rest.select("doc_id").distinct(), "doc_id"), train).collect()}
    rated = {}
    for r in rest.collect():
        rated.setdefault(r.doc_id, set()).add(r.toxic)
    cases = {d for d, r in found.items() if r.score > 0.5}
    # about one rating in twenty is wrong, so nearly all cases must be rated so, and hardly any clean rating may be one
    assert sum(1 in rated[d] for d in cases) >= 0.85 * len(cases) > 20
    assert sum(rated[d] == {0} for d in cases) <= 0.01 * len(rated)
    assert all(s.start < s.end for d in cases for s in found[d].spans)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.1), (2, "", None, 0.2), (3, "you stupid moron, go hang yourself", "a", 0.3), (3, "you stupid moron, go hang yourself", "a", 0.3), (None, "x", "a", 0.1)], "doc_id long, text string, source string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.doc_id for r in toxic(docs, none).collect()] == [3]
    assert {(r.source, r.documents, r.toxic) for r in rates(docs, none).collect()} == {("a", 2, 1), (None, 1, 0)}
    assert toxic(docs.limit(0), none).count() == 0
