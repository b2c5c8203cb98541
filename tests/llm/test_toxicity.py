from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.llm.toxicity import THRESHOLD, Scorer, Trie, score_texts

SCORER = Scorer()
ABUSE = [
    "you are a useless moron and nobody in the lab wants you here", "You are an IDIOOOOT", "@x: go f**k yourself", "what a b i t c h you are", "you pathetic lоsеr", "you are a m0r0n",
    "Women are too stupid for this work and should be kept out of the lab.", "We ought to lock immigrants out of the building", "I come over with a hammer for your knees",
    "Du bist so ein vollidiot", "Ferme ta gueule, espèce d'ab.ruti", "Cállate ya, pedazo de m13rd4", "send me your nudes", "Nobody would miss you if you vanished", "you sc​umbag", "fix it, you hlafwit idiot",
]
CLEAN = [
    "kill the child process before the parent becomes a zombie", "I was an idiot and forgot to free the list", "my own dumb mistake: wrong sign", "what a damn nasty race, took me two days",
    'a comment with the words "useless moron" was removed from OR-9 and the author was warned', "calling a colleague an idiot, as happened in OR-9, gets the comment deleted",
    "a bastard hybrid of two parsers", "naked pointers are banned, please wrap them", "the penetration test starts on Monday", "Essex and Scunthorpe cells", "male and female connectors were swapped",
    "the dummy load sucks 9 watts", "the watchdog shoots the hung node in the head", "waits 455 ms, you can retry", "", "   ", "\n\n", "4f 2a 00 7c", "the classifier assigns class 5, check the analysis",
]


@pytest.mark.parametrize("text", ABUSE)
def test_abuse(text):
    assert SCORER.score(text)[0] >= THRESHOLD


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert SCORER.score(text)[0] < THRESHOLD


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=7), st.integers(0, 2))
def test_automaton_equals_brute_force(token, most):
    words = ["abc", "abcd", "dcba", "aaaa", "bcbc", "d"]
    near = [(distance(token, w), w) for w in words if distance(token, w) <= most]
    assert Trie(dict.fromkeys(words, "x")).near(token, most) == (min(near)[1] if near else None)


def test_window_ends_with_the_sentence():
    assert SCORER.score("the old parser was a bastard.\nyou can merge it")[0] < THRESHOLD


def test_tables(spark):
    rows = [(1, "you are an idiot", "a"), (1, "you are an idiot", "a"), (2, None, None), (3, "", "b"), (4, "fine " * 10_000 + "\nyou stupid idiot", "b")]
    df = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id long, text string, source string, score double")
    got = sorted((r["doc_id"], r["source"] or "", r["score"] >= THRESHOLD) for r in score_texts(df.drop("score"), "doc_id", F.col("text"), ["source"]).collect())
    assert got == [(1, "a", True), (1, "a", True), (2, "", False), (3, "b", False), (4, "b", True)]
    assert score_texts(df.limit(0).drop("score"), "doc_id", F.col("text")).count() == 0


def misspellings():
    """Every insult of five letters or more with two letters swapped, one doubled, one left out."""
    from tracelode.llm import lexicon

    for w in lexicon.INSULT.split():
        if len(w) >= 5:
            for i in range(1, len(w) - 1):
                yield w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                yield w[: i + 1] + w[i:]
                yield w[:i] + w[i + 1 :]


def test_misspelt_words_are_found_by_the_automaton_alone():
    exact = Scorer(forgiving=False)
    words = sorted({m for m in misspellings() if exact.token(m)[1] is None and not exact.is_ordinary(m)})
    assert len(words) > 800
    with_it = sum(SCORER.score(f"you are a {m}")[0] >= THRESHOLD for m in words)
    without = sum(exact.score(f"you are a {m}")[0] >= THRESHOLD for m in words)
    assert with_it >= 0.9 * len(words) and without == 0


@pytest.mark.parametrize(
    "text",
    ["you are an idito", "you are an idiott", "you stupid bich", "you are a fuker", "what a cuntt you are", "you are such a mroon", "I will burn your house down tonight.", "People like her should be wiped off the earth.", "Those people are subhuman."],
)
def test_remarks_that_no_list_holds(text):
    assert SCORER.score(text)[0] >= THRESHOLD


def test_ordinary_words_are_no_misspellings():
    for text in ("you should batch the count and hunt the idea", "you pitch, kick and lock the clock", "did you pull the restarts"):
        assert SCORER.score(text)[0] < THRESHOLD


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=7), st.integers(0, 2))
def test_automaton_with_swaps_equals_brute_force(token, most):
    words = ["abc", "abcd", "dcba", "aaaa", "bcbc", "d", "abdcabd"]

    def osa(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, rows[i - 2][j - 2] + 1)
                rows[i].append(best)
        return rows[-1][-1]

    near = [(osa(token, w), w) for w in words if osa(token, w) <= most]
    assert Trie(dict.fromkeys(words, "x")).near(token, most, swaps=True) == (min(near)[1] if near else None)
