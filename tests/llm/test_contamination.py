from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tracelode.llm.contamination import Index, find_leaks, holds_most, holds_run
from tracelode.llm.words import bare_words

ITEM = "Compute the share of lost reports when Orla-9910 drops every 13th packet out of 2699 and explain in which order Tessin-8421 releases securityHint number 5086 before T-319c fires."


def test_words_lose_layout_markup_and_spelling():
    want = bare_words("An engineer raises cellIdentityMap from 583 to 8977")
    for text in (
        "AN ENGINEER RAISES CELLIDENTITYMAP FROM 583 TO 8977",
        "<p>An&nbsp;engineer <b>raises</b> cell<i>Identity</i>Map<br>from 583 to 8977</p>",
        "// An engineer raises cell-\n// IdentityMap from **583** to\r\n// _8977_.",
        "An eng​ineer rai­ses cellIdentityMap from ５８３ to 8977!",
        "Аn еnginееr raises cellIdentityMap, from (583) to “8977”",
    ):
        assert bare_words(text) == want, text
    assert bare_words("") == [] and bare_words("-- // ## ") == []


def brute(item: list[bytes], words: list[bytes]) -> bool:
    n = len(item)
    runs = {tuple(item[i : i + 12]) for i in range(n - 11)}
    if any(tuple(words[i : i + 12]) in runs for i in range(len(words) - 11)):
        return True
    need, stretch = math.ceil(0.75 * n), math.floor(1.5 * n)
    for s in range(len(words)):
        row = [0] * (n + 1)
        for w in words[s : s + stretch]:
            before = 0
            for j in range(n):
                keep = row[j + 1]
                row[j + 1] = before + 1 if w == item[j] else max(row[j + 1], row[j])
                before = keep
        if row[n] >= need:
            return True
    return False


def test_against_brute_force():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) + (str(rnd.randrange(999)) if rnd.random() < 0.3 else "") for _ in range(rnd.choice([3, 8, 16, 30])))) for i in range(12)]
    index = Index(items)
    leaks = 0
    for _ in range(500):
        item_id, text = rnd.choice(items)
        words = text.split()
        kind = rnd.random()
        if kind < 0.3:
            a = rnd.randrange(len(words))
            words = words[a : a + rnd.choice([6, 11, 12, 13])]
        else:
            out = []
            for w in words:
                if rnd.random() > kind / 3:
                    out.append(w)
                while rnd.random() < kind / 3:
                    out.append(rnd.choice(vocabulary))
            words = out
        doc = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))] + words + [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]
        want = {i for i, t in items if brute(bare_words(t), bare_words(" ".join(doc)))}
        assert set(index.leaked(" ".join(doc))) == want
        leaks += len(want)
    assert leaks > 100


def test_run_and_most():
    words = bare_words(ITEM)
    item = Index([(1, ITEM)]).items[0]
    assert holds_run(item, words[:12], 0, 12) and not holds_run(item, words[:11], 0, 11)
    need = math.ceil(0.75 * len(words))
    assert holds_most(item, words[:need], 0, need) and not holds_most(item, words[: need - 1], 0, need - 1)


def test_tables(spark):
    docs = [(1, "intro " + ITEM.upper() + " outro"), (2, " ".join(ITEM.split()[:11])), (3, None), (4, ""), (5, "x" * 60_000), (1, "intro " + ITEM.upper() + " outro"), (2**60 + 1, ("noise " * 9000) + ITEM), (None, "no item here")]
    d = spark.createDataFrame([(k, t, 9) for k, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, 1), (7, ITEM, 1), (8, None, 2), (9, "", 3)], "item_id long, text string, doc_id int")
    find = lambda d, i: sorted(tuple(r) for r in find_leaks(d, "doc_id", F.col("text"), i, "item_id", F.col("text")).collect())
    assert find(d.drop("item_id"), items) == [(1, 7), (2**60 + 1, 7)]
    assert find(d.limit(0).drop("item_id"), items) == [] and find(d.drop("item_id"), items.limit(0)) == []
