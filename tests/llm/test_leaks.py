import random
import unicodedata

import numpy as np
import regex

from spotframe.llm import leaks
from spotframe.llm.text import gram_hashes, plain_words


def words(t):
    t = regex.sub(r"[\p{Mn}\p{Cf}]+", "", unicodedata.normalize("NFKD", t or "")).lower()
    return regex.findall(r"[\p{L}\p{N}]+", t)


TEXTS = ["Él  niño—Straße, été ​so­ft", "", None, "plain ASCII 12,5 text.", "İstanbul ﬁne ①②", "́​", "...", "a\x00b"]


def test_plain_words():
    cp, starts = plain_words(TEXTS)
    for i, t in enumerate(TEXTS):
        got = "".join(map(chr, cp[starts[i] : starts[i + 1] - 1]))
        assert got.split() == words(t) and got == " " + "".join(w + " " for w in words(t)), (t, got)


def test_gram_hashes():
    cp = np.array([ord(c) for c in "abcabcabcd"], "uint32")
    for q in (1, 2, 3, 5, 7):
        h = gram_hashes(cp, q)
        assert len(h) == len(cp) - q + 1
        assert all((h[i] == h[j]) == (cp[i : i + q].tolist() == cp[j : j + q].tolist()) for i in range(len(h)) for j in range(len(h)))


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    sentence = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [sentence(rng.randrange(3, 60)) for _ in range(30)]
    docs = []
    for i in range(80):
        d = sentence(rng.randrange(0, 120))
        if i % 3 == 0:
            it = rng.choice(items)
            k = rng.choice([11, 12, 13, 14, 30])
            s = rng.randrange(max(1, len(it) - k + 1))
            p = rng.randrange(len(d) + 1)
            d = d[:p] + it[s : s + k] + d[p:]
        docs.append(d)
    return [" ".join(x) for x in items], [" ".join(x).capitalize() + "." for x in docs]


def exact(docs, items, n=13):
    out = set()
    for i, t in enumerate(items):
        w = words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for d, u in enumerate(docs) if any(tuple(words(u)[k : k + n]) in grams for k in range(len(words(u)) - n + 1))}
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return leaks.leaked_passages(d, i, **kw).collect()


def test_thirteen_words_are_all_found_and_nothing_else(spark):
    items, docs = corpus()
    for kw in ({}, {"max_edits": 2, "q": 8, "max_chars": 2500}):
        got = {(r.doc_id, r.item_id) for r in found(spark, docs, items, **kw) if r.edits == 0 and r.words >= 13}
        assert got == exact(docs, items) != set(), kw


def test_edited_passages(spark):
    item = "the recurring minutes of gavpellant had been sent before the parking permit of oldmere was inspected by nobody"
    base = "Before this. " + item + " After that."
    cases = {0: base, 1: base.replace("gavpellant", "gavpelant"), 2: base.replace("parking", "parkings"), 3: base.replace("minutes", "minuses"), 4: "nothing of the kind " * 5}
    got = {r.doc_id: r for r in found(spark, [cases[i] for i in range(5)], [item])}
    assert set(got) == {0, 1, 2, 3} and got[0].edits == 0
    whole = {r.doc_id: r.edits for r in found(spark, [cases[i] for i in range(5)], [item], window_words=18)}
    assert whole == {0: 0, 1: 1, 2: 1, 3: 1}


def test_bound_keeps_every_window_within_the_edits(spark):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(13))
    docs = []
    for _ in range(40):
        t = list(item)
        for _ in range(2):
            k, p = rng.randrange(3), rng.randrange(len(t))
            t[p : p + (k != 1)] = [] if k == 0 else [rng.choice("xyz")]
        docs.append("zz " + "".join(t) + " zz")
    assert {r.doc_id for r in found(spark, docs, [item], max_edits=2)} == set(range(40))


def within_one(window, text):
    """Brute force: whether a stretch of the text is within one edit of the window."""
    n = len(window)
    for i in range(len(text)):
        for m in (n - 1, n, n + 1):
            t = text[i : i + m]
            if len(t) < m:
                continue
            k = next((j for j, (a, b) in enumerate(zip(window, t)) if a != b), min(n, m))
            if window[k + (m <= n) :] == t[k + (m >= n) :]:
                return True
    return False


def test_short_windows_with_an_edit_are_all_found(spark):
    rng = random.Random(8)
    items, docs = [], []
    for n in range(24, 36):
        for _ in range(6):
            w = "".join(rng.choice("abcdefgh") if rng.random() < 0.75 else " " for _ in range(n - 2)).split()
            items.append(" ".join(w))
            t = f"zq {' '.join(w)} qz"
            p = rng.randrange(3, len(t) - 3)
            docs.append(t[:p] + rng.choice(["", "x", "xy"[: 1 + (t[p] == "x")] + t[p]]) + t[p + 1 :])
    got = {(r.doc_id, r.item_id) for r in found(spark, docs, items, window_words=30)}
    pad = lambda t: " " + " ".join(words(t)) + " "
    long_enough = [i for i, t in enumerate(items) if len(pad(t)) >= 24]
    want = {(d, i) for i in long_enough for d, u in enumerate(docs) if within_one(pad(items[i]), pad(u))}
    assert len(want) > 40 and want <= got
    assert all(i not in long_enough or (d, i) in want for d, i in got)


def test_rarest_disjoint_grams_are_chosen_together():
    f = np.array([5, 5, 5, 0.5, 5, 5, 5, 1.0])
    assert sorted(leaks._rarest_disjoint(f, 2, 4)) == [3, 7] and leaks._rarest_disjoint(f, 1, 4).tolist() == [3]
    # the rarest alone would leave no second one
    assert sorted(leaks._rarest_disjoint(np.array([3.0, 1, 2]), 2, 2)) == [0, 2]


def test_empty_null_short_and_repeated(spark):
    assert found(spark, [], ["some item of several words here"]) == []
    assert found(spark, ["a text", None, ""], []) == []
    item = "an item with enough words to be found in the text of a document"
    got = found(spark, [item, item, None, ""], [item, item, None, "", "tiny"])
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {(r.doc_id, r.item_id) for r in found(spark, ["x " * 300_000 + item + " y" * 1000], [item])} == {(0, 0)}
