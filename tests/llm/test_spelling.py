"""Spelling variants against a plain Python version that compares all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cardsight.llm import spelling


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, n, form[w], root(w), len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "form", "root", "n_near", "form_n").collect())


def corpus(seed, n_docs=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abcÿ") + w[at:], w[:at] + rng.choice("xyz") + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "\n", ", ", "1"]).join(words)))
    return rows + [(None, "Nullid " * 9), (3, None), (4, ""), (5, "x" * 400_000), (5, "x" * 400_000), (6, ("x" * 400_000 + " ") * 3),
                   (7, "ÀÖ×÷ÿß " * 5), (8, "don't 𝒳letters𝒳 " * 4), *rows[:20]]


@pytest.mark.parametrize("group_pairs", [spelling.GROUP_PAIRS, 8])
def test_equals_brute_force(spark, group_pairs):
    rows = corpus(group_pairs)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string")
    want = brute(brute_words(rows))
    assert len(want) > 200 and any(r[2] and r[3] != r[2] for r in want)
    assert got(spelling.variants(docs, group_pairs=group_pairs)) == want


def test_words_that_share_a_hot_chunk(spark):
    """A third of all words share their first half: their group is chunked on, and no group stays large."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdefgh") for _ in range(10)): 3 for _ in range(300)}
    words |= {"commonstart" + "".join(rng.choice("abcd") for _ in range(6)) + "".join(rng.choice("abcd") for _ in range(4)): 7
              for _ in range(300)}
    stem = "commonstartabcdabcdab"
    words |= {stem[:i] + c + stem[i + 1:]: 4 for i in range(len(stem)) for c in "xyz"}
    words[stem] = 100
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {frozenset((r["x"], r["y"])) for r in spelling.near_pairs(table, 64).collect()}
    assert pairs == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_chain_of_forms(spark):
    names = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbc", "bbbbcc"]
    rows = [(i, " ".join([w] * 3 * 2 ** i)) for i, w in enumerate(names)]
    words = brute_words(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(docs)) == brute(words)


def test_empty(spark):
    assert got(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []
