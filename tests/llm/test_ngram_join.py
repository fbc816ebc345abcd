import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cardsight.llm import graph, ngram_join, words

from llm_corpora import make_docs, near_copies


def brute(texts, n, num, den):
    sets = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j:j + n]) for j in range(max(1, len(words) - n + 1))} if words else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in holders[g] if j < i).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,num,den,block", [(3, 90, 100, 512), (5, 4, 5, 512), (3, 90, 100, 2), (2, 1, 2, 512)])
def test_classes_equal_brute_force(spark, odd_texts, monkeypatch, n, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    texts = [*odd_texts, *near_copies(), "One TWO", "one two", "É a b c", "é a b c"]
    rows = ngram_join.classes(make_docs(spark, texts), n, Fraction(num, den)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(texts, n, num, den)
    assert len(rows) == len(texts)


def test_no_signature_misses_a_link():
    for n, t in ((3, Fraction(9, 10)), (5, Fraction(4, 5))):
        sets = list(ngram_join.gram_sets(pa.array(near_copies(9, 60)), n))
        signed = [set(ngram_join.signatures(g, t).tolist()) for g in sets]
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j], assume_unique=True))
                union = len(a) + len(sets[j]) - both
                if both < union and both >= t * union:
                    assert signed[i] & signed[j]


def test_nothing_nulls_and_repeats(spark):
    docs = make_docs(spark, ["a b c d", "a b c d", "a b c d", None], ids=[None, 4, 2, 9])
    assert ngram_join.classes(docs.limit(0)).collect() == []
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.classes(docs).collect()), key=str)
    assert got == [(2, 2), (4, 2), (9, 9), (None, None)]


def test_keep_one(spark):
    texts = near_copies()
    docs = make_docs(spark, [*texts, texts[0]], ids=[*range(len(texts)), 0])
    kept = ngram_join.keep_one(docs, 5, Fraction(4, 5))
    assert kept.schema.names == docs.schema.names
    want = brute(texts, 5, 4, 5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i][1] == i)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), (None, 4), (20, 10), (30, 20), (40, 30), (50, 40), (50, 11)]
    roots = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert roots == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 10, 11: 10, 20: 10, 30: 10, 40: 10, 50: 10}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("part, long", [(1 << 20, 1024), (16, 6), (5, 3), (64, 1 << 30)])
def test_word_hashes(monkeypatch, odd_texts, part, long):
    """Equal words have equal hashes, other words others, wherever parts and texts end."""
    monkeypatch.setattr(words, "PART", part)
    monkeypatch.setattr(words, "LONG", long)
    texts = [*odd_texts, "AbC aBc abc", "ÀB àb", "\x0bx\x0cy\x1cz", "w" * 40 + " " + "w" * 41, "W" * 40, None, "", "end "]
    texts = [t if t is None else t[:3000] for t in texts]
    column = pa.array(["cut", *texts])[1:]
    hashes, first = words.word_hashes(column)
    plain = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(first).tolist() == list(map(len, plain))
    seen = {}
    for w, h in zip((w for p in plain for w in p), hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert words.word_hashes(pa.array([], pa.string()))[1].tolist() == [0]


def test_keep_one_of_ids_with_several_texts(spark):
    """An id over two texts: only the text that has a partner goes; of one class one document stays."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c + " more"), (6, c), (None, a), (7, ""), (7, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r[0], r[1]) for r in kept.collect()), key=str)
    one_c = [r for r in got if r[0] == 6]
    assert len(one_c) == 1 and one_c[0][1] in (c, c + " more")
    assert sorted((r for r in got if r[0] != 6), key=str) == sorted([(1, a), (5, b), (None, a), (7, ""), (7, None)], key=str)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Groups of many blocks: near copies of several bases that share a passage give brute force's classes."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "HOT_SAMPLE", 2)
    monkeypatch.setattr(ngram_join, "HOT_SAMPLED", 4)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for base in range(4):
        words_of = [f"w{base}x{i}" for i in range(14)] + passage
        for _ in range(40):
            w = list(words_of)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs, 3, Fraction(80, 100)).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 4


def mixed_passages(n=60, words_each=40, seed=5):
    """Texts of 5 of 12 passages each: none links with another, yet nearly all their n-grams are in several."""
    rng = random.Random(seed)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words_each)) for _ in range(12)]
    chosen = rng.sample([c for c in combinations(range(12), 5)], n)
    return [" ".join(passages[i] for i in c) for c in chosen]


def test_whole_sets_go_only_where_a_link_is_likely(spark, monkeypatch):
    texts = mixed_passages()
    texts += [t + " and one more word" for t in texts[:3]]
    rows = []
    links = ngram_join._tree_links
    monkeypatch.setattr(ngram_join, "_tree_links", lambda grouped, t: (rows.append(grouped.count()), links(grouped, t))[1])
    monkeypatch.setattr(ngram_join, "_groups", _every_group)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(make_docs(spark, texts), 5, Fraction(4, 5)).collect()}
    assert got == {i: c for i, (_, c) in brute(texts, 5, 4, 5).items()}
    assert len(rows) == 2 and rows[1] <= 40 < rows[0]


def _every_group(sets):
    """Each set in the groups of two others, so that every group holds several classes."""
    order = sets.select("set", F.row_number().over(Window.orderBy("set")).alias("i"))
    return order.select("set", F.explode(F.expr("array(i % 3L, 7L)")).alias("grp"))


def test_outlines_never_share_less():
    rng = np.random.default_rng(3)
    for bits in (64, 52):  # with 52 bits the leading 16 have many equal values
        pool = np.unique(rng.integers(0, 2 ** bits - 1, 400, dtype=np.uint64))
        for _ in range(20):
            a, b = (np.sort(rng.choice(pool, 200, replace=False)) for _ in "ab")
            short = [ngram_join._distinct(ngram_join.outline(x)) for x in (a, b)]
            assert [len(np.unique(x)) for x in short] == [200, 200]
            assert len(np.intersect1d(*short)) >= len(np.intersect1d(a, b))
