import hashlib
import random

import numpy as np
import pytest

from cardsight.llm import substrings

from llm_corpora import make_docs, near_copies


def brute(ids, texts, length=50):
    first = {}
    texts = [(t or "").encode() for t in texts]
    for d, b in zip(ids, texts):
        if d is not None:
            for i in range(len(b) - length + 1):
                first[b[i:i + length]] = min(d, first.get(b[i:i + length], d))
    out = []
    for d, b in zip(ids, texts):
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i:i + length]] < d:
                    gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [4 << 20, 500])
def test_removal_equals_brute_force(spark, odd_texts, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    monkeypatch.setattr(substrings, "STRETCHES_OF", 20_000)
    monkeypatch.setattr(substrings, "NAMES_OF", 20_000)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(120))
    texts = [*odd_texts, *near_copies(8, 12)]
    texts += [t + passage[:rng.randint(45, 120)] + t for t in near_copies(4, 6)] + [passage[:49], passage[:50], passage[60:]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[5] = None, ids[6]  # a null id, and an id given twice
    rows = substrings.remove_repeats(make_docs(spark, texts, ids=ids)).collect()
    assert sorted(map(tuple, rows), key=str) == brute(ids, texts)


def test_nothing(spark):
    assert substrings.remove_repeats(make_docs(spark, ["x"]).limit(0)).collect() == []


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for trial in range(12):
        data = bytes(rng.choice([b"ab", b"abcdefgh \n", b"a\0"][trial % 3]) for _ in range(rng.choice([60, 900])))
        data = data[:len(data) // 3] * 3 if trial % 4 == 0 else data
        order, rank = substrings.suffix_array(data)
        strings = [(data + b"\0" * 60)[i:i + 50] for i in order]
        assert strings == sorted(strings)
        common = substrings.neighbours_in_common(data, order)
        for i in range(1, len(order)):
            a, b = strings[i - 1], strings[i]
            assert common[i] == next((j for j in range(50) if a[j] != b[j]), 50)
            assert (rank[order[i]] == rank[order[i - 1]]) == (a == b)


def test_window_names_depend_on_the_window_only():
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(400))
    names = substrings.window_names(text)
    assert len(names) == 351
    for i in (0, 7, 350):
        assert names[i] == substrings.window_names(text[i:i + 50])[0]
    assert len(substrings.window_names(text[:49])) == 0
    assert np.array_equal(substrings._unpack6(substrings._pack6(names >> np.uint64(16))), names >> np.uint64(16))


def test_blocks_cut_runs_but_lose_no_window(monkeypatch):
    """A chunk's windows have the same names however it is cut into blocks, texts of any length included."""
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 10, 49, 50, 51, 400, 0, 3000, 60)]

    def named(block):
        monkeypatch.setattr(substrings, "BLOCK", block)
        it = substrings.Chunk(np.arange(len(texts)), np.array([len(t) for t in texts]), b"".join(texts))
        return {(int(a) + i, int(t), int(x)) for a, n, t, x in zip(*it.runs()) for i in range(n)}
    whole = named(1 << 20)
    assert len(whole) == sum(max(0, len(t) - 49) for t in texts)
    assert named(64) == named(7) == named(1000) == whole


def test_what_the_ranks_share_is_not_compared_again():
    rng = random.Random(8)
    for trial in range(12):
        data = bytes(rng.choice([b"ab", b"abcdefgh \n", b"a\0"][trial % 3]) for _ in range(rng.choice([0, 60, 900])))
        data = data[:len(data) // 3] * 3 if trial % 4 == 0 else data
        order, rank, shared = substrings._refined(data)
        whole = substrings.neighbours_in_common(data, order)
        assert np.array_equal(substrings.neighbours_in_common(data, order, shared=shared), whole)
        assert (shared <= np.where(np.arange(len(order)) == 0, 0, whole)).all()
        assert np.array_equal(shared[1:] == 50, rank[order][1:] == rank[order][:-1])
