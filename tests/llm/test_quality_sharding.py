import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from cardsight.llm import quality, sharding

from llm_corpora import make_docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    mark = [False] * len(words)
    for i in range(len(words) - 4):
        if seen[tuple(words[i:i + 5])] > 1:
            mark[i:i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(mark))


def test_ledger_equals_brute_force(spark, odd_texts):
    texts = [*odd_texts, "a b c d e f a b c d e f", "same\nsame\n\nsame", "# * | < >" * 9, "LOUD!! WORDS!! " * 9]
    led = quality.ledger(make_docs(spark, texts))
    rows = {r["doc_id"]: r for r in led.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        n, _, _, _, repeat = brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text)
        assert bool(r["fail_bits"] & quality.mask_of(quality.POLICIES["base-1"])) == (n < 10 or 100 * repeat > 20 * n)
    assert quality.ledger(make_docs(spark, texts).limit(0)).collect() == []


def test_keep_documents_keeps_columns_and_repeats(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    docs = make_docs(spark, [clean, clean, "short", None, "bad " * 60], ids=[1, 1, 2, None, 4])
    kept = quality.keep_documents(docs)
    assert kept.schema == docs.schema
    assert [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert quality.keep_documents(docs.limit(0)).collect() == []


def test_ablation_counts(spark, odd_texts):
    led = quality.ledger(make_docs(spark, odd_texts)).cache()
    mask = quality.mask_of(quality.POLICIES["web-2"])
    bits = [r["fail_bits"] & mask for r in led.collect()]
    for r in quality.ablation(led, "web-2").collect():
        bit = quality.mask_of([r["rule"]])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_only_this"] == sum(b == bit for b in bits)


def test_sharding_law(spark, odd_texts):
    ids = [*range(len(odd_texts) - 2), None, 3]
    docs = make_docs(spark, odd_texts, ids=ids)
    rows = sharding.place(docs, 8, grown=9).collect()
    assert len(rows) == len(odd_texts)
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((t or "").encode()) for t in odd_texts)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for t in odd_texts)
    by_shard, by_id = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.place(docs.limit(0), 8).collect() == []


def brute_shard(doc_id, leaves, n_open):
    """A direct descent in plain Python."""
    def draw(attempt, node, weight):
        h = 42
        for part in (str(doc_id).encode(), struct.pack("<i", attempt), f"{sharding.SEED}/{node}".encode()):
            h = xxhash.xxh64_intdigest(part, seed=h)
        return -math.log(((h >> 11) + 1) / float(1 << 53)) / weight

    def least(attempt, nodes):
        return min(nodes, key=lambda n: (draw(attempt, n[0], sum(x.weight for x in n[1])), nodes.index(n)))

    for t in range(sharding.ATTEMPTS):
        _, some = least(t, [(f"region {r}", [x for x in leaves if x.region == r]) for r in sorted({x.region for x in leaves})])
        r = some[0].region
        _, some = least(t, [(f"region {r}/rack {k}", [x for x in some if x.rack == k]) for k in sorted({x.rack for x in some})])
        k = some[0].rack
        _, (leaf,) = least(t, [(f"region {r}/rack {k}/shard {x.shard}", [x]) for x in some])
        if leaf.shard < n_open:
            return leaf.shard
    return min((x for x in leaves if x.shard < n_open), key=lambda x: draw(-1, f"shard {x.shard}", x.weight)).shard


def test_sharding_equals_brute_force(spark):
    docs = spark.range(-200, 800).selectExpr("id as doc_id", "cast(null as string) as text")
    for leaves, n in ((sharding.plan(), 8), (sharding.plan(), 1), (sharding.plan(3, 3, 2, [1.0 + i % 4 for i in range(18)]), 11)):
        for r in sharding.place(docs, n, leaves=leaves).collect():
            assert r["shard"] == brute_shard(r["doc_id"], leaves, n)


def test_sharding_law_for_every_count_and_balance(spark):
    docs = spark.range(16000).selectExpr("id as doc_id", "cast(null as string) as text")
    for n in range(1, 13):
        rows = sharding.place(docs, n, grown=n + 1)
        moved = rows.where("shard <> grown_shard")
        assert {r["grown_shard"] for r in moved.select("grown_shard").distinct().collect()} == {n}
        if n in (5, 8, 9):
            assert all(abs(r["count"] * n / 16000 - 1) < 0.12 for r in rows.groupBy("shard").count().collect())
    with pytest.raises(ValueError):
        sharding.place(docs, 17)


def test_sharding_depends_on_the_tree_and_confines_movement(spark):
    docs = spark.range(16000).selectExpr("id as doc_id", "cast(null as string) as text")

    def shards(leaves):
        return {r["doc_id"]: r["shard"] for r in sharding.place(docs, 16, leaves=leaves).collect()}

    flat, deep = shards(sharding.plan(1, 1, 16)), shards(sharding.plan())
    assert sum(flat[i] != deep[i] for i in flat) > 8000
    weights = [1.0] * 16
    weights[5] = 3.0  # region 1, rack 0
    heavier = shards(sharding.plan(weights=weights))
    moves = {(deep[i], heavier[i]) for i in deep if deep[i] != heavier[i]}
    assert moves and all(b // 4 == 1 for _, b in moves)           # into the region alone
    assert all(b // 2 == 2 for a, b in moves if a // 4 == 1)      # within it, into the rack alone
    assert all(b == 5 for a, b in moves if a // 2 == 2)           # within that, into the leaf alone
    share = sum(s == 5 for s in heavier.values()) / 16000
    assert abs(share - 3 / 18) < 0.01


def test_length_alone_never_rejects(spark):
    """A text whose stretches are varied passes, however long it is."""
    base = [f"word{i}" for i in range(900)]
    rng = random.Random(8)
    long = "\n".join(" ".join(rng.choice(base) for _ in range(20)) for _ in range(3000))
    led = quality.ledger(make_docs(spark, [long, "same few words " * 40])).orderBy("doc_id").collect()
    bit = quality.mask_of(["few_distinct_words"])
    assert 100 * 900 < 15 * led[0]["n_words"] and not led[0]["fail_bits"] & bit
    assert led[1]["fail_bits"] & bit
