import random

from pyspark.sql import functions as F

from cardsight.llm import mixing

from llm_corpora import make_docs

def levels():
    return {"domain": F.col("n_chars") % 3, "lang": F.col("lang"), "source": F.col("source")}


def fill(budget, capacities, weights):
    """Water-filling by rounds: whoever is full leaves, the rest share what is left."""
    share, left, open_ = [0.0] * len(weights), budget, [i for i, w in enumerate(weights) if w > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if capacities[i] <= level * weights[i]]
        if not full:
            for i in open_:
                share[i] = level * weights[i]
            break
        for i in full:
            share[i], left = capacities[i], left - capacities[i]
        open_ = [i for i in open_ if i not in full]
    return share


def budgets(leaves, budget, weights, epochs):
    """{leaf: budget} by splitting the budget down the tree."""
    def down(prefix, share):
        if len(prefix) == 3:
            return {prefix: share}
        kids = sorted({leaf[:len(prefix) + 1] for leaf in leaves if leaf[:len(prefix)] == prefix})
        capacity = [epochs * sum(n for leaf, n in leaves.items() if leaf[:len(k)] == k) for k in kids]
        out = {}
        for k, s in zip(kids, fill(share, capacity, [weights.get(k, 1.0) for k in kids])):
            out |= down(k, s)
        return out
    return down((), budget)


def _corpus(spark, n=400):
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(n)]
    return texts, make_docs(spark, texts, langs=[rng.choice(["en", "fr", None]) for _ in texts],
                            sources=[rng.choice(["src0"] * 5 + ["src1", "src2"]) for _ in texts])


def test_budgets_and_prefixes(spark):
    texts, docs = _corpus(spark)
    rows = [(r["doc_id"], (str(r["n_chars"] % 3), r["lang"] or "none", r["source"]), len((r["text"] or "").split()))
            for r in docs.collect()]
    leaves = {}
    for _, leaf, n in rows:
        leaves[leaf] = leaves.get(leaf, 0) + n
    total = sum(leaves.values())
    weights = {("0",): 3.0, ("0", "fr"): 0.0, ("1", "en"): 2.0, ("2", "none", "src1"): 5.0}
    for fraction, epochs in ((0.5, 1), (0.9, 1), (1.4, 2), (5.0, 2), (0.0, 1)):
        want = budgets(leaves, fraction * total, weights, epochs)
        got = mixing.mix(docs, levels(), fraction, weights, epochs).select("row.doc_id", "domain", "lang", "source", "epoch",
                                                                         "n_tokens").collect()
        taken, times = {}, {}
        for r in got:
            leaf = (r["domain"], r["lang"], r["source"])
            taken.setdefault(leaf, []).append(r["n_tokens"])
            times.setdefault(r["doc_id"], []).append(r["epoch"])
        assert all(sorted(e) == list(range(len(e))) and len(e) <= epochs for e in times.values())
        for leaf, share in want.items():
            if leaves[leaf]:  # a prefix: the budget is reached, and not before the last document (or equal ones)
                have, share = sum(taken.get(leaf, [])), int(share + 1e-6)
                assert share <= have < share + 3 * 40 and (have == 0) == (share == 0), (leaf, share, have)
        again = mixing.mix(docs.repartition(5), levels(), fraction, weights, epochs)
        assert sorted((r["doc_id"], r["epoch"]) for r in again.select("row.doc_id", "epoch").collect()) == \
            sorted((r["doc_id"], r["epoch"]) for r in got)


def test_hash_ranges_do_not_change_the_choice(spark, monkeypatch):
    _, docs = _corpus(spark)
    one = sorted(r[0] for r in mixing.mix(docs, levels(), 0.5).select("row.doc_id").collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(r[0] for r in mixing.mix(docs, levels(), 0.5).select("row.doc_id").collect()) == one


def test_rows_come_back_whole(spark):
    docs = make_docs(spark, ["a b", "a b", None, ""], ids=[1, 1, None, 3])
    mixed = mixing.mix(docs, levels(), 1.0).select("row.*")
    assert mixed.schema.names == docs.schema.names
    # Whole supply: everything with tokens is taken, the equal rows together.
    assert [r["doc_id"] for r in mixed.where("text = 'a b'").collect()] == [1, 1]
    assert mixing.mix(docs.limit(0), levels(), 1.0).collect() == []
