"""Documents for the operator tests."""

import random

WORDS = [f"w{i}" for i in range(300)] + ["the", "of", "and", "Straße", "été", "日本"]

# Names that operators use themselves: as input columns they must do no harm.
CLASHING = ["n_words", "n_tokens", "row", "key", "epoch", "size", "shard", "spans", "hash", "g", "component_id", "fail_bits"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def make_docs(spark, texts, ids=None, sources=None, langs=None):
    """A documents table with clashing extra columns; ids count from 0 unless given."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 7}",
                     len(t) if t is not None else None, *["x"] * len(CLASHING)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def near_copies(seed=3, families=40):
    """Texts in families that differ by a few words, with exact copies among them."""
    rng, out = random.Random(seed), []
    for _ in range(families):
        base = [rng.choice(WORDS) for _ in range(rng.choice([2, 5, 12, 25, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                j, r = rng.randrange(len(words)), rng.random()
                if r < 0.4:
                    words[j] = rng.choice(WORDS)
                elif r < 0.7:
                    words.insert(j, rng.choice(WORDS))
                elif len(words) > 1:
                    del words[j]
            out.append(" ".join(words))
    return out
