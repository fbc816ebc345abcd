"""Token alignment against plain Python over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from cardsight.llm import alignment
from llm_corpora import WORDS

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    # The byte-level alphabet, built the usual way: visible bytes first, then the rest from 256 on.
    visible = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    of = {chr(x): x for x in visible}
    of.update({chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)})
    docs, counts = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        ai = a.encode(" " + t, add_special_tokens=False).ids if t else []
        bi = b.encode(t) if t else []
        ab = [bytes(of[c] for c in a.id_to_token(i)) for i in ai]
        bb = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
              for i, p in ((i, b.id_to_piece(i)) for i in bi)]
        if b"".join(ab) != whole or b"".join(bb) != whole:
            docs.append(None)
            continue
        spans = []
        for tokens in (ab, bb):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        owner = {}
        links = []
        for i, (s, e) in enumerate(spans[0]):
            for x in range(s, e):
                owner[x] = i
        for j, (s, e) in enumerate(spans[1]):
            links += [(ai[i], bi[j]) for i in sorted({owner[x] for x in range(s, e)})]
        groups, before = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(ai, spans[0]) if before < e <= c) + "|" +
                          ",".join(str(i) for i, (s, e) in zip(bi, spans[1]) if before < e <= c))
            before = c
        counts.update(links)
        docs.append((len(ai), len(bi), groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, links = d
            out.append((na, nb, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                        sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def got(df):
    rows = df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def odd(seed):
    rng = random.Random(seed)
    marks = ["", " ", "  ", "\n", " \n", "\n ", "\n\n", "\t", " ", " ", "\x1c", ", ", ".\n", "▁", "<s>", "'s ", "12 ", "é", "\x00"]
    return ["".join(rng.choice(WORDS) + rng.choice(marks) for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("table_pairs", [alignment.TABLE_PAIRS, 40, 0])
def test_equals_brute_force(spark, odd_texts, table_pairs):
    texts = [t for t in odd_texts if not t or len(t) < 30_000] + odd(table_pairs) + ["<|endoftext|> <unk> <0x0A>", " lead", "\nlead", " ",
                                                                                 "\n", "  two", "a▁b"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    want = sorted(((i, *row) for i, row in enumerate(brute(texts))), key=str)
    assert got(alignment.aligned(docs, BYTES, PIECES, table_pairs)) == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "some words here"), (3, "some words here"), (3, "some words here"), (None, None)]
    want = brute([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.aligned(docs, BYTES, PIECES)) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    assert got(alignment.aligned(docs.limit(0), BYTES, PIECES)) == []


def test_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) for _ in range(60_000)) + "y" * 50_000
    a, b = alignment.Aligner.at(BYTES, PIECES).tokens([text])[0]
    assert a and b
    row = alignment.aligned(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES, PIECES).first()
    assert (row["n_a"], row["n_b"]) == (len(a), len(b)) and row["n_links"] == len(a) + len(b) - row["n_groups"]


def test_runs_walk_equals_sets():
    rng = random.Random(2)
    for _ in range(400):
        end = rng.randint(1, 60)
        ea, eb = (sorted({end, *rng.sample(range(1, end + 1), rng.randint(0, end))}) for _ in range(2))
        if rng.random() < 0.4:
            eb = sorted({*ea, *eb}) if rng.random() < 0.5 else list(ea)
        at_a = at_b = 0
        found = alignment.runs(ea, eb)
        for i, j, length, k, m in found:
            assert (i, j) == (at_a, at_b)
            assert (k - i - length) + (m - j - length) != 2  # else it would have been part of the run
            at_a, at_b = k, m
        ia, ib, n_runs = alignment.linked(found, ea, eb)
        assert n_runs == sum(f[2] for f in found)
        links = sorted(zip(ia.tolist(), ib.tolist()))
        starts = [[0, *e[:-1]] for e in (ea, eb)]
        assert links == sorted((i, j) for i in range(len(ea)) for j in range(len(eb))
                               if starts[0][i] < eb[j] and starts[1][j] < ea[i])


def test_long_stretches_are_left_to_the_slower_library():
    aligner = alignment.Aligner.at(BYTES, PIECES)
    assert aligner.fast is not None
    texts = ["short words", "q" * 50_000, "a" + " " * 50_000 + "b", "many short words " * 900, ""]
    assert aligner.a_ids(texts) == [aligner.a.encode(t, add_special_tokens=False).ids for t in texts]
