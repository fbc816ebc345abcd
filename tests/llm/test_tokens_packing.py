import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cardsight.llm import packing, tokens

from llm_corpora import make_docs

PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_equal_the_library(spark, odd_texts):
    got = {r["doc_id"]: r for r in tokens.token_counts(make_docs(spark, odd_texts), PIECE, limit=100).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        n = len(model.encode(text or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 100)


def test_token_counts_without_a_table_and_with_nothing(spark, odd_texts):
    docs = make_docs(spark, odd_texts)
    plain = sorted(tokens.token_counts(docs, PIECE, table_size=1).collect())
    assert plain == sorted(tokens.token_counts(docs, PIECE).collect())
    assert tokens.token_counts(docs.limit(0), PIECE).collect() == []


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SIZE", 3)
    counter = tokens.PieceCounter(PIECE)
    texts = ["some words here", "other words there", "some words here"]
    assert [counter.count([t], {}) for t in texts] == [[len(counter.model.encode(t))] for t in texts]


def _ids(texts):
    tok = Tokenizer.from_file(WORD)
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4") for t in texts]


def _check_pieces(rows, ids, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert bytes(r["ids"]) == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[doc])
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    return by_doc, by_sequence


def test_packing_round_trip(spark, odd_texts):
    ids = _ids(odd_texts)
    for window, open_windows in ((64, 4), (4096, 64)):
        rows = packing.pack(make_docs(spark, odd_texts), WORD, window, open_windows).collect()
        by_doc, by_sequence = _check_pieces(rows, ids, window)
        assert set(by_doc) == set(range(len(odd_texts)))
        lengths = [sum(n for _, n in parts) for parts in by_sequence.values()]
        padding = sum(0 if n & (n - 1) == 0 else window - n for n in lengths)
        assert padding <= packing.MAX_PAD * len(lengths)


def test_packing_nothing_and_null_ids(spark):
    docs = make_docs(spark, ["a b", "a b", None], ids=[None, 5, 5])
    assert packing.pack(docs.limit(0), WORD).collect() == []
    rows = packing.pack(docs, WORD).collect()
    assert sum(r["length"] for r in rows) == 3 + 3 + 1
    assert zlib.crc32(bytes(next(r["ids"] for r in rows if r["doc_id"] is None))) is not None


def test_powers_below():
    assert packing.powers_below(10, 13) == [(10, 18), (18, 22), (22, 23)]
    assert packing.powers_below(0, 0) == []
