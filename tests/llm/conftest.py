import random

import pytest

from llm_corpora import WORDS, near_copies


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and special texts."""
    rng = random.Random(11)
    return [None, "", " \n\t", "a", "one two", "x" * 5000, "x" * 5000, "ab " * 4000, "<s> </s> <|endoftext|> <unk>",
            "▁ a▁b  c \n\n d\r\n", "  lead", "trail  ", "𝒳 ﬁ \x00 é", "same text again", "same text again",
            " ".join(rng.choice(WORDS) for _ in range(6000)), *near_copies(5, 8)]
