import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokens
from tessera.llm.tokens import ChunkEncoder

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
BITS = ["the", "Über", "naïve", "don't", "we'll", "'s", "12", "3.5", "...", "!?", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "é", "́", "ΣΑΣ", "日本", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "a" * 60, "😀", "\r\n", "", "_x", "İ"]


def mixed(rng: random.Random, n: int) -> list[str | None]:
    texts: list[str | None] = ["", None, " ", "   ", "a", " a", "a ", "a  b", "a   b", "x\n y", "x \ny", "x\n \ny", "\n \n", "a <|endoftext|> b", "a<|endoftext|>b"]
    return texts + ["".join(rng.choice(BITS) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize(("name", "keeps"), KINDS)
def test_equal_to_the_untouched_library(name, keeps):
    path = public_tokenizers.path(name)
    own, library = ChunkEncoder(path, keeps), Tokenizer.from_file(path)
    texts = mixed(random.Random(5), 4000)
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        for t, got in zip(some, own.encode(some), strict=True):
            assert got.tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert own.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize(("name", "keeps"), KINDS)
def test_segments_and_forgetting(name, keeps, monkeypatch):
    """Texts far longer than a segment, with a memory that is always full."""
    monkeypatch.setattr(tokens, "SEGMENT", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    path = public_tokenizers.path(name)
    own, library = ChunkEncoder(path, keeps), Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "Über,", "don't", "3.5", "é.\nA", "x" * 70, "日本"]) for _ in range(rng.randint(1, 200))) for _ in range(200)] + ["x" * 500, "a " + "y" * 500 + " b"]
    for a in range(0, len(texts), 20):
        some = texts[a : a + 20]
        for t, got in zip(some, own.encode(some), strict=True):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert len(own.known) <= 20 + 20 * 200 and all(len(w) <= tokens.LONGEST for w in own.known)
