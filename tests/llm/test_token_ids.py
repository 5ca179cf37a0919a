"""Ids of packed texts against the whole tokenizer, added tokens spelt out in the text included."""

import random
import struct

import pytest

from tellurion.llm.packing import WordIds

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "hello", "World", " ", " ", "\n", "\t", "é", "Straße", "дом", "日本", "x1", "it's", "'LL", "3.14", "<", "|", "ñandú", "　", "\x85", "!?", "\x00"]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(path):
    from tokenizers import Tokenizer

    whole, words, rng = Tokenizer.from_file(path), WordIds(path), random.Random(1)
    for text in ["hello <|endoftext|> world", *("".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(4000))]:
        ids = b"".join(words.lines(text.encode()))
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole.encode(text, add_special_tokens=False).ids, text


def test_words_are_encoded_once(path):
    """Words that are letters are their own piece and kept once, so that twice as many fit."""
    words, made = WordIds(path), []
    make = words.plain.make
    words.plain.make = lambda x: made.append(x) or make(x)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(letters[k % 26] + letters[k // 26 % 26] + letters[k // 676 % 26] + letters[k // 17576] for k in range(390_000)).encode()
    first = words.lines(text)
    assert len(made) == 390_000 and words.lines(text + b" aaaa,")[0].startswith(first[0])
    assert made[390_000:] == ["aaaa,", ","]
