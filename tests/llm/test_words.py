"""Words are merged on bytes as the tokenizer merges them."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from evidentia.llm import packing


def test_merges_equal_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, tok, rng = packing.WordIds(path), Tokenizer.from_file(path), random.Random(2)
    assert words.merges is not None
    assert packing._PLAIN.fullmatch("Über***") and not packing._PLAIN.fullmatch("it's")
    for letters in ("ab", "aeiw", "abcdefghijklmnopqrstuvwxyz", "éàüñßæaÉ", "mhWaz", ".!?,;:#*$%&|<>'", "a'st#*.", "ab1²ªµ́́"):
        for _ in range(400):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice((4, 12, 60, 300)))))
            assert words[word] == b"".join(k.to_bytes(4, "little") for k in tok.encode(word, add_special_tokens=False).ids), word
