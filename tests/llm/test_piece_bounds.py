import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.encode import PieceEncoder

PIECES = [" the", "Don't", " żółw", "\n\n  世界", "😀", "<|endoftext|>", "a <|endoftext|> b　", "x" * 300, " \t"]


def read(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as source:
        return source.read()


@pytest.mark.parametrize("known", [True, False])
def test_pieces_are_told_apart_by_their_bytes(known):
    content = read("byte_bpe_50k.json")
    encode, plain = PieceEncoder(content), Tokenizer.from_str(content)
    assert encode.id_bytes is not None
    if not known:
        # Bytes that do not add up to the pieces: the word numbers of the tokenizer decide.
        encode.id_bytes = encode.id_bytes + 1
    expected = [np.array(plain.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes() for p in PIECES]
    assert encode._encode(PIECES) == expected
    assert [encode._encode([p])[0] for p in PIECES] == expected


def test_other_tokenizers_go_by_word_numbers():
    assert PieceEncoder(read("word_bpe_49k.json")).id_bytes is None
