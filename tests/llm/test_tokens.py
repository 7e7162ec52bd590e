import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.encode import PieceEncoder
from quarry.llm.packing import cut, encode_stream, packed_pieces, packed_sequences
from quarry.llm.token_counts import Automaton, byte_vocabulary, count_tokens
from quarry.llm.token_files import TokenFileReader, find_documents, read_token_files, write_token_files
from quarry.session import fresh_path, ship_package

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [
    (7, "Some words, and don't; “quotes”…\n\n  spaces  é́ 123"),
    (3, None),
    (5, ""),
    (-2, "x " * 3000),
    (None, "no id"),
    (7, "another row of the same id"),
    (9, "<|endoftext|> </w> \x1c tail  "),
]


def greedy(word, starts, goes_on):
    count = place = 0
    while place < len(word):
        allowed = goes_on if place else starts
        ends = [e for e in range(len(word), place, -1) if word[place:e] in allowed]
        if not ends:
            return 1
        count, place = count + 1, ends[0]
    return count


@settings(max_examples=150, deadline=None)
@given(
    st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=8),
    st.none() | st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=8),
    st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=12),
)
def test_automaton_is_greedy(starts, goes_on, words):
    follow = starts if goes_on is None else goes_on
    assert Automaton(starts, goes_on).counts(words).tolist() == [greedy(w, starts, follow) for w in words]


def test_count_tokens(spark):
    import regex

    ship_package(spark)
    vocabulary = byte_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(i, t, 0, "h") for i, t in TEXTS], "doc_id long, text string, n_tokens int, h string")
    got = count_tokens(docs, Automaton(vocabulary), public_tokenizers.PATTERN).collect()
    known, words = set(vocabulary), regex.compile(public_tokenizers.PATTERN).findall
    expected = [(i, len(words(t or "")), sum(greedy(w.encode(), known, known) for w in words(t or ""))) for i, t in TEXTS]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert count_tokens(docs.limit(0), Automaton(vocabulary), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_whole_text(name):
    with open(public_tokenizers.path(name)) as source:
        encode = PieceEncoder(source.read())
    alphabet = list(" \n\t'’.,-_(\"aZé́²5…—ßđſK\xa0\u200d😀世sre!\x1cİΣς\u3000") + ["'s", "don't", "<|endoftext|>", "\r\n"]
    chance = random.Random(1)
    texts = ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 9))) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y z", "Don't <|endoftext|>\u3000ok"]
    for text, got in zip(texts, encode.ids(texts), strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert got == np.array(ids, dtype="<u4").tobytes(), text


def expected_ids(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in ordered]


@pytest.mark.parametrize("name", FILES)
def test_round_trip_and_packing(spark, name):
    ship_package(spark)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in TEXTS], "doc_id long, text string, start int, part int")
    expected = expected_ids(name, 1)
    stream = [x for _, ids in expected for x in ids]
    manifest = encode_stream(docs, public_tokenizers.path(name), 1)
    rows, start = [], 0
    for i, ids in expected:
        rows.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in read_token_files(manifest).orderBy("start").collect()] == rows
    found = {tuple(r.ids) for r in find_documents(manifest, [9, -2]).collect()}
    assert found == {tuple(ids) for i, ids in expected if i in (9, -2)}
    pieces = packed_pieces(manifest, 64).orderBy("sequence_id", "offset").collect()
    assert [p.sequence_id * 64 + p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
    assert sum(p.length for p in pieces) == len(stream) and max(p.offset + p.length for p in pieces) == 64
    at = 0
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(stream[at : at + p.length], dtype="<u4").tobytes())
        at += p.length
    sequences = packed_sequences(manifest, 64, pad_id=5).orderBy("sequence_id").collect()
    assert [x for s in sequences for x in s.ids[: s.n_tokens]] == stream
    assert {len(s.ids) for s in sequences} == {64}


def test_no_documents(spark):
    ship_package(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    manifest = write_token_files(none, fresh_path(spark, "none"), public_tokenizers.path(FILES[0]), 1)
    assert read_token_files(manifest).count() == packed_pieces(manifest).count() == packed_sequences(manifest).count() == 0


def test_reader_reads_only_what_is_asked_and_notices_damage(tmp_path):
    from quarry.llm.token_files import TokenFileWriter

    path = tmp_path / "x"
    documents = [(k, np.arange(k % 7 * 40_000, dtype=np.uint32) % 60_000) for k in range(30)]
    with open(path, "wb") as out:
        writer = TokenFileWriter(out, 2)
        for k, ids in documents:
            writer.add(k, ids)
        writer.close()
    import pyarrow as pa

    reader = TokenFileReader(pa.OSFile(str(path)))
    frames = []
    whole = reader._content
    reader._content = lambda frame: frames.append(frame) or whole(frame)
    ((got, ids),) = reader.find([20])
    assert got == 20 and (ids == documents[20][1]).all() and len(frames) == 1 < len(reader.first) - 1
    data = bytearray(path.read_bytes())
    data[int(reader.places[1]) + 30] ^= 255
    path.write_bytes(data)
    with pytest.raises(Exception):
        list(TokenFileReader(pa.OSFile(str(path))))


def test_cut():
    assert cut(0, 5, 4) == [(0, 4), (4, 1)]
    assert cut(3, 1, 4) == [(0, 1)]
    assert cut(6, 8, 4) == [(0, 2), (2, 4), (6, 2)]
