"""Token ids of whole texts with a tokenizer file, fast enough for a large corpus.

A text is cut where the tokenizers used here never form a token across: before ASCII white space, and between a run of plain
letters and digits and a run of ASCII marks. So the ids of the pieces, put together, are the ids of the text, and a piece
that was seen before is a lookup. Where a cut is not certain (other characters, an apostrophe that may begin a
contraction), the piece goes on to the next white space; texts with white space outside ASCII, and texts that hold a string of
the tokenizer's added tokens (such as ``<|endoftext|>``), go through the tokenizer whole, so that such strings get their own ids as
in the plain ``encode(text, add_special_tokens=False)`` call.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from quarry.llm.memory import Memory, worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WHITE = " \t\n\r\x0b\x0c"
PLAIN = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
MARK = r"[!-/:-@\[-`{-~]"
INK = (
    rf"(?:{PLAIN}++(?:'{PLAIN}++)*+(?=[{WHITE}]|{MARK}|\Z)"
    rf"|(?!'{PLAIN}){MARK}++(?=[{WHITE}]|{PLAIN}|\Z)"
    rf"|[^{WHITE}]+)"
)
PIECE = re.compile(rf"[{WHITE}]*+{INK}")
# For tokenizers that make nothing of white space.
BARE_PIECE = re.compile(INK)
# White space of Unicode and control characters that only some libraries count as white space.
OTHER_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
# Bounds of the memory of one worker, not of the input: pieces remembered in each of two generations, the
# longest of them, and characters that are worked on at once.
REMEMBERED, LONGEST, BLOCK_CHARS = 400_000, 48, 1 << 21


def _bytes_of_ids(file: dict) -> np.ndarray | None:
    """Bytes of text that each id stands for, if a token is spelt by one character for each of its bytes; else None."""
    steps = file.get("pre_tokenizer") or {}
    by_bytes = [step for step in steps.get("pretokenizers", [steps]) if step.get("type") == "ByteLevel"]
    if file.get("normalizer") or file["model"].get("type") != "BPE" or not by_bytes:
        return None
    if any(step.get("add_prefix_space") for step in by_bytes):
        return None
    sizes = {i: len(token) for token, i in file["model"]["vocab"].items()}
    sizes |= {token["id"]: len(token["content"].encode()) for token in file.get("added_tokens") or []}
    lengths = np.zeros(max(sizes) + 1, dtype=np.int64)
    lengths[list(sizes)] = list(sizes.values())
    return lengths


class PieceEncoder:
    """Gives ids as the bytes of little-endian unsigned 32-bit numbers.

    Control strings of the tokenizer in a text get their own ids, as the plain call gives them; with ``special_as_text`` they
    are ordinary text.
    """

    def __init__(self, file_content: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file_content)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [token["content"] for token in json.loads(file_content).get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added and not special_as_text else None
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory(REMEMBERED, LONGEST)
        # Fewer pieces are different where white space or the case of A-Z makes no difference.
        steps = json.loads(file_content)["normalizer"] or {}
        steps = steps.get("normalizers", [steps])
        self.lower = any(step.get("type") == "Lowercase" for step in steps)
        self.id_bytes = _bytes_of_ids(json.loads(file_content))
        self.white_counts = bool(self._encode([WHITE])[0])

    def _encode(self, pieces: list[str]) -> list[bytes]:
        if self.id_bytes is not None:
            # This call does without offsets and word numbers; the ids of a piece end where its bytes do.
            found = self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            ends = np.cumsum([len(piece.encode()) for piece in pieces])
            reached = np.cumsum(self.id_bytes[ids])
            after = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and (reached[after] == ends).all():
                data, places = ids.tobytes(), [0, *(4 * (after + 1)).tolist()]
                return [data[a:b] for a, b in zip(places, places[1:])]
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        owners = np.array(found.word_ids, dtype=np.int64)
        ends = (4 * np.searchsorted(owners, np.arange(len(pieces) + 1))).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _pieces(self, text: str) -> list[str]:
        if OTHER_WHITE.search(text) or (self.added is not None and self.added.search(text)):
            return [text]
        if self.lower:
            text = text.encode().lower().decode()
        if not self.white_counts:
            return BARE_PIECE.findall(text)
        pieces = PIECE.findall(text)
        tail = text[len(text.rstrip(WHITE)) :]
        if tail:
            pieces.append(tail)
        return pieces

    def block(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(text) for text in texts]
        missing = list(self.memory.missing(set().union(*cut)))
        if missing:
            self.memory.learn(missing, self._encode(missing))
        get = self.memory.young.__getitem__
        found = [b"".join(map(get, pieces)) for pieces in cut]
        self.memory.tidy()
        return found

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, worked out in blocks."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self.block(held)
                held, size = [], 0
        yield from self.block(held)


def encoder(file_content: str, special_as_text: bool = False) -> PieceEncoder:
    """The encoder of this worker for a tokenizer file; it is kept from task to task."""
    name = f"encoder {hash(file_content)} {special_as_text}"
    return worker_state(name, lambda: PieceEncoder(file_content, special_as_text))
