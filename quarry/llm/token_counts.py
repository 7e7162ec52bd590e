"""Number of tokens by greedy longest match, in time linear in the text and without building a token.

The vocabulary becomes a trie. A node whose way down has no next step falls back along its failure link, which says
what is left of the bytes read after as many tokens as possible have been taken off their front; how many those are is
stored with the link. So each byte is looked at once, and a count is a sum of stored numbers.

Words go through the automaton side by side: a step is one array operation over the current byte of all new words of
a block. Words that were counted before are a lookup.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of
from quarry.llm.memory import Memory, worker_state

NONE = -1
# Bounds of the memory of one worker, not of the input.
BLOCK_CHARS, REMEMBERED, LONGEST = 1 << 21, 300_000, 48


class Automaton:
    """``counts(words)``: tokens of each word; a word with a part that no token covers counts as one unknown token.

    ``starts`` are the tokens that may begin a word, ``goes_on`` those that may follow; by default the same.
    """

    def __init__(self, starts: Iterable[bytes], goes_on: Iterable[bytes] | None = None):
        children: list[dict[int, int]] = [{}]
        token = [False]

        def add(root: int, pieces: Iterable[bytes]) -> None:
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in children[node]:
                        children[node][byte] = len(children)
                        children.append({})
                        token.append(False)
                    node = children[node][byte]
                token[node] = node != root

        add(0, starts)
        rest = 0
        if goes_on is not None:
            rest = len(children)
            children.append({})
            token.append(False)
            add(rest, goes_on)
        self.rest = rest
        fail, popped = [NONE] * len(children), [0] * len(children)
        level = [0] if rest == 0 else [0, rest]
        while level:
            below = []
            for parent in level:
                for byte, node in children[parent].items():
                    below.append(node)
                    if token[node]:
                        fail[node], popped[node] = rest, 1
                        continue
                    at, taken = fail[parent], popped[parent]
                    while at != NONE and byte not in children[at]:
                        taken += popped[at]
                        at = fail[at]
                    if at != NONE:
                        fail[node], popped[node] = children[at][byte], taken
            level = below
        edges = sorted((node << 8 | byte, child) for node, row in enumerate(children) for byte, child in row.items())
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.child = np.array([c for _, c in edges], dtype=np.int64)
        self.fail = np.array(fail, dtype=np.int64)
        self.popped = np.array(popped, dtype=np.int64)

    def _step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        wanted = nodes << 8 | bytes_
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.child[place], NONE)

    def _fall(self, state: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Follow the failure link of ``which``; returns those that are still known."""
        at = state[which]
        count[which] += self.popped[at]
        state[which] = self.fail[at]
        return which[state[which] != NONE]

    def counts(self, words: list[bytes]) -> np.ndarray:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        state = np.zeros(len(words), dtype=np.int64)
        count = np.zeros(len(words), dtype=np.int64)
        if not len(self.keys):
            state[sizes > 0] = NONE
        for i in range(int(sizes[0]) if len(sizes) and len(self.keys) else 0):
            live = np.flatnonzero(state[: np.searchsorted(-sizes, -i)] != NONE)
            while len(live):
                after = self._step(state[live], data[begin[live] + i].astype(np.int64))
                state[live[after != NONE]] = after[after != NONE]
                live = self._fall(state, count, live[after == NONE])
        live = np.flatnonzero((state != NONE) & (state != 0) & (state != self.rest))
        while len(live):
            live = self._fall(state, count, live)
            live = live[state[live] != self.rest]
        count[state == NONE] = 1
        result = np.empty_like(count)
        result[order] = count
        return result


def byte_vocabulary(rank_file: str) -> list[bytes]:
    """Tokens of a file with a base64 token and a rank per line."""
    with open(rank_file, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class WordCounter:
    def __init__(self, automaton: Automaton, pattern: str):
        import regex

        self.automaton = automaton
        self.words = regex.compile(pattern).findall
        self.memory = Memory(REMEMBERED, LONGEST)

    def block(self, texts: list[str]) -> list[tuple[int, int]]:
        """``words, tokens`` of each text."""
        split = [self.words(text) for text in texts]
        missing = list(self.memory.missing(set().union(*split)))
        if missing:
            self.memory.learn(missing, self.automaton.counts([w.encode() for w in missing]).tolist())
        get = self.memory.young.__getitem__
        found = [(len(words), sum(map(get, words))) for words in split]
        self.memory.tidy()
        return found


def count_tokens(
    docs: DataFrame,
    automaton: Automaton,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_tokens``.

    ``pattern`` cuts a text into words, spaces included; each word is then taken apart from the left, always by the
    longest token that fits. Null and empty texts have no words and no tokens; ids may be null or repeat.
    Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((automaton, pattern))
    name = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"counter {name}", lambda: WordCounter(*shared.value))
        for batch in batches:
            done, texts, size = [], [], 0
            for value in batch.column(1):
                texts.append(value.as_py())
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    done.extend(counter.block(texts))
                    texts, size = [], 0
            done.extend(counter.block(texts))
            words, tokens = zip(*done) if done else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
    return counted.withColumnRenamed("doc_id", doc_id)
