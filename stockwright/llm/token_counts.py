"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of word-initial pieces and, under a root of its own,
continuation pieces. Each node has a failure link and the number of tokens that
following it pops (Song et al., 2021): on a byte that does not go on, the
automaton adds the popped tokens and moves along the link, so the number of
greedy longest-match pieces of a word is known in one pass over its bytes, with
no piece built. All new words of a batch take a step at once with numpy; counts
of words seen before are looked up. The table of known words is emptied when it
holds ``KNOWN`` of them.

A word that no sequence of pieces covers is one unknown token. Words are runs
of anything but ASCII white space. Null text is empty: no words, no tokens.
Other columns are ignored, repeated rows give repeated rows.

The vocabulary is a byte-level tokenizers JSON file whose path is a parameter:
entries that begin with the mark of a space are word-initial pieces, the others
continue a word.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import batches, byte_alphabet
from .inthash import IntMap

KNOWN = 1_000_000
#: Longer words are counted but not remembered.
REMEMBER = 64
NONE = -1

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(word-initial pieces, continuation pieces) of a byte-level vocabulary."""
    alphabet = byte_alphabet()
    space = next(c for c, b in alphabet.items() if b == 0x20)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    initial, rest = [], []
    for word in sorted(set(model["model"]["vocab"]) - special):
        raw = bytes(alphabet[c] for c in word.removeprefix(space))
        if raw:
            (initial if word.startswith(space) else rest).append(raw)
    return initial, rest


class Automaton:
    def __init__(self, initial: Iterable[bytes], rest: Iterable[bytes], known: int = KNOWN):
        children: list[dict[int, int]] = [{}, {}]  # node 0: a word's start, node 1: after a piece
        token = [False, False]
        for root, words in ((0, initial), (1, rest)):
            for word in words:
                node = root
                for byte in word:
                    if byte not in children[node]:
                        children[node][byte] = len(children)
                        children.append({})
                        token.append(False)
                    node = children[node][byte]
                token[node] = True
        link, pops = [NONE] * len(children), [0] * len(children)
        queue = [0, 1]
        for node in queue:  # breadth first
            for byte, child in children[node].items():
                queue.append(child)
                if token[child]:
                    link[child], pops[child] = 1, 1
                    continue
                at, popped = link[node], pops[node]
                while at != NONE and byte not in children[at]:
                    popped += pops[at]
                    at = link[at]
                if at != NONE:
                    link[child], pops[child] = children[at][byte], popped
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        keys = [(n << 8 | b, c) for n, cs in enumerate(children) for b, c in cs.items()]
        self.child = IntMap(np.array([k for k, _ in keys], np.int64), np.array([c for _, c in keys], np.int64), NONE)
        self.known: dict[bytes, int] = {}
        self.most = known

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word; 1 where no pieces cover it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text, stop = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(size)
        which, at = np.arange(len(words)), stop - size
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        out = np.ones(len(words), np.int64)
        while len(which):
            inside = at < stop
            child = np.full(len(which), NONE)
            child[inside] = self.child.get(node[inside] << 8 | text[at[inside]])
            on = child != NONE
            # where the byte does not go on, or the word is over, tokens are popped
            count = np.where(on, count, count + self.pops[node])
            node = np.where(on, child, self.link[node])
            at += on
            over = ~inside & (node == 1)  # all of the word is in pieces
            out[which[over]] = count[over]
            go = ~over & (node != NONE)
            which, at, stop, node, count = which[go], at[go], stop[go], node[go], count[go]
        return out

    def count(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        split = [t.split() for t in texts]
        new = list({w for ws in split for w in ws if w not in known})
        made = dict(zip(new, self.lengths(new).tolist(), strict=True)) if new else {}
        known.update((w, n) for w, n in made.items() if len(w) <= REMEMBER)
        return [(len(ws), sum([known[w] if w in known else made[w] for w in ws])) for ws in split]


def count_column(text: Column, path: str) -> Column:
    """Struct (n_words, n_tokens) of a text column."""
    initial, rest = pieces(path)

    @F.arrow_udf(RESULT)
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(initial, rest)
        for texts in parts:
            found = [x for some in batches(texts) for x in automaton.count([t.encode() for t in some])]
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["n_words", "n_tokens"])

    return count(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens."""
    return docs.select(F.col(id_col).alias("doc_id"), count_column(F.col(text_col), path).alias("c")).select("doc_id", "c.n_words", "c.n_tokens")
