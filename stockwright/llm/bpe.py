"""Byte-level BPE: speculate, verify, and merge only where that fails.

A text is cut into pre-tokens by the vocabulary's pattern. For each new
pre-token a greedy longest match proposes tokens. A sequence of tokens is what
merging would give exactly when every adjacent pair is compatible, that is when
merging the bytes of the two gives these two again. All distinct adjacent pairs
of a batch are tested at once with numpy; only pre-tokens with a pair that fails
are merged exactly, lowest rank first.

The compatibility of (a, b) is found backwards in time: from the last symbols
on both sides of the border, the one that was formed later is undone, and a merge
across the border, had its rank come before the merges that consumed the two
symbols, shows that the pair is not what merging gives.

A batch of rows is handled at a time; the table of known pre-tokens is emptied
when it holds ``KNOWN`` entries, so memory is bounded whatever the input.

The vocabulary is a tokenizers JSON file whose path is a parameter. Strings of
its added special tokens in a text are those tokens, as in that library.

Null text is empty: no tokens, and the digests of nothing. Other columns are
ignored, repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inthash import IntMap

#: The pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = 300_000
#: Longer strings are encoded but not remembered.
REMEMBER = 64
#: Bytes of text that are handled at once.
BATCH = 4 << 20
NEVER = np.int64(1 << 40)

RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_alphabet() -> dict[str, int]:
    """Printable characters that stand for bytes in the vocabulary file: the
    visible Latin-1 characters for themselves, others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What encoding needs of a tokenizers JSON file. Files whose rules differ
    from those built here are refused, as their ids would be wrong."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    cut, model = file.get("pre_tokenizer") or {}, file["model"]
    other = [
        name
        for name, wrong in (
            ("normalizer", file.get("normalizer")),
            ("pre_tokenizer", cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)),
            ("model", model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
            ("added_tokens", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file["added_tokens"])),
        )
        if wrong
    ]
    if other:
        raise ValueError(f"{path}: no byte-level BPE of the plain kind ({', '.join(other)})")
    return {"added_tokens": file["added_tokens"], "model": {k: model[k] for k in ("vocab", "merges")}}


class Bpe:
    def __init__(self, model: dict, known: int = KNOWN):
        import regex

        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                self.bytes_of[i] = bytes(alphabet[c] for c in word)
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        # the merge that forms each token, for the walk back in time
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for (a, b), (rank, new) in reversed(self.merges.items()):
            self.rank[new], self.left[new], self.right[new] = rank, a, b
        keys = np.array([a << 32 | b for a, b in self.merges], dtype=np.int64)
        self.ranks = IntMap(keys, np.array([r for r, _ in self.merges.values()], dtype=np.int64), NEVER)
        self.made_by = np.array([new for _, new in self.merges.values()], dtype=np.int64)  # by rank
        made = self.rank >= 0
        whole = np.zeros(size, bool)
        whole[self.byte_id] = True
        ids = np.flatnonzero(made)
        sound = self._compatible(self.left[ids], self.right[ids], self.rank[ids])
        for i in ids[np.argsort(self.rank[ids])][sound[np.argsort(self.rank[ids])]].tolist():
            whole[i] = whole[self.left[i]] and whole[self.right[i]]
        #: tokens that merging their own bytes gives back; only these are proposed
        self.proposed = {self.bytes_of[i]: i for i in np.flatnonzero(whole).tolist()}
        self._plant()
        self.cut = regex.compile(PATTERN).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.marks = {w[0] for w in self.special}
        #: known strings: after a space, which is not part of the key, and others
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.most = known
        self.failed = self.tried = 0

    # ---------------------------------------------------------------- verify

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Which pairs stay two tokens under merging (before rank ``until``)."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        end_x = np.full(len(x), NEVER) if until is None else until.copy()
        end_y = end_x.copy()
        out, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at):
            cross = self.ranks.get(x << 32 | y)
            # of equal ranks the left place is merged first
            broken = (cross < end_x) & (cross <= end_y) & (cross < NEVER)
            if until is not None:
                broken &= ~((cross == end_y) & (x == a[at]) & (y == b[at]))
            out[at[broken]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            undo_x = rank_x > rank_y
            go = ~broken & (np.maximum(rank_x, rank_y) >= 0)
            end_x, end_y = np.where(undo_x, rank_x, end_x)[go], np.where(undo_x, end_y, rank_y)[go]
            x, y, at = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go], at[go]
        return out

    # --------------------------------------------------------------- propose

    def _plant(self) -> None:
        """The trie of proposed tokens: (node, byte) -> child, node -> token."""
        nodes: dict[bytes, int] = {b"": 0}
        keys = []
        for word in self.proposed:
            for n in range(1, len(word) + 1):
                if word[:n] not in nodes:
                    nodes[word[:n]] = len(nodes)
                    keys.append(nodes[word[: n - 1]] << 8 | word[n - 1])
        self.children = IntMap(np.array(keys, dtype=np.int64), np.arange(1, len(nodes), dtype=np.int64), -1)
        self.token_at = np.full(len(nodes), -1, np.int64)
        self.token_at[[nodes[w] for w in self.proposed]] = list(self.proposed.values())

    def _propose(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest vocabulary entry at each place of every word, all words in
        step: (word of each token, token), in order."""
        owners, tokens, steps = [], [], []
        word, at, node = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int64)
        best, best_end, stop, step = np.full(len(starts), -1, np.int64), starts.copy(), ends.copy(), 0
        while len(word):
            child = np.full(len(word), -1, np.int64)
            inside = at < stop
            child[inside] = self.children.get(node[inside] << 8 | text[at[inside]])
            on = child >= 0
            at[on] += 1
            node = np.where(on, child, 0)
            token = self.token_at[node]
            hit = on & (token >= 0)
            best[hit], best_end[hit] = token[hit], at[hit]
            done = ~on
            owners.append(word[done])
            tokens.append(best[done])
            steps.append(np.full(int(done.sum()), step))
            at[done] = best_end[done]
            over = done & (at >= stop)
            if over.any():
                word, at, node, best, best_end, stop = (x[~over] for x in (word, at, node, best, best_end, stop))
            step += 1
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.lexsort((np.concatenate(steps), owner))
        return owner[order], token[order]

    def _merge_all(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words in step: each round merges in
        every word the leftmost pair of lowest rank."""
        lengths = ends - starts
        owner = np.repeat(np.arange(len(starts)), lengths)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.asarray(self.byte_id)[text[np.repeat(starts, lengths) + within]]
        out_owner, out_ids = [], []
        while len(ids):
            rank = np.full(len(ids), NEVER)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same] = self.ranks.get(ids[same] << 32 | ids[same + 1])
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            done = least == NEVER
            out_owner.append(owner[done])
            out_ids.append(ids[done])
            at = np.flatnonzero((rank == least) & ~done)
            at = at[np.concatenate(([True], owner[at][1:] != owner[at][:-1]))] if len(at) else at
            ids[at] = self.made_by[rank[at]]
            keep = ~done
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        owner, ids = np.concatenate(out_owner), np.concatenate(out_ids)
        order = np.argsort(owner, kind="stable")
        return owner[order], ids[order]

    def _merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, leftmost first among equals."""
        ids: list[int] = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if found := merges.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (found := merges.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (found[0], before[i], ids[before[i]], ids[i]))
        return [i for i in ids if i >= 0]

    def _encode_new(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        text, ends = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.cumsum(lengths)
        starts = ends - lengths
        owner, tokens = self._propose(text, starts, ends)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tokens[inside] << 32 | tokens[inside + 1], return_inverse=True)
        bad = ~self._compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.unique(owner[inside[bad]])
        self.tried += len(words)
        self.failed += len(failing)
        if len(failing):
            good = ~np.isin(owner, failing)
            parts = [(owner[good], tokens[good])]
            short = failing[lengths[failing] <= REMEMBER]
            if len(short):
                which, ids = self._merge_all(text, starts[short], ends[short])
                parts.append((short[which], ids))
            for i in failing[lengths[failing] > REMEMBER].tolist():
                ids = np.array(self._merge(raw[i]), dtype=np.int64)
                parts.append((np.full(len(ids), i), ids))
            owner, tokens = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])
            order = np.argsort(owner, kind="stable")
            owner, tokens = owner[order], tokens[order]
        blob = tokens.astype("<u4").tobytes()
        cuts = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return {w: blob[s:e] for w, s, e in zip(words, [0, *cuts[:-1]], cuts, strict=True)}

    # ---------------------------------------------------------------- public

    def _pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; those of the common shapes without a search."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            return [piece]
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.cut(piece)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known yet; short ones become known."""
        spaced, plain = self.spaced, self.plain

        def find(w: str) -> bytes | None:
            return spaced.get(w[1:]) if w[0] == " " else plain.get(w)

        cut = {p: self._pre_tokens(p) for p in pieces}
        made = {w for ws in cut.values() for w in ws if find(w) is None}
        ids = self._encode_new(list(made)) if made else {}
        out = {}
        for p, ws in cut.items():
            out[p] = ids[p] if p in ids else b"".join([ids[w] if w in ids else find(w) for w in ws])
        for w, x in (*ids.items(), *out.items()):
            if len(w) <= REMEMBER:
                if w[0] != " ":
                    plain[w] = x
                elif len(w) > 1 and not w[1].isspace():
                    spaced[w[1:]] = x
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts as little-endian unsigned 32-bit integers.

        A text is cut at its spaces: no pre-token reaches over one that has
        another character right behind it. Texts with runs of white space
        around spaces are cut by the pattern as a whole.
        """
        if len(self.spaced) + len(self.plain) > self.most:
            self.spaced.clear()
            self.plain.clear()
        spaced, plain = self.spaced, self.plain
        new: set[str] = set()
        parts: list[list] = []
        for text in texts:
            part: list = []
            parts.append(part)
            for i, some in enumerate(self.at_special(text) if any(c in text for c in self.marks) else [text]):
                if i % 2:
                    part.append(self.special[some].to_bytes(4, "little"))
                elif some:
                    first, *rest = some.split(" ")
                    unknown = {x for x in rest if x not in spaced}
                    if any(not x or x[0].isspace() for x in unknown) or rest and first[-1:].isspace():
                        whole = self.cut(some)
                        part.append(whole)
                        new.update(whole)
                        continue
                    new.update([" " + x for x in unknown])
                    if first:
                        if first not in plain:
                            new.add(first)
                        part.append(first)
                    part.append(tuple(rest))
        made = self._learn(new) if new else {}

        def ids(x) -> bytes:
            if isinstance(x, bytes):
                return x
            if isinstance(x, str):
                return made[x] if x in made else plain[x]
            if isinstance(x, list):
                return b"".join([made[w] for w in x])
            try:
                return b"".join(map(spaced.__getitem__, x))
            except KeyError:  # a piece too long to be remembered
                return b"".join([spaced[w] if w in spaced else made[" " + w] for w in x])

        return [b"".join(map(ids, part)) for part in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


def batches(texts: pa.Array, most: int = BATCH) -> Iterator[list[str]]:
    """The texts of an Arrow array, some bytes at a time."""
    held, n = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_column(text: Column, path: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text column."""
    model = load(path)

    @F.arrow_udf(RESULT)
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = Bpe(model)  # for the task alone: a worker that kept it would crowd the executor's other work
        for texts in parts:
            n, ids_sha, text_sha = [], [], []
            for some in batches(texts):
                for ids in bpe.encode_batch(some):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(F.coalesce(text, F.lit("")))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = docs.select(F.col(id_col).alias("doc_id"), encode_column(F.col(text_col), path).alias("e"))
    return out.select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")
