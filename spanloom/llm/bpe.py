"""Byte-level BPE by speculation: greedy longest match, a check of adjacent pairs, and exact merging only where the check fails.

A sequence of tokens is the BPE encoding of its bytes exactly when every token encodes to itself and each adjacent pair of
tokens is what the merges make of the pair's own bytes. So greedy longest-match tokens are proposed for each new word, all their
adjacent pairs are looked up at once in a sorted table of pairs judged before (unknown pairs are judged by merging their few
bytes), and only the words with a bad pair are merged from single bytes. Words seen before come from a bounded memory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import give_back, lean, modest_batches, pieces, remembers, table

VOCABULARY = "byte_bpe_50k.json"
#: Words remembered by a worker, about 50 MB; beyond that the memory starts anew. Pairs are bounded likewise. Longer words are not remembered.
MOST_WORDS, MOST_PAIRS, LONG_WORD = 300_000, 2_000_000, 64
_NEVER = np.int32(2**31 - 1)
#: The split of the byte-level format into words (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> str:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return "".join(letters[b] for b in range(256))


class Bpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {c: b for b, c in enumerate(_byte_letters())}
        to_bytes = lambda token: bytes(byte[c] for c in token)
        self.ids = {to_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate((to_bytes(a), to_bytes(b)) for a, b in pairs)}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.size = max(chain(self.ids.values(), self.special.values())) + 1
        self.bytes_of = [b""] * self.size
        for token, i in chain(self.ids.items(), ((t.encode(), i) for t, i in self.special.items())):
            self.bytes_of[i] = token
        self.text_of = [str(i) for i in range(self.size)]
        self.longest = max(map(len, self.ids))
        keys = np.array([a * self.size + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], np.fromiter((r for r, _ in self.ranks.values()), np.int32, len(keys))[order]
        self.merged = np.fromiter((i for _, i in self.ranks.values()), np.int32, len(keys))
        # greedy match may only propose tokens that encode to themselves
        self.proposable = {token: self.ids[token] for token, own in zip(self.ids, self.merge_all(list(self.ids))) if own == [self.ids[token]]}
        self.split = regex.compile(PATTERN)
        self.on_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, bytes] = {}  # the ids of each word, 32 bits each
        self._forget_pairs()

    def _forget_pairs(self) -> None:
        self.pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The exact encoding of each word: its pair of lowest rank, leftmost first, is merged again and again.

        Words of about one length go together: a row of tokens each, with the rank of the pair that begins at every token.
        """
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(-1 if len(w) > LONG_WORD else -(-len(w) // 8), []).append(i)
        for i in groups.pop(-1, ()):
            out[i] = self._merge_long(words[i])
        for width, members in groups.items():
            width *= 8
            tokens = np.full((len(members), width + 1), -1, np.int32)
            flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in members), np.uint8).reshape(-1, width)
            filled = np.arange(width) < np.fromiter((len(words[i]) for i in members), np.int64, len(members))[:, None]
            tokens[:, :-1] = np.where(filled, self.byte_ids[flat], -1)
            ranks = self._ranks(tokens[:, :-1], tokens[:, 1:])
            rows, columns = np.arange(len(members)), np.arange(width)
            while len(rows):
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                if (best == _NEVER).any():
                    for r in np.flatnonzero(best == _NEVER).tolist():
                        out[members[rows[r]]] = [t for t in tokens[r].tolist() if t >= 0]
                    keep = best != _NEVER
                    rows, tokens, ranks, at, best = rows[keep], tokens[keep], ranks[keep], at[keep], best[keep]
                    if not len(rows):
                        break
                n = np.arange(len(rows))
                moved = columns + (columns > at[:, None])  # drop the pair's second token
                tokens = np.c_[np.take_along_axis(tokens, moved, 1), np.full(len(rows), -1, np.int32)]
                ranks = np.take_along_axis(np.c_[ranks, np.full(len(rows), _NEVER, np.int32)], moved, 1)
                tokens[n, at] = self.merged[best]
                ranks[n, at] = self._ranks(tokens[n, at], tokens[n, at + 1])
                left = at > 0
                ranks[n[left], at[left] - 1] = self._ranks(tokens[n[left], at[left] - 1], tokens[n[left], at[left]])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each a and b; _NEVER if there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where((self.merge_keys[at] == key) & (a >= 0) & (b >= 0), self.merge_ranks[at], _NEVER).astype(np.int32)

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one word of any length, with a heap and a linked list."""
        from heapq import heapify, heappop, heappush

        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        ranks, alive = self.ranks, [True] * len(parts)
        heap = [(ranks[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i] = ranks[a, b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (parts[k], parts[after[k]])) in ranks:
                    heappush(heap, (ranks[p][0], k, *p))
        return [p for p, x in zip(parts, alive) if x]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, known, n = [], 0, self.proposable, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (i := known.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair a * size + b: do the merges leave the bytes of a and b as these two tokens?"""
        at = np.searchsorted(self.pairs, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == pairs[inside]
        if not known.all():
            new = np.unique(pairs[~known])
            both = list(zip((new // self.size).tolist(), (new % self.size).tolist()))
            good = np.array([x == [a, b] for x, (a, b) in zip(self.merge_all([self.bytes_of[a] + self.bytes_of[b] for a, b in both]), both)], bool)
            if len(self.pairs) and len(self.pairs) + len(new) > MOST_PAIRS:
                self._forget_pairs()
                return self._compatible(pairs)
            order = np.argsort(every := np.r_[self.pairs, new], kind="stable")
            self.pairs, self.good = every[order], np.r_[self.good, good][order]
            at = np.searchsorted(self.pairs, pairs)
        return self.good[at]

    def learn(self, new: list[str]) -> None:
        """Encodes words not in memory, all at once."""
        raw = [w.encode() for w in new]
        proposed = [self.propose(w) for w in raw]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(counts.sum()))
        bad = np.zeros(len(new), bool)
        if len(flat) > 1:
            ends = np.cumsum(counts)
            inner = np.ones(len(flat) - 1, bool)
            inner[ends[:-1] - 1] = False
            word_of = np.repeat(np.arange(len(new)), counts)[:-1][inner]
            bad[word_of[~self._compatible((flat[:-1] * self.size + flat[1:])[inner])]] = True
        failing = np.flatnonzero(bad).tolist()
        for i, exact in zip(failing, self.merge_all([raw[i] for i in failing])):
            proposed[i] = exact
        self.memory.update(zip(new, (np.array(p, np.int32).tobytes() for p in proposed)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. A special token's string is that token; truncation, padding and added tokens are not used."""
        return [x.tolist() for x in self.encoded(texts)]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """The same, packed."""
        split = [self._words(t) for t in texts]
        if len(self.memory) > MOST_WORDS:
            self.memory.clear()
        new = set(chain.from_iterable(split)).difference(self.memory, self.special)
        self.memory.update((s, np.int32(i).tobytes()) for s, i in self.special.items())  # no other word is such a string
        if new:
            self.learn(list(new))
        out = [np.frombuffer(b"".join(map(self.memory.__getitem__, ws)), np.int32) for ws in split]
        for w in new:
            if len(w) > LONG_WORD:
                del self.memory[w]
        return out

    def _words(self, text: str) -> list[str]:
        if self.on_special and any(s in text for s in self.special):
            return [w for part in self.on_special.split(text) for w in ([part] if part in self.special else self.split.findall(part))]
        return self.split.findall(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder for each Python worker and file."""
    return Bpe(path)


def _located(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids; a row for each row.

    Null text counts as empty: no ids, and both digests of the empty string. `path`: a vocabulary file that every worker can
    open (default: the installed package of public tokenizers). Texts are encoded whole; extra columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(_located(path))
        remembers("bpe", bpe.forget)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in pieces(batches):
            ids = bpe.encoded(batch.column("text").fill_null("").to_pylist())
            digests = [(sha(",".join(map(bpe.text_of.__getitem__, own := x.tolist()))), sha(bpe.decode(own))) for x in ids]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids_sha256": pa.array([d[0] for d in digests], pa.string()),
                "decoded_sha256": pa.array([d[1] for d in digests], pa.string()),
            } | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if keep_ids else {})
            yield pa.RecordBatch.from_pydict(columns)
            del ids, digests, columns
            give_back()

    modest_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(lean(work, "bpe"), schema)


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
