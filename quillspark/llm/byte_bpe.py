"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of many pre-tokens lie in one array as a doubly linked list, with a
wall after each pre-token.  A pair of neighbours whose joined bytes have a rank
lies in the bucket of that rank, as the position where it starts; a two-level
bitmap over the ranks (256 bits to a word) tells the lowest rank that has
entries by find-first-set.  That bucket is taken out, entries that a merge made
stale are skipped (the rank of the pair that starts at a position now is noted
beside it), and the live ones are merged together as arrays: of pairs that
overlap the leftmost goes first.  Their new neighbour pairs go to their buckets.

Merging a bucket as a whole gives what merging one pair at a time gives, as
long as a merge can't make a pair of a lower rank.  Where it can, by the table
of pairs, only the leftmost entry of each pre-token is merged and the others go
back to the bucket.  A pre-token of n bytes costs O(n log n), and every one that
is not a token itself goes through the queue, long or short.

Pre-tokens repeat, so each worker keeps ids in tables of bounded size (see
``run_table``; ``CACHE`` runs in a generation).

Defined cases: null and empty texts have no ids; lone surrogates are replaced
by U+FFFD as text columns cannot hold them; rows with null or repeated ids are
encoded like others; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .run_table import RunTables, spread

#: Runs in a generation of a worker's tables; bits of a bitmap word as a power of two; characters whose ids are gathered at once; bytes of texts in a batch.
CACHE, WORD, PIECE, BATCH = 100_000, 8, 1 << 19, 2 << 20
#: The pattern for which ``Codec`` may cut texts at single blanks and line feeds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Ranks, the table of pairs, and the merging of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.wall = max(ranks.values(), default=0) + 1  # no token; also one more than the greatest rank
        self.base = self.wall + 1
        self.byte = np.array([ranks.get(bytes([k]), -2) for k in range(256)], dtype=np.int64)
        get = ranks.get
        found = [(a * self.base + b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None]
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        self.keys, self.values = np.ascontiguousarray(np.append(pairs[:, 0], np.iinfo(np.int64).max)), np.append(pairs[:, 1], -1)
        left, right, rank = pairs[:, 0] // self.base, pairs[:, 0] % self.base, pairs[:, 1]
        #: tokens that may be half of a token of a lower rank
        self.early = set(left[rank < left].tolist()) | set(right[rank < right].tolist())
        self.first = self.rank_of(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.bit = [1 << k for k in range(1 << WORD)]
        self.queued = 0  # pre-tokens that went through the queue

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined tokens, -1 where they make none."""
        key = left * self.base + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each pre-token has, all ids on end); as with the public library, one that is a token stays whole."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)
        todo = np.flatnonzero((whole < 0) & (np.array([len(p) for p in pieces], dtype=np.int64) > 0))
        counts = (whole >= 0).astype(np.int32)
        merged, own = self._merge([pieces[k] for k in todo.tolist()])
        counts[todo] = own
        begin = np.cumsum(counts, dtype=np.int64) - counts
        ids = np.zeros(int(counts.sum()), dtype=np.int32)
        ids[begin[whole >= 0]] = whole[whole >= 0]
        ids[spread(begin[todo], own)] = merged
        return counts, ids

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.queued += len(pieces)
        data = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", dtype=np.uint8)
        n = len(data)
        walls = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        token = self.byte[data]
        if (token[np.delete(np.arange(n), walls)] < 0).any():
            raise KeyError("a byte has no rank")
        token[walls] = self.wall
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1, dtype=np.int64)  # rank of the pair that starts here now
        pair[:-1] = self.first[data[:-1].astype(np.int64) * 256 + data[1:]]
        pair[walls] = -1
        pair[walls[1:] - 1] = -1
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        have, cuts = np.unique(pair[order], return_index=True)
        places = order.tolist()
        buckets = {rank: places[a:z] for rank, a, z in zip(have.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(places)], strict=True)}
        low, top, bit, mask = [0] * ((self.wall >> WORD) + 1), 0, self.bit, (1 << WORD) - 1
        for rank in buckets:
            low[rank >> WORD] |= bit[rank & mask]
        for word, bits in enumerate(low):
            if bits:
                top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            place = (low[word] & -low[word]).bit_length() - 1
            rank = (word << WORD) + place
            at = np.array(buckets.pop(rank), dtype=np.int64)
            low[word] ^= bit[place]
            if not low[word]:
                top ^= 1 << word
            at = at[pair[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                if rank in self.early:
                    _, leftmost = np.unique(walls.searchsorted(at), return_index=True)
                    back = np.delete(at, leftmost)
                    at = at[leftmost]
                    if len(back):
                        buckets[rank] = back.tolist()
                        low[word] |= bit[place]
                        top |= 1 << word
                else:
                    overlaps = after[at[:-1]] == at[1:]
                    if overlaps.any():
                        runs = np.flatnonzero(np.append(True, ~overlaps))
                        nth = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
                        at = at[nth % 2 == 0]
            elif not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            token[at] = rank
            token[gone] = -1
            pair[gone] = -1
            after[at] = behind
            before[behind] = at
            ahead = before[at]
            new_at = np.concatenate([at, ahead])
            new = self.rank_of(token[new_at], token[after[new_at]])
            pair[new_at] = new
            for r, p in zip(new.tolist(), new_at.tolist(), strict=True):
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(p)
                    else:
                        buckets[r] = [p]
                        low[r >> WORD] |= bit[r & mask]
                        top |= 1 << (r >> WORD)
        live = (token >= 0) & (token < self.wall)
        return token[live].astype(np.int32), np.diff(np.cumsum(live)[walls]).astype(np.int32)


class Codec:
    """Whole texts to ids and back, with tables of bounded size.

    A blank between two characters that are not white space always begins a
    pre-token, and a line feed in such a place is one by itself.  So a text is cut
    at blanks and line feeds and every distinct run is split by the pattern once;
    a text with one in another place goes through the pattern whole.
    """

    LINE, SPACED, PIECE = 0, 1, 2  # runs at a line's start, runs after a blank, pre-tokens

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(load_ranks(path))
        self.tables = RunTables([_inner, _inner, None], CACHE, self._learn)
        self.simple = pattern == PATTERN
        by_id = sorted((i, b) for b, i in self.queue.ranks.items())
        size = self.queue.wall
        self.byte_counts, self.byte_starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ids = np.array([i for i, _ in by_id], dtype=np.int64)
        self.byte_counts[ids] = [len(b) for _, b in by_id]
        self.blob = np.frombuffer(b"".join(b for _, b in by_id), dtype=np.uint8)
        self.byte_starts[ids] = np.cumsum(self.byte_counts[ids]) - self.byte_counts[ids]
        width = len(str(size)) + 1
        self.decimal = np.frombuffer(b"".join(f"{i} ".encode().ljust(width, b"\0") for i in range(size)), dtype=np.uint8).reshape(size, width)
        self.decimal_counts = (self.decimal > 0).sum(axis=1)

    def _learn(self, runs: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Split runs into pre-tokens and encode the distinct ones together; those that are known runs themselves are looked up."""
        local: dict[str, int] = {}
        known: list[int] = []  # numbers of pre-tokens in the tables
        parts, sizes = [], []
        for kind, run in runs:
            split = [run] if kind == Codec.PIECE else self.split(run if kind == Codec.LINE else " " + run)
            sizes.append(len(split))
            for p in split:
                if (at := local.get(p)) is None:
                    at = self.tables.known(Codec.SPACED, p[1:]) if p[0] == " " and len(split) > 1 else -1
                    if at >= 0:
                        known.append(at)
                        at = local[p] = -len(known)
                    else:
                        at = local[p] = len(local) - len(known)
                parts.append(at)
        counts, ids = self.queue.encode([p.encode("utf-8", "replace") for p, at in local.items() if at >= 0])
        own, old_counts = self.tables.gather(np.array(known, dtype=np.int64))
        begin = np.concatenate([np.cumsum(counts, dtype=np.int64) - counts, (len(ids) + np.cumsum(old_counts, dtype=np.int64) - old_counts)[::-1]])
        every, ids = np.concatenate([counts, old_counts[::-1]]), np.concatenate([ids, own])
        at = np.array(parts, dtype=np.int64)
        ids = ids[spread(begin[at], every[at])]
        total = np.concatenate([[0], np.cumsum(every[at], dtype=np.int64)])
        return np.diff(total[np.concatenate([[0], np.cumsum(sizes)])]).astype(np.int32), ids

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids on end, where each text's begin, with the end) of successive slices of the texts."""
        line, spaced, piece = (t.__getitem__ for t in self.tables.begin())
        feed = piece("\n")
        texts_rows: list[np.ndarray] = []
        for text in texts:
            rows: list[int] = []
            if text and self.simple:
                for part in text.split("\n"):
                    words = part.split(" ")
                    if rows:
                        rows.append(feed)
                    rows.append(line(words[0]))
                    del words[0]
                    rows += map(spaced, words)
            found = np.array(rows, dtype=np.int32)
            if text and (not self.simple or found.min() < 0):
                found = np.array(list(map(piece, self.split(text))), dtype=np.int32)
            texts_rows.append(found)
        self.tables.settle()
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= PIECE):
                chars += len(texts[to])
                to += 1
            ids, counts = self.tables.gather(np.concatenate(texts_rows[at:to]))
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            yield ids, total[np.cumsum([0, *map(len, texts_rows[at:to])])]
            at = to

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of ids on end, and where those of each text begin, with the end."""
        counts = self.byte_counts[ids]
        return memoryview(self.blob[spread(self.byte_starts[ids], counts)]), np.concatenate([[0], np.cumsum(counts)])[bounds]

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Ids as decimal text, a blank after each, and where those of each text begin, with the end."""
        wide = self.decimal[ids].ravel()
        return memoryview(wide[wide > 0]), np.concatenate([[0], np.cumsum(self.decimal_counts[ids])])[bounds]


def _inner(run: str) -> bool:
    """Whether blanks and line feeds beside the run stand between characters that are not white space."""
    return bool(run) and not run[0].isspace() and not run[-1].isspace()


def _key(path: str, pattern: str) -> str:
    return f"byte bpe {path} {pattern}"


def _codec(path: str, pattern: str) -> Codec:
    return shared.held(_key(path, pattern), lambda: Codec(path, pattern))


def _digests(data: memoryview, bounds: np.ndarray, tail: int = 0) -> list[str]:
    """SHA-256 of each text's bytes without the last ``tail``."""
    cuts = bounds.tolist()
    return [hashlib.sha256(data[a : max(a, z - tail)]).hexdigest() for a, z in zip(cuts, cuts[1:], strict=False)]


def encode_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids, and report counts and digests (see REPORT)."""

    def make():
        codec = _codec(path, pattern)

        def work(ids, texts):
            out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for found, bounds in codec.encode(texts):
                out["n_tokens"] += np.diff(bounds).tolist()
                out["ids_sha256"] += _digests(*codec.decimals(found, bounds), tail=1)
                out["decoded_sha256"] += _digests(*codec.decode(found, bounds))
            return out

        return work

    return shared.map_texts(shared.id_text(docs), REPORT, make, _key(path, pattern), BATCH)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int> and decoded_sha256 (of the bytes that the ids decode to) of every text."""

    def make():
        codec = _codec(path, pattern)

        def work(ids, texts):
            counts, lists, digests = [], [], []
            for found, bounds in codec.encode(texts):
                counts += np.diff(bounds).tolist()
                lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found)))
                digests += _digests(*codec.decode(found, bounds))
            return {"doc_id": ids, "n_tokens": counts, "ids": pa.concat_arrays(lists) if lists else [], "decoded_sha256": digests}

        return work

    return shared.map_texts(shared.id_text(docs), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", make, _key(path, pattern), BATCH)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give null, bytes that are not UTF-8 become U+FFFD."""

    def run(batches):
        codec = _codec(path, pattern)
        for b in shared.small_batches(batches):
            texts = [None if i is None else bytes(codec.decode(np.array(i, dtype=np.int64), np.zeros(1, np.int64))[0]).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    shared.bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(shared.tidy(run, _key(path, pattern)), "doc_id long, text string")
