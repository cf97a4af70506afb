"""Token ids in files of fixed-width bit packing.

Documents are range-partitioned and sorted by id; each partition writes one
shard.  A shard is, little-endian,

    magic "QSPK2\\0", u16 width, u32 block
    payload          each id in ``width`` bits, least significant bit first,
                     every block of ``block`` ids padded to a whole byte
    u64[blocks]      byte offset of each block's payload from the payload start
    i64[documents]   document ids (0 where a bit in the next field is set)
    u8[documents]    1 where the document id is null
    u64[documents+1] first token of each document within the shard
    u64 documents, u64 tokens, u64 blocks, magic

``width`` is the fewest bits that hold every id of the vocabulary, so a block
or a single document is found by arithmetic and unpacked by numpy.  Blocks are
written as they fill, so a task holds one batch of texts and its shard's index.
Every attempt of a task writes a file of its own; a ``shards`` table beside them
lists those that count, with their place in the order and number of tokens, one
row per shard.

Defined cases: null and empty texts have the end id alone; null ids sort first;
repeated ids keep all their rows (ties by text length and hash); an empty table
has no shard; extra columns are not read.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .run_table import RunTables, spread

MAGIC, HEAD, TAIL = b"QSPK2\0", struct.Struct("<HI"), struct.Struct("<QQQ")
BLOCK = 4096
REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long"
SHARD = "shard int, name string, n_docs long, n_tokens long"
#: Runs in a generation of a worker's table; characters whose ids are gathered at once; bytes of the input's files for a shard.
CACHE, PIECE, SHARD_BYTES = 600_000, 1 << 20, 64 << 20
MARKS = ",.;:!?"
#: The normaliser and pre-tokeniser for which texts may be cut at white space.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def width_of(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, least significant bit first, padded to a byte."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class ShardWriter:
    """Writes a shard to a stream: blocks as soon as they are full, the index at the end."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        out.write(MAGIC + HEAD.pack(width, block))

    def add(self, docs: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents, how many ids each has, and all their ids on end."""
        self.docs += docs
        self.lengths += lengths
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= 64 * self.block:
            every = np.concatenate(self.held)
            self._write(every[: len(every) // self.block * self.block])
            self.held = [every[len(every) // self.block * self.block :]]
            self.n_held = len(self.held[0])

    def _write(self, ids: np.ndarray) -> None:
        step = self.block if self.block * self.width % 8 else len(ids) or 1
        for at in range(0, len(ids), step):
            self.out.write(pack(ids[at : at + step], self.width))

    def finish(self) -> None:
        self._write(np.concatenate([np.zeros(0, np.uint32), *self.held]))
        n_blocks = -(-self.n_tokens // self.block)
        self.out.write((np.arange(n_blocks, dtype=np.uint64) * np.uint64((self.block * self.width + 7) // 8)).astype("<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes())
        self.out.write(np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)]).astype("<u8").tobytes())
        self.out.write(TAIL.pack(len(self.docs), self.n_tokens, n_blocks) + MAGIC)


class Shard:
    """Random access to a shard: ``doc(i)`` and ``tokens(a, b)`` read only the blocks they need."""

    def __init__(self, f):
        self.f = f
        head, tail = len(MAGIC) + HEAD.size, len(MAGIC) + TAIL.size
        front = f.read(head)
        size = f.seek(0, io.SEEK_END)
        f.seek(max(0, size - tail))
        back = f.read(tail)
        if front[: len(MAGIC)] != MAGIC or back[-len(MAGIC) :] != MAGIC:
            raise ValueError("this is no shard of packed tokens")
        self.width, self.block = HEAD.unpack(front[len(MAGIC) :])
        n, self.n_tokens, blocks = TAIL.unpack(back[: -len(MAGIC)])
        self.payload = head
        f.seek(size - tail - 8 * blocks - 9 * n - 8 * (n + 1))
        self.offsets = np.frombuffer(f.read(8 * blocks), "<u8")
        ids, null = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), np.uint8)
        self.docs = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.starts = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)

    def tokens(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, dtype=np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        self.f.seek(self.payload + int(self.offsets[first]))
        held = min((last + 1) * self.block, self.n_tokens) - first * self.block
        whole = (self.block * self.width + 7) // 8
        tail = held - (last - first) * self.block
        data = self.f.read((last - first) * whole + (tail * self.width + 7) // 8)
        parts = [unpack(data[k * whole : (k + 1) * whole], self.block if first + k < last else tail, self.width) for k in range(last - first + 1)] if self.block * self.width % 8 else [unpack(data, held, self.width)]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def doc(self, at: int) -> np.ndarray:
        return self.tokens(int(self.starts[at]), int(self.starts[at + 1]))

    def each(self, tokens: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in the shard, ids) in order, read about ``tokens`` ids at a time."""
        at = 0
        while at < len(self.docs):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + tokens, side="right")) - 1)
            ids, base = self.tokens(int(self.starts[at]), int(self.starts[to])), int(self.starts[at])
            for k in range(at, to):
                yield self.docs[k], int(self.starts[k]), ids[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]
            at = to


class Encoder:
    """Texts -> ids by the tokenizers library.

    Where the file's normaliser and pre-tokeniser are the ones in ``BY_WORD``,
    which never join across white space, texts are cut at ASCII white space and
    each distinct run goes through the library once (see ``run_table``; ``CACHE``
    runs in a generation).  One of ``MARKS`` after letters is a pre-token by
    itself, so such a run is made of two; and since the normaliser lower-cases,
    an ASCII capital before letters is lower-cased first.  Runs of letters go
    through the library together: each of them is one pre-token or more, and a
    pre-token ends in a token with the vocabulary's suffix, so as many such tokens
    as runs tell where each run ends; otherwise its own word numbers tell it.
    With any other file, and where a text has one of the added tokens in it, texts
    go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.added = [a.content for a in self.lib.get_added_tokens_decoder().values()]
        described = json.loads(self.lib.to_str())
        self.by_word = {k: described[k] for k in BY_WORD} == BY_WORD and bool(described["model"].get("end_of_word_suffix"))
        self.last = np.zeros(self.size, dtype=bool)
        if self.by_word:
            suffix = described["model"]["end_of_word_suffix"]
            self.last[[i for t, i in self.lib.get_vocab().items() if t.endswith(suffix)]] = True
        self.tables = RunTables([None], CACHE, self._learn)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _by_number(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.lib.encode(runs, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(runs)), np.array(found.ids, dtype=np.int32)

    def _by_suffix(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.whole(" ".join(runs))
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(runs) or (len(ends) and ends[-1] != len(ids) - 1):
            return self._by_number(runs)
        return np.diff(ends, prepend=-1), ids

    def _learn(self, runs: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        local: dict[str, int] = {}
        known, parts, sizes, letters, others = [], [], [], [], []
        find, settled = self.tables.known, local.get
        for _, run in runs:
            if run[-1:] in _MARKS and run[:-1].isalpha():
                split = (_lowered(run[:-1]), run[-1])
            elif run.isalpha():
                split = (_lowered(run),)
            else:
                split = (run,)
            sizes.append(len(split))
            for p in split:
                if (at := settled(p)) is None:
                    if p is not run and (held := find(0, p)) >= 0:
                        at = 3 * len(known)
                        known.append(held)
                    elif p.isalpha():
                        at = 3 * len(letters) + 1
                        letters.append(p)
                    else:
                        at = 3 * len(others) + 2
                        others.append(p)
                    local[p] = at
                parts.append(at)
        old_ids, old_counts = self.tables.gather(np.array(known, dtype=np.int64))
        found = [(old_counts, old_ids)]
        for words, encode in ((letters, self._by_suffix), (others, self._by_number)):
            done = [encode(words[k : k + 4096]) for k in range(0, len(words), 4096)]
            found.append(tuple(np.concatenate([np.zeros(0, np.int32), *(d[k] for d in done)]) for k in range(2)))
        counts, ids = (np.concatenate([f[k] for f in found]).astype(np.int32) for k in range(2))
        begin = np.cumsum(counts, dtype=np.int64) - counts
        at = np.array(parts, dtype=np.int64)
        at = at // 3 + np.array([0, len(known), len(known) + len(letters)])[at % 3]
        ids = ids[spread(begin[at], counts[at])]
        total = np.concatenate([[0], np.cumsum(counts[at], dtype=np.int64)])
        return np.diff(total[np.concatenate([[0], np.cumsum(sizes)])]).astype(np.int32), ids

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids on end, how many each text has) of successive slices of the texts."""
        number = self.tables.begin()[0].__getitem__
        rows: list[np.ndarray | None] = []
        for t in texts:
            if not self.by_word or any(a in t for a in self.added):
                rows.append(None)
            else:
                rows.append(np.array(list(map(number, (t.translate(_BLANKS) if _odd(t) else t.replace("\n", " ")).split(" "))), dtype=np.int32))
        self.tables.settle()
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or (chars + len(texts[to]) <= PIECE and (rows[to] is None) == (rows[at] is None))):
                chars += len(texts[to])
                to += 1
            if rows[at] is None:
                own = [self.whole(t) for t in texts[at:to]]
                yield np.concatenate(own), np.array([len(o) for o in own])
            else:
                ids, counts = self.tables.gather(np.concatenate(rows[at:to]))
                total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                yield ids, np.diff(total[np.cumsum([0, *map(len, rows[at:to])])])
            at = to


_MARKS = frozenset(MARKS)


def _lowered(letters: str) -> str:
    """Letters with an ASCII capital at their start lower-cased."""
    first = letters[0]
    return first.lower() + letters[1:] if "A" <= first <= "Z" else letters


_BLANKS = dict.fromkeys((9, 10, 11, 12, 13), " ")


def _odd(text: str) -> bool:
    return "\t" in text or "\r" in text or "\v" in text or "\f" in text


def _key(path: str) -> str:
    return f"packed tokens {path}"


def _encoder(path: str) -> Encoder:
    return shared.held(_key(path), lambda: Encoder(path))


def write(docs: DataFrame, path: str, folder: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Tokenise and write shards below ``folder``; the table of shards (see SHARD) comes back."""
    spark = docs.sparkSession
    src = shared.id_text(docs)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(size, 1 << 50) // SHARD_BYTES), 1)

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(path)
        writer = name = None
        for b in shared.small_batches(batches):
            if writer is None:
                task = TaskContext.get()
                fs, root = shared.open_fs(folder)
                fs.create_dir(root, recursive=True)
                # each attempt has a file of its own, and the table of shards lists the one that counts
                name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.qspk"
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                writer = ShardWriter(out, width_of(max(encoder.size, end_id + 1)), block)
            ids, at = b.column(0).to_pylist(), 0
            for found, counts in encoder.encode([t or "" for t in b.column(1).to_pylist()]):
                ended = np.insert(found, np.cumsum(counts), end_id)
                writer.add(ids[at : at + len(counts)], (counts + 1).tolist(), ended)
                at += len(counts)
        if writer is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens]}, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shared.bounded_batches(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.length("text"), F.xxhash64("text")]
    return shared.stored(src.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(shared.tidy(run, _key(path)), SHARD).repartition(1), f"{folder}/shards")  # one row a shard


def read_report(shards: DataFrame, folder: str) -> DataFrame:
    """Read the shards back: per document its first token's place among all, token count and crc32 (see REPORT)."""
    spark = shards.sparkSession
    listed = sorted(shards.collect())  # one row per shard
    firsts, total = [], 0
    for s in listed:
        firsts.append((s["name"], total))
        total += s["n_tokens"]

    def run(batches):
        fs, root = shared.open_fs(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    rows = [(d, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in Shard(f).each()]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(firsts, "name string, first long")
    return frame.repartition(max(1, len(firsts)), "name").mapInArrow(run, REPORT)
