"""Benchmark decontamination by a broadcast set of test n-grams.

Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII
characters.  A benchmark item's windows are its runs of ``n`` consecutive words;
an item of fewer words, but not none, is one window.  Every word of a document
that lies inside an occurrence of a window is hit.

The windows of the benchmark are shipped to every task while they number at
most ``max_windows`` (a checked bound; about 40 bytes a word).  A larger
benchmark goes through in blocks of that size: each block gives the hit spans
of every document, and spans are united at the end, so the answer is the same
at any size.  A block's windows are hashed once, on the driver, and shipped as
sorted arrays.  Inside a task rolling hashes of a document's windows are made by
numpy and looked up in a bit table and then among the sorted hashes; what is
found there is verified word by word.

Defined cases: null or wordless text has no words and no hits; null or wordless
items have no windows; items with equal windows are all reported; rows with a
null id keep it; an empty benchmark hits nothing; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .word_hashes import words_of

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that go through numpy at once.
PIECE = 1 << 18
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WindowSet:
    """Windows of benchmark items as sorted hashes, with the items' words to verify them; built once and shipped.

    It takes about 40 bytes a word of the items.  A bit table, eight places a window,
    lets most of a document's windows pass without a search.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int = 10):
        self.items = [str(item) for item, _ in items]
        every = [words(text) for _, text in items]
        counts = np.array([len(w) for w in every], dtype=np.int64)
        self.text = b" ".join(w for own in every for w in own) + b" "  # as bytes that words can be cut from
        lengths = np.array([len(w) + 1 for own in every for w in own], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])  # where each word begins in the text
        hashes = words_of(self.text)[2] if len(lengths) else np.zeros(0, np.uint64)
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(items)), counts)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = {}
        for size in sorted({min(n, int(c)) for c in counts.tolist() if c}):
            starts = np.arange(len(hashes))
            left = np.repeat(counts + first, counts) - starts  # words from here to the item's end
            starts = starts[(left >= size) & (np.minimum(np.repeat(counts, counts), n) == size)]
            if not len(starts):
                continue
            found = _rolled(hashes, size)[starts]  # a window of one item, so it ends before the last word does
            order = np.lexsort((starts, owner[starts], found))
            found, starts = found[order], starts[order]
            keep = np.append(True, (found[1:] != found[:-1]) | (owner[starts[1:]] != owner[starts[:-1]]))
            found, starts = found[keep], starts[keep]
            bits = max(10, int(8 * len(found)).bit_length())
            marks = np.zeros(1 << bits, dtype=bool)
            marks[(found >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.sizes[size] = (found, starts, owner[starts], marks, bits)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, hit word spans united and in order, items found)."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """``scan`` of each text; texts go through numpy together, in pieces of about ``PIECE`` bytes.

        A longer text is cut into pieces that share as many words as a window has, less one.
        """
        most = max(self.sizes, default=1)
        out: list[list] = [[0, [], set()] for _ in texts]
        held: list[tuple[int, int, int, bytes]] = []  # text, its word where the piece begins, words shared with the piece before, bytes
        size = 0
        for at, text in enumerate(texts):
            for piece in _pieces((text or "").encode("utf-8", "surrogatepass").translate(_TABLE), most - 1):
                if held and size + len(piece[2]) > PIECE:
                    self._scan(held, out)
                    held, size = [], 0
                held.append((at, *piece))
                size += len(piece[2])
        if held:
            self._scan(held, out)
        return [(n, unite(spans), items) for n, spans, items in out]

    def _scan(self, pieces: list[tuple[int, int, int, bytes]], out: list[list]) -> None:
        data = b" ".join(p[3] for p in pieces) + b" "
        begin = np.cumsum([0, *(len(p[3]) + 1 for p in pieces)])
        starts, ends, hashes = words_of(data)
        first = starts.searchsorted(begin)  # first word of each piece, with the end
        counts = np.diff(first)
        for (at, _, shared_words, _), n in zip(pieces, counts.tolist(), strict=True):
            out[at][0] += n - shared_words
        if not len(starts):
            return
        owner = np.repeat(np.arange(len(pieces)), counts)
        left = first[1:][owner] - np.arange(len(starts))  # words from here to the piece's end
        for size, (found, where, item, marks, bits) in self.sizes.items():
            rolled = _rolled(hashes, size)
            maybe = np.flatnonzero(marks[(rolled >> np.uint64(64 - bits)).astype(np.int64)] & (left[: len(rolled)] >= size))
            if not len(maybe):
                continue
            low, high = found.searchsorted(rolled[maybe], "left"), found.searchsorted(rolled[maybe], "right")
            for word, a, z in zip(maybe.tolist(), low.tolist(), high.tolist(), strict=True):
                if a == z:
                    continue
                window, hit = b" ".join(data[starts[word] : ends[word + size - 1]].split()) + b" ", set()
                for k in range(a, z):
                    other = int(where[k])
                    if self.text[self.begin[other] : self.begin[other + size]] == window:
                        hit.add(self.items[item[k]])
                if hit:
                    at, base, _, _ = pieces[owner[word]]
                    place = base + word - int(first[owner[word]])
                    out[at][1].append((place, place + size))
                    out[at][2].update(hit)


def _pieces(data: bytes, overlap: int) -> Iterator[tuple[int, int, bytes]]:
    """(words before it, words it shares with the piece before, bytes) of the pieces of a text."""
    if len(data) <= PIECE:
        yield 0, 0, data
        return
    import re

    data = re.sub(b" +", b" ", data).strip()
    at = base = again = 0
    while True:
        cut = data.find(b" ", at + PIECE)
        piece = data[at : cut if cut >= 0 else len(data)]
        yield base, again, piece
        if cut < 0:
            return
        n, back = piece.count(b" ") + 1, cut
        again = min(overlap, n)
        for _ in range(again):
            back = data.rfind(b" ", at, back)
        base, at = base + n - again, (back + 1 if again else cut + 1)


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; positions too near the end are left out."""
    n = max(0, len(hashes) - size + 1)
    h = hashes[:n] * _MULT
    for j in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * _MULT + hashes[j : n + j]
    return (h ^ (h >> np.uint64(32))) * _MULT


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the words, for cutting spans out of a text."""
    import re

    return [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, n: int, max_windows: int) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of at most ``max_windows`` words (so windows); the driver holds one or two at a time."""
    block: list[tuple[object, str | None]] = []
    size = 0
    for item, text in benchmark.toLocalIterator():
        k = len(words(text))
        if block and size + k > max_windows:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += k
    if block:
        yield block


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 2_000_000) -> DataFrame:
    """Report per document: word count, hit words, items found (see REPORT)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    blocks = _blocks(bench, n, max_windows)
    first, second = next(blocks, []), next(blocks, None)
    src = shared.id_text(docs)
    if second is None:
        held = spark.sparkContext.broadcast(WindowSet(first, n))

        def make():
            found = held.value

            def work(ids, texts):
                out = {k: [] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
                for i, (k, spans, items) in zip(ids, found.scan_all(texts), strict=True):
                    hit = sum(b - a for a, b in spans)
                    for c, v in zip(out, (i, k, hit, len(items), _digest(items), hit > 0), strict=True):
                        out[c].append(v)
                return out

            return work

        return shared.map_texts(src, REPORT, make)
    folder = shared.fresh_dir(spark, "decontaminate")
    base = shared.stored(src.withColumn("uid", F.monotonically_increasing_id()), f"{folder}/docs")
    parts = []
    for at, block in enumerate(chain([first, second], blocks)):
        parts.append(shared.stored(_block_hits(base, block, n), f"{folder}/hits-{at}"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)

    def join(batches):
        for b in batches:
            rows = b.to_pylist()
            spans = [unite([tuple(s) for s in r["spans"] or []]) for r in rows]
            items = [set(r["items"] or []) for r in rows]
            yield pa.RecordBatch.from_pydict({"uid": [r["uid"] for r in rows], "n_hit": [sum(y - x for x, y in s) for s in spans], "n_items": [len(s) for s in items], "items_sha256": [_digest(s) for s in items]}, schema=pa.schema([("uid", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]))

    found = hits.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).mapInArrow(join, "uid long, n_hit long, n_items long, items_sha256 string")
    size = shared.map_texts(base.select("uid", "text"), "uid long, n_words long", lambda: lambda ids, texts: {"uid": ids, "n_words": [len(words(t)) for t in texts]})
    return base.select("uid", "doc_id").join(size, "uid").join(found, "uid", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def _block_hits(base: DataFrame, block, n: int) -> DataFrame:
    held = base.sparkSession.sparkContext.broadcast(WindowSet(block, n))

    def make():
        found = held.value

        def work(ids, texts):
            out = {"uid": [], "spans": [], "items": []}
            for i, (_, spans, items) in zip(ids, found.scan_all(texts), strict=True):
                if spans:
                    out["uid"].append(i)
                    out["spans"].append([list(s) for s in spans])
                    out["items"].append(sorted(items))
            return out

        return work

    return shared.map_texts(base.select("uid", "text"), "uid long, spans array<array<long>>, items array<string>", make)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 2_000_000, spans_only: bool = False) -> DataFrame:
    """``docs``, all columns, without contaminated documents, or with the hit spans cut out of their texts.

    Benchmark blocks are applied one after another; a cut leaves one blank.
    """
    bench = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for block in _blocks(bench, n, max_windows):
        held = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n))
        docs = _cut(docs, held) if spans_only else _clean(docs, held)
    return docs


def _clean(docs: DataFrame, held) -> DataFrame:
    """The rows without hits; Python gets the texts alone."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shared.only(None)
        found = held.value
        for texts in batches:
            yield pa.array([not spans for _, spans, _ in found.scan_all(texts.to_pylist())], pa.bool_())
        shared.release()

    shared.bounded_batches(docs.sparkSession)
    return docs.where(clean.asNondeterministic()(F.col("text").cast("string")))


def _cut(docs: DataFrame, held) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches):
        found = held.value
        for b in shared.small_batches(batches):
            texts = []
            own = b.column(at).to_pylist()
            for t, (_, spans, _) in zip(own, found.scan_all(own), strict=True):
                if spans:
                    offsets = word_offsets(t)
                    for x, y in reversed(spans):
                        t = t[: offsets[x][0]] + " " + t[offsets[y - 1][1] :]
                texts.append(t)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, type=b.schema.field(at).type))

    shared.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
