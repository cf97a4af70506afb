"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's set is its distinct five-word shingles (words between
``[ \\t-\\r]``, A-Z lower-cased), as 64-bit hashes.  Documents are linked when
their sets' Jaccard similarity reaches ``SIMILARITY``; components of links are
the groups.

1. One pass makes, for every document, a MinHash signature of 60 symbols of 16
   bits and a finer sketch (1024 bins of two bits).  Documents with equal sets
   form a class from here on, and one of them stands for it.
2. Multi-index join: the signature is cut into 14 chunks.  Ten chunks of four
   symbols must agree whole; four chunks of five symbols may err in one, so they
   are listed once without each symbol.  Two signatures that differ in at most
   ``GUARANTEED`` = 10 * 1 + 4 * 2 - 1 = 17 of 60 symbols agree in a key, by the
   pigeonhole principle; a pair of similarity 0.85, which differs in 9 on
   average, misses all 30 keys with probability 5e-7.
3. Within a key, documents are compared by sketch, one row of bit operations
   against all that are still alone.  What is surely similar grows into trees;
   a tree gives one pair for each of its documents, not all pairs, and once it
   has taken in all of them the key is done, so a group of near copies costs its
   size and not its square.  Near the threshold each document names its ``FIRST``
   most similar partners in other trees, and whether there were more.
4. Pairs are verified on the full sets, first one per document, then those
   between components that are still apart.  Where a document had more partners in
   a key than it named, it is held against the key's documents in other components
   again, with eight times as many partners each time, until none is left out; so
   are all documents of a key where a sure pair failed.  Pairs inside a component
   that is already joined are never listed.

All pairs within 17 symbols meet in a key.  There the sketch takes part: a pair
is passed over when its estimated similarity is ``SLACK`` = 5 standard errors
below the threshold.  That is a bound by chance and not by proof; the README
gives the recall measured against brute force.

A key with more than ``LARGE`` documents is dealt to blocks of half that many,
twice by different hashes, so trees of both dealings meet.  Then it is gone
through once more: its documents outside its largest component are held against
every block, and those of that component are in one block each.  So no task
holds more than ``LARGE`` documents of a key, and no pair is passed over.
Copies are never expanded into pairs.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing; fewer than five words are one shingle; null ids belong to their
group and order last; of rows with equal ids and sets one is kept; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .word_hashes import hashes

SHINGLE, SIMILARITY, PERCENT = 5, 0.85, 85
SYMBOLS, GUARANTEED, BINS = 60, 17, 1024
LARGE, FIRST = 2048, 8
#: Ends of pairs to be verified are shipped to all tasks up to this many (about 15 MB); beyond, a shuffle finds their texts.
SHIPPED, BESIDE = 300_000, 256
#: A written table has at most one file for so many documents, or for so many texts to be verified (see ``shared.writers``).
EACH, EACH_TEXT = 5000, 1000
SLACK = 5.0
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PICK = np.array([[4 * c + k for k in range(4)] for c in range(10)] + [[40 + 5 * c + k for k in range(5) if k != gap] for c in range(4) for gap in range(5)])
_SALT = _RNG.integers(0, 2**63, len(_PICK), dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def __call__(self, text: str | None) -> np.ndarray:
        h = hashes((text or "").encode("utf-8", "surrogatepass").translate(_TABLE))
        if not len(h):
            return np.zeros(0, dtype=np.uint64)
        if len(h) < self.size:
            out = np.full(1, len(h), dtype=np.uint64)
            for x in h:
                out = _mix(out * _M1 + x)
            return out
        n = len(h) - self.size + 1
        out = h[:n] * _M1
        for k in range(1, self.size):
            out = (out ^ (out >> np.uint64(29))) * _M1 + h[k : k + n]
        return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """60 symbols of 16 bits."""
    least = np.full(SYMBOLS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(8)).astype(np.uint16)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """The 30 keys of each signature (rows), as int64."""
    four = symbols.astype(np.uint64)[..., _PICK]
    packed = four[..., 0] | four[..., 1] << np.uint64(16) | four[..., 2] << np.uint64(32) | four[..., 3] << np.uint64(48)
    return _mix(packed ^ _SALT).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """1024 bins of two bits: 0 for empty, else 1 to 3 from the bin's least hash."""
    g = np.sort(hashes * _M3)
    bins = (g >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first]] = 1 + (_mix(g[first]) % np.uint64(3)).astype(np.uint8)
    four = out.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


class Bucket:
    """The documents of one key, with bit planes of their sketches."""

    def __init__(self, uids: np.ndarray, sizes: np.ndarray, sketches: list[bytes]):
        self.uids, self.sizes = uids, sizes.astype(np.float64)
        raw = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(uids), -1)
        bins = (raw[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
        bins = bins.reshape(len(uids), BINS)
        planes = [np.packbits(bins == v, axis=1).view(np.uint64) for v in (1, 2, 3)]
        self.planes = np.concatenate(planes, axis=1)
        self.full = planes[0] | planes[1] | planes[2]
        self.held = np.bitwise_count(self.full).sum(axis=1, dtype=np.int64)

    def compare(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated similarity, five times its standard error) of i with others; sizes that rule a link out give -1."""
        same = np.bitwise_count(self.planes[others] & self.planes[i]).sum(axis=1, dtype=np.int64)
        both = np.bitwise_count(self.full[others] & self.full[i]).sum(axis=1, dtype=np.int64)
        union = np.maximum(self.held[others] + self.held[i] - both, 1)
        about = np.clip((same - both / 3) / (union * (2 / 3)), 0, 1)
        whole = (self.sizes[others] + self.sizes[i]) / (1 + np.maximum(about, 0.5))
        error = SLACK * 1.5 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / union * np.maximum(1 - union / whole, 0.05)) + 0.005
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        about[100 * small < PERCENT * large] = -1.0
        return about, error

    def pairs(self, most: int) -> Iterator[tuple[int, int, bool, bool]]:
        """(uid, uid, sure, cut): the trees of surely similar documents, and of each document its ``most`` nearest doubtful ones in other trees.

        Where there were more, a row with ``cut`` gives the key (see ``_pairs``) and the document.
        """
        n = len(self.uids)
        free = np.arange(n)
        label = np.full(n, -1)
        for start in range(n):
            if label[start] >= 0:
                continue
            label[start] = start
            free = free[label[free] < 0]
            queue, doubtful = [start], []
            for i in queue:
                if not len(free):
                    break
                about, error = self.compare(i, free)
                sure = about >= SIMILARITY + error
                maybe = ~sure & (about >= SIMILARITY - error)
                if maybe.any():
                    doubtful.append((i, free[maybe], about[maybe]))
                for j in free[sure].tolist():
                    label[j] = start
                    queue.append(j)
                    yield int(self.uids[j]), int(self.uids[i]), True, False
                free = free[~sure]
            for i, others, about in doubtful:
                apart = label[others] != start
                yield from self._nearest(i, others[apart], about[apart], most)

    def across(self, roots: np.ndarray, asked: np.ndarray, whole: bool, own_key: int, symbols: np.ndarray, most: int) -> Iterator[tuple[int, int, bool, bool]]:
        """Of each document that is ``asked`` its ``most`` nearest ones in other components that may be similar.

        With ``whole`` all documents are asked that are outside the largest component
        here, since a pair of two components has an end outside it.  A pair is named
        under the first key that its documents share.
        """
        if whole:
            own, counts = np.unique(roots, return_counts=True)
            asked = roots != own[counts.argmax()]
        slot = int(np.flatnonzero(chunk_keys(symbols[:1])[0] == own_key)[0])
        for i in np.flatnonzero(asked).tolist():
            others = np.flatnonzero(roots != roots[i])
            about, error = self.compare(i, others)
            near = about >= SIMILARITY - error
            others, about = others[near], about[near]
            if slot:
                earlier = (symbols[others] == symbols[i])[:, _PICK[:slot]].all(axis=2).any(axis=1)
                others, about = others[~earlier], about[~earlier]
            yield from self._nearest(i, others, about, most)

    def _nearest(self, i: int, others: np.ndarray, about: np.ndarray, most: int) -> Iterator[tuple[int, int, bool, bool]]:
        if len(others) > most:
            others = others[np.lexsort((others, -about))[:most]]
            yield 0, int(self.uids[i]), False, True
        for j in others.tolist():
            yield int(self.uids[j]), int(self.uids[i]), False, False


def _groups(batches, width: int) -> Iterator[list[list]]:
    """Runs of equal keys (first column) in sorted batches, as column lists; one group in memory at a time."""
    held: list[list] = [[] for _ in range(width)]
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
        columns = [b.column(k) for k in range(width)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if held[0] and held[0][0] != keys[a]:
                if len(held[0]) > 1:
                    yield held
                held = [[] for _ in range(width)]
            if z - a == 1 and z < len(keys) and not held[0]:
                continue  # alone with its key
            for k in range(width):
                held[k] += columns[k].slice(a, z - a).to_pylist()
    if len(held[0]) > 1:
        yield held


def profile(rows: DataFrame) -> DataFrame:
    """uid, doc_id, n_shingles, set_id, symbols, sketch of every row (uid, doc_id, text)."""

    def run(batches):
        shingle = Shingler()
        for b in shared.small_batches(batches):
            sizes, ids, symbols, sketches = [], [], [], []
            for text in b.column(2).to_pylist():
                h = shingle(text)
                sizes.append(len(h))
                ids.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                symbols.append(signature(h).tobytes() if len(h) else None)
                sketches.append(sketch(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(symbols, pa.binary()), pa.array(sketches, pa.binary())], names=["uid", "doc_id", "n_shingles", "set_id", "symbols", "sketch"])

    shared.bounded_batches(rows.sparkSession)
    return rows.select("uid", "doc_id", "text").mapInArrow(shared.tidy(run), "uid long, doc_id long, n_shingles long, set_id binary, symbols binary, sketch binary")


def _signatures(symbols: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(symbols), dtype=np.uint16).reshape(-1, SYMBOLS)


def _keys(reps: DataFrame) -> DataFrame:
    """(key, uid): every document under its 30 keys."""

    def run(batches):
        for b in batches:
            keys = chunk_keys(_signatures(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))], names=["key", "uid"])

    return reps.select("uid", "symbols").mapInArrow(run, "key long, uid long")


def _buckets(reps: DataFrame, folder: str, tasks: int) -> DataFrame:
    """(key, uid, n) of keys that n > 1 documents have; keys are counted within tasks before they meet."""
    keys = _keys(reps)
    often = shared.stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/often", tasks)
    return shared.stored(keys.join(often, "key").select("key", "uid", "n"), f"{folder}/keys", tasks)


def _dealt(buckets: DataFrame, large: int) -> DataFrame:
    """(key, uid) with large keys dealt to blocks, twice."""
    block = lambda s: F.xxhash64("key", F.lit(s), F.pmod(F.xxhash64("uid", F.lit(s)), F.ceil(F.col("n") * 2 / large)))
    own = F.when(F.col("n") > large, F.array(block(1), block(2))).otherwise(F.array("key"))
    return buckets.select(F.explode(own).alias("key"), "uid")


def _shipped(small: DataFrame) -> DataFrame:
    """A written table of keys, to be sent to all tasks while it has at most ``SHIPPED`` rows, so that rows of a hot key stay where they are."""
    return F.broadcast(small) if small.count() <= SHIPPED else small


def _dealt_across(buckets: DataFrame, roots: DataFrame, cuts: DataFrame, whole: DataFrame | None, large: int, folder: str, tasks: int) -> DataFrame:
    """(key, uid, root, asked, whole, own_key) of the documents to be compared once more.

    ``cuts`` has (key, uid) of documents that had more partners, ``whole`` the keys
    to be gone through with all their documents (null: none).  Of other keys, documents
    of the largest component that had no more partners come along only if a document
    outside it had.  Large keys are dealt to blocks; ``own_key`` is the key before.
    """
    cuts = cuts.select("key", "uid").distinct().withColumn("cut", F.lit(True))
    active = cuts.groupBy("key").agg(F.lit(False).alias("whole"))
    if whole is not None:
        active = active.union(whole.select("key", F.lit(True))).groupBy("key").agg(F.max("whole").alias("whole"))
    active = shared.stored(active, f"{folder}/active", tasks)
    rows = buckets.join(_shipped(active), "key").join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").join(cuts, ["key", "uid"], "left")
    rows = shared.stored(rows.select("key", "uid", "n", F.coalesce("root", "uid").alias("root"), F.coalesce("cut", F.lit(False)).alias("asked"), (F.col("whole") | (F.col("n") > large)).alias("whole")), f"{folder}/rows", tasks)
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("asked").alias("asked"))
    tops = each.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("top.root").alias("top"), F.col("top.c").alias("n_top"))
    outside = each.join(tops, "key").groupBy("key").agg(F.max(F.col("asked") & (F.col("root") != F.col("top"))).alias("outside"), F.first("top").alias("top"), F.first("n_top").alias("n_top"))
    rows = rows.join(_shipped(shared.stored(outside, f"{folder}/outside", tasks)), "key")
    in_top = F.col("root") == F.col("top")
    small = rows.where((F.col("n") <= large) & (F.col("whole") | F.col("asked") | F.col("outside") | ~in_top)).select("key", "uid", "root", "asked", "whole", F.col("key").alias("own_key"))
    half = large / 2
    big = rows.where(F.col("n") > large).withColumn("bt", F.ceil(F.col("n_top") / half)).withColumn("bo", F.ceil((F.col("n") - F.col("n_top")) / half))
    big = big.withColumn("own", F.pmod(F.xxhash64("uid"), F.when(in_top, F.col("bt")).otherwise(F.col("bo"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_other = F.transform(upto("bo"), lambda c: F.xxhash64("key", F.lit(0), F.col("own"), c))
    with_top = F.transform(upto("bt"), lambda b: F.xxhash64("key", F.lit(0), b, F.col("own")))
    among = F.transform(upto("bo"), lambda c: F.xxhash64("key", F.lit(1), F.least("own", c), F.greatest("own", c)))
    spread = big.select(F.explode(F.when(in_top, with_other).otherwise(F.concat(with_top, among))).alias("key"), "uid", "root", "asked", "whole", F.col("key").alias("own_key"))
    return small.unionByName(spread)


_PAIR = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("sure", pa.bool_()), ("cut", pa.bool_())])


def _pairs(dealt: DataFrame, reps: DataFrame, most: int, folder: str, tasks: int, across: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (x, y, sure), and (key, uid) of documents that had more partners; with ``across`` between components."""
    columns_of = ["key", "uid", "n_shingles", "sketch", *(["root", "asked", "whole", "own_key", "symbols"] if across else [])]

    def found_in(columns: list[list]) -> tuple[int, Iterator[tuple[int, int, bool, bool]]]:
        bucket = Bucket(np.array(columns[1], dtype=np.int64), np.array(columns[2]), columns[3])
        if not across:
            return columns[0][0], bucket.pairs(most)
        own = columns[7][0]
        return own, bucket.across(np.array(columns[4]), np.array(columns[5]), columns[6][0], own, _signatures(columns[8]), most)

    def run(batches):
        rows = []
        for columns in _groups(batches, len(columns_of)):
            key, pairs = found_in(columns)
            for x, y, sure, cut in pairs:
                rows.append((key if cut else x, y, sure, cut))
                if len(rows) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_PAIR)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_PAIR)

    wide = dealt.join(reps.select("uid", "n_shingles", "sketch", *columns_of[8:]), "uid").select(*columns_of)
    found = wide.repartition("key").sortWithinPartitions("key", "uid").mapInArrow(shared.tidy(run), "x long, y long, sure boolean, cut boolean")
    ends = (F.col("x"), F.col("y"))
    low, high = (F.when(F.col("cut"), c).otherwise(f(*ends)) for c, f in zip(ends, (F.least, F.greatest), strict=True))
    every = shared.stored(found.groupBy(low.alias("x"), high.alias("y"), "cut").agg(F.max("sure").alias("sure")), folder, tasks)
    return every.where("not cut").select("x", "y", "sure"), every.where("cut").select(F.col("x").alias("key"), F.col("y").alias("uid"))


def _verified(pairs: DataFrame, rows: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Those of the pairs (x, y) whose full sets are similar enough.

    The texts of a document x and of its partners y travel once to one place; a
    document with more than ``BESIDE`` partners goes to several.
    """
    spark = rows.sparkSession
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / BESIDE).alias("parts"))
    partners = pairs.join(parts, "x").select(F.col("y").alias("uid"), "x", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part"), F.lit(1).alias("place"))
    firsts = parts.select(F.col("x").alias("uid"), "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"))
    ends = shared.stored(partners.unionByName(firsts), f"{folder}/ends", tasks)
    n = ends.count()

    def run(batches):
        shingle, now, first = Shingler(), None, None
        for b in shared.small_batches(batches):
            linked = []
            for x, part, place, y, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                h = shingle(text)
                if not place:
                    now, first = (x, part), h
                    continue
                if now != (x, part):
                    raise ValueError("a document's partners came without it")
                common = len(np.intersect1d(first, h, assume_unique=True))
                if 100 * common >= PERCENT * (len(first) + len(h) - common) and common:
                    linked.append((x, y))
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in zip(*linked, strict=True)], names=["x", "y"])

    shared.bounded_batches(spark)
    texts = rows.select("uid", "text").join(F.broadcast(ends) if n <= SHIPPED else ends, "uid").select("x", "part", "place", "uid", "text")
    out = shared.stored(texts.repartition("x", "part").sortWithinPartitions("x", "part", "place", "uid").mapInArrow(shared.tidy(run), "x long, y long"), f"{folder}/linked", shared.writers(spark, n, EACH_TEXT))
    shared.remove(spark, f"{folder}/ends")
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    both = pairs.join(at("x"), "x", "left").join(at("y"), "y", "left")
    return both.where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y", "sure")


def classes(docs: DataFrame, large: int = LARGE, first: int = FIRST) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, kept of every row; of the rows of a group exactly one is kept."""
    folder = shared.fresh_dir(docs.sparkSession, "near")
    return classes_of(shared.numbered(shared.id_text(docs), folder), folder, large, first)


def classes_of(texts: DataFrame, folder: str, large: int = LARGE, first: int = FIRST) -> DataFrame:
    """The same for rows (uid, doc_id, text); only the result's table stays below ``folder``."""
    spark = texts.sparkSession
    rows = shared.stored(profile(texts), f"{folder}/profile")
    tasks = shared.writers(spark, rows.count(), EACH)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    sets = shared.stored(rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("uid").alias("uid"), order.alias("first"), F.count("*").alias("n")), f"{folder}/sets", tasks)
    reps = shared.stored(rows.join(sets.select("uid"), "uid", "left_semi").select("uid", "n_shingles", "symbols", "sketch"), f"{folder}/reps", tasks)
    buckets = _buckets(reps, folder, tasks)
    shared.remove(spark, f"{folder}/often")
    pairs, cuts = _pairs(_dealt(buckets, large), reps, first, f"{folder}/pairs", tasks)
    one = shared.stored(pairs.where("sure").groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), f"{folder}/one", tasks)
    linked = _verified(one, texts, f"{folder}/verify-1", tasks)
    roots = components(linked, f"{folder}/components-1", tasks=tasks)
    rest = shared.stored(_apart(pairs, roots).select("x", "y"), f"{folder}/rest", tasks)
    tried = one.unionByName(rest)
    linked = linked.unionByName(_verified(rest, texts, f"{folder}/verify-2", tasks))
    roots = components(linked, f"{folder}/components-2", tasks=tasks)
    shared.remove(spark, f"{folder}/components-1")
    failed = shared.stored(_apart(pairs.where("sure"), roots).select(F.explode(F.array("x", "y")).alias("uid")).distinct(), f"{folder}/failed", tasks)
    whole = shared.stored(buckets.join(failed, "uid").select("key").union(buckets.where(F.col("n") > large).select("key")).distinct(), f"{folder}/whole", tasks)
    left, most, at = not (cuts.isEmpty() and whole.isEmpty()), first, 2
    while left:
        most, at = 8 * most, at + 1
        dealt = _dealt_across(buckets, roots, cuts, whole, large, f"{folder}/round-{at}", tasks)
        pairs, cuts = _pairs(dealt, reps, most, f"{folder}/pairs-{at}", tasks, across=True)
        whole, left = None, not cuts.isEmpty()
        rest = shared.stored(pairs.join(tried, ["x", "y"], "left_anti").select("x", "y"), f"{folder}/rest-{at}", tasks)
        shared.remove(spark, f"{folder}/round-{at}")
        if rest.isEmpty():
            continue
        tried = tried.unionByName(rest)
        linked = linked.unionByName(_verified(rest, texts, f"{folder}/verify-{at}", tasks))
        roots = components(linked, f"{folder}/components-{at}", tasks=tasks)
        shared.remove(spark, f"{folder}/components-{at - 1}")
    rooted = sets.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").select("set_id", "n", F.coalesce("root", "uid").alias("root"), "first")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("size"))
    named = rooted.select("set_id", "root").join(firsts.where("size > 1"), "root").select("set_id", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("keep_uid"))
    # rows that are alone keep themselves, so only sets of groups are joined, and rows without words never are
    ours = rows.select("uid", "doc_id", "n_shingles", "set_id").withColumn("set_id", F.coalesce("set_id", F.col("uid").cast("string").cast("binary")))
    out = ours.join(named, "set_id", "left")
    alone = F.col("keep_uid").isNull()
    out = out.select("uid", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"))
    out = shared.stored(out, f"{folder}/result", tasks)
    own = {"result", "numbered"}
    for part in shared.names(spark, folder):
        if part not in own:
            shared.remove(spark, f"{folder}/{part}")
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and whether they are equal, of every row."""
    return classes(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group."""
    folder, name = shared.fresh_dir(docs.sparkSession, "near"), shared.row_name()
    rows = shared.numbered(docs, folder, name)
    found = classes_of(rows.select(F.col(name).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), folder)
    return shared.without(rows, name, found.where("not kept").select("uid"), f"{folder}/gone")
