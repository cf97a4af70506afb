"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A document
is cut into blocks of ``BLOCK`` symbols; every block is parsed greedily into
longest matches: walk the automaton from its start state as far as it goes, and
begin a new phrase where it stops.  So a phrase also ends where a block does, in
every language alike.  The language whose automaton needs the fewest phrases for
a symbol explains the text best and wins; ties go to the language that sorts
first.  All blocks of a batch of documents step through the automata of all
languages together, as numpy gathers from one hash table of transitions.

Symbols are lower-cased letters; runs of anything else are one separator.
Every letter of a language's training text is in its alphabet; a letter that a
language does not have costs it a phrase.

Training is bounded: of each language the whole texts of at most ``TRAIN_DOCS``
labelled rows are taken, those with the lowest hash of their id, one after
another until they have ``TRAIN_CHARS`` characters together; rows of more than
``LONG`` characters come after all others.  So the choice does not depend on how
rows are spread.  All labels are learned.  Documents to learn from are chosen by
the caller, and prediction sees texts only.

Defined cases: null, empty and letterless texts are ``und`` with score 0;
labels of null are not learned; with no labelled text at all, all is ``und``;
repeated rows are predicted alike; extra columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK, TRAIN_CHARS, TRAIN_DOCS, LONG = 1024, 30_000, 400, 20_000
#: Characters that go through the automata at once.
SLICE = 1 << 19
REPORT = "doc_id long, lang_pred string, score double"
SEPARATOR, OTHER = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: 0 where it is no letter, else its lower-case form's code point."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.int32)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters (0 for others) of all texts on end, and where each text begins."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], starts


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of every state; state 0 is the start."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now = len(step)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Transitions:
    """(state, symbol) -> state for the states of all languages, as a hash table with linear probing at a load of a quarter at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        left, slots = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[left[free]]
            put = self.keys[slots] == keys[left]
            self.values[slots[put]] = values[left[put]]
            left, slots = left[~put], (slots[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """States, -1 where there is none."""
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Model:
    """Languages, the letters of their texts and the transitions of their automata; small enough to ship to every task."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        folded = {lang: _folded(["\n".join(texts[lang])])[0] for lang in self.langs}
        self.alphabet = np.unique(np.concatenate([np.zeros(1, np.int32), *folded.values()]))  # 0, the separator, and the letters
        self.size = len(self.alphabet) + 1
        keys, values, first, starts = [], [], 1, []  # state 0 is where no phrase is under way
        for lang in self.langs:
            states = suffix_automaton(self.symbols(folded[lang]).tolist())
            starts.append(first)
            keys += [(first + state) * self.size + c for state, to in enumerate(states) for c in to]
            values += [first + t for to in states for t in to.values()]
            first += len(states)
        self.table = Transitions(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))
        # where each language goes with a symbol at the beginning of a phrase; 0 if it lacks the symbol
        every = np.arange(self.size, dtype=np.int64)
        self.begin = np.concatenate([np.zeros(0, np.int32), *(np.maximum(self.table.get(s * self.size + every), 0) for s in starts)]).astype(np.int32)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of folded letters, runs of others joined into one separator."""
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        return self._lookup(codes[keep])

    def _lookup(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(codes == 0, SEPARATOR, np.where(self.alphabet[at] == codes, at + 1, OTHER)).astype(np.int32)

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per symbol [text, language], whether the text has a letter)."""
        codes, starts = _folded(texts)
        keep = codes > 0
        letters = np.array([bool(keep[a:z].any()) for a, z in zip(starts.tolist(), starts[1:].tolist(), strict=False)], dtype=bool)
        inner = starts[:-1][starts[:-1] < len(keep)]
        at_start = keep[inner]
        keep[1:] |= codes[:-1] > 0
        keep[inner] = at_start  # what is kept of a text is up to that text alone
        begin = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[starts].astype(np.int64)
        symbols = self._lookup(codes[keep])
        del codes, keep
        lengths = np.diff(begin)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = begin[:-1][owner] + place * BLOCK
        size = np.minimum(begin[1:][owner] - first, BLOCK)
        order = np.argsort(-size, kind="stable")
        first, size, owner = first[order], size[order], owner[order]
        n = len(self.langs)
        states, counts = np.zeros((len(owner), n), dtype=np.int32), np.zeros((len(owner), n), dtype=np.int32)
        own_begin = np.arange(n, dtype=np.int64) * self.size
        live_at = np.searchsorted(-size, -np.arange(BLOCK), side="left") if len(size) else []
        for step in range(int(size[0]) if len(size) else 0):
            live = int(live_at[step])
            own = symbols[first[:live] + step].astype(np.int64)[:, None]
            to = self.table.get((states[:live] * np.int64(self.size) + own).ravel()).reshape(live, n)
            miss = to < 0
            counts[:live] += miss
            states[:live] = np.where(miss, self.begin[own_begin + own], to)
        phrases = np.stack([np.bincount(owner, weights=counts[:, k], minlength=len(texts)) for k in range(n)], axis=1) if n else np.zeros((len(texts), 0))
        return phrases / np.maximum(lengths, 1)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        for part in _slices(texts):
            rates, lettered = self.rates(part)
            best = rates.argmin(axis=1)
            inverse = 1 / np.maximum(rates, 1e-9)
            score = inverse[np.arange(len(part)), best] / inverse.sum(axis=1)
            langs += [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            scores += np.where(lettered, score, 0.0).tolist()
        return langs, scores


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Texts of about ``SLICE`` characters together; which slice a text is in does not matter to its result."""
    held: list[str] = []
    chars = 0
    for t in texts:
        if held and chars + len(t) > SLICE:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def fit(labelled: DataFrame) -> Model:
    """Learn from rows (doc_id, text, lang); labels and texts may be null, which are passed over."""
    spark = labelled.sparkSession
    known = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    ranked = known.select("lang", "id", F.xxhash64("id").alias("h"), F.char_length("text").alias("n")).withColumn("over", F.col("n") > LONG)
    # of many rows only those with a low hash can be among the first, so no language is gathered in one place;
    # eight times as many pass as are wanted, and all where there are fewer
    sizes = ranked.groupBy("lang", "over").agg(F.approx_count_distinct("h", 0.05).alias("ids")).collect()  # two rows a language
    ids = spark.createDataFrame(sizes, "lang string, over boolean, ids long")
    low = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("ids") <= 8 * TRAIN_DOCS
    order = Window.partitionBy("lang").orderBy("over", "h", "id", "n")
    few = ranked.join(F.broadcast(ids) if len(sizes) <= 100_000 else ids, ["lang", "over"]).where(low).select("lang", "over", "h", "id", "n").distinct()
    best = few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TRAIN_DOCS).orderBy("lang", "nth").collect()  # TRAIN_DOCS rows a language
    wanted: dict[tuple, int] = {}
    total: dict[str, int] = {}
    for r in best:
        if total.get(r["lang"], 0) < TRAIN_CHARS:
            total[r["lang"]] = total.get(r["lang"], 0) + r["n"]
            wanted[r["lang"], r["id"], r["n"]] = r["nth"]
    chosen: dict[str, dict[int, str]] = {lang: {} for lang in total}
    if wanted:
        asked = spark.createDataFrame([(*k, nth) for k, nth in wanted.items()], "lang string, wanted_id string, n int, nth int")
        rows = known.withColumn("n", F.char_length("text")).join(F.broadcast(asked) if len(wanted) <= 100_000 else asked, ["lang", "n"]).where(F.col("id").eqNullSafe(F.col("wanted_id")))
        for r in rows.select("lang", "nth", "text").toLocalIterator():
            chosen[r["lang"]][r["nth"]] = max(r["text"], chosen[r["lang"]].get(r["nth"], ""))
    texts = {lang: [own[k] for k in sorted(own)] for lang, own in chosen.items()}
    return Model({lang: own for lang, own in texts.items() if any(c.isalpha() for t in own for c in t)})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document (see REPORT)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def work(ids, texts):
            langs, scores = m.predict(texts)
            return {"doc_id": ids, "lang_pred": langs, "score": scores}

        return work

    return shared.map_texts(shared.id_text(docs), REPORT, make)


def held_out(doc_id: str = "doc_id"):
    """Documents that are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without those whose language cannot be told; where ``lang`` is null it becomes what was told.

    Python gets the texts alone, the other columns stay with Spark.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shared.only(None)
        m = held.value
        for texts in batches:
            yield pa.array(m.predict([t or "" for t in texts.to_pylist()])[0], pa.string())
        shared.release()

    shared.bounded_batches(docs.sparkSession)
    told = told.asNondeterministic()  # so that Spark does not call it once for the test and once for the column
    name = shared.row_name()
    rows = docs.withColumn(name, told(F.col("text").cast("string"))).where(F.col(name) != "und")
    return rows.select(*(F.coalesce(F.col("lang"), F.col(name).cast(docs.schema["lang"].dataType)).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))
