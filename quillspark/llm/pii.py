"""Personal data by weak supervision.

Base spans follow fixed patterns (email, ip, card, phone) and always stay.
Beside them, wider candidates are gathered: email addresses written with "at"
and "dot", social security numbers, bank account numbers, and names of persons.
Three labelers vote on every candidate, base or not, with yes, no or nothing:

* regex - does its form hold (check digits, ranges, known shapes)?
* gazetteer - is a part of it in a list (given names, top-level domains, issuers' prefixes, countries)?
* context - do the words just before it speak for or against it?

Votes and a few marks of the candidate make a pattern, a small number, of
which there are at most ``PATTERNS``.  The corpus is counted by pattern over all
rows; only those counts reach the driver.  Expectation-maximisation estimates
from them how reliable each labeler is for each kind and how likely each pattern
is to be right.

The final span classifier is a logistic one.  Beside the pattern it sees the
text that no labeler looks at: the candidate's shape and length and the words
before and after it, hashed to ``HASHED`` features.  It is fitted to the soft
labels of a bounded sample, the ``SAMPLE`` candidates with the lowest hash of
their document and place, and then scores every candidate; those that reach
``THRESHOLD`` become spans.

Defined cases: null and empty texts have no spans; repeated rows and rows with
null ids are reported like others; with no candidates no model is needed; extra
columns are not read.  All patterns work in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_at", "ssn", "iban", "name")
LABELERS = ("regex", "gazetteer", "context")
THRESHOLD = 0.5
#: kind, three votes of three values, four marks.
PATTERNS = len(KINDS) * 27 * 16
#: Candidates that the classifier is fitted to, and its hashed features.
SAMPLE, HASHED = 20_000, 1 << 13

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r" ?[(\[] ?at ?[)\]] ?([A-Za-z0-9-]+(?: ?(?:[(\[] ?dot ?[)\]]|\.) ?[A-Za-z0-9-]+)+)", re.I | re.A)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
GIVEN_NAMES = tuple(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie Ronald Rebecca Timothy Laura Jason Sharon Jeffrey Cynthia Ryan Kathleen Jacob Amy Gary Angela "
    "Anna Peter Maria Hans Klaus Petra Sabine Wolfgang Ursula Heinz Monika Jürgen Andrea Stefan Claudia Uwe Birgit Jean Pierre Marie Sophie Jacques Nathalie Michel Isabelle Philippe Sylvie Alain Catherine Nicolas Camille Carlos Juan Carmen Luis Ana José Francisco Antonio Isabel Manuel Pilar Javier Dolores Miguel Teresa Marco Giulia Luca Chiara Paolo Francesca Ivan Olga Dmitri Natalia Wei Li Yuki Hiroshi Priya Rahul Fatima Ahmed Omar Aisha".split()
)
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Mme", "Señor", "Señora")
_NAME = re.compile(r"\b(?:" + "|".join(map(re.escape, (*GIVEN_NAMES, *TITLES))) + r") [A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ][a-zà-ÿ]+)?\b")
TLDS = frozenset("com org net edu gov mil int io ai app dev info biz de fr es uk eu ch at it nl be dk se no fi pl pt cz gr ie ru us ca mx br ar au nz jp cn in kr za".split())
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split())
CUES = {
    "email": ("mail", "contact", "write"), "email_at": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("tel", "phone", "call", "fax", "mobile"), "ssn": ("ssn", "social"),
    "iban": ("iban", "account", "konto"), "name": ("name", "dear", "regards", "signed", "by"),
}
AGAINST = ("version", "isbn", "order", "invoice", "part", "serial", "ticket", "example", "page")
REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _emails(text: str):
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, whether it passes); failing matches are listed for the labelers' sake."""
    found = []
    if "@" in text:
        found += [(a, 0, b, True) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        found.append((m.start(), 1, m.end(), all(map(_small, m.group().split(".")))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d) <= 19:
                found.append((m.start(), 2, m.end(), luhn(d)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            found.append((m.start(), 3, m.end(), 9 <= len(_digits(m.group())) <= 15))
    return sorted(found)


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of candidates beyond the base patterns."""
    found = []
    if "at" in text or "AT" in text or "At" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 4, m.end()))
                done = m.end()
    if "-" in text:
        found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    found += [(m.start(), 6, m.end()) for m in _IBAN.finditer(text)]
    found += [(m.start(), 7, m.end()) for m in _NAME.finditer(text)]
    return found


def _form(kind: str, s: str, passes: bool) -> int:
    if kind in BASE:
        return 1 if passes else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "iban":
        t = s.replace(" ", "")
        t = t[4:] + t[:4]
        return 1 if int("".join(str(int(c, 36)) for c in t)) % 97 == 1 else -1
    return 1 if kind == "email_at" else 0


def _listed(kind: str, s: str) -> int:
    if kind in ("email", "email_at"):
        return 1 if re.split(r"[.)\] ]", s)[-1].lower() in TLDS else -1
    if kind == "card":
        d = _digits(s)
        return 1 if d[0] in "45" or d[:2] in ("34", "37") or d[:4] == "6011" else -1
    if kind == "iban":
        return 1 if s[:2] in COUNTRIES else -1
    if kind == "name":
        return 1 if s.split(" ")[0] in GIVEN_NAMES or s.split(" ")[-2] in GIVEN_NAMES else 0
    if kind == "ip":
        return 1 if s.split(".")[0] not in ("0", "127", "255") else -1
    return 0


def _heard(kind: str, before: str) -> int:
    words = re.findall(r"[a-z]+", before.lower())
    return 1 if any(w.startswith(c) for w in words for c in CUES[kind]) else -1 if any(w in AGAINST for w in words) else 0


def pattern_of(text: str, kind_no: int, start: int, end: int, passes: bool = True) -> int:
    """Votes and features of a candidate, as one number below ``PATTERNS``."""
    kind, s = KINDS[kind_no], text[start:end]
    before, after = text[max(0, start - 32) : start], text[end : end + 1]
    key = kind_no
    for vote in (_form(kind, s, passes), _listed(kind, s), _heard(kind, before)):
        key = key * 3 + vote + 1
    for bit in (not before[-1:].isalnum(), not after.isalnum(), any(c in s for c in " -()"), end - start > 16):
        key = key * 2 + bit
    return key


def features_of(text: str, kind_no: int, start: int, end: int, pattern: int) -> list[int]:
    """Hashed features of a candidate: its pattern, shape and length, and the words beside it."""
    s = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[0-9]", "0", s[:64]))))
    before = re.findall(r"\w+", text[max(0, start - 40) : start])
    after = re.findall(r"\w+", text[end : end + 40])
    named = (f"p{pattern}", f"s{shape}", f"l{(end - start).bit_length()}", "b" + (before[-1].lower() if before else ""), "c" + (before[-2].lower() if len(before) > 1 else ""), "a" + (after[0].lower() if after else ""))
    return [zlib.crc32(f"{kind_no} {n}".encode("utf-8", "surrogatepass")) % HASHED for n in named]


def _unpack(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.stack([keys >> k & 1 for k in (3, 2, 1, 0)], axis=1)
    rest = keys >> 4
    return rest // 27, np.stack([rest // 9 % 3, rest // 3 % 3, rest % 3], axis=1), bits


def aggregate_votes(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """Expectation-maximisation over pattern counts: (probability that a pattern is right, reliabilities).

    reliabilities[kind, labeler, truth, vote] is the chance of a vote (no, none, yes) given the truth.
    """
    keys = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[k] for k in keys.tolist()], dtype=float)
    kind, votes, _ = _unpack(keys)
    score = (votes - 1).sum(axis=1)
    p = 1 / (1 + np.exp(-2.0 * score - 0.5))
    table = np.zeros((len(KINDS), len(LABELERS), 2, 3))
    for _ in range(rounds):
        prior = np.full((len(KINDS), 2), 1.0)
        table[:] = np.array([[0.8, 1.0, 0.4], [0.4, 1.0, 0.8]])
        for k, w in ((1, p * n), (0, (1 - p) * n)):
            np.add.at(prior[:, k], kind, w)
            for j in range(len(LABELERS)):
                np.add.at(table[:, j, k], (kind, votes[:, j]), w)
        table /= table.sum(axis=3, keepdims=True)
        odds = np.log(prior[kind, 1] / prior[kind, 0])
        for j in range(len(LABELERS)):
            odds = odds + np.log(table[kind, j, 1, votes[:, j]] / table[kind, j, 0, votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys.tolist(), p.tolist(), strict=True)), table


def train_classifier(rows: list[list[int]], soft: list[float], steps: int = 200, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over hashed features (the last is the bias), fitted to soft labels; every row weighs the same."""
    weights, squares = np.zeros(HASHED + 1), np.full(HASHED + 1, 1e-6)
    if not rows:
        return weights
    at = np.concatenate([np.array(rows, dtype=np.int64), np.full((len(rows), 1), HASHED)], axis=1)
    y = np.array(soft)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(weights[at].sum(axis=1), -30, 30)))
        slope = np.bincount(at.ravel(), weights=np.repeat((p - y) / len(y), at.shape[1]), minlength=HASHED + 1) + decay * weights
        squares += slope * slope
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def classify(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(weights[np.array(rows, dtype=np.int64)].sum(axis=1) + weights[HASHED], -30, 30)))


_CANDIDATES = "doc_id long, starts array<int>, kinds array<int>, ends array<int>, passes array<boolean>, patterns array<int>, features array<array<int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Per document its candidates in order of start, with the pattern and the features of each."""

    def work(ids, texts):
        out = {k: [] for k in ("starts", "kinds", "ends", "passes", "patterns", "features")}
        for t in texts:
            found = sorted(base_spans(t) + [(*s, True) for s in wide_spans(t)]) if t else []
            rows = [(a, k, b, ok, pattern := pattern_of(t, k, a, b, ok), features_of(t, k, a, b, pattern)) for a, k, b, ok in found]
            for c, v in zip(out, zip(*rows, strict=True) if rows else ([],) * 6, strict=True):
                out[c].append(list(v))
        return {"doc_id": ids, **out}

    return shared.map_texts(shared.id_text(docs), _CANDIDATES, lambda: work)


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans array<struct<start, kind, end, score>> of every document; kind is a number into KINDS."""
    held = shared.stored(candidates(docs), shared.fresh_dir(docs.sparkSession, "pii"))
    counted = held.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()  # PATTERNS rows at most
    soft, _ = aggregate_votes({r["p"]: r["count"] for r in counted}) if counted else ({}, None)
    every = held.select("doc_id", F.posexplode(F.arrays_zip("patterns", "features")).alias("at", "c")).select("c.patterns", "c.features", F.xxhash64("doc_id", "at", "c").alias("h"))
    sample = every.orderBy("h", "features").limit(SAMPLE).collect()  # SAMPLE rows at most
    weights = train_classifier([r["features"] for r in sample], [soft[r["patterns"]] for r in sample])
    kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            spans = []
            for starts, kinds, ends, passes, features in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4, 6)), strict=True):
                rows = zip(starts, kinds, ends, passes, classify(weights, features).tolist(), strict=True)
                spans.append([{"start": a, "kind": k, "end": e, "score": p} for a, k, e, ok, p in rows if (ok if k < len(BASE) else p >= threshold)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    return held.mapInArrow(run, "doc_id long, spans array<struct<start:int,kind:int,end:int,score:double>>")


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests per document (see REPORT)."""
    found = find(docs)
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{BASE[k]}") for k in range(len(BASE))), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
            done = b
    return "".join([*out, text[done:]])


def digest_of(text: str | None) -> str:
    """base_sha256 of one text, on the driver."""
    return hashlib.sha256(written([(a, k, b) for a, k, b, ok in base_spans(text or "") if ok]).encode()).hexdigest()
