"""Full-text queries: tokens, a boolean query language, and BM25 without document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from functools import cached_property, lru_cache

# With other ones, other rows would be found.
STOP = tuple("a an the and or but in on at to for of with by is was are be it as".split())
SUFFIXES = ("ing", "tion", "ed", "ly", "er", "est", "s")
K1, B, AVERAGE, PHRASE = 1.2, 0.75, 100.0, 1.5
#: Words that a question in natural language is freed of before its words are joined by OR.
QUESTION_STOP = frozenset("a an and are as at be before can do does for from how i in is it of on or the this to what which with als auf das der die ein eine für fuer ich jede mit setze und wie".split())


def stem(word: str) -> str:
    for s in SUFFIXES:
        if word.endswith(s):
            return word[: -len(s)] if len(word) > len(s) + 3 else word
    return word


#: Bytes of UTF-8 as words have them: letters in lower case, digits, and blanks for all else.
_LOW = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def _long(word: bytes) -> str | None:
    w = word.decode()
    return stem(w) if len(w) > 1 and w not in STOP else None


_token = lru_cache(maxsize=1 << 16)(_long)


def _words(text: str) -> list[bytes]:
    return text.encode(errors="replace").translate(_LOW).split()


def tokens(text: str | None) -> list[str]:
    return [t for w in _words(text or "") if (t := (_token if len(w) < 40 else _long)(w)) is not None]


#: Words that are no tokens.
_NONE = [w.encode() for w in (*"abcdefghijklmnopqrstuvwxyz0123456789", *(x for x in STOP if len(x) > 1))]


@lru_cache(maxsize=1 << 12)
def _forms(token: str) -> tuple[bytes, ...]:
    """All words whose token it is."""
    return tuple(w.encode() for w in (token, *(token + s for s in SUFFIXES)) if len(w) > 1 and w not in STOP and stem(w) == token)


class Bag:
    """A text's words with their numbers, asked for tokens by the few words that have them; their order only when need be."""

    def __init__(self, text: str):
        words = _words(text)
        self.text, self.words = text, Counter(words)
        get = self.words.get
        self.n = len(words) - sum([get(w, 0) for w in _NONE])

    def count(self, token: str) -> int:
        return sum([self.words.get(w, 0) for w in _forms(token)])

    def __contains__(self, token: str) -> bool:
        return any(w in self.words for w in _forms(token))

    def __len__(self) -> int:
        return self.n

    def like(self, pattern: str) -> set[str]:
        """Tokens that a pattern stands for; a token begins as its word does."""
        head, fits = re.match("[a-z0-9]*", pattern)[0].encode(), re.compile(pattern).fullmatch
        return {t for w in self.words if w.startswith(head) and (t := _long(w)) is not None and fits(t)}

    @cached_property
    def order(self) -> list[str]:
        return tokens(self.text)


def natural(question: str) -> str:
    """A question's content words joined by OR."""
    words = [w.strip("-?") for w in re.findall(r"[a-z0-9_*?%\\-]+", question.lower())]
    kept = [w for w in dict.fromkeys(words) if len(w) > 1 and w not in QUESTION_STOP]
    return " OR ".join(kept) or question.strip()


@lru_cache(maxsize=512)
def parse(query: str):
    """('or' | 'and', parts), ('not', part), ('term', t), ('phrase', [t...]), ('like', pattern), or None for nothing."""
    parts = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def either():
        nonlocal at
        found = [both()]
        while at < len(parts) and parts[at] == "OR":
            at += 1
            found.append(both())
        found = [f for f in found if f]
        return found[0] if len(found) == 1 else ("or", found) if found else None

    def both():
        nonlocal at
        found = []
        while at < len(parts) and parts[at] not in (")", "OR"):
            if parts[at] == "AND":
                at += 1
                continue
            found.append(single())
        found = [f for f in found if f]
        return found[0] if len(found) == 1 else ("and", found) if found else None

    def single():
        nonlocal at
        p = parts[at]
        at += 1
        if p == "NOT":
            inner = single() if at < len(parts) else None
            return ("not", inner) if inner else None
        if p == "(":
            inner = either()
            at += at < len(parts) and parts[at] == ")"
            return inner
        if p.startswith('"'):
            t = tokens(p)
            return ("phrase", t) if len(t) > 1 else ("term", t[0]) if t else None
        if "*" in p or "?" in p:
            return ("like", re.escape(p.lower()).replace(r"\*", ".*").replace(r"\?", "."))
        t = tokens(p)
        return ("term", t[0]) if len(t) == 1 else ("and", [("term", x) for x in t]) if t else None

    return either()


def _like(have: Bag | Container[str], pattern: str) -> set[str]:
    return have.like(pattern) if isinstance(have, Bag) else {t for t in have if re.fullmatch(pattern, t)}


def _in_order(toks: list[str] | Bag, phrase: list[str], have: Container[str]) -> bool:
    if not all(t in have for t in phrase):
        return False
    toks = toks.order if isinstance(toks, Bag) else toks
    return any(t == phrase[0] and toks[k : k + len(phrase)] == phrase for k, t in enumerate(toks))


def match(node, toks: list[str] | Bag, have: Container[str]) -> bool:
    if node is None:
        return False
    kind, x = node
    if kind == "term":
        return x in have
    if kind == "phrase":
        return _in_order(toks, x, have)
    if kind == "like":
        return bool(_like(have, x))
    if kind == "not":
        return not match(x, toks, have)
    return (any if kind == "or" else all)(match(n, toks, have) for n in x)


def _bm25(tf: int, n: int, average: float, idf: float) -> float:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average)) if tf else 0.0


def score(node, toks: list[str] | Bag, average: float = AVERAGE, idf=lambda term: 1.0) -> float:
    if node is None:
        return 0.0
    kind, x = node
    if kind == "term":
        return _bm25(toks.count(x), len(toks), average, idf(x))
    if kind == "phrase":
        return PHRASE * sum(_bm25(toks.count(t), len(toks), average, idf(t)) for t in x) if _in_order(toks, x, toks if isinstance(toks, Bag) else set(toks)) else 0.0
    if kind == "like":
        return sum(_bm25(toks.count(t), len(toks), average, idf(t)) for t in sorted(_like(toks, x)))
    if kind == "not":
        return 0.0
    found = [score(n, toks, average, idf) for n in x]
    return max(found) if kind == "or" else sum(found)


def terms(node) -> list[str]:
    if node is None or node[0] in ("not", "like"):
        return []
    return [node[1]] if node[0] == "term" else list(node[1]) if node[0] == "phrase" else [t for n in node[1] for t in terms(n)]


def snippet(text: str, query: str, before: str = "<b>", after: str = "</b>", dots: str = "...", most: int = 20, whole: bool = False) -> str:
    wanted = set(terms(parse(query)))
    words = re.findall(r"\S+", text)
    hit = [any(t in wanted for t in tokens(w)) for w in words]
    first = hit.index(True) if True in hit else 0
    a = 0 if whole or len(words) <= most else max(0, min(first - most // 4, len(words) - most))
    z = len(words) if whole else min(len(words), a + most)
    shown = [f"{before}{w}{after}" if h else w for w, h in zip(words[a:z], hit[a:z], strict=True)]
    return (dots if a else "") + " ".join(shown) + (dots if z < len(words) else "")
