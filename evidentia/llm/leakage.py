"""Evaluation texts leaking into training text: a generalised suffix automaton of the items, streamed over every document that holds a gram of them."""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.common import spread

#: Words of an item that must stand in a row, and the edits allowed among them.
WORDS, EDITS = 25, 1
#: Letters of items in one automaton, and in all automata a worker holds at once; more items go in further passes over the documents.
BLOCK_LETTERS, PASS_LETTERS = 250_000, 4_000_000
#: Letters of documents that are looked up in the grams of the items at once.
BATCH_LETTERS = 2_000_000
#: Share of a document's letters in leaked spans from which the whole document is removed.
COVERAGE = 0.5

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    dict(zip("авеіјкмнорсѕтухһԁԛԝգոսցհ", "abeijkmhopcstyxhdqwqnugh")) | dict(zip("αβγικνορτυχωеηӏıɡℓøđłŧ", "abyikvoptuxwenliglodlt")) | {"æ": "ae", "œ": "oe", "ß": "ss"}
)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|blockquote|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_HYPHEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_OTHER = re.compile(r"[^a-z0-9]+")
_ODD = re.compile(r"[^\x09\x0a\x0d\x20-\x7e]")
_SYMBOLS = b"abcdefghijklmnopqrstuvwxyz0123456789"
_NO_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)
_CODE = bytes(_SYMBOLS.index(c) if c in _SYMBOLS else 255 for c in range(256))
_SIZE, _STOP = len(_SYMBOLS), 255
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEEN: dict[str, str] = {}


def _visible(m: re.Match) -> str:
    c = m.group()
    got = _SEEN.get(c)
    if got is None:
        got = _SEEN[c] = "" if unicodedata.category(c) in ("Cf", "Mn", "Cc") else c
    return got


def plain(text: str) -> str:
    """Text without markup, entities and invisible characters, words broken by a hyphen at a line end joined."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub(" ", text))
    if not text.isascii():
        text = _ODD.sub(_visible, unicodedata.normalize("NFKD", text))
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    return text


def letters(text: str) -> str:
    """Lower-case letters and digits, look-alikes read as Latin."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(None, _NO_SYMBOL).decode()
    return _OTHER.sub("", text.translate(_LOOKALIKES))


def words_of(text: str) -> list[str]:
    """The words of a plain text, as blanks divide them, each reduced to its letters and digits."""
    return [w for w in map(letters, text.split()) if w]


def codes(s: str) -> bytes:
    """Letters and digits as numbers below _SIZE."""
    return s.encode().translate(_CODE)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _totals(s: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of codes times powers, and the inverse powers: a window's sum times that of its place is its hash wherever it stands."""
    while len(_POWERS[0]) <= len(s):
        for k, by in enumerate((_BASE, _INVERSE)):
            more = np.full(len(_POWERS[k]), by, np.uint64)
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k][-1] * np.cumprod(more)])
    v = np.frombuffer(s, np.uint8).astype(np.uint64) + np.uint64(1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * _POWERS[0][: len(v)])]), _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * _BASE


def _window_hashes(s: bytes, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n codes."""
    if len(s) < n:
        return np.zeros(0, np.uint64)
    total, down = _totals(s)
    return _mixed((total[n:] - total[:-n]) * down[: len(s) - n + 1])


class Automaton:
    """Suffix automaton of the items of one block, over letters; words are bounded by offsets, so blanks and breaks inside words do not matter.

    It is built with a row of _SIZE places a state and then packed: the letters and targets of a state's edges side by side, about 40 bytes a letter.
    """

    built = 0

    def __init__(self, items: list[tuple[int, list[str]]], words: int = WORDS):
        Automaton.built += 1
        self.need = words
        self.ids, self.starts, self.begin, self.end = [], [], [], []  # items; their place in the text; word bounds
        parts, at = [], 0
        for i, ws in items:
            if len(ws) < words:
                continue
            self.ids.append(i)
            self.starts.append(at)
            b, e = array("i"), array("i")
            for w in ws:
                b.append(at)
                at += len(w)
                e.append(at)
            self.begin.append(b)
            self.end.append(e)
            parts.append(codes("".join(ws)) + bytes([_STOP]))
            at += 1
        self.text = b"".join(parts)
        half = self.half = (words - EDITS) // 2  # of words with one edit, one side has so many
        least = [min(e[k + half - 1] - b[k] for k in range(len(b) - half + 1)) for b, e in zip(self.begin, self.end)]
        self.least = min(least, default=1)
        self._build()
        # items by the letters half of the words take at least; each kind is looked up by grams of its own length
        kinds = defaultdict(list)
        for k, n in enumerate(least):
            kinds[n // 16].append(k)
        self.kinds = []
        for ks in (kinds[x] for x in sorted(kinds)):
            n = min(least[k] for k in ks)
            h = _window_hashes(self.text, n)
            place = np.concatenate([np.arange(self.starts[k], self.end[k][-1] - n + 1, dtype=np.int32) for k in ks])
            order = np.argsort(h[place], kind="stable")
            self.kinds.append((n, h[place][order], place[order]))

    def _build(self) -> None:
        row = bytes(4 * _SIZE)
        nxt, link, length, last = array("i", row), array("i", [-1]), array("i", [0]), 0  # no edge leads to the root, so 0 is none
        for ch in self.text:
            if ch == _STOP:  # the next item starts from the root: nothing runs across
                last = 0
                continue
            q = nxt[last * _SIZE + ch]
            if q and length[q] == length[last] + 1:
                last = q
                continue
            cur, p, clone = len(length), last, -1
            nxt.frombytes(row)
            length.append(length[last] + 1)
            link.append(0)
            while p != -1 and not nxt[p * _SIZE + ch]:
                nxt[p * _SIZE + ch] = cur
                p = link[p]
            if p != -1:
                q = nxt[p * _SIZE + ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    nxt.extend(nxt[q * _SIZE : (q + 1) * _SIZE])
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p * _SIZE + ch] == q:
                        nxt[p * _SIZE + ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
            if clone != -1 and length[cur] == length[clone] and not any(nxt[cur * _SIZE : (cur + 1) * _SIZE]):
                last = clone
        table = np.frombuffer(nxt, np.int32).reshape(-1, _SIZE)
        state, letter = table.nonzero()
        self.edges, self.target = letter.astype(np.uint8).tobytes(), array("i", table[state, letter].tobytes())
        self.start = array("i", np.searchsorted(state, np.arange(len(table) + 1)).astype(np.int32).tobytes())
        self.link, self.length = link, length

    def segments(self, s: bytes) -> list[tuple[int, int]]:
        """(start, end) of the longest stretches of s that occur in an item, of at least `least` letters."""
        start, find, target, link, length, least = self.start, self.edges.find, self.target, self.link, self.length, self.least
        v = n = 0
        out = []
        for i, ch in enumerate(s):
            q = find(ch, start[v], start[v + 1])
            if q < 0:
                if n >= least:
                    out.append((i - n, i))
                while v and q < 0:
                    v = link[v]
                    q = find(ch, start[v], start[v + 1])
                n = length[v] + 1 if q >= 0 else 0
            else:
                n += 1
            v = target[q] if q >= 0 else 0
        if n >= least:
            out.append((len(s) - n, len(s)))
        return out

    def passages(self, p: str, s: bytes) -> list[tuple[int, int, int, int]]:
        """(item, words in a row, with at most one edit; start and end of them among the letters) of a plain text p with the codes s: every run with enough words."""
        segs = self.segments(s)
        if not segs:
            return []
        lines: dict[int, list[int]] = defaultdict(list)  # place in the items minus place in s: places in s
        total, down = _totals(s)
        for n, grams, place in self.kinds:
            done, parts = 0, []
            for a, b in segs:  # in order of their ends, and so of their starts
                parts.append(np.arange(max(a, done), max(a, done, b - n + 1)))
                done = max(done, b - n + 1)
            xs = np.concatenate(parts)
            h = _mixed((total[xs + n] - total[xs]) * down[xs])
            lo, hi = np.searchsorted(grams, h), np.searchsorted(grams, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                x = int(xs[k])
                for y in place[lo[k] : hi[k]].tolist():
                    lines[y - x].append(x)
        if not lines:
            return []
        tokens, at = [], 0
        for w in p.split():
            n = len(letters(w))
            if n:
                tokens.append(at)
                at += n
        tokens.append(at)
        out = []
        for d, xs in lines.items():
            until = -1
            for x in sorted(set(xs)):
                if x < until:
                    continue
                k = bisect_right(self.starts, x + d) - 1
                got, until = self._runs(s, x, d, k, tokens)
                out += [(self.ids[k], *run) for run in got if run[0] >= self.need]
        return out

    def _runs(self, s: bytes, x: int, d: int, k: int, tokens: list[int]) -> tuple[list[tuple[int, int, int]], int]:
        """(words, start, end) of the exact run through s[x] and text[x + d], as it is and widened over one edit on either side; the place where it ends."""
        t, begin, end = self.text, self.begin[k], self.end[k]
        lo, hi = x, x
        while lo > 0 and lo + d > begin[0] and s[lo - 1] == t[lo + d - 1]:
            lo -= 1
        while hi < len(s) and hi + d < end[-1] and s[hi] == t[hi + d]:
            hi += 1
        a, b = bisect_left(begin, lo + d), bisect_right(end, hi + d)  # words a..b-1 are whole
        if b - a < self.half:
            return [], max(hi, x + 1)
        left, right = begin[a] - d, end[b - 1] - d
        wider = [(b - a + n, left, stop) for n, stop in self._right(s, right, b, k, tokens)] + [(b - a + n, stop, right) for n, stop in self._left(s, left, a, k, tokens)]
        return [(b - a, left, right), *wider], hi

    def _right(self, s: bytes, at: int, w: int, k: int, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(words gained, end) going on after one edit: word w left out, changed, or another added before it."""
        begin, end = self.begin[k], self.end[k]
        nxt = bisect_right(tokens, at)
        after = tokens[nxt] if nxt < len(tokens) else len(s)
        for start, word, plus in ((at, w + 1, 1), (after, w + 1, 1), (after, w, 0)):
            n, p = 0, start
            while word + n < len(begin) and s.startswith(self.text[begin[word + n] : end[word + n]], p):
                p += end[word + n] - begin[word + n]
                n += 1
            if n:
                yield n + plus, p

    def _left(self, s: bytes, at: int, w: int, k: int, tokens: list[int]) -> Iterator[tuple[int, int]]:
        begin, end = self.begin[k], self.end[k]
        prev = bisect_left(tokens, at) - 1
        before = tokens[prev] if prev >= 0 else 0
        for stop, word, plus in ((at, w - 2, 1), (before, w - 2, 1), (before, w - 1, 0)):
            n, p = 0, stop
            while word - n >= 0 and s.endswith(self.text[begin[word - n] : end[word - n]], 0, p):
                p -= end[word - n] - begin[word - n]
                n += 1
            if n:
                yield n + plus, p


class Index:
    """The automata of some items in blocks, and a filter that names the blocks a text may quote.

    A leaked passage holds an exact run of half of its words. Runs are of kinds by their letters, n or more each; such a run holds one gram of q letters
    that starts at a multiple of n - q + 1 in the document, so these are all the filter must look up: no leak is lost.
    """

    def __init__(self, items: list[tuple[int, list[str]]], words: int = WORDS):
        self.ids: list[list[int]] = []  # items with the same words are one
        known: dict[tuple, int] = {}
        distinct, size = [[]], 0
        for i, ws in items:
            if len(ws) < words:
                continue
            k = known.setdefault(tuple(ws), len(self.ids))
            if k < len(self.ids):
                self.ids[k].append(i)
                continue
            self.ids.append([i])
            n = sum(map(len, ws))
            if size + n > BLOCK_LETTERS and distinct[-1]:
                distinct.append([])
                size = 0
            distinct[-1].append((k, ws))
            size += n
        self.blocks = [Automaton(b, words) for b in distinct if b]
        grams: dict[tuple, list] = defaultdict(list)
        for b, auto in enumerate(self.blocks):
            runs = [(x, e[a + auto.half - 1] - x) for begin, e in zip(auto.begin, auto.end) for a, x in enumerate(begin[: len(begin) - auto.half + 1])]
            kinds: dict[int, list] = defaultdict(list)
            for x, n in runs:
                kinds[n // 16].append((x, n))
            for kind in kinds.values():
                n = min(n for _, n in kind)
                q = max(n - 7, n // 2 + 1)
                starts = np.zeros(len(auto.text) + 1, bool)
                for x, m in kind:
                    starts[x : x + m - q + 1] = True
                held = np.unique(_window_hashes(auto.text, q)[np.flatnonzero(starts)])
                grams[n, q].append((held, np.full(len(held), b, np.int32)))
        self.grams = []
        for (n, q), parts in sorted(grams.items()):
            h, b = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(h, kind="stable")
            bits = max(10, int(len(h)).bit_length() + 4)
            mark = np.zeros(1 << bits, bool)
            mark[h >> np.uint64(64 - bits)] = True
            self.grams.append((q, n - q + 1, h[order], b[order], mark, np.uint64(64 - bits)))
        self.longest = max((q for q, *_ in self.grams), default=0)

    def candidates(self, texts: list[bytes]) -> list[set[int]]:
        """For each text the blocks of which it holds a gram."""
        out: list[set[int]] = [set() for _ in texts]
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size) - size
        joined = b"".join(texts)
        for lo in range(0, len(joined), BATCH_LETTERS):  # a long text goes in parts that overlap
            total, down = _totals(joined[lo : lo + BATCH_LETTERS + self.longest])
            for q, step, held, block, mark, shift in self.grams:
                first = np.maximum(-(-(lo - start) // step), 0)  # of the grams of a text, those that start in this part
                last = np.minimum((size - q) // step, (lo + BATCH_LETTERS - 1 - start) // step)
                n = np.maximum(last - first + 1, 0)
                of = np.repeat(np.arange(len(texts)), n)
                at = start[of] - lo + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n - first, n)) * step
                h = _mixed((total[at + q] - total[at]) * down[at])
                maybe = np.flatnonzero(mark[h >> shift])
                a, b = np.searchsorted(held, h[maybe]), np.searchsorted(held, h[maybe], "right")
                for x, i, j in zip(of[maybe].tolist(), a.tolist(), b.tolist()):
                    if j > i:
                        out[x].update(block[i:j].tolist())
        return out

    def scan(self, texts: list[str | None]) -> Iterator[tuple[str, list[tuple[int, int, int, int]]]]:
        """For each text its plain form and its passages: (number of the item, words, start, end)."""
        held: list[tuple[str, bytes]] = []
        size = 0
        for t in texts:
            p = plain(t) if t else ""
            held.append((p, codes(letters(p))))
            size += len(held[-1][1])
            if size > BATCH_LETTERS:
                yield from self._scan(held)
                held, size = [], 0
        yield from self._scan(held)

    def _scan(self, held: list[tuple[str, bytes]]) -> Iterator[tuple[str, list]]:
        for (p, s), blocks in zip(held, self.candidates([s for _, s in held])):
            yield p, [x for b in sorted(blocks) for x in self.blocks[b].passages(p, s)]

    def found(self, text: str | None) -> dict[int, int]:
        """item id: most words in a row, with at most one edit, for items with enough words."""
        best: dict[int, int] = {}
        for k, n, _, _ in next(iter(self.scan([text])))[1]:
            for i in self.ids[k]:
                best[i] = max(n, best.get(i, 0))
        return best


def _passes(items: DataFrame, item_id: str, text: str, words: int) -> Iterator[Index]:
    """Indexes of at most PASS_LETTERS letters of items, whatever their number; items that are too short are in none. Each is built once, here."""
    held, size = [], 0
    for i, t in items.where(F.col(text).isNotNull()).select(item_id, text).orderBy(item_id).toLocalIterator():
        ws = words_of(plain(t))
        if len(ws) < words:
            continue
        n = sum(map(len, ws))
        if held and size + n > PASS_LETTERS:
            yield Index(held, words)
            held, size = [], 0
        held.append((i, ws))
        size += n
    if held:
        yield Index(held, words)


def _sent(docs: DataFrame, index: Index) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(index)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = WORDS) -> DataFrame:
    """(item_id, doc_id, words): every document that contains `words` or more words of an item in a row, one of them perhaps changed, left out or added.

    Case, punctuation, markup, entities, blanks and line breaks (also inside words), accents, look-alike and invisible characters do not matter. Each
    document is read once, whole, in a narrow pass. Documents that hold no gram of an item at the places where every passage must have one are settled by
    that. The letters of the others run through the suffix automata of the items, which give the longest match ending at each place; stretches that
    half of the words could fill are aligned with every item that holds them and widened over one edit, in both directions. Null and empty texts give no
    rows; items shorter than `words` cannot leak; documents with the same id give rows each; items with the same words are one until the end. The
    automata are built once, on the driver, in blocks, and broadcast: about 70 bytes a letter, of PASS_LETTERS letters at most; more items go in
    further passes. Documents are never moved.
    """
    schema = f"{item_id} bigint, {doc_id} bigint, words int"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _passes(items, item_id, item_text, words):
        sent = _sent(docs, index)

        def scan(batches: Iterator[pd.DataFrame], sent: Broadcast = sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for b in batches:
                rows = []
                for d, (_, spans) in zip(b[doc_id], index.scan(b[text].tolist())):
                    best: dict[int, int] = {}
                    for k, n, _, _ in spans:
                        best[k] = max(n, best.get(k, 0))
                    rows += [(i, d, n) for k, n in best.items() for i in index.ids[k]]
                yield pd.DataFrame(rows, columns=[item_id, doc_id, "words"])

        out = out.unionByName(spread(docs.select(doc_id, text)).mapInPandas(scan, schema))
    return out


def _without(p: str, spans: list[tuple[int, int, int, int]]) -> tuple[str, int, float]:
    """The plain text p without the words of the spans, how many these are, and the share of its letters that leaked."""
    pieces = [(w, len(letters(w))) for w in re.findall(r"\S+|\s+", p)]
    gone = np.zeros(sum(n for _, n in pieces), bool)
    for _, _, x, y in spans:
        gone[x:y] = True
    whole = any(n and gone[at : at + n].all() for (_, n), at in zip(pieces, np.cumsum([0] + [n for _, n in pieces])))
    keep, at, n = [], 0, 0
    for w, size in pieces:
        here = gone[at : at + size]
        if size and (here.all() if whole else here.any()):  # a word of which only a part leaked stays, unless that is all there is
            n += 1
        else:
            keep.append(w)
        at += size
    return re.sub(r"[ \t]{2,}", " ", "".join(keep)).strip(), n, float(gone.mean()) if len(gone) else 0.0


def scrub(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = WORDS, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text, removed_words): the documents without any leaked span, several of one item included. A document of which more than `coverage` of the
    letters leaked has a null text. What is left is looked through again until it holds no leak, as parts may only meet when what stood between them is gone.
    Texts without leaks stay as they are; others lose their markup with the spans. Null texts stay null. Items beyond one pass follow in further passes
    over what the earlier ones left; the share of a document is then that of each pass."""
    out = docs.select(doc_id, text, F.lit(0).alias("removed_words"))
    for index in _passes(items, item_id, item_text, words):
        sent = _sent(docs, index)

        def clean(batches: Iterator[pd.DataFrame], sent: Broadcast = sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for b in batches:
                rows = []
                texts = b[text].tolist()
                for d, t, before, (p, spans) in zip(b[doc_id], texts, b["removed_words"], index.scan(texts)):
                    removed, share = 0, 0.0
                    while spans:
                        t, n, part = _without(p, spans)
                        removed, share = removed + n, max(share, part)
                        p, spans = next(iter(index.scan([t])))
                    rows.append((d, None if share > coverage else t, before + removed))
                yield pd.DataFrame(rows, columns=[doc_id, text, "removed_words"])

        out = spread(out).mapInPandas(clean, f"{doc_id} bigint, {text} string, removed_words int")
    return out
