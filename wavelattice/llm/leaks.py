"""Evaluation passages in corpus documents: pigeonhole pieces, then Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, product
from operator import sub

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.llm.pages import BREAKS, letters, page_columns, restored_lines

# How the parts of an item that are not its passage begin.
_LABELLED = re.compile(r"^\s*(?:question|q|answer|a|choices|options|instruction)s?\s*:", re.I)
_ANSWER = re.compile(r"^\s*(?:answer|a|choices|options|instruction)s?\s*:", re.I)
_CHOICE = re.compile(r"^\s*(?:\(?[A-Ha-h]\)|[A-H][.:])\s")
_INSTRUCTION = re.compile(r"^(?:read|use|choose|answer|select|pick|based on|using|consider|decide|refer|complete)\b[^.]*\b(?:passage|text|answer|below|following|question|option)s?\b", re.I)
_PASSAGE = re.compile(r"^\s*(?:passage|text|context|story|article)\s*:\s*", re.I)
_SENTENCE_END = re.compile(r"(?<=[.?!])[\"')\]]*\s+")


def passage_of(text: str | None) -> str:
    """An item's passage: without its instruction, question and answer choices ('' where nothing is left).

    An item asks one question.  Where no line is labelled as one, the last sentence that ends the
    text in a question mark, or else the first, is the question; all sentences between stay as they stand.
    """
    if not text:
        return ""
    lines = text.split("\n")
    asked = any(_LABELLED.match(line) and not _ANSWER.match(line) for line in lines)
    kept = [_PASSAGE.sub("", line) for line in lines if not _LABELLED.match(line) and not _CHOICE.match(line)]
    sentences = [s for s in _SENTENCE_END.split(" ".join(kept).strip()) if s]

    def is_question(sentence: str) -> bool:
        return sentence.rstrip("\"')] ").endswith("?")

    if sentences and _INSTRUCTION.match(sentences[0]):
        sentences.pop(0)
    if sentences and not asked:
        if is_question(sentences[-1]):
            sentences.pop()
        elif is_question(sentences[0]):
            sentences.pop(0)
    if sentences and _INSTRUCTION.match(sentences[0]):
        sentences.pop(0)
    if sentences and _INSTRUCTION.match(sentences[-1]):
        sentences.pop()
    return " ".join(sentences).strip()


def myers(pattern: str, text: str, most: int) -> int:
    """Edit distance of two short strings by Myers' bit vectors (``most + 1`` where it is larger)."""
    m = len(pattern)
    if abs(m - len(text)) > most:
        return most + 1
    if m == 0:
        return len(text)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) | 1
        mh <<= 1
        pv, mv = (mh | (~(xv | ph) & mask)) & mask, ph & xv & mask
    return score if score <= most else most + 1


def budget(word: str) -> int:
    """Edits that still count as a misread word."""
    n = len(word)
    return 0 if n < 2 else 1 if n < 5 else 2 if n < 9 else 3


def same_word(a: str, b: str) -> bool:
    """Whether either word may be a misreading of the other."""
    if a == b:
        return True
    most = min(budget(a), budget(b))
    return abs(len(a) - len(b)) <= most and any(a[i : i + n] in b for i, n in _cuts(len(a), most)) and myers(a, b, most) <= most


@cache  # words are short: few pairs of numbers
def _cuts(n: int, most: int) -> list[tuple[int, int]]:
    """Start and width of the ``most + 1`` pieces of a word of ``n`` letters."""
    edges = [n * i // (most + 1) for i in range(most + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


class Passages:
    """The query side: distinct passages, their words, and the pieces that pigeonhole them.

    Any ``run`` words of a passage may suffer ``errors`` errors (misread places, line breaks with other matter
    behind them) and so hold ``errors + 1`` pieces, one of which at least stands undamaged in the text.  The pieces of all
    these stretches lie on one grid per passage: m letters hold at least ``(m + 1) // size - 1`` whole pieces of
    ``size`` letters, and the shortest stretch of the passage sets the size.  ``damaged`` is the number of words of
    a stretch that may be beyond recognition as single words.
    """

    def __init__(self, items: list[tuple[int, str]], run: int, errors: int, damaged: int) -> None:
        import ahocorasick

        self.run, self.damaged = run, damaged
        texts: dict[str, list[int]] = defaultdict(list)
        for item, text in items:
            words = [w for w in (letters(x) for x in passage_of(text).split()) if w]
            if len(words) >= run:
                texts[" ".join(words)].append(item)
        self.words = [t.split(" ") for t in texts]
        self.items = list(texts.values())
        pieces: dict[str, set[int]] = defaultdict(set)
        for k, words in enumerate(self.words):
            ends = list(accumulate(map(len, words), initial=0))
            stretches = [ends[i + run] - ends[i] for i in range(len(words) - run + 1)]
            size = max(2, (min(stretches) + 1) // (errors + 2))
            whole = "".join(words)
            for i in range(len(whole) // size):
                pieces[whole[i * size : (i + 1) * size]].add(k)
        self.automaton = ahocorasick.Automaton()
        self.holders = list(pieces.values())
        for i, s in enumerate(pieces):
            self.automaton.add_word(s, i)
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.places: list[dict[str, list[int]]] = []
        for words in self.words:
            where: dict[str, list[int]] = defaultdict(list)
            for p, w in enumerate(words):
                where[w].append(p)
            self.places.append(where)
        # The same pigeonhole for single words: (length, place of the piece, piece) -> words.
        self.vocabulary = {w for words in self.words for w in words}
        self.word_pieces: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for w in self.vocabulary:
            for i, (at, size) in enumerate(_cuts(len(w), budget(w))):
                self.word_pieces[len(w), i, w[at : at + size]].append(w)
        self.memo: dict[str, tuple[str, ...]] = {}
        self.tokens: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.beginnings: dict[str, frozenset[str]] = {}
        self.joined: dict[str, dict[str, tuple[str, ...]]] = defaultdict(dict)
        self.n_joined = 0

    def candidates(self, text: str) -> list[int]:
        """Passages of which ``text`` holds a piece."""
        hit = {i for _, i in self.automaton.iter(text)}
        return sorted(set().union(*[self.holders[i] for i in hit])) if hit else []

    def similar(self, word: str) -> tuple[str, ...]:
        """Words of the passages that ``word`` is or may be a misreading of."""
        got = self.memo.get(word)
        if got is None:
            if word in self.vocabulary:
                got = (word,)
            else:
                n, most, near = len(word), budget(word), set()
                for size in range(max(1, n - most), n + most + 1):
                    for i, (at, width) in enumerate(_cuts(size, min(most, budget("x" * size)))):
                        for j in range(max(0, at - most), min(n - width, at + most) + 1):
                            near.update(self.word_pieces.get((size, i, word[j : j + width]), ()))
                got = tuple(w for w in near if myers(w, word, min(most, budget(w))) <= min(most, budget(w)))
            if len(self.memo) > 200_000:  # only a cache: it may be emptied at any time
                self.memo.clear()
            self.memo[word] = got
        return got

    def read(self, token: str) -> tuple[str, tuple[str, ...]]:
        """The letters of a token of a line, and the words of the passages that these may be."""
        got = self.tokens.get(token)
        if got is None:
            word = letters(token)
            got = (word, self.similar(word) if word else ())
            if len(self.tokens) > 200_000:  # only a cache
                self.tokens.clear()
            self.tokens[token] = got
        return got

    def begun(self, half: str) -> frozenset[str]:
        """Words of the passages that begin like ``half``, the first part of a broken word, up to one misread letter."""
        got = self.beginnings.get(half)
        if got is None:
            n, m = len(half), len(half) // 2
            left, right = half[:m], half[m:]  # one error leaves either part whole
            got = frozenset(w for w in self.vocabulary if len(w) > n and (w.startswith(half) or (n > 2 and (w.startswith(left) or right in w) and myers(w[:n], half, 1) <= 1)))
            if len(self.beginnings) > 50_000:  # only a cache
                self.beginnings.clear()
            self.beginnings[half] = got
        return got

    def joins(self, half: str, rest: str, whole: frozenset[str]) -> tuple[str, ...]:
        """The words of ``whole`` that a broken word's two parts are, or may be a misreading of; kept in ``joined``."""
        n, ends = len(half) + len(rest), set(rest[-2:])
        # one of the last two letters stands
        got = tuple(w for w in whole if -3 <= len(w) - n <= 3 and not ends.isdisjoint(w[-2:]) and same_word(w, half + rest))
        if self.n_joined > 200_000:  # only a cache
            self.joined.clear()
            self.n_joined = 0
        self.joined[half][rest] = got
        self.n_joined += 1
        return got


class Page:
    """A page's words by line, in reading order, and which words of the passages each may be a misreading of."""

    def __init__(self, passages: Passages, lines: list[str]) -> None:
        self.passages = passages
        self.words: list[list[str]] = []
        self.similar: list[list[tuple[str, ...]]] = []
        #: For each line the words that its last one, broken by a sign, may begin.
        self.begun: list[frozenset[str]] = []
        self.known: set[str] = set()
        for line in lines:
            line = line.rstrip()
            read = [r for r in map(passages.read, line.replace("—", " ").split()) if r[0]]
            words = [w for w, _ in read]
            self.words.append(words)
            self.similar.append([near for _, near in read])
            self.begun.append(passages.begun(words[-1]) if words and line[-1:] in BREAKS else frozenset())
            self.known.update(*[near for _, near in read if near])
        #: The same with all words that a broken one may be.
        self.maybe = self.known.union(*self.begun)

    def may_hold(self, k: int) -> bool:
        """Whether the page knows all but ``damaged`` words of a stretch of passage ``k``, broken words taken as whole."""
        p = self.passages
        sums = list(accumulate(map(self.maybe.__contains__, p.words[k]), initial=0))
        return max(map(sub, sums[p.run :], sums)) >= p.run - p.damaged

    def complete(self, found: list[int]) -> None:
        """Joins broken words of the passages ``found``, and notes where all words stand and which are neighbours."""
        wanted = {w for k in found for w in self.passages.words[k]}
        #: For each line the words that its first one completes: the line of the first part and the word.
        self.completed: list[list[tuple[int, str]]] = []
        #: Pairs of neighbours within a line, and words at the ends and starts of lines.
        self.pairs: set[tuple[str, str]] = set()
        self.firsts: set[str] = set()
        self.lasts: set[str] = set()
        #: Where each word of these passages stands: line and place in the line, broken words at the line that completes them.
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        halves: list[tuple[int, str, frozenset[str], dict[str, tuple[str, ...]]]] = []
        for y, (words, similar, begun) in enumerate(zip(self.words, self.similar, self.begun)):
            done = []
            if words:
                rest = words[0]
                for x, half, whole, memo in halves:
                    got = memo.get(rest)
                    for w in self.passages.joins(half, rest, whole) if got is None else got:
                        done.append((x, w))
            self.completed.append(done)
            for c, near in enumerate(similar):
                for w in near:
                    if w in wanted:
                        self.places[w].append((y, c))
            for _, w in done:
                self.places[w].append((y, 0))
            for left, right in zip(similar, similar[1:]):
                if left and right:
                    self.pairs.update(product(left, right))
            if words:
                first = [w for _, w in done]
                self.known.update(first)
                self.pairs.update(product(first, similar[1] if len(words) > 1 else ()))
                self.firsts.update(similar[0], first)
                self.lasts.update(similar[-1], first if len(words) == 1 else ())
                if begun:
                    if not begun.isdisjoint(wanted):
                        halves.append((y, words[-1], begun, self.passages.joined[words[-1]]))
                    self.lasts.update(*similar[-2:-1])


def longest_run(passages: Passages, k: int, page: Page, lone: int) -> bool:
    """Whether ``run`` consecutive words of passage ``k`` stand in the page.

    Words match when equal or within ``budget`` of
    Myers' distance.  A run goes on over a word split in two or two words run together,
    over a lone replaced word (at most ``lone`` in any ``run`` words), and at a line's end to the
    start of any line below, with a word that the line break divides.  Only stretches of which the page
    knows all but ``damaged`` words, and the pairs of neighbours that these leave, wherever they stand, are followed word by word.
    """
    need, own = passages.run, passages.words[k]
    size = len(own)
    sums = list(accumulate(map(page.known.__contains__, own), initial=0))
    if max(map(sub, sums[need:], sums)) < need - passages.damaged:
        return False
    linked = list(accumulate(((a, b) in page.pairs or (a in page.lasts and b in page.firsts) for a, b in zip(own, own[1:])), initial=0))
    where: dict[str, list[int]] = {}
    open_to = -1
    for p in range(size):
        # a word that is not known parts two links
        if p + need <= size and sums[p + need] - sums[p] >= need - passages.damaged and linked[p + need - 1] - linked[p] >= need - 1 - 2 * passages.damaged:
            open_to = p + need
        if p < open_to:
            where.setdefault(own[p], []).append(p)
    if not where:
        return False
    # A state holds the run's length and the places of replaced words within the last ``need`` words.
    State = tuple[int, tuple[int, ...]]
    empty: dict[int, State] = {}
    above: dict[int, State] = {}  # the best states at the ends of the lines above
    heads: list[dict[int, State]] = []  # of each line the states before its last word

    def better(a: State | None, b: State) -> State:
        return b if a is None or (b[0], -len(b[1])) > (a[0], -len(a[1])) else a

    def grown(state: State, p: int, missed: int | None = None) -> State:
        length, gone = state[0] + (1 if missed is None else 2), state[1]
        if missed is not None:
            gone = (*gone, missed)
        if gone:
            gone = tuple(g for g in gone if g > p - need)
            if len(gone) > lone:  # the run starts anew behind the oldest replaced word
                cut = gone[-lone - 1]
                gone = gone[-lone:] if lone else ()
                length = min(length, p - cut)
        return (length, gone)

    starts: dict[int, set[int]] = defaultdict(set)  # by line the places of words to follow
    for w in where:
        for y, c in page.places.get(w, ()):
            starts[y].add(c)
    for y, (words, similar, completed) in enumerate(zip(page.words, page.similar, page.completed)):
        before2, before = empty, empty  # states at the last two words of this line
        if y not in starts:  # no word to follow, so no state at the end of the line
            heads.append(above.copy() if len(words) == 1 and page.begun[y] else empty)
            continue
        here = starts[y]
        for c in range(min(here), len(words)):
            if not before and not before2 and c not in here:
                continue
            like, word = similar[c], words[c]
            now: dict[int, State] = {}
            for w in like:
                for p in where.get(w, ()):
                    best: State | None = (1, ())
                    if c:
                        if (s := before.get(p - 1)) is not None:
                            best = better(best, grown(s, p))
                        if (s := before2.get(p - 2)) is not None:
                            best = better(best, grown(s, p, p - 1))
                    if c <= 1 and above:
                        if c == 0 and (s := above.get(p - 1)) is not None:
                            best = better(best, grown(s, p))
                        if (s := above.get(p - 2)) is not None:
                            best = better(best, grown(s, p, p - 1))
                    now[p] = better(now.get(p), best)
            if before2:  # a word in two pieces
                whole = words[c - 1] + word
                for q, s in before2.items():
                    if q + 1 < size and abs(len(own[q + 1]) - len(whole)) <= 1 and myers(own[q + 1], whole, 1) <= 1:
                        now[q + 1] = better(now.get(q + 1), grown(s, q + 1))
            if before and len(word) > 5:  # two words in one
                for q, s in before.items():
                    if q + 2 < size and abs(len(own[q + 1]) + len(own[q + 2]) - len(word)) <= 1 and myers(own[q + 1] + own[q + 2], word, 1) <= 1:
                        now[q + 2] = better(now.get(q + 2), grown(grown(s, q + 1), q + 2))
            if c == 0:
                for x, w in completed:
                    for p in where.get(w, ()):
                        s = heads[x].get(p - 1)
                        now[p] = better(now.get(p), grown(s, p) if s is not None else (1, ()))
            for s in now.values():
                if s[0] >= need:
                    return True
            before2, before = before, now
        heads.append(above.copy() if len(words) == 1 else before2)
        for p, s in before.items():
            above[p] = better(above.get(p), s)
        if before2 and lone:  # the last word replaced: the run goes on two words after the one before it
            for p, s in before2.items():
                if p + 1 not in before:
                    g = grown(s, p + 1)
                    if len(g[1]) < lone:
                        above[p + 1] = better(above.get(p + 1), (g[0], (*g[1], p + 1)))
    return False


def leaks_in(passages: Passages, text: str, x, y, lone: int) -> list[int]:
    """Ids of the items whose passage stands in the page."""
    if passages.empty:
        return []
    lines = restored_lines(text, x, y)
    found = passages.candidates(letters("".join(lines)))
    if not found:
        return []
    page = Page(passages, lines)
    found = [k for k in found if page.may_hold(k)]
    if not found:
        return []
    page.complete(found)
    return [item for k in found if longest_run(passages, k, page, lone) for item in passages.items[k]]


def find_leaks(
    items: DataFrame,
    documents: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    doc_id: str = "doc_id",
    doc_text: str = "text",
    boxes: str | None = "line_boxes",
    run: int = 18,
    errors: int = 5,
    damaged: int = 3,
    lone: int = 1,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """``item_id, doc_id``: every pair where at least ``run`` consecutive words of the item's passage stand in the document.

    The items are a stated query set: they are read in blocks of at most ``block_chars``
    characters, each block goes to all tasks, and the corpus is scanned once per block
    without any exchange.  Per document, whole and in reading order, an automaton finds the
    exact pieces of all passages (pigeonhole: ``errors`` errors leave one of ``errors + 1`` pieces
    whole); one hit makes the passage a candidate on the page, whose words are then all
    verified with Myers' bit-parallel distance by ``longest_run``.

    Null and empty texts leak nothing; a passage of fewer than ``run`` words cannot be found;
    items that share a passage are all returned; repeated rows give repeated pairs.
    """
    queries = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = queries.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    pages = page_columns(documents, doc_id, doc_text, boxes).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in part.collect()]

        def scan(batches: Iterator[pd.DataFrame], rows: list = rows) -> Iterator[pd.DataFrame]:
            passages = Passages(rows, run, errors, damaged)
            for pdf in batches:
                pairs = [
                    (item, doc)
                    for doc, text, x, y in zip(pdf["doc_id"], pdf["text"], pdf["x"], pdf["y"])
                    for item in leaks_in(passages, text, x, y, lone)
                ]
                yield pd.DataFrame(pairs, columns=["item_id", "doc_id"], dtype="int64")

        found = pages.mapInPandas(scan, "item_id long, doc_id long")
        out = found if out is None else out.unionByName(found)
    return out
