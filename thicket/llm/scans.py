"""Problem 2: text of scanned pages repaired into continuous paragraphs.

Furniture. Running lines are found by an averaged perceptron over a line's place on the page (breaks above and below, form
feeds, numbers beside it), its form, and its recurrence in the document and over the corpus; page numbers by counting up from
page to page or standing by other furniture.

Editor. An averaged perceptron edits characters: keep, replace, delete, insert and, at a line's end, join. It is trained
on words of the documents that were not scanned, spoiled by the confusions that the scanned ones show (a word unknown
to the clean documents that one confusion turns into a known word is evidence for the confusion), and half of the time
taken for unknown, so that it learns from the letters too. Whether a result is a known word is one feature of many.

Two passes. The first counts words and line patterns per partition (in plain counters, summed by Spark); what comes to
the driver is bounded by shares of the totals: words of at least WORD_SHARE of all words, patterns on at least
PATTERN_SHARE of the documents, and confusions of a thousandth of the evidence. The second
pass repairs every document in place; nothing is shuffled.
"""

from __future__ import annotations

import ast
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.lookalikes import single_map
from thicket.session import spread

WORD_SHARE, PATTERN_SHARE = 2e-6, 0.001
#: Words that the editor is trained on in a round, and documents whose lines train the finder of running lines.
FIT, FIT_DOCUMENTS = 5_000, 1_000
#: Lines of text between a line and the break of the page that it may belong to.
NEAR = 2
#: Words whose decisions a task remembers.
MEMO = 200_000
MARKS = "-‐¬\xad"
_MARK_SET = frozenset(MARKS)
_WORD = re.compile(r"[^\W_]+(?:[-‑’'][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+(?:[-‑’'][^\W\d_]+)*")
_THREE_DIGITS = re.compile(r"\d.*\d.*\d")
_MARKUP = re.compile(r"\s*(?:[#|>]|[*\-+] |\d+\. |```)")
_HEADING = re.compile(r"#{1,6}\s+(.*)")
_BREAK = re.compile(r"([^\W_]+(?:[-‑’'][^\W_]+)*)([-‐¬\xad])[ \t]*$")
_PAGE = re.compile(r"^(?P<a>[\[\-–—(]?)\s*(?P<w>p\.|pp\.|page|seite|s\.|p[áa]gina|p[áa]g\.)?\s*(?P<n>[\dlIOoSB]{1,4}|[ivxlc]{1,7})\s*(?:(?P<of>of|von|de|sur|/)\s*(?P<m>[\dlIOoSB]{1,4}))?\s*(?P<b>[\])\-–—.]?)$", re.I)
_DIGIT = str.maketrans("lIOoSB", "110058")
_SPLIT = re.compile(r"^(?:[\dlIO]{1,4}\s{2,}(.+?)|(.+?)\s{2,}[\dlIO]{1,4})$")
_END = re.compile(r"[.!?:;…][\"'”’)\]*]*\s*$")


def plain(text: str) -> str:
    """The text with look-alike characters in one form (problem 5), line-break marks kept; lines stay what they are."""
    if _Look.table is None:
        _Look.table = {k: v for k, v in single_map().items() if chr(k) not in MARKS and "\n" not in v}
        _Look.odd = {chr(k) for k in _Look.table}
    if not text.isascii():
        for ch in _Look.odd.intersection(text):  # few kinds in a text; none maps to another
            text = text.replace(ch, _Look.table[ord(ch)])
    return re.sub(r"\xad(?![ \t]*(?:\n|$))", "", text) if "\xad" in text else text


class _Look:
    table = None
    odd = None


def scanned(text: str) -> bool:
    """Whether the prose of a document is broken into lines of a page.

    Prose in lines of over 100 characters is not; prose in shorter lines is where one follows another. The larger part,
    in characters, decides, so that single long lines don't make a scanned document another.
    """
    lines = text.split("\n")
    long = sum(len(x) for x in lines if len(x) > 100 and not _MARKUP.match(x))
    if not long:
        return True
    short = [bool(x.strip()) and len(x) <= 100 and not _MARKUP.match(x) for x in lines]
    return sum(len(x) for x, own, before, after in zip(lines, short, [False, *short], [*short[1:], False]) if own and (before or after)) > long


def pattern(line: str) -> str:
    """A line without what changes from page to page and document to document."""
    return re.sub(r"\d+", "9", re.sub(r"\b[A-Z]{2,3}-\d+", "AA-9", line.strip()))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, item, n): words of clean (w) and scanned (s) documents; documents that repeat a line's pattern by breaks of pages (p)."""
    clean, noisy, again = Counter(), Counter(), Counter()
    for pdf in batches:
        for t in map(plain, pdf["t"]):
            if not scanned(t):
                clean.update(_LETTERS.findall(t.lower()))
                continue
            noisy.update(w for w in _WORD.findall(t.lower()) if len(w) > 4 and not _THREE_DIGITS.search(w))
            lines = t.split("\n")
            page = Page(lines)
            own = Counter(page.pattern(i) for i in page.near if i not in page.numbers)
            again.update(k for k, n in own.items() if n > 1 and len(k) > 3)
        if len(clean) + len(noisy) + len(again) > 500_000:  # a partition of any size in bounded memory
            yield _rows(clean, noisy, again)
            clean, noisy, again = Counter(), Counter(), Counter()
    yield _rows(clean, noisy, again)


def _rows(clean: Counter, noisy: Counter, again: Counter) -> pd.DataFrame:
    rows = [(kind, k, n) for kind, counts in (("w", clean), ("s", noisy), ("p", again)) for k, n in counts.items()]
    return pd.DataFrame(rows, columns=["kind", "item", "n"])


_DIGITS = re.compile(r"[0-9]+")


class Page:
    """Where the lines of a scanned document stand. ``up``, ``down``: how many lines of text lie between a line and a break (a
    blank line, a form feed, the start or end). ``near``: the lines that may be a page's margin: at most NEAR lines
    from a break, beside a number that stands alone, recurring but for digits, or like the title."""

    def __init__(self, lines: list[str]):
        self.lines, self.strip = lines, [x.strip() for x in lines]
        self.code: set[int] = set()
        fenced = False
        for i, s in enumerate(self.strip):
            fence = s.startswith("```")
            if fenced or fence:
                self.code.add(i)
            fenced = fenced != fence
        self.filled = [i for i, s in enumerate(self.strip) if s]
        self.place = {i: k for k, i in enumerate(self.filled)}
        self.up, self.down = self._distance(range(len(lines)), -1), self._distance(range(len(lines) - 1, -1, -1), 1)
        self.head = next((m.group(1).strip().lower() for x in self.strip if (m := _HEADING.match(x))), None)
        bare = [_DIGITS.sub("", s).strip() for s in self.strip]
        self.plain = {i for i in self.filled if len(bare[i]) == len(self.strip[i])}  # without digits: their own pattern
        times = Counter(bare)
        self.numbers = {i for i in self.filled if len(bare[i]) < 12 and _PAGE.match(self.strip[i])}
        self.fed = any("\x0c" in x for x in lines)
        beside = {j for i in self.numbers for j in (self.beside(i, -1), self.beside(i, 1))}
        self.near = [
            i for i in self.filled
            if i not in self.code and not _MARKUP.match(self.strip[i]) and (self.up[i] <= NEAR or self.down[i] <= NEAR or i in beside or (times[bare[i]] > 1 and len(bare[i]) > 3) or (self.head and self._like(bare[i])))
        ]

    def _distance(self, order: range, _side: int) -> list[int]:
        out, n = [0] * len(self.lines), 0
        for i in order:
            if not self.strip[i] or "\x0c" in self.lines[i]:
                out[i] = n = 0
                continue
            out[i] = n
            n += 1
        return out

    def _like(self, s: str) -> bool:
        """Of the title's length, or with its beginning or end."""
        s = s.rpartition(" / ")[2].lower()
        return abs(len(s) - len(self.head)) <= 2 or s[:4] == self.head[:4] or s[-4:] == self.head[-4:]

    def pattern(self, i: int) -> str:
        return self.strip[i] if i in self.plain else pattern(self.strip[i])

    def beside(self, i: int, d: int) -> int | None:
        k = self.place[i] + d
        return self.filled[k] if 0 <= k < len(self.filled) else None


class Perceptron:
    """Averaged perceptron over edits; an edit is a sequence of character operations, its score the sum of their features."""

    def __init__(self) -> None:
        self.w: dict = defaultdict(float)
        self.sum: dict = defaultdict(float)
        self.t = 0

    def score(self, feats: list) -> float:
        return sum(self.w.get(f, 0.0) for f in feats)

    def best(self, options: list[tuple]) -> int:
        return max(range(len(options)), key=lambda i: (self.score(options[i][1]), -i))

    def learn(self, options: list[tuple], truth: int) -> None:
        self.t += 1
        guess = self.best(options)
        if guess != truth:
            for f in options[truth][1]:
                self.w[f] += 1
                self.sum[f] += self.t
            for f in options[guess][1]:
                self.w[f] -= 1
                self.sum[f] -= self.t

    def average(self) -> None:
        self.w = {f: w - self.sum[f] / (self.t + 1) for f, w in self.w.items() if w or self.sum[f]}


class Editor:
    """Decides about words and line ends, character by character. ``vocab``: word -> count; ``channel``: (seen, meant) -> weight.

    A script keeps every character of a word but those of one place (two in long words), which a confusion of the channel
    replaces, with an insertion or a deletion where it changes the length. A script is scored by the operations at every
    place where the channel could act, with the characters around them, by how usual the three-letter runs are that it
    leaves, and by whether the result is a known word. Neither must the result be known nor the word unknown: the weights decide.
    """

    def __init__(self, vocab: dict[str, int], channel: dict[tuple[str, str], float]):
        self.vocab, self.channel = vocab, channel
        self.by_seen: dict[str, list[str]] = defaultdict(list)
        for seen, meant in sorted(channel):
            self.by_seen[seen].append(meant)
        self.grams: Counter = Counter()
        for w in vocab:
            self.grams.update(self._runs(w))
        self.model = Perceptron()
        self.memo: dict[str, str | None] = {}
        self.right: set[str] = set()  # words that were decided to read right

    @staticmethod
    def _runs(word: str) -> set[str]:
        p = f"^{word}$"
        return {p[i : i + 3] for i in range(len(p) - 2)}

    def _bucket(self, word: str, hidden: str | None = None) -> int:
        return 0 if word == hidden else min(8, self.vocab.get(word, 0).bit_length() // 2)

    def _usual(self, word: str, own: set[str]) -> int:
        """How many known words hold the rarest three-letter run of a word, as a bucket; ``own`` runs count one less."""
        return min(((self.grams.get(g, 0) - (g in own)).bit_length() for g in self._runs(word)), default=0)

    def _places(self, word: str) -> list[tuple[int, int]]:
        return [(i, z) for z in (1, 2) for i in range(len(word) - z + 1) if word[i : i + z] in self.by_seen]

    def edits(self, word: str, hidden: str | None = None, once: bool = True) -> list[tuple[str, list]]:
        """Every script: (result, features), keeping the word first. ``hidden`` is a word to take for unknown."""
        own = self._runs(hidden) if hidden else set()
        p = f"^{word}$"
        known = self._bucket(word, hidden)
        places = self._places(word)
        out = [(word, [("keep", known), ("keep runs", self._usual(word, own), known > 0), ("keep digit", any(c.isdigit() for c in word) and not word.isdigit())] + [("keep", word[i : i + z], p[i]) for i, z in places] + [("keep", word[i : i + z]) for i, z in places])]
        for i, z in places:
            seen = word[i : i + z]
            rest = [f for j, y in places if (j, y) != (i, z) for f in (("keep", word[j : j + y], p[j]), ("keep", word[j : j + y]))]
            for meant in self.by_seen[seen]:
                new = word[:i] + meant + word[i + z :]
                to = self._bucket(new, hidden)
                if known and not to:
                    continue  # a known word is no misreading of an unknown one
                ops = ["replace " + meant[0]] + (["insert " + meant[1:]] if len(meant) > z else ["delete " + seen[1:]] if z > len(meant) else [])
                feats = rest + [f for op in ops for f in ((op, seen), (op, p[i], seen), (op, seen, p[i + z + 1]))]
                feats += [("known", to), ("runs", self._usual(new, own), to > 0), ("from", known, to), ("digit", any(c.isdigit() for c in seen))]
                out.append((new, feats))
        if not once and len(word) > 6 and len(out) > 1:  # a second confusion in a long word
            near = sorted(out[1:], key=lambda o: (-self.model.score(o[1]), o[0]))[:4]
            seen_already = {o[0] for o in out}
            out += [(r, [*f, ("second", 1)]) for x, _ in near for r, f in self.edits(x, hidden)[1:] if r in self.vocab and r not in seen_already]
        return out

    def meant(self, word: str) -> str | None:
        """What a word (in lower case) should read; None if it reads right."""
        if word.isdigit():
            return None
        if word not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
                self.right.clear()
            options = self.edits(word, once=word in self.vocab)
            k = self.model.best(options)
            if not k and "-" in word and word not in self.vocab:  # a compound: part by part
                parts = word.split("-")
                fixed = [self.meant(p) or p if len(p) > 2 else p for p in parts]
                self.memo[word] = "-".join(fixed) if fixed != parts else None
            else:
                self.memo[word] = options[k][0] if k else None
        return self.memo[word]

    def ends(self, left: str, mark: str, right: str) -> list[tuple[bool, list]]:
        """At a line's end: join (the mark vanishes) or keep (the mark is a hyphen)."""
        joined, compound = left + right, f"{left}-{right}"
        tail, front = left.rsplit("-", 1)[-1], right.split("-", 1)[0]
        f = [("mark", mark), ("joined", self._bucket(joined)), ("mended", joined not in self.vocab and self.meant(joined) is not None), ("compound", self._bucket(compound)),
             ("parts", tail in self.vocab, front in self.vocab), ("short", min(len(tail), len(front)) < 3), ("digits", tail.isdigit() or front.isdigit()),
             ("run", min(self.grams.get(f"^{joined}$"[len(left) + d :][:3], 0).bit_length() for d in (-1, 0)))]
        return [(False, [("keep", *x) for x in f]), (True, [("join", *x) for x in f])]

    def joins(self, left: str, mark: str, right: str) -> bool:
        options = self.ends(left, mark, right)
        return options[self.model.best(options)][0]

    def train(self, seed: int = 11, rounds: int = 6) -> None:
        """On known words and compounds, FIT of each drawn anew every round: spoiled by the channel, left alone, half of the time taken for unknown, glued
        together to words that nobody knows, and broken at line ends."""
        rng = random.Random(seed)
        words = sorted(w for w in self.vocab if len(w) >= 5 and w.isalpha())
        compounds = sorted(w for w in self.vocab if w.count("-") == 1 and w.replace("-", "").isalpha())
        pairs = sorted(self.channel, key=lambda p: (-self.channel[p], p))
        weights = [self.channel[p] ** 0.5 for p in pairs]  # rare confusions are learnt, too
        if not words:
            return
        for _ in range(rounds):
            for w in rng.sample(words, min(FIT, len(words))):
                hidden = w if rng.random() < 0.5 else None
                if pairs:
                    seen, meant = rng.choices(pairs, weights)[0]
                    at = [i for i in range(len(w)) if w.startswith(meant, i)]
                    if at:
                        i = rng.choice(at)
                        bad = w[:i] + seen + w[i + len(meant) :]
                        options = self.edits(bad, hidden)
                        if bad not in self.vocab and (k := next((k for k, o in enumerate(options) if o[0] == w), None)):
                            self.model.learn(options, k)
                self.model.learn(self.edits(w, hidden), 0)
                other = rng.choice(words)
                strange = w[: rng.randint(3, len(w))] + other[rng.randint(1, len(other) - 2) :]
                if strange not in self.vocab:
                    self.model.learn(self.edits(strange), 0)
                cut = rng.randint(2, len(w) - 2)
                mark = rng.choice(MARKS)
                self.memo.clear()
                self.model.learn(self.ends(w[:cut], mark, w[cut:]), 1)
            for w in rng.sample(compounds, min(FIT, len(compounds))):
                self.memo.clear()
                self.model.learn(self.ends(*w.split("-")[:1], rng.choice("-‐-"), w.split("-")[1]), 0)
                cut = rng.randint(2, len(w) - 2)
                if w[cut - 1] != "-" and w[cut] != "-":
                    self.model.learn(self.ends(w[:cut], rng.choice(MARKS), w[cut:]), 1)
        self.model.average()
        self.memo.clear()
        self.right.clear()


class Holes:
    """Known words with one or two characters left out, to find what an unknown word may be a misreading of."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab
        self.holes: dict[tuple, list[str]] = defaultdict(list)
        for v in vocab:
            if len(v) >= 5 and v.isalpha():
                for size in (1, 2):
                    for i in range(len(v) - size + 1):
                        self.holes[v[:i], v[i + size :]].append(v[i : i + size])

    def readings(self, w: str) -> set[tuple[str, str]]:
        """(seen, meant) of every confusion (1:1, 2:1, 1:2 characters) that turns an unknown word into a known one."""
        found: set[tuple[str, str]] = set()
        if w in self.vocab or len(w) < 5 or w.isdigit() or sum(c.isdigit() for c in w) > 2:
            return found
        for size in (1, 2):
            for i in range(len(w) - size + 1):
                for meant in self.holes.get((w[:i], w[i + size :]), ()):
                    if len(meant) + size <= 3 and meant != w[i : i + size] and not (size == 2 and meant in w[i : i + size]) and not (len(meant) == 2 and w[i] in meant):
                        found.add((w[i : i + size], meant))
        return found


def confusions(weight: dict[tuple[str, str], tuple[float, int]]) -> dict[tuple[str, str], float]:
    """(seen, meant) -> weight, from (seen, meant) -> (weight, unknown words that show it).

    Kept: confusions shown by at least three unknown words that make up a thousandth of the evidence, and those with a
    digit from two.
    """
    total = sum(w for w, _ in weight.values())
    return {f: w for f, (w, kinds) in weight.items() if (kinds >= 3 and w >= total / 1000) or (kinds >= 2 and any(c.isdigit() for c in f[0]))}


def _close(a: str, b: str) -> bool:
    """Equal but for a few misread characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or len(b) < 4:
        return False
    few = max(1, len(b) // 6)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > few + 1:
            return False
    return row[-1] <= few


def _number(m: re.Match) -> int | None:
    n = m["n"]
    if re.fullmatch(r"[ivxlc]+", n, re.I) and not re.fullmatch(r"[lI]{1,2}", n):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
        d = [value[c] for c in n.lower()]
        return sum(-x if any(y > x for y in d[k + 1 : k + 2]) else x for k, x in enumerate(d))
    t = n.translate(_DIGIT)
    return int(t) if t.isdigit() else None


class Margins:
    """Finds running lines: an averaged perceptron over where a line stands on the page and how it recurs.

    Its features: the breaks above and below and how near they are, form feeds, page numbers beside the line or in it,
    the share of the usual width, how it begins and ends, whether it repeats the document's title, recurs in the document, or is
    of a pattern that documents of the corpus repeat. It is trained without labels by hand on what is sure: lines that
    recur by breaks of pages are running lines, lines inside paragraphs that don't are text. Two times in five what made them sure
    is hidden, so that the place on the page has to tell.
    """

    def __init__(self, patterns: set[str]):
        self.patterns = patterns
        self.loose: dict[tuple, list[str]] = defaultdict(list)  # by beginning and by end
        for p in sorted({p.lower() for p in patterns}):
            self.loose[0, p[:4]].append(p)
            self.loose[1, p[-4:]].append(p)
        self.model = Perceptron()
        self.memo: dict[tuple, bool] = {}

    def _title(self, page: Page, s: str) -> tuple[str, bool]:
        m = _SPLIT.match(s) if "  " in s else None
        core = (next((g for g in m.groups() if g), s) if m else s).strip().lower()
        named = re.sub(r"^[^\W\d_]+ / ", "", core) if " / " in core else core
        if page.head and (core == page.head or named == page.head):
            return "same", m is not None
        return ("close" if page.head and page._like(core) and (_close(core, page.head) or _close(named, page.head)) else "other"), m is not None

    def _shared(self, own: str) -> str:
        if own in self.patterns:
            return "same"
        low = own.lower()
        near = [p for k in ((0, low[:4]), (1, low[-4:])) for p in self.loose.get(k, ()) if abs(len(p) - len(low)) < 3]
        if not near:
            return "no"
        bare = _DIGITS.sub("", low)
        return "close" if any(_close(low, p) or _close(bare, _DIGITS.sub("", p)) for p in near) else "no"

    def keys(self, page: Page) -> dict[int, tuple]:
        """line -> what the features are made of, for the lines that may be a page's margin."""
        if not page.near:
            return {}
        patterns = {i: page.pattern(i) for i in page.near}
        own = Counter(patterns.values())
        often = [p.lower() for p, n in own.most_common(6) if n > 1]
        width = sorted(len(page.strip[i]) for i in page.filled)[len(page.filled) * 3 // 4] or 1
        out = {}
        for i, mine in patterns.items():
            if i in page.numbers:
                continue
            s = page.strip[i]
            before, after = page.beside(i, -1), page.beside(i, 1)
            feed = page.fed and any("\x0c" in x for x in page.lines[max(0, i - 2) : i + 3])
            title, split = self._title(page, s)
            last = "comma" if s[-1] == "," else "mark" if s[-1] in _MARK_SET else "digit" if s[-1].isdigit() else "end" if _END.search(s) else "open"
            first = "digit" if s[0].isdigit() else "small" if s[0].islower() else "large"
            n = min(own[mine], 3)
            if n == 1 and often:
                low = mine.lower()
                if any(abs(len(low) - len(q)) < 3 and (low[:4] == q[:4] or low[-4:] == q[-4:]) and _close(low, q) for q in often):
                    n = -1  # but for misread letters
            out[i] = (min(page.up[i], 3), min(page.down[i], 3), before in page.numbers or after in page.numbers, feed, before is None, after is None, last, first, min(4, 4 * len(s) // width), title, split, n, self._shared(mine))
        return out

    @staticmethod
    def features(key: tuple) -> tuple[list, list]:
        """(features of a line's place and form, features of its recurrence)."""
        up, down, number, feed, top, end, last, first, wide, title, split, n, shared = key
        place = [("up", up), ("down", down), ("both", up, down), ("number", number), ("feed", feed), ("edge", top, end), ("last", last), ("first", first), ("wide", wide), ("form", last, first, wide), ("sides", first, last), ("first", first, number), ("title", title), ("title number", title, split, number), ("title place", title, min(up, down))]
        return place, [("again", n), ("shared", shared), ("again shared", n, shared), ("again title", n, title), ("again number", n, number, shared)]

    def sure(self, page: Page) -> list[tuple[bool, tuple]]:
        """(running, key) of the lines of a document that are sure."""
        out = []
        for key in self.keys(page).values():
            _, _, number, feed, _, _, last, first, _, title, _, n, shared = key
            ends, text = last in ("open", "digit") and first != "small", shared == "no" and title == "other"
            if not text and (shared == "same" or n != 1 or number or feed):
                out.append((True, key))
            elif n >= 3 and ends and (number or feed):
                out.append((True, key))
            elif text and (n == 1 or not ends):
                out.append((False, key))
        return out

    @staticmethod
    def _options(feats: list) -> list[tuple[bool, list]]:
        return [(False, [("text", *f) for f in feats]), (True, [("running", *f) for f in feats])]

    def train(self, lines: list[tuple[bool, tuple]], seed: int = 5, rounds: int = 8) -> None:
        rng = random.Random(seed)
        yes, no = [x for x in lines if x[0]], [x for x in lines if not x[0]]
        for _ in range(rounds if yes and no else 0):
            some = yes + rng.sample(no, min(len(no), 5 * len(yes)))
            rng.shuffle(some)
            for running, key in some:
                place, again = self.features(key)
                self.model.learn(self._options(place + (again if rng.random() < 0.6 else [])), int(running))
        self.model.average()
        self.memo.clear()

    def running(self, page: Page) -> set[int]:
        out = set()
        for i, key in self.keys(page).items():
            yes = self.memo.get(key)
            if yes is None:  # few thousand keys there can be
                place, again = self.features(key)
                yes = self.memo[key] = bool(self.model.best(self._options(place + again)))
            if yes:
                out.add(i)
        return out


def furniture(lines: list[str], margins: Margins) -> dict[int, str]:
    """index -> ``running`` or ``page_no``, from where on the pages the lines stand and what they say."""
    page = Page(lines)
    strip, code = page.strip, page.code
    kind: dict[int, str] = dict.fromkeys(margins.running(page), "running")
    filled, place = page.filled, page.place
    numbers = [(i, m, v) for i in filled if i not in kind and i not in code and (m := _PAGE.match(strip[i])) and (v := _number(m)) is not None]
    if not numbers:
        return kind

    def style(m: re.Match) -> tuple:
        return (m["a"], (m["w"] or "").lower(), bool(m["m"]), m["b"], m["n"][0].isdigit() or m["n"][0] in "lIOSB")

    best: dict[int, int] = {}
    for i, m, v in numbers:  # the longest run of pages that counts up, by style
        best[i] = 1 + max((best[j] for j, n, u in numbers if j < i and 0 < v - u <= 1 and style(n)[1:3] == style(m)[1:3]), default=0)
    for i, m, v in numbers:
        follows = best[i] > 1 or any(best[j] == best[i] + 1 and u == v + 1 for j, n, u in numbers if j > i)
        k = place[i]
        before, after = (filled[k - 1] if k else None), (filled[k + 1] if k + 1 < len(filled) else None)
        by = any(x in kind and kind[x] == "running" for x in (before, after)) or any("\x0c" in x for x in lines[max(0, i - 2) : i + 3])
        edge = k == 0 or k == len(filled) - 1
        worded = bool(m["w"] or m["m"])
        if before is not None and strip[before].endswith(":") and not worded and not m["a"]:
            continue  # a figure that the text announces
        if m["b"] == "." and not worded:
            continue  # the end of a sentence
        if worded and (not m["m"] or not m["m"].isdigit() or v <= int(m["m"])) or follows or by or (edge and (m["a"] or k == 0 or lines[i] != lines[i].lstrip())):
            kind[i] = "page_no"
    return kind


def noise(text: str, editor: Editor, margins: Margins) -> tuple[list[str], dict[int, str], dict[int, tuple[int, str]], dict[int, list[tuple[int, int, str]]]]:
    """Lines, furniture, joins (line -> the line that goes on, the word) and misread words (line -> [(from, to, meant)])."""
    lines = plain(text).split("\n")
    kind = furniture(lines, margins)
    if len(editor.right) > 2 * MEMO:
        editor.right.clear()
    body = [i for i, x in enumerate(lines) if i not in kind and x.strip("\x0c \t")]
    joins: dict[int, tuple[int, str]] = {}
    bad: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    skip: dict[int, int] = {}
    fenced = False
    for k, i in enumerate(body):
        x = lines[i]
        if x.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            continue
        stop = len(x)
        if x.rstrip(" \t")[-1:] in _MARK_SET and (m := _BREAK.search(x)) and k + 1 < len(body) and (n := re.match(rf"\s*({_WORD.pattern})", lines[body[k + 1]])) and not _MARKUP.match(lines[body[k + 1]]):
            left, right = m.group(1).lower(), n.group(1).lower()
            joined = editor.joins(left, m.group(2), right)
            whole = left + right if joined else f"{left}-{right}"
            if joined:
                joins[i] = (body[k + 1], whole)
            if m.start(1) >= skip.get(i, 0) and (fix := editor.meant(whole)) is not None and len(fix) > 4 and not _code(whole):
                bad[i].append((m.start(1), len(x), fix))
            stop = m.start(1)
            skip[body[k + 1]] = n.end(1)
        start = skip.get(i, 0)
        if editor.right.issuperset(_WORD.findall(x[start:stop].lower())):
            continue
        for w in _WORD.finditer(x, start, stop):
            word = w.group()
            if len(word) < 4:
                editor.right.add(word.lower())
                continue
            if (w.end() < len(x) and x[w.end()] in "@=") or (w.start() and x[w.start() - 1] in "@/."):
                continue
            low = word.lower()
            if _code(low) or (fix := editor.meant(low)) is None:
                editor.right.add(low)
            elif len(fix.replace("-", "")) > 4:
                bad[i].append((w.start(), w.end(), fix))
    return lines, kind, joins, bad


def _code(word: str) -> bool:
    """A code such as AB-1234, or a number with a letter or two."""
    return sum(c.isdigit() for c in word) > 2 or re.fullmatch(r"[a-z]{2}-[\dlo]+", word) is not None


def _case(seen: str, meant: str) -> str:
    return meant.upper() if seen.isupper() and len(seen) > 1 else meant[:1].upper() + meant[1:] if seen[:1].isupper() else meant


def repair(text: str, editor: Editor, margins: Margins) -> str:
    """Continuous paragraphs: no furniture, broken words joined, misread words mended, lines of a paragraph on one line."""
    if not scanned(text):
        return text
    lines, kind, joins, bad = noise(text, editor, margins)
    owed = {j: (i, w) for i, (j, w) in joins.items()}
    out: list[str] = []
    flow = gap = margin = fenced = False  # in a paragraph; blank lines, furniture since the last line
    for i, x in enumerate(lines):
        if i in kind or not x.strip("\x0c \t"):
            if fenced and i not in kind:
                out.append(x)
            margin = margin or i in kind or "\x0c" in x
            gap = gap or i not in kind
            continue
        line = x
        for a, b, meant in sorted(bad.get(i, ()), reverse=True):
            if i in joins and b == len(x):
                continue
            tail = x[b - 1] if b == len(x) and _BREAK.search(x) else ""
            if tail and i not in joins:  # a compound over the line's end: only its first part is here
                meant = meant.rsplit("-", 1)[0]
            line = line[:a] + _case(x[a:b], meant) + tail + line[b:]
        if i in joins:
            m = _BREAK.search(x)
            fix = next((f for a, b, f in bad.get(i, ()) if b == len(x)), joins[i][1])
            at = len(line) - (len(x) - m.start(1))
            line = line[:at] + _case(m.group(1), fix)
        if i in owed:
            line = re.sub(rf"^\s*{_WORD.pattern}", "", line)
        if i in owed and out:
            out[-1] += line.rstrip()
        elif flow and not fenced and not _MARKUP.match(x) and (not _END.search(out[-1]) if margin else not gap):
            out[-1] += ("" if re.search(r"[^\W_]-$", out[-1]) else " ") + line.strip()
        else:
            if (gap or margin) and out and out[-1] and not fenced:
                out.append("")
            fence = x.lstrip().startswith("```")
            flow = not (fence or fenced or _MARKUP.match(x))
            fenced = fenced != fence
            out.append(line.strip() if flow else line)
        gap = margin = False
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def learn(df: DataFrame) -> tuple[Editor, Margins]:
    """The editor and the finder of running lines, from (t): all texts of the corpus."""
    total = df.count()
    counts = df.mapInPandas(_count, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n")).persist()
    try:
        words = int(counts.where("kind = 'w'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"])
        least = max(2, WORD_SHARE * words)
        vocab = {r["item"]: int(r["n"]) for r in counts.where((F.col("kind") == "w") & (F.col("n") >= least)).select("item", "n").collect()}  # at most 1 / WORD_SHARE words
        docs = max(2, PATTERN_SHARE * total)
        patterns = {r["item"] for r in counts.where((F.col("kind") == "p") & (F.col("n") >= docs)).select("item").collect() if re.search(r"[^\W\d_]{3}", r["item"])}  # at most lines of a document / PATTERN_SHARE
        holes = Holes(vocab)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A word with several readings shares its weight among them."""
            for pdf in batches:
                out = [(seen, meant, float(n) / len(found)) for w, n in zip(pdf["item"], pdf["n"]) if (found := holes.readings(w)) for seen, meant in found]
                yield pd.DataFrame(out, columns=["seen", "meant", "x"])

        told = counts.where("kind = 's'").select("item", "n").mapInPandas(read, "seen string, meant string, x double").groupBy("seen", "meant").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("kinds"))
        total = told.agg(F.sum("x")).first()[0] or 0.0
        few = told.where(f"(kinds >= 3 and x >= {total / 1000}) or (kinds >= 2 and seen rlike '[0-9]')").collect()  # a thousandth each, and pairs of characters
        channel = confusions({(r["seen"], r["meant"]): (r["x"], r["kinds"]) for r in few} | {("", ""): (total - sum(r["x"] for r in few), 0)})
    finally:
        counts.unpersist()
    editor = Editor(vocab, channel)
    editor.train()
    margins = Margins(patterns)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [repr(x) for t in pdf["t"] if scanned(t) for x in margins.sure(Page(plain(t).split("\n")))]}, dtype=object)  # some 100 bytes a line

    # A bounded sample by hash, to which the finder is fitted: all documents while there are few.
    part = df.where(F.pmod(F.xxhash64(F.lit(29), "t"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_DOCUMENTS / max(1, total))))
    lines = part.mapInPandas(label, "x string").orderBy(F.xxhash64("x"), "x").limit(20 * FIT_DOCUMENTS).collect()
    margins.train([ast.literal_eval(r["x"]) for r in lines])
    return editor, margins


def _rows_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t <> ''"))


def noisy_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, noise_kind): hyphen, running, page_no and misread lines of the scanned documents.

    Null and empty texts have none, nor do documents whose prose stands mostly in lines of over 100 characters: these
    are not scanned. Repeated rows give their lines each. Texts are read whole. An empty table gives no rows. Other columns are
    not read. A line may be of two kinds; lines count from 1.
    """
    rows = _rows_of(df, key, text)
    editor, margins = learn(rows.select("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                if scanned(t):
                    _, furn, joins, bad = noise(t, editor, margins)
                    out += [(k, i + 1, f) for i, f in furn.items()] + [(k, i + 1, "hyphen") for i in joins] + [(k, i + 1, "misread") for i, b in bad.items() if b]
            yield pd.DataFrame(out, columns=["k", "line_no", "noise_kind"])

    return rows.mapInPandas(run, f"k {kind}, line_no int, noise_kind string").withColumnRenamed("k", key)


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, repaired) of every row with a text; documents that were not scanned come out as they are."""
    rows = _rows_of(df, key, text)
    editor, margins = learn(rows.select("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "repaired": [repair(t, editor, margins) for t in pdf["t"]]})

    return rows.mapInPandas(run, f"k {kind}, repaired string").withColumnRenamed("k", key)
