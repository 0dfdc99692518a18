"""Problem 6: personal information in free text, by weak supervision.

Candidates (email, phone, id_number, address, name) are proposed broadly: whatever has the outline of a type, in any context.
Labelers vote on each, saying yes, no or nothing: formats (regular expressions), gazetteers of known names, what the corpus
says about a word (mostly in small letters, mostly alone, or mostly beside a known name), and context (labels, titles,
what follows, a cell or line of its own). Expectation-maximisation over the counts of vote patterns estimates how reliable
every labeler is and how likely every pattern is a true span. A logistic span classifier is trained on those estimates;
beside the votes it sees the words around the span and its outline, and has the last word. Nothing is labelled by hand, and no
sentence is written down here: which words announce a name or a number is learnt from the corpus.

Three passes without a shuffle of texts: words are counted (plain counters per partition, summed by Spark), candidates
proposed and written, candidates decided. To the driver come words of at least WORD_SHARE of all words, counts of vote
patterns (bounded by the labelers) and SAMPLE candidates, to which the classifier is fitted. Texts are read whole and in the
consistent form of problem 5, positions mapped back, so look-alike letters and invisible characters hide nothing.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.lookalikes import single_map
from thicket.session import cut, spread

TYPES = ("email", "phone", "id_number", "address", "name")
#: What overlaps an email or an address is part of it.
FIRST = {"email": 40.0, "address": 20.0}
#: Words of at least this share of all words have statistics: at most 1 / WORD_SHARE words.
WORD_SHARE = 2e-6
#: Candidates that the span classifier is fitted to, and its hashed features.
SAMPLE, FEATURES = 30_000, 1 << 18

_W = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
_SEP = r"[ \n]{1,2}"
_AT = r"(?:@| ?@ ?|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_LABEL = r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+%\-])[\w][\w.+%\-]*(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*|\sat\s{_LABEL}(?:\sdot\s{_LABEL})+)(?![\w@])", re.I)
PHONES = {
    "international": re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?![\w])"),
    "zeros": re.compile(r"(?<![\w+./\-])00[1-9]\d{8,12}(?![\w/])"),
    "bracket": re.compile(r"(?<![\w+])\(\d{2,5}\)[ .\-/]?\d{2,5}(?:[ .\-]\d{2,5}){0,3}(?![\w/])"),
    "triple": re.compile(r"(?<![\w+./\-])\d{3}([ .\-])\d{3}\1\d{4}(?![\w/])"),
    "pairs": re.compile(r"(?<![\w+./\-])0[1-9](?:([ .\-])\d{2})(?:\1\d{2}){3}(?![\w/])"),
    "slash": re.compile(r"(?<![\w+./\-])0[1-9]\d{1,4}/\d{4,9}(?![\w/])"),
    "national": re.compile(r"(?<![\w+./\-])0[1-9]\d{1,3}[ .\-]\d{3,8}(?:[ .\-]\d{2,5}){0,3}(?![\w/])"),
}
IDS = {
    "three-two-four": re.compile(r"(?<![\w./\-])\d{3}([ .\-]?)\d{2}\1\d{4}(?![\w/])"),
    "grouped": re.compile(r"(?<![\w./\-])\d{2}(?:[ .\-]\d{3}){3}(?![\w/])"),
    "lettered": re.compile(r"(?<![\w./\-])[A-Z]{1,3}\d{6,9}[A-Z]?(?![\w/])", re.I),
    "long": re.compile(r"(?<![\w./\-])\d{10,12}(?![\w/])"),
}
_PLACE = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*(?:[ \n][^\W\d_]+(?:[’'\-][^\W\d_]+)*){0,2}?"
_TOWN = rf"(?:\d{{5}}[ \n]{_W}|{_PLACE}[ \n]\d{{5}})"
_STREETS = r"avenue|ave\.?|road|rd\.?|street|st\.?|lane|ln\.?|court|ct\.?|blvd\.?|boulevard|drive|dr\.?|terrace|way|close|place|square|walk|row|crescent|grove|hill|gardens|parade|quay"
_VOIES = r"rue|avenue|impasse|chemin|all[ée]e|place|boulevard|quai|cours|route|passage|square|calle|plaza|paseo|avenida|camino|carrer|via|viale"
_STRASSEN = r"stra(?:ß|ss)e|str\.|weg|kehre|gasse|platz|allee|ufer|ring|damm|steig|pfad|hof|markt"
_UNIT = r"(?:,?[ \n](?:apt|apartment|suite|unit|flat|floor)\.?[ \n]?\w{1,5}|[ \n]?#[ ]?\w{1,5})?"
ADDRESSES = {
    "number-street": re.compile(rf"(?<![\w\-])\d{{1,5}}[a-z]?[ \n]{_W}(?:[ \n]{_W}){{0,3}}?[ \n](?:{_STREETS}){_UNIT}(?:,[ \n]|\n){_TOWN}", re.I),
    "voie": re.compile(rf"(?<![\w\-])\d{{1,5}}(?:[ \n]?(?:bis|ter|[a-d]))?,?[ \n](?:{_VOIES})[ \n]{_W}(?:[ \n]{_W}){{0,4}}?{_UNIT}(?:,[ \n]|\n){_TOWN}", re.I),
    "voie-first": re.compile(rf"(?<![\w\-])(?:{_VOIES})[ \n](?:{_W}[ \n]){{1,4}}?\d{{1,5}}[a-z]?(?:,[ \n]|\n){_TOWN}", re.I),
    "strasse": re.compile(rf"(?<![\w\-])(?:[^\W\d_\-]+[ \-])?[^\W\d_]+(?:{_STRASSEN})[ \n]\d{{1,5}}[ ]?[a-z]?{_UNIT}(?:,[ \n]|\n){_TOWN}", re.I),
    "am": re.compile(rf"(?<![\w\-])(?:am|an der|an den|auf der|auf dem|im|in der|zum|zur|unter den|alte|alter|neue|neuer)[ \n]{_W}(?:[ \n]{_W})?[ \n]\d{{1,5}}[ ]?[a-z]?{_UNIT}(?:,[ \n]|\n){_TOWN}", re.I),
    "box": re.compile(rf"(?<![\w\-])(?:P\.?[ ]?O\.?[ ]?Box|Postfach|Bo[îi]te postale|B\.?P\.?|Apartado(?:[ ]de[ ]correos)?)[ \n]\d{{1,6}}(?:,[ \n]|\n){_TOWN}", re.I),
}
#: A street without a place, and a place without a street: outlines that only votes tell from an address.
NOT_WHOLE = {
    "street-only": re.compile(rf"(?<![\w\-])\d{{1,5}}[a-z]?[ \n]{_W}(?:[ \n]{_W}){{0,3}}?[ \n](?:{_STREETS})(?![\w])", re.I),
    "place-only": re.compile(rf"(?<![\w\-])\d{{1,5}}[a-z]?,?[ \n]{_W}(?:[ \n]{_W}){{0,3}}?(?:,[ \n]|\n){_TOWN}", re.I),
}
#: Any digits with separators, and any digits with letters.
_RUN = re.compile(r"[+(]?\d(?:[ .\-/()]{0,2}\d){6,14}")
_CODE, _CODE_BEFORE = re.compile(r"\d{6,12}[A-Za-z]?(?![\w/])"), re.compile(r"(?<![\w./\-])[A-Za-z]{1,4}[ \-]?$")
_POSTAL = re.compile(r"(?<!\d)\d{5}(?!\d)")
_WRITTEN_AT = re.compile(r"@|[\[(] ?at ?[\])]|\bat\b[^.\n]{2,60}\bdot\b", re.I)

# Closed classes of words in the languages of the corpus. Fixed values.
_TITLE = {"mr", "mrs", "ms", "dr", "prof", "herr", "frau", "sr", "sra", "mme", "mlle", "don", "doña", "señor", "señora", "madame", "monsieur", "dear", "hello", "hi", "liebe", "lieber", "geehrte", "geehrter", "cher", "chère", "estimado", "estimada", "querido", "querida"}
_FUNCTION = set(
    "the a an and or of in on at to by for from with as if it is are was were be been when where while each any both some most all there this that these those you your we our i he she they his her their not no but so "
    "der die das dem den des ein eine einer eines einem einen und oder am im beim zum zur in an auf aus bei mit nach von vor zu wo er sie es wir ihr nicht kein keine ist sind war wenn dass "
    "le la les l un une des du de et ou où il elle on nous vous ils elles à au aux en dans sur sous par pour avec sans est sont ne pas que qui "
    "el los las lo una unos unas y o del al con sin por para se su sus hay no es son que quien "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz juni juli oktober dezember "
    "lundi mardi mercredi jeudi vendredi samedi dimanche janvier février avril juin juillet août septembre octobre novembre décembre "
    "lunes martes miércoles jueves viernes sábado domingo enero febrero abril junio julio agosto septiembre octubre noviembre diciembre".split()
)
_LEGAL = re.compile(r"[ \n]+(?:gmbh|ltd|limited|inc|llc|plc|ag|kg|s\.a\.|sarl|s\.l\.|company|co\.|corporation|group)\b", re.I)
#: What introduces a number or an address, and what introduces numbers of other kinds.
_PHONE_BEFORE = re.compile(r"(?:\btel\.?|\bt[ée]l[ée]phone|\btelefon|\btel[ée]fono|\bphone|\bfax|\bcall|\bmobile?|\bm[óo]vil|\bcell|\bhandy|\brufnummer|\bext\.?)[ .:\n]*$", re.I)
_ID_BEFORE = re.compile(r"(?:\bssn|\bsocial security(?: number| no\.?)?|\bid(?: number| no\.?)?|\bpassport(?: number| no\.?)?|\breisepass(?:nummer)?|\bpasaporte|\bpasseport|\btax (?:number|id|no\.?)|\bsteuer(?:nummer|-id)|\bnif|\bdni|\bnie|\b(?:personal)?ausweis(?:nummer)?|\bidentidad|\bnum[ée]ro fiscal|\bidentity (?:number|card))[ .:\n]*$", re.I)
_OTHER_BEFORE = re.compile(r"(?:\border|\bserial|\bpart no\.?|\bsheet|\bsection|\basset|\bshelf|\bhost|\bcode|\binvoice|\breference|\bref\.?|\bsee|\bbatch|\bversion|\bbuild|\bisbn|\btag|\bform|\btable|\bnote|\blist|\bhall|\broom|\bauftrag|\bformular|\btabelle|\bcommande|\bpedido)[ .:#\n]*$", re.I)
_ADDRESS_BEFORE = re.compile(r"(?:anschrift|adresse|address|direcci[óo]n|domicil\w*|wohnhaft|lives at|resid\w+ at)(?: on file)?(?: is)?[ :\n]*$", re.I)
_MAIL_BEFORE = re.compile(r"(?:mailto:|\bmail\b|e-?mail:?|correo:?|courriel:?|write to|reply to|contact:?|[(<|])[ \n]*$", re.I)

LABELERS = {
    "email": ("direct", "written", "ending", "no ending", "label", "function word"),
    "phone": ("international", "format", "label", "other label", "date", "plain", "own place"),
    "id_number": ("format", "label", "other label", "plain", "code"),
    "address": ("whole", "street", "postal", "not whole", "label"),
    "name": ("family", "given", "beside names", "title", "outline", "contact follows", "own place", "ordinary", "noun", "legal form"),
}
#: What the corpus says about a word: mostly in small letters; capitalised, but mostly alone or never beside a known name;
#: mostly beside a known name.
ORDINARY, NOUN, BESIDE = 1, 2, 4
#: Outlines in which the family name comes first.
TURNED = ("comma", "upper", "behind")
_WORD = re.compile(_W)
#: Words of the text itself, not of addresses of the net.
_COUNTED = re.compile(rf"(?<![\w@.+\-]){_W}(?![@_]|[.+\-]\w)")
#: Words that don't begin with a small letter (of those most common; the others are looked at).
_CAPITAL = re.compile(rf"(?<![\w’'\-])(?![a-zß-öø-ÿ]){_W}")
_TOKEN = re.compile(r"\w+|[^\w\s]|\n")

Candidate = tuple[int, int, int, int, str, list[int]]  # type, start, end, full words, votes, features


class Look:
    """Look-alike characters and what they read as (problem 5); made once on the driver and sent to the tasks."""

    def __init__(self) -> None:
        self.table = {chr(x): v for x, v in single_map().items()}
        self.odd = frozenset(self.table) | {chr(x) for x in range(0x300, 0x370)}


class Plain:
    """The consistent form of a text, with the stored position of each of its characters."""

    def __init__(self, text: str, look: Look):
        self.text, self.at = text, None
        if text.isascii() or not (own := look.odd.intersection(text)):
            return
        out: list[str] = []
        at: list[int] = []
        end = 0
        for m in re.finditer(f"[{''.join(map(re.escape, sorted(own)))}]", text):
            i, ch = m.start(), m.group()
            if i > end:
                out.append(text[end:i])
                at.extend(range(end, i))
            end = i + 1
            if "\u0300" <= ch <= "\u036f" and out:
                joined = unicodedata.normalize("NFC", out[-1][-1] + ch)
                if len(joined) == 1:
                    out[-1] = out[-1][:-1] + joined
                    continue
            if x := look.table.get(ch, ch):
                out.append(x)
                at.extend([i] * len(x))
        out.append(text[end:])
        at.extend(range(end, len(text)))
        self.text, self.at = "".join(out), at

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.at is None else (self.at[a], self.at[b - 1] + 1)


def _fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


_UPPER, _LOWER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[a-zß-öø-ÿ]")


def one_case(s: str) -> bool:
    """Whether a text is (nearly) all in small or all in capital letters, so that capitals say nothing."""
    up, low = len(_UPPER.findall(s)), len(_LOWER.findall(s))  # of the letters most common
    return up > 4 * low or not up


class Names:
    """Pairs of words that have the outline of a person's name. ``known``: gazetteer; ``said``: what the corpus says."""

    def __init__(self, given: Iterable[str], family: Iterable[str], said: dict[str, int] | None = None):
        self.given, self.family = {_fold(x) for x in given}, {_fold(x) for x in family}
        self.listed = self.given | self.family
        self.said = said or {}

    def pairs(self, s: str, uniform: bool) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, first, second, outline) of two capitalised words side by side, with a comma or initials.

        Capitals say nothing in a text of one case: there one of the two must be, or stand mostly beside, a known name.
        """
        last = None  # the word before, if it may be part of a name
        initials = -1  # where initials before this word begin
        for m in (_WORD if uniform else _CAPITAL).finditer(s):
            w, a, b = m.group(), m.start(), m.end()
            if not (uniform or w[0].isupper()) or (a and s[a - 1] in "@_&/+") or s[b : b + 1] in ("@", "_", "&") or (s[b : b + 1] in (".", "+") and s[b + 1 : b + 2].isalnum() and len(w) > 1):
                last, initials = None, -1
                continue
            gap = s[last[1] : a] if last else ""
            if len(w) == 1:
                if s[b : b + 1] != "." or not w.isalpha():
                    last, initials = None, -1
                    continue
                if last and re.fullmatch(r",[ \n]{1,2}", gap) and not s[b + 1 : b + 2].isalnum():
                    yield last[0], b + 1, last[2], w, "comma"  # Family, G.
                if initials < 0 or not re.fullmatch(r"\. ?", s[at_initial:a]):
                    if last and re.fullmatch(r"[ \n]{1,2}", gap):
                        if s[b + 1 : b + 2] in ("", " ", ",", "\n", "|"):
                            yield last[0], b + 1, last[2], w, "behind"  # Family G.
                    else:
                        last = None
                    initials = a
                at_initial = b
                continue
            low = _fold(w)
            if low in _FUNCTION or low in _TITLE:
                last, initials = None, -1
                continue
            if initials >= 0 and not re.fullmatch(r"\.[ \n]{0,2}", s[at_initial:a]):
                initials, last = -1, None
            if initials >= 0:
                yield initials, b, s[initials], w, "initial"
                if last and initials - last[1] <= 2:
                    yield last[0], b, last[2], w, "middle"
            elif last:
                if re.fullmatch(r"[ \n]{1,2}", gap):
                    yield last[0], b, last[2], w, "upper" if not uniform and last[2].isupper() != w.isupper() else "pair"
                elif re.fullmatch(r",[ \n]{1,2}", gap):
                    yield last[0], b, last[2], w, "comma"
            last, initials = (a, b, w), -1

    def plausible(self, first: str, second: str, uniform: bool) -> bool:
        return not uniform or any(w in self.listed or self.said.get(w, 0) & BESIDE for w in (_fold(first), _fold(second)))

    def count(self, s: str, words: Counter, out: Counter) -> None:
        """Adds up the words as they are written, and (w, kind): capitalised ones beside another (b), and beside a known name of the other sort (k)."""
        if one_case(s):
            return
        words.update(_COUNTED.findall(s))
        near = set()
        for a, b, first, second, outline in self.pairs(s, False):
            given, family = (second, first) if outline in TURNED else (first, second)
            near |= {(x, "b", at) for x, at in ((first, a), (second, b)) if len(x) > 1}
            if len(given) > 1 and _fold(family) in self.family:
                near.add((given, "k", a))
            if len(family) > 1 and _fold(given) in self.given:
                near.add((family, "k", b))
        out.update((_fold(x), k) for x, k, _ in near)


def say(small: int, capital: int, beside: int, known: int) -> int:
    """What the counts of a word say about it."""
    out = ORDINARY if small >= 0.2 * (small + capital) and small else 0
    if not out and capital >= 3 and (beside < 0.4 * capital or (beside >= 10 and known < 0.03 * beside)):
        out |= NOUN
    return out | (BESIDE if not out & ORDINARY and known >= 2 and known >= 0.15 * capital else 0)


def _feature(kind: str, x: str) -> int:
    return zlib.crc32(f"{kind} {x}".encode()) % FEATURES


def _outline(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in s))[:16]


class Extractor:
    """Candidates with their votes and features."""

    def __init__(self, names: Names, look: Look):
        self.names, self.look = names, look

    def candidates(self, text: str) -> list[Candidate]:
        p = Plain(text, self.look)
        s = p.text
        out: list[Candidate] = []
        uniform = one_case(s)

        def add(kind: str, a: int, b: int, votes: list[int], form: str, more: tuple = ()) -> None:
            x, y = p.span(a, b)
            left, right = _TOKEN.findall(s[max(0, a - 60) : a].casefold())[-3:], _TOKEN.findall(s[b : b + 60].casefold())[:2]
            left, right = ["0" if t.isdigit() else t for t in left], ["0" if t.isdigit() else t for t in right]
            code = "".join("-0+"[v + 1] for v in votes)
            feats = [f"v{j}{c}" for j, c in enumerate(code) if c != "0"] + [f"form {form}", f"l1 {left[-1:]}", f"l2 {left[-2:]}", f"l3 {left}", f"r1 {right[:1]}", f"r2 {right}", *more]
            if kind != "name":
                feats.append(f"is {_outline(s[a:b])}")
            full = 1 if kind != "name" or form in ("initial", "behind") or s[b - 2 : b - 1].isupper() and s[b - 1] == "." else 2
            out.append((TYPES.index(kind), x, y, full, code, sorted({_feature(kind, f) for f in feats})))

        def before(a: int) -> str:
            return s[max(0, a - 40) : a]

        def alone(a: int, b: int) -> int:
            """A table cell or a line of its own."""
            left, right = s[max(0, a - 3) : a].rstrip(" ")[-1:], s[b : b + 3].lstrip(" ")[:1]
            return int((left == right == "|") or ((left == "\n" or a == 0) and right in ("", "\n")))

        if _WRITTEN_AT.search(s):
            for m in EMAIL.finditer(s):
                x = m.group()
                direct = "@" in x
                ends = re.search(r"(?:\.|dot[\])]?\s?)[a-z]{2,24}$", x, re.I) is not None
                prose = not direct and any(w in _FUNCTION for w in _WORD.findall(x.casefold())[:-1] if w not in ("at", "dot"))
                written = not direct and not prose and (ends or re.search(r"\bdot\b", x, re.I) is not None)
                label = _MAIL_BEFORE.search(before(m.start())) is not None
                add("email", *m.span(), [int(direct), int(written), int(ends and not prose), -int(not ends or prose), int(label), -int(prose)], "@" if direct else "at")
        for run in _RUN.finditer(s):
            lo, hi = max(0, run.start() - 3), min(len(s), run.end() + 2)
            spans: dict[tuple[int, int], str] = {}
            for form, rx in PHONES.items():
                for m in rx.finditer(s, lo, hi):
                    if 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                        spans.setdefault(m.span(), form)
            if not run.group().isdigit() and (run.start() == 0 or not (s[run.start() - 1].isalnum() or s[run.start() - 1] in "_+./-")) and not s[run.end() : run.end() + 1].isalnum():
                spans.setdefault(run.span(), "run")  # with separators, in no form known
            for (a, b), form in spans.items():
                prev, x = before(a), s[a:b]
                date = re.search(r"(?:19|20)\d\d[\-./ ]\d\d?[\-./ ]\d\d?|\d\d?[./]\d\d?[./](?:19|20)\d\d", x) is not None
                add("phone", a, b, [int(x[0] == "+" or x.startswith("00")), 1 if form != "run" else -1, int(_PHONE_BEFORE.search(prev) is not None), -int(_OTHER_BEFORE.search(prev) is not None or _ID_BEFORE.search(prev) is not None), -int(date), -int(x.isdigit()), alone(a, b)], form)
            spans = {}
            for form, rx in IDS.items():
                for m in rx.finditer(s, lo, hi):
                    spans.setdefault(m.span(), form)
            for (a, b), form in spans.items():
                self._id(add, before(a), a, b, s[a:b], form)
        for m in _CODE.finditer(s):
            if x := _CODE_BEFORE.search(s, max(0, m.start() - 7), m.start()):
                code = s[x.start() : m.end()]
                self._id(add, before(x.start()), x.start(), m.end(), code, "lettered" if IDS["lettered"].fullmatch(code) else "code")
        self._addresses(s, uniform, add, before)
        for a, b, first, second, outline in self.names.pairs(s, uniform):
            if not self.names.plausible(first, second, uniform):
                continue
            x, y = _fold(first), _fold(second)
            n = self.names
            sx, sy = n.said.get(x, 0), n.said.get(y, 0)
            words = [w for w in (x, y) if len(w) > 1]
            given, family = (y, x) if outline in TURNED else (x, y)  # a name of either sort counts in its own place
            other = (0 if x in n.listed else sx) | (0 if y in n.listed else sy)  # of words that are no known names
            prev = before(a)
            title = re.search(rf"(?:^|[^\w])({'|'.join(_TITLE)})\.?[ \n]+$", prev, re.I) is not None
            follows = re.match(r"[ \n,(]{1,3}(?:[\w.+%\-]+ ?(?:@|[\[(]at[\])])|\+?\(?\d{2,})", s[b : b + 60]) is not None
            votes = [
                int(any(w in n.family for w in (words if uniform else (family,)))), int(any(w in n.given for w in (words if uniform else (given,)))), int(all(w in n.listed or n.said.get(w, 0) & BESIDE for w in words)), int(title),
                int(outline in ("comma", "initial", "middle", "upper", "behind") and bool(any(w in n.listed for w in words) or (sx | sy) & BESIDE)), int(follows), alone(a, b),
                -int(bool(other & ORDINARY)), -int(bool(other & NOUN)), -int(_LEGAL.match(s, b) is not None),
            ]
            role = lambda w, f: f"{'g' if w in n.given else ''}{'f' if w in n.family else ''}{f}{'i' if len(w) == 1 else ''}"
            add("name", a, b, votes, outline, (f"w1 {role(x, sx)}", f"w2 {role(y, sy)}", f"w {role(x, sx)} {role(y, sy)} {outline}", f"one case {uniform} {role(x, sx)} {role(y, sy)}"))
        return out

    @staticmethod
    def _id(add, prev: str, a: int, b: int, x: str, form: str) -> None:
        known = form in ("three-two-four", "grouped") and not x.isdigit()
        add("id_number", a, b, [int(known), int(_ID_BEFORE.search(prev) is not None), -int(_OTHER_BEFORE.search(prev) is not None or _PHONE_BEFORE.search(prev) is not None), -int(x.isdigit()), -int(form == "code")], form)

    @staticmethod
    def _addresses(s: str, uniform: bool, add, before) -> None:
        """Streets and boxes, sought in the lines that hold a postal code and the lines beside them, whatever their length."""
        areas: list[list[int]] = []
        for code in _POSTAL.finditer(s):
            line = s.rfind("\n", 0, code.start())
            lo = s.rfind("\n", 0, line) + 1 if line >= 0 else 0
            lo, hi = lo, s.find("\n", code.end())
            hi = len(s) if hi < 0 else hi
            if areas and lo <= areas[-1][1]:
                areas[-1][1] = max(areas[-1][1], hi)
            else:
                areas.append([lo, hi])
        spans: dict[tuple[int, int], str] = {}
        for lo, hi in areas:
            for form, rx in ADDRESSES.items():
                for m in rx.finditer(s, lo, hi):
                    a = m.start()
                    while form == "strasse" and (x := re.match(rf"({_W})[ \n]", s[a : m.end()])) and (x.group(1).casefold() in _FUNCTION or x.group(1)[0].islower() and not uniform):
                        a += x.end()  # a word of the sentence before
                    spans.setdefault((a, m.end()), form)
            for m in NOT_WHOLE["place-only"].finditer(s, lo, hi):
                spans.setdefault(m.span(), "place-only")
        for m in NOT_WHOLE["street-only"].finditer(s):
            spans.setdefault(m.span(), "street-only")
        for (a, b), form in spans.items():
            place = re.split(r",[ \n]|\n", s[a:b])[-1]
            town = re.search(r"[^\W\d_]", place)
            whole = form in ADDRESSES and (uniform or town.group().isupper())
            add("address", a, b, [int(whole), int(form not in ("place-only",)), int(_POSTAL.search(place) is not None), -int(not whole), int(_ADDRESS_BEFORE.search(before(a)) is not None)], form)


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 60, strength: float = 10.0) -> np.ndarray:
    """P(true) of every vote pattern (patterns x labelers in -1, 0, 1), labelers independent given the truth.

    Reliabilities start from a labeler that is mostly right; a Dirichlet prior of ``strength`` spans, however many there are,
    keeps those defined that hardly vote. A vote for never counts against, nor the other way round, and a labeler errs on
    at most a tenth of the spans of either kind. A pattern counts by the square root of its spans, lest one outline that
    is everywhere, and never true, makes whatever is rare look reliable.
    """
    count = np.sqrt(count)
    n = count.sum()
    start = np.array([[0.3, 0.65, 0.05], [0.03, 0.47, 0.5]])  # truth x vote
    theta = np.repeat(start[:, None, :], votes.shape[1], axis=1)
    for j in range(votes.shape[1]):  # a labeler of one direction says the other thing never
        for side, v in ((0, -1), (2, 1)):
            if not (votes[:, j] == v).any():
                theta[:, j, 1] += theta[:, j, side]
                theta[:, j, side] = 1e-6
    prior = theta.copy()
    share = 0.5
    p = np.full(len(votes), 0.5)
    for _ in range(rounds):
        log = np.log(np.stack([np.full(len(votes), 1 - share), np.full(len(votes), share)]))
        for j in range(votes.shape[1]):
            log += np.log(theta[:, j, :])[:, votes[:, j] + 1]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        for y, w in ((0, (1 - p) * count), (1, p * count)):
            for j in range(votes.shape[1]):
                c = np.array([w[votes[:, j] == v].sum() for v in (-1, 0, 1)])
                theta[y, j] = (c + strength * prior[y, j]) / (c.sum() + strength)
        for side, sign in ((0, -1), (2, 1)):  # keep what a vote means
            wrong = sign * (theta[1, :, side] - theta[0, :, side]) < 0
            middle = (theta[1, :, side] + theta[0, :, side]) / 2
            theta[:, wrong, side] = middle[wrong]
        theta[1, :, 0] = np.minimum(theta[1, :, 0], 0.1)
        theta[0, :, 2] = np.minimum(theta[0, :, 2], 0.1)
        theta /= theta.sum(2, keepdims=True)
        share = float(np.clip(((p * count).sum() + 0.5 * strength) / (n + strength), 0.01, 0.99))
    return p


def logistic(rows: list[list[int]], y: np.ndarray, ridge: float = 0.5, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights of hashed features and the constant of a ridge logistic regression on soft labels, by scaled gradient steps."""
    w, c = np.zeros(FEATURES, np.float32), 0.0
    if not rows:
        return w, c
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
    used, own = np.unique(flat, return_inverse=True)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    v, g2, c2 = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(at, v[own], len(rows)) + c, -30, 30)))
        d = q - y
        g = np.bincount(own, d[at], len(used)) + ridge * v
        g2 += g * g
        c2 += d.sum() ** 2
        v -= 0.5 * g / np.sqrt(g2)
        c -= 0.5 * d.sum() / np.sqrt(c2)
    w[used] = v
    return w, c


def believed(patterns: Iterable[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """(type, votes, count) -> P(true) of each, by expectation-maximisation over each type."""
    out: dict[tuple[int, str], float] = {}
    every = sorted(patterns)
    for k in range(len(TYPES)):
        own = [(v, n) for t, v, n in every if t == k]
        if own:
            votes = np.array([["-0+".index(c) - 1 for c in v] for v, _ in own])
            p = expectation_maximisation(votes, np.array([n for _, n in own], float))
            out |= {(k, v): float(x) for (v, _), x in zip(own, p)}
    return out


def resolve(cands: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(type, start, end, full words, P(true)): of overlapping spans, those that are together the likeliest.

    Emails and addresses come first; a name of two full words counts more than two of one and an initial; the longer where
    they tie.
    """
    rows = sorted((b, a, k, n * q - 0.45 + FIRST.get(TYPES[k], 0.0) + 1e-4 * min(b - a, 500)) for k, a, b, n, q in cands)
    best: list[float] = [0.0]
    took: list[tuple[int, bool]] = []
    ends = [b for b, *_ in rows]
    for i, (_b, a, _k, score) in enumerate(rows):
        j = bisect.bisect_right(ends, a, 0, i)
        take = best[j] + score > best[i]
        best.append(best[j] + score if take else best[i])
        took.append((j, take))
    out, i = [], len(rows)
    while i:
        j, take = took[i - 1]
        if take:
            b, a, k, _ = rows[i - 1]
            out.append((k, a, b))
        i = j if take else i - 1
    return out[::-1]


_FOUND = "array<struct<type:int,a:int,b:int,n:int,votes:string,f:array<int>>>"


def _statistics(base: DataFrame, names: Names, look: Look) -> dict[str, int]:
    """What the corpus says about its words, for words of at least WORD_SHARE of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, out = Counter(), Counter()
        for pdf in batches:
            for t in pdf["__t"]:
                names.count(Plain(t, look).text, words, out)
            if len(words) > 300_000:  # a partition of any size in bounded memory
                yield counted(words, out)
                words, out = Counter(), Counter()
        yield counted(words, out)

    n = base.select("__t").mapInPandas(run, "w string, k string, n long").groupBy("w").pivot("k", ["s", "c", "b", "k"]).agg(F.sum("n")).fillna(0).persist()
    try:
        every = n.agg(F.coalesce(F.sum(F.col("s") + F.col("c")), F.lit(0)).alias("n")).first()["n"]
        often = n.where(F.col("s") + F.col("c") >= max(2, WORD_SHARE * every)).collect()  # at most 1 / WORD_SHARE words
    finally:
        n.unpersist()
    return {r["w"]: x for r in often if (x := say(r["s"], r["c"], r["b"], r["k"]))}


def counted(words: Counter, out: Counter) -> pd.DataFrame:
    for w, n in words.items():
        if len(w) > 1:
            out[_fold(w), "c" if w[0].isupper() else "s"] += n
    return pd.DataFrame([(w, k, n) for (w, k), n in out.items()], columns=["w", "k", "n"])


class Judge:
    """The trained span classifier of each type."""

    def __init__(self, models: dict[int, tuple[np.ndarray, float]]):
        self.models = models

    def probability(self, kind: int, feats: list[int]) -> float:
        w, c = self.models[kind]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[feats].sum()) + c))))


def proposals(df: DataFrame, keys: list[str], text: str, names: DataFrame) -> tuple[DataFrame, Judge]:
    """(keys..., found): the candidates of every text that has some, and the judge trained on them."""
    listed = names.where("name is not null").select("name", "kind").limit(200_001).collect()
    if len(listed) > 200_000:
        raise ValueError("the gazetteer is too large to be shipped to every task")
    known = Names([r["name"] for r in listed if r["kind"] == "given"], [r["name"] for r in listed if r["kind"] == "family"])
    base = spread(df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__t")).where("__t <> ''"))
    look = Look()
    known.said = _statistics(base, known, look)
    ex = Extractor(known, look)
    kinds = ", ".join(f"`{k}` {base.schema[k].dataType.simpleString()}" for k in keys)

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[dict(zip(("type", "a", "b", "n", "votes", "f"), c)) for c in ex.candidates(t)] for t in pdf["__t"]]
            any_ = np.array([bool(x) for x in found], bool)
            out = pdf.loc[any_, keys].copy()
            out["found"] = pd.Series([x for x in found if x], index=out.index, dtype=object)
            yield out

    proposed = cut(base.mapInPandas(propose, f"{kinds}, found {_FOUND}"))
    each = proposed.select(*keys, F.explode("found").alias("c"))
    counts = {(r["type"], r["votes"]): r["count"] for r in each.groupBy("c.type", "c.votes").count().collect()}  # vote patterns
    belief = believed((t, v, n) for (t, v), n in counts.items())
    models = {}
    per = Counter()
    for (t, _), n in counts.items():
        per[t] += n
    for t, n in sorted(per.items()):
        most = SAMPLE // len(TYPES)
        some = each.where(F.col("c.type") == t).select("c.votes", "c.f", F.pmod(F.xxhash64(*keys, "c.a", "c.b"), F.lit(1 << 30)).alias("h"))
        # Every candidate while there are few, else a share of them by hash: a bounded sample that the classifier is fitted to.
        taken = some.where(F.col("h") < F.lit(int((1 << 30) * min(1.0, 1.1 * most / n)))).orderBy("h", "votes", "f").limit(most).collect()
        models[t] = logistic([r["f"] for r in taken], np.array([belief[t, r["votes"]] for r in taken]))
    return proposed, Judge(models)


def spans(df: DataFrame, keys: list[str], text: str, names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(keys..., pii_type, start_pos, end_pos) of every occurrence; positions count code points from 1, the end included.

    Null and empty texts have none. Repeated rows give their spans each. ``names`` is the gazetteer (name, kind), a fixed
    table that is checked to have at most 200,000 rows; null names are left out. Texts are read whole. Of overlapping
    spans those stay that are together the likeliest; the longer where they tie. An empty table gives no rows. Other
    columns are not read.
    """
    proposed, judge = proposals(df, keys, text, names)
    kinds = ", ".join(f"`{k}` {proposed.schema[k].dataType.simpleString()}" for k in keys)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                own = [(c["type"], c["a"], c["b"], c["n"], q) for c in row[-1] if (q := judge.probability(c["type"], c["f"])) >= threshold]
                rows += [(*row[:-1], TYPES[k], a + 1, b) for k, a, b in resolve(own)]
            yield pd.DataFrame(rows, columns=[*keys, "pii_type", "start_pos", "end_pos"])

    return proposed.mapInPandas(decide, f"{kinds}, pii_type string, start_pos int, end_pos int")


def redact(df: DataFrame, keys: list[str], text: str, found: DataFrame) -> DataFrame:
    """(keys..., redacted): the text with every span replaced by its type in brackets, such as [EMAIL]; the rest as stored."""
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "pii_type"))).alias("__s"))
    base = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__t")).join(per, keys, "left")
    t, s = F.col("__t"), F.col("__s")
    part = lambda x, i: F.concat(
        F.substring(t, F.when(i == 0, 1).otherwise(F.get(s, i - 1)["end_pos"] + 1), x["start_pos"] - F.when(i == 0, 1).otherwise(F.get(s, i - 1)["end_pos"] + 1)), F.lit("["), F.upper(x["pii_type"]), F.lit("]")
    )
    rest = F.substring(t, F.get(s, F.size(s) - 1)["end_pos"] + 1, F.length(t))
    return base.select(*keys, F.when(s.isNull(), t).otherwise(F.concat(F.array_join(F.transform(s, part), ""), rest)).alias("redacted"))
