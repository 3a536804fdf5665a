"""Problem 3: personal information inside free text, replaced by typed placeholders.

A semi-Markov conditional random field.  Its candidates are whole spans: runs
of number groups, lettered numbers, addresses in several notations, street
lines with what may follow them, and every part of a run of capitalised words
(with initials and particles) that may be a name.  Features look at a whole
span (its shape, its words) and at the words around it.  The candidates of a
text fall into stretches that do not overlap; inside a stretch, dynamic
programming over the candidate ends sums (training) or maximises (use) over all
choices of boundaries and types, no candidate being longer than its entity can
be, so the work is linear in the text.

The model is trained here, on a bounded number of sentences that
``pii_examples`` composes (``TRAIN_TEXTS``, seeded), in a few seconds on the
driver.  What it knows of the texts at hand are only their *usual* words, told
from case and place in the sentence by counts over all texts (``usual_of``),
which keeps sentence openings from looking like names.

Bounds of a candidate, as documented parameters: a name has at most
``NAME_WORDS`` words; a name in lower case is proposed only where it begins
with a given name of the training list or follows a title; a number has at
most ``NUMBER_GROUPS`` groups.

Defined results: null, empty and blank texts hold nothing and stay as they
are; texts of any length are read whole; rows with the same number are
reported each; an empty table gives an empty result; further columns are kept
out of the result.  Positions count code points; ``end_pos`` is exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.pii_examples import GIVEN_NAMES, compose, ordinary_words

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
TRAIN_TEXTS, EPOCHS = 5000, 4
NAME_WORDS, NUMBER_GROUPS = 6, 10
#: A usual word has at least this share in all words, so there are at most 400,000 of them.
USUAL = 5e-6

#: Training passes without the words around a candidate, and the share of usual words that a training text may know.
DROP_WORDS, KEEP_USUAL = 0.4, 0.7

#: Given names that the field knows; training also uses names that are not among them.
GIVEN = frozenset(w for i, w in enumerate(GIVEN_NAMES) if i % 4 != 1)
PARTICLES = frozenset("von van vom zum zur de del della dello degli di da du des dos das la le les lo el al ben bin ibn abu der den ter ten te zu st mac".split())
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam lady lord rev herr frau fräulein monsieur madame mme mlle señor señora sr sra don doña signor signora dott".split())
FIRMS = frozenset(
    "automotive aviation banking biotech ceramics chemicals construction dairy design electronics engineering entertainment farms fashion finance furniture games glass healthcare instruments investments kg machinery manufacturing marine metals mining optics orchards packaging paper petroleum plastics plc printing robotics security shipping steel telecom telegraph textiles tools toys trading transport travel ventures wines "
    "academy agency airlines analytics airport ag archives association avenue bank bay beach boulevard bridge brothers bv cathedral center centre church city clinic club college committee company consulting cooperative corp corporation council county court department drive energy factory festival foods foundation foundry gallery gmbh group harbour hall hill hospital hotel inc industries institute insurance island journal laboratories labs lake lane library limited llc llp logistics ltd market media ministry motors mountain museum news observatory office orchestra park partners pharma plaza press publishing railway restaurant river road school services shop society software solutions square station street studio studios systems technologies theatre times tower trust university valley way works".split()
)
CALENDAR = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz juni juli oktober dezember lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo christmas easter".split()
)

_W = r"[^\W\d_](?:\w|['’](?!s\b)|-(?=\w))*"
_S = r"[^\S\n]{1,3}"
_AT = r"(?:@|\(at\)|\[at\]|[^\S\n]+(?:\(at\)|\[at\]|at)[^\S\n]+)"
_DOT = r"(?:\.|[^\S\n]+(?:\(dot\)|\[dot\]|dot)[^\S\n]+)"
EMAIL = re.compile(rf"(?i)(?<![\w.+@/-])[^\W_][\w.+%-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+")
_BETWEEN = r"[ \u00a0.\-\u2010-\u2015/]"
NUMBERS = re.compile(rf"(?i)(?<![\w.])(?:[a-z]{{1,2}}[ .-]?)?[+(]{{0,2}}\d+\)?(?:(?:{_BETWEEN}{{1,2}}\(?|(?<=\d)\(|(?<=\)))\d+\)?)*(?:[ -]?[a-z])?(?![^\W\d_])")
_GROUP = re.compile(r"(?i)[a-z]{0,2}[+(]{0,2}\d+[a-z]?|[a-z]{1,2}")
#: Groups of capitals and digits mixed, as many authorities write them.
LETTERED = re.compile(r"(?<![\w-])(?=[A-Z0-9-]*\d[A-Z0-9-]*\d[A-Z0-9-]*\d)(?=[0-9-]*[A-Z])[A-Z0-9]{1,20}(?:-[A-Z0-9]{1,8}){0,5}(?![\w-])")
_TYPES = r"(?:road|rd|street|st|lane|ln|court|ct|avenue|ave|way|close|drive|dr|square|sq|terrace|row|hill|gardens|crescent|grove|boulevard|blvd|place|pl|parkway|walk|mews)\b\.?"
_UNIT = rf"(?:flat|apt|apartment|unit|suite|room)\.?{_S}\d+[a-z]?"
STREET = re.compile(
    rf"(?i)(?<!\w)(?:(?P<unit>{_UNIT},{_S})?"
    rf"\d+[a-z]?{_S}(?:(?:bis|ter){_S})?(?:[nsew]\.?{_S})?(?!(?:the|and|of|to|a|an|in|on|at|for|from|by|with|or){_S})(?:(?:rue|avenue|boulevard|chemin|impasse|place|quai)(?:{_S}{_W}){{1,4}}?(?=,|{_S}\d|\s*$|\n|;|\.)|(?:(?!(?:and|to|or|in|at|from|by|with)\b){_W}{_S}){{1,3}}?{_TYPES}(?:,{_S}{_UNIT}(?!\w))?)"
    rf"|(?:calle|avenida|plaza|paseo|camino|via|viale|piazza|corso)(?:{_S}(?:del|de|la|los|las|el|della))?(?:{_S}la)?{_S}{_W}(?:{_S}{_W})?{_S}\d+[a-z]?(?:,{_S}\d{{1,3}}(?!\d)[ºª°]?(?:{_S})?[a-z]?\b)?"
    rf"|{_W}(?:straße|strasse|str\.|allee|weg|platz|gasse|ring|damm|ufer|straat|laan|gata|vej){_S}\d+(?:(?:{_S})?[a-z]\b)?)"
)
_SEP = r"(?:,[^\S\n]{0,3}|,?[^\S\n]{0,3}\r?\n[^\S\n]{0,3}|[^\S\n]{1,3})"
_POST = rf"(?:\d{{4,5}}|[A-Za-z]{{1,2}}\d[A-Za-z\d]?{_S}\d[A-Za-z]{{2}}|[A-Z]{{2}}{_S}\d{{5}})"
_TOWN = rf"{_W}(?:[ -]{_W})?"
TAILS = tuple(re.compile(p) for p in (rf"{_SEP}\d{{4,5}}{_S}{_W}", rf"{_SEP}\d{{4,5}}{_S}{_W}[ -]{_W}", rf"{_SEP}{_W}", rf"{_SEP}{_W}[ -]{_W}", rf"{_SEP}{_W},?{_S}{_POST}(?!\w)", rf"{_SEP}{_W}[ -]{_W},?{_S}{_POST}(?!\w)"))
WORD = re.compile(_W)

Span = tuple[int, int, str]


@lru_cache(maxsize=1 << 17)
def _class(w: str) -> str:
    """Kind and case of a word, without what the texts at hand say about it."""
    low = w.lower()
    case = "U" if w.isupper() and len(w) > 1 else "C" if w[0].isupper() else "l"
    return ("I" if len(w) == 1 else "p" if low in PARTICLES else "G" if low in GIVEN else "F" if low in FIRMS else "D" if low in CALENDAR else "T" if low in TITLES else "w") + case


class _Text:
    """A text with its words, read once for all its candidates."""

    def __init__(self, text: str, usual: frozenset[str]) -> None:
        self.text, self.usual = text, usual
        self.words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        self.at = {a: i for i, (a, _, _) in enumerate(self.words)}
        self.near: dict[int, list[str]] = {}  # words before position a under -a, behind b under b

    def kind(self, w: str) -> str:
        c = _class(w)
        return "u" + c[1] if c[0] in "wp" and c[1] != "l" and w.lower() in self.usual else c

    def gap(self, i: int) -> str:
        return self.text[self.words[i][1] : self.words[i + 1][0]] if i + 1 < len(self.words) else "\n"

    def blank(self, i: int) -> bool:
        g = self.gap(i)
        return 0 < len(g) <= 3 and g.isspace() and "\n" not in g

    def initial(self, i: int) -> bool:
        """Whether word i is one letter with a dot."""
        w = self.words[i]
        return len(w[2]) == 1 and self.text[w[1] : w[1] + 1] == "."

    def candidates(self) -> list[Span]:
        """All spans that may be an item, with their kinds, without repeats."""
        text = self.text
        found: set[Span] = set()
        if "@" in text or "at" in text.lower():
            found.update((m.start(), m.end(), "EMAIL") for m in EMAIL.finditer(text))
        if any(c.isdigit() for c in text):
            self._numbers(found)
        found.update((a, b, "NAME") for a, b in self._names())
        return sorted(found)

    def _numbers(self, found: set[Span]) -> None:
        text = self.text
        for m in NUMBERS.finditer(text):
            groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
            for i, (a, _) in enumerate(groups):
                for j in range(i, min(len(groups), i + NUMBER_GROUPS)):
                    b = groups[j][1]
                    digits = sum(c.isdigit() for c in text[a:b])
                    inner = text[groups[i + 1][0] : groups[j - 1][1]] if j > i + 1 else ""
                    lettered = text[b - 1].isalpha() or text[a].isalpha()
                    if digits < (6 if lettered else 7) or any(c.isalpha() for c in inner):
                        continue
                    for start in (a, a + 1) if text[a] == "(" else (a,):  # the bracket may stand around the whole number
                        if not lettered:
                            found.add((start, b, "PHONE"))
                        if text[start] not in "+(":
                            found.add((start, b, "ID_NUMBER"))
        found.update((m.start(), m.end(), "ID_NUMBER") for m in LETTERED.finditer(text) if sum(c.isalnum() for c in m[0]) > 7)
        for m in STREET.finditer(text):
            starts = {m.start(), m.end("unit") if m["unit"] else m.start()}
            ends = {m.end(), m.end() - (text[m.end() - 1] == ".")} | {t.end() for p in TAILS if (t := p.match(text, m.end()))}
            found.update((a, b, "ADDRESS") for a in starts for b in ends)

    def _names(self) -> Iterator[tuple[int, int]]:
        words, text = self.words, self.text
        n = len(words)
        low = [w[2].lower() for w in words]
        big = [w[2][0].isupper() for w in words]
        past = lambda i: words[i][1] + (1 if self.initial(i) else 0)
        tied = lambda i: self.blank(i) or (self.initial(i) and i + 1 < n and (g := self.gap(i)[1:]) is not None and len(g) <= 2 and not g.strip() and "\n" not in g)

        for i, w in enumerate(words):
            if big[i] and any(c.isdigit() for c in w[2]):
                big[i] = False

        def run(i: int) -> list[int]:
            """Last words of the names that may begin with word i."""
            ends, j = [], i
            while j - i < NAME_WORDS:
                if low[j] not in PARTICLES or big[j]:
                    ends.append(j)
                if not tied(j) or not (big[j + 1] or (low[j + 1] in PARTICLES and j + 2 < n)):
                    break
                j += 1
            return ends

        for i in range(n):
            if (big[i] or low[i] in GIVEN) and low[i] not in TITLES:  # a title is no part of the name
                ends = run(i)
                for j in ends:
                    if i < j or not self.initial(i):
                        yield words[i][0], past(j) if j > i else words[j][1]
                    # "Family, Given M."
                    if j - i < 3 and self.gap(j) in (", ", ",  ") and j + 1 < n and (big[j + 1] or low[j + 1] in GIVEN):
                        yield words[i][0], words[j + 1][1]
                        if tied(j + 1) and j + 2 < n and big[j + 2]:
                            yield words[i][0], past(j + 2)
            after_title = i > 0 and low[i - 1] in TITLES and not text[words[i - 1][1] : words[i][0]].strip(" .")
            if not big[i] and (low[i] in GIVEN or after_title):
                j = i
                if after_title:
                    yield words[i][0], words[i][1]
                for _ in range(3):  # particles, then one family name
                    if not tied(j):
                        break
                    j += 1
                    if low[j] not in PARTICLES:
                        yield words[i][0], words[j][1]
                        break
            if not big[i] and self.gap(i) == ", " and i + 1 < n and low[i + 1] in GIVEN and not big[i + 1]:
                yield words[i][0], words[i + 1][1]

    def left(self, a: int) -> list[str]:
        """Four words before a position, digits levelled."""
        if (known := self.near.get(-a if a else None)) is not None:
            return known
        part = self.text[max(0, a - 48) : a]
        found = _AROUND.findall(part)
        if a > 48 and found and not self.text[a - 49].isspace():
            found = found[1:]
        known = self.near[-a if a else None] = [_level(w) for w in found[-4:]]
        return known

    def right(self, b: int) -> list[str]:
        """Three words behind it."""
        if (known := self.near.get(b)) is None:
            known = self.near[b] = [_level(w) for w in _AROUND.findall(self.text[b : b + 36])[:3]]
        return known

    def before(self, k: str, a: int) -> list[str]:
        """Features of what stands before a candidate of kind ``k``."""
        left = self.left(a)
        return [f"{k}l1={left[-1] if left else '^'}", f"{k}l2={' '.join(left[-2:])}", f"{k}bc={_mark(self.text[a - 1 : a])}", *[f"{k}lw={w}" for w in left if w.isalpha()]]

    def behind(self, k: str, b: int) -> list[str]:
        """Features of what stands behind it."""
        right = self.right(b)
        return [f"{k}r1={right[0] if right else '$'}", f"{k}r2={' '.join(right[:2])}", f"{k}ac={_mark(self.text[b : b + 1])}"]

    def features(self, span: Span) -> list[str]:
        """Features of a whole span and its surroundings."""
        return [*self.before(span[2][0], span[0]), *self.behind(span[2][0], span[1]), *self.body(span)]

    def body(self, span: Span) -> list[str]:
        a, b, kind = span
        text = self.text
        body = text[a:b]
        k = kind[0]
        out = [k]
        if kind in ("PHONE", "ID_NUMBER"):
            shape = re.sub(r"[A-Za-z]", "A", body.translate(_SHAPES))
            groups = "-".join(str(len(g)) for g in re.findall(r"9+", shape))
            separators = "".join(sorted(set(re.sub(r"[9A]", "", shape))))
            out += [f"{k}shape={shape}", f"{k}groups={groups}", f"{k}sep={separators}", f"{k}sepn={separators}{groups.count('-')}", f"{k}n={shape.count('9')}", f"{k}let={shape.count('A')}", f"{k}ends={shape[0]}{shape[-1]}", f"{k}lead={body[:2] if body[0] in '+0(' else '-'}"]
            if any(w in _HASHES for w in self.left(a)):
                out.append(f"{k}thing")
        elif kind == "EMAIL":
            parts = re.split(_AT, body, maxsplit=1)
            labels = re.split(_DOT, parts[-1])
            out += [f"Eat={body[len(parts[0]) : len(body) - len(parts[-1])].strip().lower()}", f"Ealpha={labels[-1].isalpha()}", f"Efirst={parts[0][0].isdigit()}", f"Edots={len(labels)}", f"Etld={labels[-1].lower()}"]
        elif kind == "ADDRESS":
            words = WORD.findall(body)
            post, commas = bool(_POSTED.search(body)), body.count(",")
            end = _class(words[-1]) if not body[-1].isdigit() else "9"
            street = next((w.lower() for w in words if _IS_TYPE.fullmatch(w) or w.lower() in _ROMANCE), "-")
            tail = _TAIL.match(text[b : b + 40])
            follows = ("post" if tail[2] or not tail[1] else _class(tail[1])) if tail and text[b : b + 1] in ",\n " else "-"
            out += [f"Aunit={body[:3].lower() in _UNITS}", f"Apost={post}", f"Acommas={commas}", f"Aend={end}", f"Aline={chr(10) in body}", f"Astreet={street}", f"Anext={follows}", f"Anext2={follows}{post}{text[b : b + 1] == ','}", f"Ast={street},{commas},{post}", f"Aw={len(words)}"]
        else:
            words = WORD.findall(body)
            kinds = [self.kind(w) for w in words]
            pattern = "".join(c if c[0] != "I" else "I" for c in kinds) + ("," if "," in body else "")
            i = self.at[a]
            j = i + len(words)
            before = kinds and i > 0 and self.blank(i - 1) and self.kind(self.words[i - 1][2]) or "-"
            behind = j < len(self.words) and (self.blank(j - 1) or self.gap(j - 1) == ", ") and self.kind(self.words[j][2]) or "-"
            left, right = self.left(a), self.right(b)
            l1, r1 = (left[-1] if left else "^"), (right[0] if right else "$")
            opens = l1 in _OPENERS or chr(10) in text[max(0, a - 2) : a]
            title = i > 0 and self.words[i - 1][2].lower() in TITLES and a - self.words[i - 1][1] <= 2
            known = any(c[0] in "GI" for c in kinds)
            out += [f"Np={pattern}", f"Np{opens}={pattern}", f"Nbb={before}{behind}", f"Nk={known},{before},{behind},{len(words)}", f"Npl={pattern}|{l1}", f"Npr={pattern}|{r1}", f"Nlast={kinds[-1]}", f"Nfirst={kinds[0]}", f"Nt={title}", f"Nw={len(words)}"]
            out += [f"Nf={c[0]}" for c in kinds if c[0] in "FuD"]
            if kinds[-1][0] == "w":
                end = words[-1].lower()
                out += [f"Ne{len(words)}={end[-3:]}", f"Ne{len(words)}={end[-4:]}", f"Ne{len(words)}{known}={end[-2:]}"]
            out += [f"Nu={w.lower()}" for w, c in zip(words, kinds) if c[0] in "uFTD"]
            if not known:
                out += [f"Nul={l1}", f"Nur={r1}", f"Nuo={opens}{title}"]
        return out


_SHAPES = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "-" for c in "\u2010\u2011\u2012\u2013"}, "\u00a0": " "})
_AROUND = re.compile(r"\w+|[^\w\s]")
_IS_TYPE = re.compile(rf"(?i){_TYPES}")
_POSTED = re.compile(rf"(?:\d{{5}}|[A-Za-z]{{1,2}}\d[A-Za-z\d]?{_S}\d[A-Za-z]{{2}})")
_TAIL = re.compile(rf"{_SEP}({_W})(?:,?{_S}({_POST}))?|{_SEP}\d{{4,5}}")
_ROMANCE = frozenset("rue calle avenida plaza paseo via piazza viale corso chemin quai".split())
_UNITS = frozenset("fla apt apa uni sui roo".split())
_OPENERS = frozenset(["^", ".", "!", "?", '"', ":", "“", "•", ">"])
_HASHES = frozenset("order invoice ticket build version serial part tracking batch lot reference article model error flight checksum commit session account page chapter case isbn id host port".split())


@lru_cache(maxsize=1 << 17)
def _level(w: str) -> str:
    return re.sub(r"\d+", "9", w.lower())


#: Features that name a word.
_LEXICAL = re.compile(r".(?:l1|l2|r1|r2|lw|pl|pr|ul|ur|u)=")


def _mark(c: str) -> str:
    return "a" if c.isalpha() else "9" if c.isdigit() else c or "^"


def stretches(spans: list[Span]) -> Iterator[list[Span]]:
    """Groups of candidates such that no two of different groups overlap."""
    group, end = [], -1
    for s in spans:
        if group and s[0] >= end:
            yield group
            group = []
        group.append(s)
        end = max(end, s[1]) if len(group) > 1 else s[1]
    if group:
        yield group


def usual_words(texts: Iterable[str], share: float = USUAL) -> frozenset[str]:
    """Words that stand in lower case with at least this share in all words."""
    seen, total = Counter(), 0
    for text in texts:
        found = WORD.findall(text)
        total += len(found)
        seen.update(w for w in found if len(w) > 1 and w.islower())
    return frozenset(w for w, n in seen.items() if n >= share * total)


class Field:
    """Weights of the random field, with the dynamic programmes over them."""

    def __init__(self, weights: dict[str, float] | None = None, usual: frozenset[str] = frozenset()) -> None:
        self.weights, self.usual = weights or {}, usual

    @staticmethod
    def order(group: list[Span]) -> tuple[list[int], list[int]]:
        """Candidates by end, and for each how many ends lie at or before its begin."""
        order = sorted(range(len(group)), key=lambda i: group[i][1])
        ends = [group[i][1] for i in order]
        return order, [bisect_right(ends, group[i][0]) for i in order]

    def scores(self, read: _Text, group: list[Span]) -> list[float]:
        """Score of each candidate; what candidates share at one side is looked up once."""
        get, known = self.weights.get, {}
        out = []
        for s in group:
            k = s[2][0]
            if (left := known.get((k, s[0]))) is None:
                left = known[k, s[0]] = sum([get(f, 0.0) for f in read.before(k, s[0])])
            if (right := known.get((k, -s[1]))) is None:
                right = known[k, -s[1]] = sum([get(f, 0.0) for f in read.behind(k, s[1])])
            out.append(left + right + sum([get(f, 0.0) for f in read.body(s)]))
        return out

    def best(self, text: str) -> list[Span]:
        out: list[Span] = []
        read = _Text(text, self.usual)
        for group in stretches(read.candidates()):
            scores = self.scores(read, group)
            if len(group) == 1:
                out += group if scores[0] > 0 else []
                continue
            order, before = self.order(group)
            value, take = [0.0], []
            for k, i in enumerate(order):
                with_it = value[before[k]] + scores[i]
                take.append(with_it > value[-1])
                value.append(max(with_it, value[-1]))
            k, chosen = len(order), []
            while k:
                if take[k - 1]:
                    chosen.append(group[order[k - 1]])
                    k = before[k - 1]
                else:
                    k -= 1
            out += reversed(chosen)
        return out

    def train(self, examples: Iterable[tuple[str, list[Span]]], usual: frozenset[str] = frozenset(), epochs: int = EPOCHS, seed: int = 3) -> Field:
        """Fit the weights; ``usual`` words are held back at random, as are the words around a candidate, so that neither is relied upon."""
        names: dict[str, int] = {}
        rows = []
        rng = np.random.default_rng(seed)
        known = sorted(usual)
        for text, gold in examples:
            held = frozenset(w for w, keep in zip(known, rng.random(len(known)) < KEEP_USUAL) if keep) if len(rows) % 50 == 0 or not rows else held
            right, read = set(gold), _Text(text, held)
            for group in stretches(read.candidates()):
                order, before = self.order(group)
                feats = [np.array([names.setdefault(f, len(names)) for f in read.features(group[i])]) for i in order]
                rows.append((feats, before, [float(group[i] in right) for i in order]))
        lexical = np.array([bool(_LEXICAL.match(f)) for f in names])
        squares, w = np.full(len(names), 1e-2), np.zeros(len(names))
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                feats, before, gold = rows[r]
                if rng.random() < DROP_WORDS:
                    feats = [f[~lexical[f]] for f in feats]
                n = len(feats)
                score = [w[f].sum() for f in feats]
                ahead = [0.0] * (n + 1)
                for k in range(n):
                    a, b = ahead[k], ahead[before[k]] + score[k]
                    ahead[k + 1] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
                # backward: share of all segmentations that pass through each state
                mass, inside = [0.0] * (n + 1), [0.0] * n
                mass[n] = 1.0
                for k in range(n - 1, -1, -1):
                    inside[k] = mass[k + 1] * math.exp(ahead[before[k]] + score[k] - ahead[k + 1])
                    mass[before[k]] += inside[k]
                    mass[k] += mass[k + 1] - inside[k]
                for k in range(n):
                    step = gold[k] - inside[k]
                    if abs(step) > 1e-3:
                        f = feats[k]
                        squares[f] += step * step
                        w[f] += 0.2 * step / np.sqrt(squares[f]) - 1e-4 * w[f]
        self.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}
        return self


@lru_cache(maxsize=2)
def trained(texts: int = TRAIN_TEXTS, seed: int = 11) -> Field:
    """The model, trained once per process on all sentences and names."""
    return Field().train(compose(texts, seed, None), frozenset(ordinary_words()))


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _tag(shared, whole: bool):
    found = pa.schema([("row_no", pa.int64()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])
    texts = pa.schema([("row_no", pa.int64()), ("redacted", pa.string()), ("n_items", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            rows, read = [], {}
            for no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (spans := read.get(text)) is None:
                    spans = read[text] = field.best(text) if text else []
                rows += [(no, redacted(text, spans) if spans else text, len(spans))] if whole else [(no, k, a, b) for a, b, k in spans]
            schema = texts if whole else found
            columns = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def usual_of(texts: DataFrame, share: float = USUAL) -> frozenset[str]:
    """Usual words of all ``texts(content)``: counts are combined before the shuffle, and at most ``2 / share`` words come back.

    A word is usual if it stands in lower case about as often as with a capital
    inside a sentence, or with a capital at the begin of sentences only.
    """
    word = r"[\\p{L}][\\p{L}\\p{N}_\'’]+"
    found = texts.select(F.explode(F.expr(rf"regexp_extract_all(concat(chr(10), content), '(?:[.!?:;\\n\"“(>|]\\s*)?(?<![\\p{{L}}\\p{{N}}_]){word}', 0)")).alias("m"))
    found = found.select(F.regexp_replace("m", r"^[^\p{L}]+", "").alias("w"), F.col("m").rlike(r"^[^\p{L}]").alias("opens"))
    low = F.lower("w") == F.col("w")
    counts = found.groupBy(F.lower("w").alias("w")).agg(F.count_if(low).alias("low"), F.count_if(~low & F.col("opens")).alias("start"), F.count_if(~low & ~F.col("opens")).alias("mid"))
    total = counts.agg(F.sum(F.col("low") + F.col("start") + F.col("mid"))).first()[0] or 0
    often = F.lit(share * total)
    usual = ((F.col("low") >= often) & (F.col("low") >= 0.3 * (F.col("low") + F.col("mid")))) | ((F.col("start") >= often) & (F.col("start") >= 4) & (F.col("mid") <= 0.05 * F.col("start")))
    return frozenset(r.w for r in counts.filter(usual).select("w").collect())


def fitted(texts: DataFrame) -> Field:
    """The trained field with the usual words of ``texts(content)``."""
    return Field(trained().weights, usual_of(texts))


def _shared(texts: DataFrame, field: Field | None):
    """Weights and usual words for the executors, both of bounded size."""
    field = field or fitted(texts)
    return texts.sparkSession.sparkContext.broadcast((field.weights, field.usual))


def find_items(rows: DataFrame, row_no: str, content: str = "content", field: Field | None = None) -> DataFrame:
    """``(row_no, kind, start_pos, end_pos)`` of every item."""
    texts = rows.select(F.col(row_no).cast("long").alias("row_no"), F.col(content).alias("content")).filter("content is not null")
    return texts.mapInArrow(_tag(_shared(texts, field), whole=False), "row_no long, kind string, start_pos int, end_pos int")


def redact(rows: DataFrame, row_no: str, content: str = "content", field: Field | None = None) -> DataFrame:
    """``(row_no, redacted, n_items)``: each text with typed placeholders in place of its items."""
    texts = rows.select(F.col(row_no).cast("long").alias("row_no"), F.col(content).alias("content"))
    return texts.mapInArrow(_tag(_shared(texts, field), whole=True), "row_no long, redacted string, n_items int")
