"""Problem 4: variant spellings of the names of people and organisations.

Names are cut into tokens (case, accents, titles, joined words and dotted
abbreviations levelled).  Tokens with many different neighbours are *common*
(given names, trades, legal forms); what is left is the name's *root*, a
surname or the proper part of a firm.  A symmetric-delete index finds roots
within a small edit distance: every root is filed under all strings that arise
by deleting up to one letter (two of a long root), and roots that share such a
string are compared.  Roots map to the most frequent spelling that a chain of
near ones leads to.  Then the other tokens of
two names are aligned by an optimal assignment in which an initial stands for
any word that begins with it, an abbreviation for a word it is a subsequence
of, and a short form for a given name.

A stated place separates: names are linked inside a place; a name without
place joins the one entity that its name fits, or others without place.  The
place is a column; where it is null, brackets behind the name give it, else the
first part of the description that is the place of some row.

Work is done on distinct spellings, so a name that a third of the rows share is
one row until the end.  Only the result, all pairs that name the same entity,
is as large as the question makes it.

Names without a root (all words short or common, or initials alone) are linked
by equality of their levelled words, inside kind and place; near is not enough
for them, as 'J. Lee' is one letter from 'K. Lee'.  Initials that several firms
of the place have (without a place: any firm) stay alone.

Defined results: a null or empty name (no letter or digit) names nobody and is
no case; repeated rows under one id are one row; a null kind is told from the
name; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.session import materialize

TITLES = {"dr", "prof", "mr", "mrs", "ms", "the", "of", "and", "von", "van", "sir"}
LEGAL = {
    "gmbh": "gmbh", "inc": "inc", "incorporated": "inc", "ltd": "ltd", "limited": "ltd", "ag": "ag", "aktiengesellschaft": "ag",
    "llc": "llc", "sa": "sa", "foundation": "foundation", "fdn": "foundation", "cooperative": "cooperative", "coop": "cooperative",
    "corp": "corp", "corporation": "corp", "plc": "plc", "co": "co", "company": "co", "kg": "kg",
}
#: Short forms of given names, each with the names it may stand for.
SHORT = {
    "abby": "abigail", "alex": "alexander", "sandy": "alexander", "xander": "alexander", "tony": "anthony", "gus": "augustine", "ben": "benjamin", "benny": "benjamin",
    "charlie": "charlotte charles", "lottie": "charlotte", "chris": "christopher", "kit": "christopher", "debbie": "deborah", "deb": "deborah", "lola": "dolores", "loli": "dolores",
    "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore edward", "teddy": "theodore", "theo": "theodore", "ellie": "eleanor", "nora": "eleanor", "nell": "eleanor",
    "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "paco": "francisco", "fran": "francisco frances", "pancho": "francisco", "fred": "frederick", "freddy": "frederick",
    "beppe": "giuseppe", "pino": "giuseppe", "peppe": "giuseppe", "greg": "gregory", "hetty": "henrietta", "etta": "henrietta", "bella": "isabella", "isa": "isabella", "izzy": "isabella",
    "hans": "johannes", "jo": "josefina johannes", "john": "johannes", "jon": "jonathan", "nathan": "jonathan", "josie": "josefina", "pepa": "josefina", "kate": "katherine", "katie": "katherine", "kathy": "katherine",
    "leo": "leonardo", "nardo": "leonardo", "luda": "ludmila", "mila": "ludmila", "lena": "magdalena", "magda": "magdalena", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret",
    "matt": "matthias", "hias": "matthias", "mike": "michael", "mick": "michael", "mickey": "michael", "nick": "nikolai", "kolya": "nikolai", "niko": "nikolai", "pat": "patricia", "trish": "patricia", "patty": "patricia", "tricia": "patricia",
    "dick": "richard", "rick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "roz": "rosalind", "ros": "rosalind", "linda": "rosalind", "seb": "sebastian", "bastian": "sebastian", "basti": "sebastian",
    "sue": "susanna", "suzy": "susanna", "susie": "susanna", "sanna": "susanna", "vicky": "victoria", "tori": "victoria", "vic": "victoria", "mina": "wilhelmina", "willa": "wilhelmina", "minnie": "wilhelmina",
    "bill": "william", "will": "william", "liam": "william", "billy": "william", "zach": "zachary", "zack": "zachary", "hannes": "johannes", "fritz": "frederick", "lex": "alexander", "rita": "margaret", "lotte": "charlotte", "wilma": "wilhelmina", "johnny": "jonathan",
}
#: Roots of more than ``LONG`` letters are filed with up to ``EDITS`` deletions and may differ by as many edits, others by one;
#: spellings of a short root that are two edits away are therefore not linked.
LONG, EDITS = 6, 2
#: First letters of legal forms, which initials of a firm may end with.
LEGAL_LETTERS = frozenset(form[0] for form in LEGAL.values())
#: A token is common if it has at least this share of the neighbours of the token that has most, and at least ``LEAST`` neighbours.
SHARE, LEAST = 0.3, 6


def fold(text: str) -> str:
    """Accents off (``ß`` to ``ss``), case kept."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(c))


def tokens(name: str) -> list[str]:
    """Levelled tokens of a name in their order, without what stands in brackets at its end."""
    name = re.sub(r"\s*\([^()]*\)\s*$", "", fold(name)).replace("_", " ")
    name = re.sub(r"\b(?:[^\W\d_]\.){2,}(?:[^\W\d_]\b)?", lambda m: m[0].replace(".", "") + " ", name)
    name = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])", " ", name)
    name = re.sub(r"(?i)\bco-op\b", "coop", name)
    return re.findall(r"[^\W_]+", name.lower())


def place_words(name: str, text: str | None) -> tuple[str | None, list[str]]:
    """What stands in brackets behind the name, and every part of up to three words of the runs of capitalised words in ``text``."""
    inside = re.search(r"\(([^()]*)\)\s*$", name)
    runs = re.findall(r"[^\W\d_a-z][\w'’-]*(?: [^\W\d_a-z][\w'’-]*)*", text or "")
    level = lambda x: fold(x).lower().strip()
    parts = [" ".join(words[i:j]) for r in runs for words in (r.split(" "),) for i in range(len(words)) for j in range(min(len(words), i + 3), i, -1)]
    return level(inside[1]) or None if inside else None, list(dict.fromkeys(level(x) for x in parts))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def edits(word: str) -> int:
    """Edits that are allowed in a root."""
    return EDITS if len(word) > LONG else 1


def deletes(word: str, most: int = 1) -> list[str]:
    """The word and what is left after deleting up to ``most`` letters."""
    out = last = dict.fromkeys([word])
    for _ in range(most if len(word) > 2 else 0):
        last = dict.fromkeys(w[:i] + w[i + 1 :] for w in last for i in range(len(w)))
        out = out | last
    return list(out)


class Lexicon:
    """Common tokens with their symmetric-delete index."""

    def __init__(self, common: dict[str, int], kinds: dict[str, str]) -> None:
        self.kinds, self.index = kinds, {}
        self.full = {w for names in SHORT.values() for w in names.split()}
        self.trades = {w for w in common if len(w) > 4 and kinds.get(w) == "organization"}
        self.common = dict.fromkeys(self.full, 0) | common
        for word in [*self.common, *SHORT]:
            for d in deletes(word) if len(word) > 4 else [word]:
                self.index.setdefault(d, []).append(word)

    def level(self, token: str) -> str | None:
        """The common word, or short form, that the token is or misspells."""
        if token in self.common or token in SHORT:
            return token
        if len(token) < 5:
            return None
        near = {w for d in deletes(token) for w in self.index.get(d, ()) if len(w) > 4 and distance(token, w, 1) <= 1}
        return max(near, key=lambda w: (self.common.get(w, 0), w)) if near else None


    def parts(self, token: str) -> list[str]:
        """A joined token cut before the common word it ends with."""
        if len(token) > 8 and token not in self.common:
            for i in range(3, len(token) - 4):
                if token[i:] in self.trades:
                    return [token[:i], token[i:]]
        return [token]


def subsequence(short: str, word: str) -> bool:
    rest = iter(word)
    return bool(short) and short[0] == word[:1] and all(c in rest for c in short)


def agrees(a: str, b: str) -> float:
    """How well two tokens agree: 1 the same, 0 not at all."""
    if a == b:
        return 1.0
    if b in SHORT and (a not in SHORT or len(a) < len(b)):
        a, b = b, a
    if a in SHORT:
        if b in SHORT[a].split() or (b in SHORT and set(SHORT[a].split()) & set(SHORT[b].split())):
            return 0.9
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.6 if long[0] == short else 0.0
    if len(short) <= 5 and len(short) < len(long) and subsequence(short, long):
        return 0.8
    return 0.7 if min(len(a), len(b)) > 3 and distance(a, b, 1) <= 1 else 0.0


def starts(word: str) -> set[str]:
    """First letters of a word and of the names it is short for."""
    return {word[0], *(w[0] for w in SHORT.get(word, "").split())}


def assignment(gain: list[list[float]]) -> float:
    """Largest total of an assignment of all rows to different columns (no more rows than columns), by the Hungarian method."""
    n, m = len(gain), len(gain[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, came, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j0]:
            used[j0], i0, delta, j1 = True, row_of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -gain[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], came[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row_of[j0], j0 = row_of[came[j0]], came[j0]
    return sum(gain[row_of[j] - 1][j - 1] for j in range(1, m + 1) if row_of[j])


def align(a: list[str], b: list[str]) -> float:
    """Best total agreement of an assignment between two token lists of any length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    gain = [[agrees(x, y) for y in b] for x in a]
    return max(gain[0]) if len(a) == 1 else assignment(gain)


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            name = r.name if isinstance(r.name, str) else ""
            words = tokens(name)
            if words:
                place = fold(r.place).lower().strip() if isinstance(r.place, str) else None
                inside, said = place_words(name, r.description if isinstance(r.description, str) else None)
                rows.append((r.id, r.kind, place or inside, said if not (place or inside) else [], words))
        yield pd.DataFrame(rows, columns=["id", "kind", "place", "said", "words"])


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, and the shuffle files behind the table go at once; else they stay until the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, was)


def _drop(stored: DataFrame) -> None:
    """Remove a table of ``_stored`` that nothing reads any more."""
    spark = stored.sparkSession
    for file in stored.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _placed(named: DataFrame) -> DataFrame:
    """Rows without a place of their own get the first one that their description names, places being what rows state."""
    stated, open_ = named.filter("place is not null").drop("said"), named.filter("place is null")
    known = stated.select(F.col("place").alias("found")).distinct()
    told = open_.filter("size(said) > 0").select("id", F.posexplode("said").alias("at", "found")).join(known, "found")
    first = told.groupBy("id").agg(F.min_by("found", "at").alias("found"))
    return stated.unionByName(open_.join(first, "id", "left").select("id", "kind", F.col("found").alias("place"), "words"))


def _structure(lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon.value
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                words = [p for w in r.words if w not in TITLES for p in lex.parts(w)]
                legal = [LEGAL[w] for w in words if w in LEGAL]
                left = [w for w in words if w not in LEGAL]
                levels = [lex.level(w) for w in left]
                free = [w for w, lv in zip(left, levels) if lv is None and len(w) > 3]
                root = max(free, key=len) if free else ""
                if not root:  # a short or common word can be the root when nothing else is there
                    rest = [w for w, lv in zip(left, levels) if len(w) > 2]
                    root = max(rest, key=len) if len(rest) > 1 else ""
                # words that are in no list are marked: they cannot contradict
                other = sorted(lv or (w if len(w) < 4 else f"~{w}") for w, lv in zip(left, levels) if w != root)
                initials = "".join(w[0] for w in [*left, *legal])
                acronym = left[0] if len(left) == 1 and not root and 2 <= len(left[0]) <= 5 else None
                if acronym:
                    other = []
                full = [SHORT[w] if w in SHORT and " " not in SHORT[w] else w for w in (lv or w for w, lv in zip(left, levels))]
                bare = None if root else " ".join(sorted(full) or r.words)
                votes = [lex.kinds.get(lv) or ("person" if lv in SHORT or lv in lex.full else None) for lv in levels if lv]
                votes = [v for v in votes if v]
                kind = "organization" if legal or acronym or "the" in r.words or "of" in r.words else votes[0] if votes else "person" if any(len(w) == 1 for w in left) else None
                rows.append((r.kind if r.kind in ("person", "organization") else kind, r.place, " ".join(r.words), root, other, initials, acronym, bare, r.n))
            yield pd.DataFrame(rows, columns=["kind", "place", "spelling", "root", "other", "initials", "acronym", "bare", "n"])

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def _delete_keys(words: pd.Series) -> pd.Series:
    return words.map(lambda w: deletes(w, edits(w)))


@F.pandas_udf(T.IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y, 3) for x, y in zip(a, b)], dtype="int32")


def _merged(keys: DataFrame) -> DataFrame:
    """A side of exploded delete keys, never to be broadcast: the optimizer takes it to be as small as the words, and their number grows with the input."""
    return keys.hint("merge")


def _centres(roots: DataFrame, scope: list[str]) -> DataFrame:
    """Map each root of a scope to the top of its chain of ever more frequent near roots: ``(scope..., root, centre)``."""
    keyed = roots.select(*scope, "root", "n", F.explode(_delete_keys("root")).alias("d"))
    other = keyed.select(*scope, "d", F.col("root").alias("near"), F.col("n").alias("near_n"))
    higher = F.expr("near_n > n or (near_n = n and near < root)")
    allowed = F.when(F.least(F.length("root"), F.length("near")) > LONG, EDITS).otherwise(1)
    # a swap is one edit here and two of Levenshtein's
    pairs = keyed.join(_merged(other), [*scope, "d"]).filter(higher & F.levenshtein("root", "near", 2 * EDITS).between(0, 2 * allowed)).select(*scope, "root", "near", "near_n").distinct()
    close = pairs.filter(_apart("root", "near") <= allowed)
    up = close.groupBy(*scope, "root").agg(F.max_by("near", F.struct("near_n", "near")).alias("centre"))
    top = _stored(roots.select(*scope, "root").join(up, [*scope, "root"], "left").select(*scope, "root", F.coalesce("centre", "root").alias("centre")), "centres")
    while True:  # every round doubles the length of the chains that are followed
        next_ = top.select(*scope, F.col("root").alias("centre"), F.col("centre").alias("top"))
        jumped = _stored(top.join(next_, [*scope, "centre"]).select(*scope, "root", "top", F.col("centre").alias("was")), "centres")
        _drop(top)
        top = jumped.select(*scope, "root", F.col("top").alias("centre"))
        if jumped.filter("top <> was").isEmpty():
            return top


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spellings of one root in one place, sorted together: part those whose other words contradict."""

    def fits(r: tuple, part: dict) -> float | None:
        """Agreement of a spelling with a part, None if they contradict."""
        strong, known = [w for w in r[5] if len(w) > 1 and (w[0] != "~" or r[0] == "person")], part["words"]
        if r[0] == "person":
            clear = [w for w in strong if w[0] != "~" and (len(w) > 3 or w in SHORT)]
            if not clear:  # unknown words, or initials, maybe written together
                letters = {c for w in [*known, *part["letters"]] for c in starts(w)}
                own = {w[0] for w in r[5] if w[0] != "~"}
                return 0.5 if not own or not letters or own & letters else None
            first = {c for w in clear for c in starts(w)}
            if not known:
                return 0.5 if not part["letters"] or first & {w[0] for w in part["letters"]} else None
            total = max(align(clear, [w]) for w in known)
            return total if total >= 0.6 else None
        if not strong or not known:
            return 0.5
        total = align(strong, known)
        if total >= 0.6 * min(len(strong), len(known)):
            return total
        joined = [w for w in strong if len(w) <= 5]
        return 0.5 if joined and any(subsequence(w, i) or (len(i) > 1 and w.startswith(i)) for w in joined for i in part["initials"]) else None

    def close(group: list[tuple]) -> list[tuple]:
        parts: list[dict] = []
        out = []
        # spellings that say most come first and found the parts
        for r in sorted(group, key=lambda r: (-sum(len(w) > 3 for w in r[5]), -r[7], r[4])):
            scores = [(score, -k) for k, part in enumerate(parts) if (score := fits(r, part)) is not None]
            k = -max(scores)[1] if scores else len(parts)
            if k == len(parts):
                parts.append({"words": [], "letters": [], "initials": set()})
            part = parts[k]
            clear = [w for w in r[5] if w[0] != "~" and (len(w) > 3 or w in SHORT or (r[0] != "person" and len(w) > 1))]
            part["words"] = list(dict.fromkeys([*part["words"], *clear]))
            part["letters"] = list(dict.fromkeys([*part["letters"], *(w for w in r[5] if w not in clear and w[0] != "~")]))
            part["initials"].add(r[6])
            out.append((*r[:7], k))
        return out

    columns = ["kind", "place", "centre", "root", "spelling", "other", "initials", "part"]
    key, group = None, []
    for batch in batches:
        done = []
        for r in batch.itertuples(index=False):
            k = (r.kind, r.place, r.centre)
            if k != key and group:
                done += close(group)
                group = []
            key = k
            group.append((r.kind, r.place, r.centre, r.root, r.spelling, list(r.other), r.initials, r.n))
        yield pd.DataFrame(done, columns=columns)
    if group:
        yield pd.DataFrame(close(group), columns=columns)


@F.pandas_udf(T.DoubleType())
def _fit(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """How well the other words of two names agree; negative if they contradict."""

    def one(k: str | None, x: list[str], y: list[str]) -> float:
        x, y = [w for w in x if w[0] != "~"], [w for w in y if w[0] != "~"]
        short = lambda w: len(w) == 1 or (k == "person" and len(w) < 4 and w not in SHORT)
        long_x, long_y = [w for w in x if not short(w)], [w for w in y if not short(w)]
        if long_x and long_y:
            total = align(long_x, long_y)
            if total < 0.6 * min(len(long_x), len(long_y)):
                # an organisation's initials instead of its words; the first is the root's
                short, other = (long_x, y) if len(long_x) == 1 and len(long_x[0]) < 5 else (long_y, x)
                if k != "person" and len(short) == 1 and 1 < len(short[0]) < 5 and {*short[0][1:]} <= {w[0] for w in other} | LEGAL_LETTERS and short[0][1] in {w[0] for w in other}:
                    return 0.3
                return -1.0
        elif x and y and k == "person" and not {c for w in x for c in starts(w)} & {c for w in y for c in starts(w)}:
            return -1.0
        # a middle initial that contradicts
        mid_x, mid_y = {w for w in x if len(w) == 1}, {w for w in y if len(w) == 1}
        if long_x and long_y and mid_x and mid_y and not mid_x & mid_y:
            return -1.0
        return align(x, y)

    return pd.Series([one(k, x, y) for k, x, y in zip(kind, a, b)])


def same_names(rows: DataFrame) -> DataFrame:
    """``(id, entity)``: rows with the same ``entity`` name the same person or organisation.

    ``rows`` has ``id, name, kind, place, description`` (strings, each but the id may be null).
    """
    spark = rows.sparkSession
    read = rows.select("id", "name", "kind", "place", "description").filter("id is not null").mapInPandas(_normalise, "id string, kind string, place string, said array<string>, words array<string>")
    read = _stored(read, "read")
    named = _stored(_placed(read), "names")
    _drop(read)
    # neighbours of a token in the names, at most two per place it stands in
    long = F.filter("words", lambda w: F.length(w) > 1)
    near = named.select(long.alias("w")).distinct().select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))).alias("p")).filter("p.b is not null")
    sides = near.select(F.col("p.a").alias("t"), F.col("p.b").alias("o")).unionByName(near.select(F.col("p.b").alias("t"), F.col("p.a").alias("o"))).filter("length(t) > 2 and length(o) > 2").distinct()
    counts = _stored(sides.groupBy("t").count(), "neighbours")
    most = counts.agg(F.max("count")).first()[0] or 0
    # at most 2 * distinct names / LEAST words, in practice a few hundred
    common = {r.t: r["count"] for r in counts.filter(F.col("count") >= max(LEAST, SHARE * most)).collect()}
    told = named.filter("kind in ('person', 'organization')").select("kind", F.explode("words").alias("t")).join(counts.filter(F.col("count") >= max(LEAST, SHARE * most)).select("t"), "t", "left_semi")
    told = told.groupBy("t", "kind").count().groupBy("t").agg(F.max_by("kind", "count").alias("kind"))
    lexicon = spark.sparkContext.broadcast(Lexicon(common, {r.t: r.kind for r in told.collect()}))
    plain = named.select("kind", "place", "words").groupBy("kind", "place", "words").agg(F.count("*").alias("n"))
    shape = plain.mapInPandas(_structure(lexicon), "kind string, place string, spelling string, root string, other array<string>, initials string, acronym string, bare string, n long")
    forms = _stored(shape, "forms")
    number = lambda kind: F.sum(F.when(F.col("kind").eqNullSafe(kind), F.col("n")))
    spelt = forms.filter("root <> ''").groupBy("place", "root", "spelling", "other", "initials").agg(number("person").alias("person"), number("organization").alias("organization"), number(None).alias("untold"))
    # a kind that neither the row nor the name tells: the one the same root has elsewhere
    open_ = spelt.filter("untold is not null")
    kinds = spelt.filter("person is not null or organization is not null").join(open_.select("root").distinct(), "root", "left_semi")
    kinds = kinds.groupBy("root").agg((F.coalesce(F.max("organization"), F.lit(0)) > F.coalesce(F.max("person"), F.lit(0))).alias("firm"))
    given = {kind: F.when(F.coalesce("firm", F.lit(False)) == F.lit(kind == "organization"), F.coalesce(kind, F.lit(0)) + F.col("untold")).otherwise(F.col(kind)) for kind in ("person", "organization")}
    spelt = spelt.filter("untold is null").drop("untold").unionByName(open_.join(kinds, "root", "left").withColumns(given).drop("untold", "firm"))
    spelt = spelt.withColumn("k", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("n")) for kind in given)))).filter("k.n is not null")
    spellings = _stored(spelt.select("k.kind", "place", "root", "spelling", "other", "initials", "k.n"), "spellings")
    rest = _stored(forms.filter("root = ''"), "rest")
    _drop(forms)
    placed = spellings.filter("place is not null")
    centres = _centres(placed.groupBy("kind", "place", "root").agg(F.sum("n").alias("n")), ["kind", "place"])
    grouped = placed.join(centres, ["kind", "place", "root"]).repartition("kind", "place", "centre").sortWithinPartitions("kind", "place", "centre")
    parts = _stored(grouped.select("kind", "place", "centre", "root", "spelling", "other", "initials", "n").mapInPandas(_split, "kind string, place string, centre string, root string, spelling string, other array<string>, initials string, part int"), "parts")
    _drop(centres)
    entity = F.concat_ws("|", "kind", "place", "centre", "part")
    known = parts.withColumn("entity", entity)
    # names without a place: entities of the same or a near root whose other words fit
    free = _stored(spellings.filter("place is null"), "free")
    _drop(spellings)
    keys = free.select("kind", "root").distinct().withColumn("d", F.explode(_delete_keys("root")))
    targets = known.select("kind", F.col("centre").alias("target")).distinct().withColumn("d", F.explode(_delete_keys("target")))
    reach = keys.join(_merged(targets), ["kind", "d"]).filter(F.levenshtein("root", "target", 4) >= 0).select("kind", "root", "target").distinct().withColumn("far", _apart("root", "target")).filter("far <= 1 or (far = 2 and length(root) > 7)")
    shown = known.select("kind", F.col("centre").alias("target"), "entity", F.col("other").alias("shown"), F.col("root").alias("spelt")).distinct()
    offers = free.select("kind", "root", "spelling", "other").join(reach, ["kind", "root"]).join(shown, ["kind", "target"])
    offers = offers.withColumn("fit", _fit("kind", "other", "shown") - F.col("far") * 0.5).filter("fit > -0.9")
    # every spelling of the entity is an offer; a contradiction with its fullest spelling excludes it
    best = offers.groupBy("kind", "root", "spelling", "entity").agg(F.max("fit").alias("fit"))
    top = best.withColumn("r", F.rank().over(Window.partitionBy("kind", "root", "spelling").orderBy(F.desc("fit"))))
    single = top.filter("r = 1").groupBy("kind", "root", "spelling").agg(F.count("*").alias("n"), F.min("entity").alias("entity")).filter("n = 1").drop("n")
    joined = _stored(single, "joined")
    lone = free.join(joined, ["kind", "root", "spelling"], "left_anti").withColumn("place", F.lit(""))
    lone_centres = _centres(lone.groupBy("kind", "place", "root").agg(F.sum("n").alias("n")), ["kind", "place"])
    lone = lone.join(lone_centres, ["kind", "place", "root"]).repartition("kind", "place", "centre").sortWithinPartitions("kind", "place", "centre")
    lone = lone.select("kind", "place", "centre", "root", "spelling", "other", "initials", "n").mapInPandas(_split, "kind string, place string, centre string, root string, spelling string, other array<string>, initials string, part int").withColumn("entity", entity)
    # initials alone: the organisation of that place with those initials
    short = rest.filter("acronym is not null and place is not null").select("spelling", "place", "acronym").distinct()
    short = short.withColumn("initials", F.explode(F.array(F.col("acronym"), F.expr("left(acronym, length(acronym) - 1)"))))  # the legal form may be left out
    firms = known.filter("kind = 'organization' and length(initials) > 1").select("place", "initials", "entity").distinct()
    fitting = _stored(short.join(firms, ["place", "initials"]).groupBy("spelling", "place").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")), "fitting")
    named_by = fitting.filter("n = 1").drop("n")
    # names without a root: equal levelled words
    bare = rest.filter("bare is not null").select("kind", "place", "spelling", "bare", "acronym").distinct()
    told_there = bare.filter("kind is not null").groupBy("bare").agg(F.max("kind").alias("kind_there"))
    bare = bare.join(told_there, "bare", "left").withColumn("kind", F.coalesce("kind", "kind_there", F.lit("person"))).drop("kind_there").distinct()
    stated = bare.filter("place is not null").join(fitting, ["spelling", "place"], "left").filter("n is null or n = 1")
    stated = _stored(stated.withColumn("entity", F.coalesce("entity", F.concat_ws("|", "kind", "place", F.lit("="), "bare"))).select("spelling", "place", "kind", "bare", "entity"), "bare")
    unstated = bare.filter("place is null").withColumn("initials", F.explode(F.array(F.coalesce("acronym", F.lit("")), F.coalesce(F.expr("left(acronym, length(acronym) - 1)"), F.lit("")))))
    several = unstated.join(firms.select("initials").distinct(), "initials", "left_semi").select("spelling").distinct()
    one = stated.groupBy("kind", "bare").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")).filter("n = 1").drop("n")
    unstated = unstated.select("spelling", "kind", "bare").distinct().join(several, "spelling", "left_anti").join(one, ["kind", "bare"], "left")
    unstated = unstated.select("spelling", F.lit("").alias("place"), "kind", F.coalesce("entity", F.concat_ws("|", "kind", F.lit(""), F.lit("="), "bare")).alias("entity"))
    where = (
        known.select("spelling", "place", "kind", "entity")
        .unionByName(joined.select("spelling", F.lit("").alias("place"), "kind", "entity"))
        .unionByName(lone.select("spelling", "place", "kind", "entity"))
        .unionByName(named_by.select("spelling", "place", F.lit("organization").alias("kind"), "entity"))
        .unionByName(stated.select("spelling", "place", "kind", "entity"))
        .unionByName(unstated)
    )
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("entity")))
    where = _stored(where.groupBy("spelling", "place").agg(of("person").alias("person"), of("organization").alias("organization"), F.min("entity").alias("any_entity")), "where")
    for stored in (parts, free, rest, joined, fitting, stated):
        _drop(stored)
    asked = named.select("id", F.array_join("words", " ").alias("spelling"), F.coalesce("place", F.lit("")).alias("place"), "kind").dropDuplicates(["id"])
    entity = F.coalesce(F.when(F.col("kind") == "person", F.col("person")).when(F.col("kind") == "organization", F.col("organization")), "any_entity")
    return asked.join(where, ["spelling", "place"]).select("id", entity.alias("entity")).filter("entity is not null")


def same_name_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different rows that name the same person or organisation: ``(id_a, id_b)``."""
    linked = _stored(same_names(rows), "linked")
    a, b = linked.select("entity", F.col("id").alias("id_a")), linked.select("entity", F.col("id").alias("id_b"))
    return a.join(b, "entity").filter("id_a < id_b").select("id_a", "id_b")
