"""Visually identical text with different characters (problem 6).

Look-alike classes come from a union-find over strings and code points, each class gets its most frequent member in the corpus as its
representative, and a multi-pattern automaton rewrites texts greedily, longest match first. Canonically equal texts (order of marks, composed
letters and syllables of any script) are one from the start: rewriting sees letters apart from their marks, and what comes out is composed. All of it
has a bounded size: the classes depend on Unicode, not on the corpus, so the driver sees a few thousand counts at most.

Defined results: null stays null and the empty text stays empty; a text without unusual characters comes back unchanged; of members with
the same count an ASCII one, then the shorter, then the one that sorts first represents the class; other columns pass through untouched.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.pairs import member_pairs
from ravelin.runtime import written

# Letters of other scripts that common fonts draw like a Latin letter.
HOMOGLYPHS = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟОՕ",
    "P": "ΡР", "Q": "Ԛ", "S": "Ѕ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "o": "οоօ", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
    "μ": "µ",
}
#: Spaces of about the usual width, and hyphens that only differ in where a line may break.
SPACES = "\u00a0\u2004\u2005\u2006\u2007\u2008\u2009\u202f\u205f"
HYPHENS = "\u2010\u2011"
#: Code points that show nothing besides the format characters (category Cf): grapheme joiner, Mongolian and general variation selectors.
INVISIBLE_MORE = "\u034f\u180b\u180c\u180d\u180f" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Blocks whose letters with marks are paired with their decompositions: Latin, Greek, Cyrillic and their extensions.
COMPOSED = ((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000))


class UnionFind:
    """Classes of strings, joined pair by pair."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (above := self.up.setdefault(root, root)) != root:
            root = above
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        found = defaultdict(list)
        for x in self.up:
            found[self.find(x)].append(x)
        return [sorted(v) for _, v in sorted(found.items()) if len(v) > 1]


def invisible() -> str:
    """Every code point that shows nothing: they're all in the class of the empty string."""
    return "".join(chr(c) for c in range(0x80, 0x1_0000) if ud.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2)) + INVISIBLE_MORE


@lru_cache(1)
def canonical() -> tuple[frozenset[str], frozenset[str]]:
    """Code points with which a text may not be in composed form, and those that are taken apart when letters and marks are."""
    loose, apart = set(), set()
    seconds = set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))  # vowels and finals of syllables
    for c in range(0x80, sys.maxunicode + 1):
        x = chr(c)
        if ud.combining(x):
            loose.add(x)
        if 0xAC00 <= c < 0xD7A4:
            continue  # whole syllables come back as they were
        parts = ud.decomposition(x)
        if parts and not parts.startswith("<"):
            apart.add(x)
            if ud.normalize("NFC", x) != x:
                loose.add(x)
            seconds.update(chr(int(p, 16)) for p in parts.split()[1:])
    return frozenset(loose | seconds), frozenset(apart)


def pairs() -> Iterator[tuple[str, str]]:
    """The look-alike relation before it's closed: pairs of strings that look the same."""
    for c in range(0xFF01, 0xFF5F):
        yield chr(c), chr(c - 0xFEE0)
    for plain, others in HOMOGLYPHS.items():
        for x in others:
            yield x, plain
    for x in SPACES:
        yield x, " "
    for x in HYPHENS:
        yield x, "-"
    for c in range(0xA0, 0xFB07):
        x = chr(c)
        kind, *parts = (ud.decomposition(x) or "none").split()
        if kind == "<compat>" and len(k := ud.normalize("NFKC", x)) > 1 and k.isalpha() and ud.name(x, "").startswith("LATIN"):
            yield x, k
        elif kind == "<compat>" and ud.category(x) == "Nl" and len(k := ud.normalize("NFKC", x)) == 1:  # Roman numerals of one letter
            yield x, k
        elif not kind.startswith("<") and kind != "none" and not parts and not 0xF900 <= c < 0xFB00:
            yield x, chr(int(kind, 16))


@lru_cache(4)
def classes(more: tuple[tuple[str, str], ...] = ()) -> list[list[str]]:
    """The transitive look-alike classes: of code points and short strings first, then of letters with marks over those."""
    u = UnionFind()
    for x, y in (*pairs(), *more):
        u.join(x, y)
    members: dict[str, set[str]] = defaultdict(set)
    for group in u.classes():
        for x in group:
            members[x].update(group)
    for x in [x for x in u.up if len(x) > 1]:  # joined letters look like the single ones, whatever script those are from
        for y in map("".join, product(*(sorted(members.get(c, {c})) for c in x))):
            u.join(x, y)
    two = [(chr(c), d) for a, b in COMPOSED for c in range(a, b) if len(d := ud.normalize("NFD", chr(c))) > 1 or len((ud.decomposition(chr(c)) or "<").split()) == 2]
    for x, _ in sorted(two, key=lambda p: len(p[1])):  # a letter with one mark comes before those with two, whose base it is
        parts = (ud.decomposition(x) or "<").split()
        if len(parts) != 2 or parts[0].startswith("<"):
            continue
        base, mark = (chr(int(p, 16)) for p in parts)
        if not ud.combining(mark):
            continue
        group = {x} | {b + mark for b in members.get(base, {base}) | {base}}
        for y in group:
            u.join(x, y)
        joined = set().union(group, *(members.get(y, ()) for y in group))
        for y in joined:
            members[y] = joined
    return u.classes()


def trigger_of(x: str) -> str:
    """The rarest kind of sign in a member: a combining mark, else one beyond ASCII, else the first. A text without it can't contain the member."""
    return next((c for c in x if ud.combining(c)), next((c for c in x if ord(c) > 127), x[0]))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def sliced(batch: pa.RecordBatch, column: int | str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes of text, or of one row: bounds what arrays over all signs of a part take."""
    offsets, _ = utf8(batch.column(column))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def beyond_ascii(data: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each sign beyond ASCII in valid UTF-8."""
    at = np.flatnonzero(data[start:stop] >= 0xC0) + start
    tail = np.concatenate((data[:stop], np.zeros(3, np.uint8))) if len(at) and at[-1] + 3 >= len(data) else data
    b = tail[at].astype(np.uint32)
    c = [tail[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
    two, three = (b & 0x1F) << 6 | c[0], (b & 0x0F) << 12 | c[0] << 6 | c[1]
    return at, np.where(b < 0xE0, two, np.where(b < 0xF0, three, (b & 0x07) << 18 | c[0] << 12 | c[1] << 6 | c[2]))


def member_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """member STRING, n LONG: how often each member of a look-alike class occurs in the columns. Counted in the map tasks, a few thousand rows a task at most."""
    wanted = [x for group in classes() for x in group]
    single = sorted(ord(x) for x in wanted if len(x) == 1)
    longer = defaultdict(list)
    for x in wanted:
        if len(x) > 1:
            longer[trigger_of(x)].append(x)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, strings = np.zeros(sys.maxunicode + 1, np.int64), defaultdict(int)
        for batch in batches:
            for column in batch.columns:
                offsets, data = utf8(column)
                text = data[offsets[0] : offsets[-1]]
                total[:128] += np.bincount(text, minlength=256)[:128]
                at, codes = beyond_ascii(data, int(offsets[0]), int(offsets[-1]))
                here = np.bincount(codes, minlength=1)
                total[: len(here)] += here
                raw = text.tobytes()
                for trigger, found in longer.items():
                    if trigger.isascii():
                        for x in found:
                            strings[x] += raw.count(x.encode())
                    elif ord(trigger) < len(here) and here[ord(trigger)]:
                        k = at[codes == ord(trigger)]
                        for x in found:
                            form = np.frombuffer(x.encode(), np.uint8)
                            begin = k - len(x[: x.index(trigger)].encode())
                            begin = begin[(begin >= offsets[0]) & (begin + len(form) <= offsets[-1])]
                            for j, byte in enumerate(form):
                                begin = begin[data[begin + j] == byte]
                            strings[x] += len(begin)
        rows = [(chr(c), int(total[c])) for c in single if total[c]] + [(x, n) for x, n in strings.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["member", "n"])

    texts = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    return texts.mapInArrow(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


class Rewriter:
    """Rewrites a text so that each member of a look-alike class becomes the class's representative and canonically equal texts become one.

    more: further pairs of strings that look the same, for instance from a public table of confusable signs.
    """

    def __init__(self, counts: dict[str, int], more: tuple[tuple[str, str], ...] = ()) -> None:
        self.rewrites: dict[str, str] = {}
        # letters with marks follow from their letters, so only strings that nothing takes apart are rewritten
        bare = [[x for x in group if x and not any(map(ud.combining, x)) and ud.normalize("NFD", x) == x] for group in classes(tuple(more))]
        for group in sorted((g for g in bare if len(g) > 1), key=lambda g: max(map(len, g))):
            # a string of signs that others stand for can't itself stand for a class: its signs would be rewritten again
            settled = [x for x in group if len(x) == 1 or not any(c in self.rewrites for c in x)]
            best = min(settled, key=lambda x: (-counts.get(x, 0), not x.isascii(), len(x), x))
            self.rewrites |= {x: best for x in group if x != best}
        gone = invisible()
        self.gone = str.maketrans("", "", gone)
        self.any_gone = re.compile(f"[{re.escape(gone)}]")
        loose, apart = canonical()
        signs = {trigger_of(x) for x in self.rewrites}
        first = signs | loose | {x for x in apart if any(c in signs for c in ud.normalize("NFD", x))}
        self.any_pattern = re.compile(f"[{re.escape(''.join(sorted(first)))}]")
        self.first, self.plain = first, any(x.isascii() for x in first)
        self._automaton = self._unusual = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_unusual": None}

    @property
    def unusual(self) -> np.ndarray:
        """For each code point whether a text with it may be changed."""
        if self._unusual is None:
            self._unusual = np.zeros(sys.maxunicode + 1, bool)
            self._unusual[[ord(c) for c in (*self.first, *map(chr, self.gone))]] = True
        return self._unusual

    def column(self, texts: pa.Array) -> pa.Array:
        """All texts rewritten; those without unusual signs are recognised by their bytes and passed on."""
        offsets, data = utf8(texts)
        if self.plain or not len(texts):
            return pa.array([self(x) for x in texts.to_pylist()], pa.string())
        at, codes = beyond_ascii(data, int(offsets[0]), int(offsets[-1]))
        change = np.unique(np.searchsorted(offsets, at[self.unusual[codes]], "right") - 1)
        if not len(change):
            return texts
        new = [self._settled(x.translate(self.gone) if self.any_gone.search(x) else x) for x in texts.take(pa.array(change)).to_pylist()]
        mask = np.zeros(len(texts), bool)
        mask[change] = True
        return pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))

    @property
    def automaton(self):  # noqa: ANN201
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for x, y in self.rewrites.items():
                self._automaton.add_word(x, (len(x), y))
            self._automaton.make_automaton()
        return self._automaton

    def _once(self, text: str) -> str:
        """Letters apart from their marks, the longest pattern at each place rewritten, and all of it composed again."""
        text = ud.normalize("NFD", text)
        out, done = [], 0
        for end, (n, y) in self.automaton.iter_long(text):
            out += (text[done : end + 1 - n], y)
            done = end + 1
        return ud.normalize("NFC", "".join(out) + text[done:] if done else text)

    def __call__(self, text: str | None) -> str | None:
        """Signs that show nothing go first, for they may stand between a letter and its mark. Then again and again until nothing changes: signs of
        one that was split may join others. Should forms follow each other in a circle, its smallest stands for all of them."""
        if not text:
            return text
        if self.any_gone.search(text):
            text = text.translate(self.gone)
        return self._settled(text) if self.any_pattern.search(text) else text

    def _settled(self, text: str) -> str:
        seen = [text]
        while (text := self._once(text)) not in seen:
            seen.append(text)
        return min(seen[seen.index(text) :])


def fit_rewriter(df: DataFrame, columns: list[str], more: tuple[tuple[str, str], ...] = ()) -> Rewriter:
    """The rewriter whose representatives are the most frequent members in these columns. Collects one count per member: bounded by the classes."""
    return Rewriter({r["member"]: r["n"] for r in member_counts(df, columns).collect()}, more)


def rewritten(df: DataFrame, columns: list[str], rewriter: Rewriter | None = None) -> DataFrame:
    """df with the given text columns in their consistent form; all other columns stay as they are."""
    r = rewriter or fit_rewriter(df, columns)

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        return r.column(texts)

    return df.withColumns({c: form(F.col(f"`{c}`")) for c in columns})


def looks(df: DataFrame, key: str, columns: list[str], rewriter: Rewriter | None = None) -> DataFrame:
    """id, variant, look: digests of a row's columns as they're stored and in their consistent form. Rows with a null among key or columns are left out."""
    raw = df.select(F.col(key).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    names = [f"c{k}" for k in range(len(columns))]

    def digest(*cols: str) -> F.Column:
        return F.unhex(F.md5(F.concat_ws("\u0001", *[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in cols])))

    stored = raw.withColumn("variant", digest(*names))
    return rewritten(stored, names, rewriter or fit_rewriter(df, columns)).select("id", "variant", digest(*names).alias("look"))


def same_looking_pairs(df: DataFrame, key: str, columns: list[str], rewriter: Rewriter | None = None) -> DataFrame:
    """id_a, id_b: rows whose columns all look the same while at least one differs in its stored characters. Rows with a null among key or columns are in no pair.

    Variants (rows with the same stored characters) are joined first and expanded afterwards, in pieces, so a hot group of exact copies is never
    joined with itself nor in one task. Repeated rows count once; the smaller key comes first. same_looking_classes() has one row a record.
    """
    rows = written(looks(df, key, columns, rewriter), "looks")
    variants = rows.select("look", "variant").distinct()
    several = variants.groupBy("look").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("look")
    few = written(variants.join(several, "look", "left_semi"), "variants")
    sides = few.select("look", F.col("variant").alias("a")).join(few.select("look", F.col("variant").alias("b")), "look").where("a < b").select("a", "b")
    members = rows.join(few.select("variant"), "variant", "left_semi").select("id", F.col("variant").alias("key")).distinct()
    return member_pairs(sides, members)


def same_looking_classes(df: DataFrame, key: str, columns: list[str], rewriter: Rewriter | None = None) -> DataFrame:
    """id, class_id, members, variants, copies, links: one row for each identifier with all columns; class_id is the smallest identifier that looks like it.

    members counts the class's identifiers, variants its different stored forms, copies those identifiers stored with exactly this form and links the
    others, that look the same though their characters differ. An identifier that comes with several forms is in the class of its smallest digest.
    """
    rows = written(looks(df, key, columns, rewriter).groupBy("id").agg(F.min(F.struct("look", "variant")).alias("r")).select("id", "r.*"), "looks")
    variants = rows.groupBy("look", "variant").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    found = variants.groupBy("look").agg(F.sum("copies").alias("members"), F.count(F.lit(1)).alias("variants"), F.min("least").alias("class_id"))
    named = variants.join(found, "look").select("variant", "class_id", "members", "variants", "copies", (F.col("members") - F.col("copies")).alias("links"))
    return rows.select("id", "variant").join(named, "variant").drop("variant")
