"""Texts that look the same but are stored as different characters: one form per look.

Look-alike classes come from union-find over code points and short strings (a ligature and its letters), from three
sources: a table of look-alike letters; Unicode's own compatibility data for full-width forms, spaces and ligatures; and the
strings of the corpus, where a letter of a foreign script stands in a word of Latin letters and the corpus holds the same
word with a Latin letter in its place. Classes are transitive over all three. The representative
of a class is its most frequent member in the corpus, and texts are rewritten with a multi-pattern automaton, longest
match first, over decomposed text; recomposition follows. Other case, accents, superscripts, circled digits and
fractions are kept apart, for they look different.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.session import stage

# Latin letters, then the Cyrillic, Greek and other letters that look the same.
HOMOGLYPHS = """
a а α ɑ
c с ϲ
d ԁ
e е
h һ
i і
j ј ϳ
l ӏ
o о ο օ
p р ρ
q ԛ
s ѕ
u υ ս
v ν ѵ
w ԝ
x х χ
y у γ
g ɡ
A А Α Ꭺ
B В Β Ᏼ
C С Ϲ Ꮯ
D Ꭰ
E Е Ε Ꭼ
F Ϝ
G Ԍ Ꮐ
H Н Η Ꮋ
I І Ι Ӏ
J Ј Ꭻ
K К Κ Ꮶ
L Ꮮ
M М Μ Ϻ Ꮇ
N Ν
O О Ο Օ
P Р Ρ Ꮲ
Q Ԛ
S Ѕ Ꮪ
T Т Τ Ꭲ
U Ս
V Ѵ Ꮩ
W Ԝ Ꮃ
X Х Χ
Y У Υ Ү
Z Ζ Ꮓ
Γ Г
Π П
Φ Ф
- ‐ ‑ −
' ’ ʼ
: ꞉ ∶
"""
_RULED = {"<wide>", "<narrow>", "<noBreak>"}
#: Compatibility forms that look like what they decompose to: ligatures and digraphs, dots, Roman numerals.
_COMPAT = [(0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026), (0x2160, 0x217F)]


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return {k: v for k, v in out.items() if len(v) > 1}


def invisible(c: str) -> bool:
    """Whether a character has no look of its own: formats, tags and variation selectors of all planes, fillers."""
    return unicodedata.category(c) == "Cf" or any(a <= ord(c) <= b for a, b in _SELECTORS) or c in "͏ᅟᅠ឴឵ㅤ"


_SELECTORS = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x180B, 0x180F)]


def look_alikes() -> Classes:
    """The classes, from the table above and by rule from Unicode's data. All members are in decomposed form."""
    k = Classes()
    for line in HOMOGLYPHS.strip().splitlines():
        first, *rest = line.split()
        for x in rest:
            k.union(unicodedata.normalize("NFD", x), first)
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        tag, _, to = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            k.union(c, " ")
        elif tag in _RULED or (tag == "<compat>" and any(a <= cp <= b for a, b in _COMPAT)):
            k.union(c, unicodedata.normalize("NFKD", "".join(chr(int(x, 16)) for x in to.split())))
    return k


def _latin(c: str) -> bool:
    return c.isascii() or ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00


_MIXED = re.compile(r"[^\W\d_]*[A-Za-z][^\W\d_]*")


def mixed_words(texts: DataFrame, text: str, known: set[str]) -> DataFrame:
    """(word, at, letter): words of Latin letters but for one letter of another script that no class holds yet, each once,
    with its place. Texts of ASCII alone never leave the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for t in b.column(0).to_pylist():
                for w in _MIXED.findall(unicodedata.normalize("NFD", t)):
                    if not w.isascii():
                        odd = [i for i, c in enumerate(w) if not _latin(c) and c not in known]
                        if len(odd) == 1 and all(_latin(c) for i, c in enumerate(w) if i != odd[0]):
                            found.add((w, odd[0], w[odd[0]]))
            rows = sorted(found)
            yield pa.record_batch({"word": pa.array([r[0] for r in rows], pa.string()), "at": pa.array([r[1] for r in rows], pa.int32()), "letter": pa.array([r[2] for r in rows], pa.string())})

    odd = texts.select(text).filter(F.col(text).isNotNull() & ~F.col(text).rlike(r"^\p{ASCII}*$"))
    return odd.mapInArrow(run, "word string, at int, letter string").distinct()


def learn_from_words(texts: DataFrame, text: str, classes: Classes, least_words: int = 2, share: float = 0.9) -> Classes:
    """classes with the letters that the strings of the corpus show to look like a Latin one: in `least_words` different words
    or more the same word stands elsewhere with one Latin letter in that place, in `share` of the cases the same letter. Case
    is kept. Words meet in an equi-join on the word with a hole; only a vote per letter comes to the driver. Without
    a mixed word nothing more is read."""
    odd = stage(mixed_words(texts, text, {m for g in classes.members().values() for m in g}), "mixed")
    if odd.isEmpty():
        return classes
    hole = lambda w, i: F.concat(F.left(w, i), F.lit("\0"), F.substring(w, i + 2, F.length(w)))
    asked = odd.select("word", "letter", hole(F.col("word"), F.col("at")).alias("hole"), F.length("word").alias("_n"))
    plain = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z\u00C0-\u024F]{2,}"), F.lit(0))).alias("w")).distinct()
    plain = plain.join(asked.select("_n").distinct(), F.length("w") == F.col("_n"), "left_semi")
    plain = plain.select("w", F.posexplode(F.split("w", "")).alias("i", "c")).select(F.col("c").alias("latin"), hole(F.col("w"), F.col("i")).alias("_hole"))
    votes = asked.join(plain, F.col("hole") == F.col("_hole")).groupBy("letter", "latin").agg(F.countDistinct("word").alias("n")).collect()  # a row per letter pair
    best: dict[str, list] = {}
    for r in votes:
        if r["letter"].isupper() == r["latin"].isupper() or not (r["letter"].isupper() or r["letter"].islower()):
            best.setdefault(r["letter"], []).append((r["n"], r["latin"]))
    for letter, got in best.items():
        n, latin = max(got)
        if n >= least_words and n >= share * sum(x for x, _ in got):
            classes.union(letter, unicodedata.normalize("NFD", latin))
    return classes


def member_counts(texts: DataFrame, members: list[str]) -> dict[str, int]:
    """How often each class member stands in the corpus. Counted in all partitions; at most one row per member comes
    to the driver."""
    single, several = {m for m in members if len(m) == 1}, [m for m in members if len(m) > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            text = "\0".join(x for x in b.column(0).to_pylist() if x is not None)
            if not text.isascii():
                text = unicodedata.normalize("NFD", text)
            total.update({c: n for c, n in Counter(text).items() if c in single})
            total.update({m: n for m in several if (n := text.count(m))})
        yield pa.record_batch({"m": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return {r["m"]: r["n"] for r in texts.mapInArrow(run, "m string, n bigint").groupBy("m").agg(F.sum("n").alias("n")).collect()}


def representatives(classes: Classes, counts: dict[str, int]) -> dict[str, str]:
    """{member: representative} for the members that are rewritten: the most frequent one, of equals the shorter and
    smaller."""
    out = {}
    for group in classes.members().values():
        best = min(group, key=lambda m: (-counts.get(m, 0), len(m), m))
        out |= {m: best for m in group if m != best}
    return out


class Rewriter:
    """One consistent form per look. Invisible characters go, the rest is rewritten by longest match."""

    def __init__(self, to: dict[str, str]) -> None:
        import ahocorasick

        self.touched_ascii = any(m.isascii() for m in to)
        self.auto = ahocorasick.Automaton()
        for m, r in to.items():
            self.auto.add_word(m, (len(m), r))
        self.auto.make_automaton()
        self.invisible = {ord(c): None for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1000))) if invisible(c)}

    def __call__(self, text: str) -> str:
        if text.isascii() and not self.touched_ascii:
            return text
        t = unicodedata.normalize("NFD", text.translate(self.invisible))
        out, at = [], 0
        for end, (n, r) in self.auto.iter_long(t):
            if (start := end + 1 - n) >= at:
                out += (t[at:start], r)
                at = end + 1
        return unicodedata.normalize("NFC", "".join(out) + t[at:])


def consistent_form(df: DataFrame, text: str, form: str = "form", to: dict[str, str] | None = None) -> DataFrame:
    """df with column `form`. Null texts keep a null form; a text of invisible characters only becomes empty. `to`: the
    rewriting of an earlier corpus, else it is made from this one. A column `form` that is already there is replaced."""
    if to is None:
        classes = learn_from_words(df, text, look_alikes())
        to = representatives(classes, member_counts(df.select(text), [m for g in classes.members().values() for m in g]))

    @F.arrow_udf("string")
    def rewrite(x: pa.Array) -> pa.Array:
        if not _CACHE.get("to") == to:
            _CACHE.update(to=to, rewriter=Rewriter(to))
        f = _CACHE["rewriter"]
        return pa.array([t if t is None else f(t) for t in x.to_pylist()], pa.string())

    plain = F.lit(all(not m.isascii() for m in to)) & F.col(text).rlike(r"^\p{ASCII}*$")  # its own form: no need to send it
    return df.withColumn(form, F.when(plain, F.col(text)).otherwise(rewrite(F.when(~plain, F.col(text)))))


_CACHE: dict = {}


def same_look_classes(df: DataFrame, scope: list[str], id_: str, text: str, form: str = "form") -> DataFrame:
    """(scope, id, class, links) for each id that looks like another one of its scope stored differently: class is the smallest
    such id, links the number of ids that look the same and are stored as another text. What the pairs say, in a row per
    id: a hot class is two aggregates, never pairs. Blank forms are left out and repeated rows count once."""
    rows = df.filter(F.col(text).isNotNull() & ~F.col(form).rlike(r"(?U)^\s*$")).dropna(subset=scope)  # a null scope is none
    rows = rows.select(*scope, F.col(id_), F.xxhash64(*scope, form, F.length(form)).alias("_f"), F.xxhash64(text, F.length(text)).alias("_t"))
    rows = stage(rows, "forms")
    mixed = rows.groupBy("_f").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).filter("_lo <> _hi").select(F.col("_f").alias("_m"))
    rows = rows.join(mixed, F.col("_f") == F.col("_m"), "left_semi").distinct()  # what follows is as large as the look-alikes alone
    per = rows.groupBy("_f", "_t").agg(F.count(F.lit(1)).alias("_n"), F.min(id_).alias("_lo"))
    whole = per.groupBy(F.col("_f").alias("_w")).agg(F.sum("_n").alias("_all"), F.min("_lo").alias("class"))
    mine = per.select(F.col("_f").alias("_p"), F.col("_t").alias("_pt"), "_n")
    j = rows.join(whole, F.col("_f") == F.col("_w")).join(mine, (F.col("_f") == F.col("_p")) & (F.col("_t") == F.col("_pt")))
    return j.select(*scope, id_, "class", (F.col("_all") - F.col("_n")).alias("links"))


def same_look_pairs(df: DataFrame, scope: list[str], id_: str, text: str, form: str = "form") -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, within equal scope, whose texts differ as stored but have the same form.
    Blank forms are left out and repeated rows count once. Only forms with more than one stored text are joined, so
    a hot scope full of copies costs one aggregate."""
    rows = df.filter(F.col(text).isNotNull() & ~F.col(form).rlike(r"(?U)^\s*$"))
    rows = rows.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)], F.col(id_).alias("_id"), F.xxhash64(form, F.length(form)).alias("_f"), F.xxhash64(text, F.length(text)).alias("_t"))
    rows = stage(rows, "forms")
    key = [*[f"_s{i}" for i in range(len(scope))], "_f"]
    mixed = rows.groupBy(*key).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).filter("_lo <> _hi").select(*key)
    rows = rows.join(mixed, key, "left_semi").distinct()
    a, b = (rows.select(*[F.col(c).alias(f"{c}{s}") for c in key], F.col("_id").alias(f"key_{s}"), F.col("_t").alias(f"_t{s}")) for s in "ab")
    return a.join(b, [*[F.col(f"{c}a") == F.col(f"{c}b") for c in key], F.col("key_a") < F.col("key_b"), F.col("_ta") != F.col("_tb")]).select("key_a", "key_b")
