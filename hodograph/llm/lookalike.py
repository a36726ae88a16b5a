"""Problem 9: one form for texts that look the same but differ in their characters."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodograph.llm.copies import expand_pairs
from hodograph.runtime import Scratch, read, unbroadcast, widen

# Letters of other scripts that look like the Latin letter at the front of their group.
ALIKE = (
    "aа cсϲ dԁ eе hһ iі jјϳ lӏ oоοօ pр qԛ sѕ vѵ wԝ xх yу "
    "AАΑ BВΒ CСϹ EЕΕ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YΥҮ ZΖ"
).split()
# Format characters that do show, and marks besides the format characters that do not.
SHOWN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
HIDDEN = "\u034f\u180b\u180c\u180d\u180f"
SEQUENCE = re.compile(".[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f]+")
#: A run of characters beyond ASCII and the one before it, which their marks may belong to.
PIECE = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")

# Kinds of compatibility decomposition that look the same when shown. Ring, raised, lowered, square and
# upright forms show and are told apart; ``circle`` and the like can be added by whoever wants them folded.
KINDS = frozenset("wide narrow noBreak font compat initial medial final isolated".split())
#: One character for another by ``compat`` that does look the same; others (long s, variant Greek letters) do not.
COMPAT_NAMES = ("ROMAN NUMERAL", "RADICAL", "MICRO SIGN")

#: Short pieces of text whose form a task remembers.
PIECES = 200_000


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        by = defaultdict(list)
        for x in self.up:
            by[self.find(x)].append(x)
        return list(by.values())


def listed() -> tuple[tuple[str, str], ...]:
    """The look-alike letters of :data:`ALIKE` as pairs."""
    return tuple((x, group[0]) for group in ALIKE for x in group[1:])


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


def derived(skeletons: dict[str, str]) -> tuple[tuple[str, str], ...]:
    """Look-alike letters of different scripts from a table of skeletons (character: what it is confused with).

    Two letters are alike if they have one skeleton and one case. A script has one letter in a class at most, so that no
    two letters of a script fall together: the one of :data:`ALIKE` if there is one, else the only one, else the only one
    whose other case is alike too; of Latin the ASCII letter. The fixed pairs are always among the result.
    """
    fixed = {x for group in ALIKE for x in group}
    classes = defaultdict(lambda: defaultdict(list))
    for ch, skeleton in skeletons.items():
        if unicodedata.category(ch) in ("Lu", "Ll") and not unicodedata.decomposition(ch):
            classes[skeleton, unicodedata.category(ch)][_script(ch)].append(ch)
    other = {ch: skeletons.get(ch.swapcase()) for by in classes.values() for chars in by.values() for ch in chars}
    out = set(listed())
    for by in classes.values():
        if not (latin := [ch for ch in by.get("LATIN", []) if ch.isascii()]):
            continue
        for script, chars in by.items():
            if script == "LATIN" or any(c in fixed for c in chars):
                continue
            for some in (chars, [c for c in chars if other[c] == other[latin[0]]]):
                if len(some) == 1:
                    out.add((some[0], latin[0]))
                    break
    return tuple(sorted(out))


def _public_skeletons(checker) -> dict[str, str]:
    chars = [chr(cp) for cp in range(0x80, 0x1E000) if unicodedata.category(chr(cp)) in ("Lu", "Ll")]
    chars += list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return dict(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n"), strict=True))


def alike_letters(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """Look-alike letters by Unicode's public table of confusables, which Spark carries for its collations.

    Where a Spark comes without it, those of :data:`ALIKE`.
    """
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError:  # not on the class path: py4j then has a package of that name
        return listed()
    return derived(_public_skeletons(checker))


@lru_cache(maxsize=4)
def relations(kinds: frozenset[str] = KINDS) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
    """``(pairs, composed)``: characters with the string that looks the same by rule, and those composed canonically.

    Invisible characters go with the empty string, blanks with a space, and characters of a decomposition in ``kinds``
    with what they decompose to.
    """
    pairs, composed = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if (cat == "Cf" and ch not in SHOWN) or ch in HIDDEN or "VARIATION SELECTOR" in unicodedata.name(ch, ""):
            pairs.append((ch, ""))
        elif cat == "Zs" and cp != 0x1680:
            pairs.append((ch, " "))
        elif unicodedata.normalize("NFD", ch) != ch:
            composed.append(ch)
        elif way := unicodedata.decomposition(ch):
            kind, _, rest = way.rpartition(">")
            target = "".join(chr(int(x, 16)) for x in rest.split())
            if kind[1:] not in kinds or target[0] == " ":
                continue
            # By compat go ligatures, digraphs and dots; of single characters and signs only those named.
            if kind == "<compat" and (len(target) == 1 or cat in ("So", "No")) and not any(x in unicodedata.name(ch, "") for x in COMPAT_NAMES):
                continue
            pairs.append((ch, target))
    return tuple(pairs), tuple(composed)


@lru_cache(maxsize=1)
def _cased() -> tuple[tuple[str, str], ...]:
    """Characters that differ in case only."""
    chars = [chr(cp) for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lt")]
    return tuple((c, d) for c in chars for d in (c.lower(), c.upper()) if d != c and len(d) == 1)


def countable(alike: tuple[tuple[str, str], ...]) -> set[str]:
    """Strings whose frequency can decide a class's representative."""
    pairs, composed = relations()
    return {x for pair in (*pairs, *alike) for x in pair} | set(composed) | {unicodedata.normalize("NFD", c) for c in composed} - {""}


class Canon:
    """Rewriter to the class representatives.

    Classes are transitive: a union-find over single characters (look-alikes, width and other forms, invisible ones),
    and over strings, which fall together if they are spelt alike in the representatives of their decomposed characters.
    The representative is the member that ``counts`` has most often, then the shortest, then the least; what is invisible
    becomes nothing.

    A text is first *spelt*: decomposed, each character replaced by its class's, and its marks brought into one order.
    Replacing keeps the order of marks and yields only what is replaced by itself, so a spelling is the same for all texts
    that are alike, and spelling it again changes nothing. Then one automaton over all strings that are a composed
    character's spelling puts representatives in, leftmost-longest; that depends on the spelling only, and what it puts in
    is spelt as before. So alike texts have one form, and a form is its own.
    """

    def __init__(self, counts: dict[str, int] | None = None, fold_case: bool = False, alike: tuple[tuple[str, str], ...] | None = None, kinds: frozenset[str] = KINDS):
        n = counts or {}
        pairs, composed = relations(kinds)
        order = lambda x: (-n.get(x, 0), len(x), x)
        whole = lambda c: unicodedata.normalize("NFD", c) == c
        atoms, spelt = Classes(), {}
        for a, b in (*pairs, *(listed() if alike is None else alike), *(_cased() if fold_case else ())):
            if len(b) > 1 or not whole(b):
                spelt[a] = b
            # A mark may vanish, but another's place in the order of marks would change what the text is.
            elif whole(a) and (not b or unicodedata.combining(a) in (0, unicodedata.combining(b))):
                atoms.union(a, b)
        nothing = atoms.find("")
        self.to: dict[str, str] = {}
        for group in atoms.members():
            best = "" if atoms.find(group[0]) == nothing else min(group, key=order)
            self.to |= {x: best for x in group if x != best and x}
        self.to |= spelt
        while True:  # until what a character becomes is replaced by itself
            closed = {x: unicodedata.normalize("NFD", "".join(self.to.get(c, c) for c in unicodedata.normalize("NFD", y))) for x, y in self.to.items()}
            if closed == self.to:
                break
            self.to = closed
        self.table = str.maketrans(self.to)
        strings: dict[str, list[str]] = defaultdict(list)
        seen: dict[str, int] = defaultdict(int)
        for ch in composed:
            apart = unicodedata.normalize("NFD", ch)
            key = self.spelling(ch)
            if len(key) > 1:
                seen[key] += n.get(apart, 0)
                if unicodedata.normalize("NFC", ch) == ch:
                    strings[key].append(ch)
        self.trie = ahocorasick.Automaton()
        self.trie.add_word("\x00\x00", (2, "\x00\x00"))  # never empty
        for key, chars in strings.items():
            best = min([*chars, key], key=lambda x: (-(seen[x] if x == key else n.get(x, 0)), len(x), x))
            if best != key:
                self.trie.add_word(key, (len(key), best))
        self.trie.make_automaton()
        self.ascii = str.maketrans({x: y for x, y in self.to.items() if x.isascii()})
        self.known: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def spelling(self, text: str) -> str:
        return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(self.table))

    def _piece(self, m: re.Match) -> str:
        piece = m.group()
        if (form := self.known.get(piece)) is None:
            form = self.whole(piece)
            if len(piece) <= 16 and len(self.known) < PIECES:
                self.known[piece] = form
        return form

    def __call__(self, text: str) -> str:
        """The form of a text, made of the forms of its pieces beyond ASCII, each spelling of which is worked out once."""
        if self.ascii:
            text = text.translate(self.ascii)
        return text if text.isascii() else PIECE.sub(self._piece, text)

    def whole(self, text: str) -> str:
        text, out, last = self.spelling(text), [], 0
        for end, (n, rep) in self.trie.iter_long(text):
            out += (text[last : end + 1 - n], rep)
            last = end + 1
        return "".join(out) + text[last:]


# --- Arrow steps ----------------------------------------------------------------------------------------------------
def _count(batches: Iterator[pa.RecordBatch], alike: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    """Occurrences of countable strings; characters by code point at once, marked letters by a scan for marks."""
    can = countable(alike)
    chars = np.array(sorted(ord(x) for x in can if len(x) == 1))
    total, seqs = np.zeros(sys.maxunicode + 1, dtype=np.int64), defaultdict(int)
    for batch in batches:
        col = batch.column("text")
        for at in range(0, len(col), 1000):
            text = "\n".join(x for x in col.slice(at, 1000).to_pylist() if x)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            found = np.bincount(codes)
            total[: len(found)] += found
            if found[0x300:0x370].any() or len(found) > 0x483:
                for s in SEQUENCE.findall(text):
                    seqs[s] += 1
    n = total[chars]
    rows = [(chr(c), int(k)) for c, k in zip(chars[n > 0], n[n > 0], strict=True)] + [(s, k) for s, k in seqs.items() if s in can]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["s", "n"])


def _digest(text: str) -> tuple[int, int]:
    h = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _rewriter(counts: dict[str, int], alike: tuple[tuple[str, str], ...], keep: bool):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(counts, alike=alike)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            forms = [canon(t) for t in texts]
            keys = np.array([_digest(f) + _digest(t) for f, t in zip(forms, texts, strict=True)], dtype=np.int64).reshape(-1, 4)
            cols = [batch.column("id"), *(pa.array(keys[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(forms, pa.string())] * keep, ["id", "c1", "c2", "r1", "r2"] + ["form"] * keep)

    return rewrite


def corpus_counts(docs: DataFrame) -> dict[str, int]:
    """Frequency of every countable string over all texts; its size is bounded by Unicode, not by the corpus."""
    alike = alike_letters(docs.sparkSession)
    return {r["s"]: r["n"] for r in docs.select("text").mapInArrow(lambda b: _count(b, alike), "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}


def canonical_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: dict[str, int] | None = None, keep: bool = True) -> DataFrame:
    """``(id, c1, c2, r1, r2[, form])``: each text's canonical form, and 128-bit keys of the form (c) and the text (r).

    Null ids and texts are left out; an empty text stays empty, and a text of invisible characters becomes empty.
    ``counts`` are frequencies from :func:`corpus_counts`; without them they are taken over all texts given.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    src = widen(src, "id")
    counts = corpus_counts(src) if counts is None else counts
    alike = alike_letters(docs.sparkSession)
    return src.mapInArrow(_rewriter(counts, alike, keep), "id long, c1 long, c2 long, r1 long, r2 long" + ", form string" * keep)


def lookalikes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(pairs(a, b), members(id, rep))``: different texts that look the same, and the exact copies of each.

    Representatives are the least ids of equal texts. A document given again counts once. Only texts that have a
    look-alike are members. Copies are folded with map-side aggregation, so a text that a third of all rows hold is
    one row; the variants of a form are written as pairs like records of one class (see :func:`expand_pairs`), so a form
    of very many variants stays linear too.
    """
    scratch = Scratch(docs.sparkSession, "lookalike")
    keys = scratch.cut(canonical_text(docs, id_col, text_col, keep=False), "keys")
    texts = keys.groupBy("c1", "c2", "r1", "r2").agg(F.min("id").alias("id"))
    mixed = texts.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).filter("n > 1").select("c1", "c2", "rep")
    texts = scratch.cut(texts.join(unbroadcast(mixed), ["c1", "c2"]), "texts")
    forms = texts.select("id", "rep")
    pairs = expand_pairs(forms.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0), forms)
    variants = texts.select("c1", "c2", "r1", "r2", F.col("id").alias("rep"))
    members = keys.join(unbroadcast(variants), ["c1", "c2", "r1", "r2"]).select("id", "rep").distinct()
    return pairs, scratch.cut(members, "members")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = lookalikes(read(spark, sf_dir, "documents"))
    return expand_pairs(pairs, members, inner=False).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first document that has the same form, and how many have it."""
    f = canonical_text(read(spark, sf_dir, "documents"), keep=False).select("id", "c1", "c2")
    f = Scratch(spark, "forms").cut(f, "forms").distinct()
    first = f.groupBy("c1", "c2").agg(F.min("id").alias("form_doc"), F.count(F.lit(1)).alias("n_docs"))
    return f.join(unbroadcast(first), ["c1", "c2"]).select(F.col("id").alias("doc_id"), "form_doc", "n_docs")


QUERIES = {"p9_found": p9_found, "p9_forms": p9_forms}


def _sql() -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    blanks = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    others = "".join(g[1:] for g in ALIKE) + "ёЁїЇ"
    old = wide + blanks + others
    new = "".join(chr(c) for c in range(0x21, 0x7F)) + " " * len(blanks) + "".join(g[0] * (len(g) - 1) for g in ALIKE) + "ëËïÏ"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hidden = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
    return f"""
WITH form AS (SELECT DISTINCT doc_id, text,
                nfc_normalize(translate(translate(text, {quote(hidden)}, ''), {quote(old)}, {quote(new)})) AS form
              FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
"""


SQL = {
    "p9_found": _sql() + """SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b
FROM form a JOIN form b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p9_forms": _sql() + "SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS form_doc, count(*) OVER (PARTITION BY form) AS n_docs FROM form",
}
