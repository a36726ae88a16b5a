"""Problem 8: evaluation passages inside a training corpus."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodograph.llm.lookalike import Canon
from hodograph.runtime import read, widen

#: Words of a window that must agree exactly before a place is looked at.
GRAM = 5
#: Words of a case, and how many words of a case allow one misspelt.
LEAST, PER_ERROR = 12, 8
#: Characters of evaluation text that one broadcast holds; more items are scanned in further blocks.
BLOCK_CHARS = 3_000_000
#: Spellings that a task remembers.
REMEMBERED = 400_000

INVISIBLE = "\u00ad\u200b-\u200f\u2060-\u2064\ufeff"
HIDDEN = re.compile(f"[{INVISIBLE}]")
# Scripts written without blanks between words (Thai, Lao, Myanmar, Khmer, kana, ideographs); each of their
# characters is a word.
UNSPACED = "\u0e01-\u0e2f\u0e40-\u0e46\u0e81-\u0eae\u1000-\u102a\u1780-\u17a2\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003134f"
WORD = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}](?:[^\\W_{UNSPACED}]|[\u0300-\u036f])*")
#: What a subtitle file has between its spoken words: cue times and numbers, markup, sound descriptions.
NOISE = re.compile(
    r"<[^<>\n]{0,300}>"
    r"|\{[^{}\n]{0,300}\}"
    r"|[\[\uff3b](?:[^\]\uff3d\n]|\n(?!\r?\n)){0,300}[\]\uff3d]"
    r"|[(\uff08](?:[^)\uff09\n]|\n(?!\r?\n)){0,300}[)\uff09]"
    r"|\*[^*\n]{1,100}\*"
    r"|^[^\n]{0,20}\d[:\uff1a]\d\d[^\n]{0,20}[>\uff1e][^\n]*$"
    r"|^[^\S\n]*\d+[^\S\n]*$",
    re.M,
)
LABEL = re.compile(r"^[^\S\n]*(?:[-\u2013\u2014][^\S\n]*)?[^\W\d_][\w.'-]{0,24}[:\uff1a](?=\s)", re.M)


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def spoken(text: str) -> str:
    """The text with everything but spoken words blanked; places stay where they are."""
    return NOISE.sub(_blank, text)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def misspelt(a: str, b: str) -> bool:
    return edits(a, b, most := max(2, max(len(a), len(b)) // 3)) <= most


class Codes(dict):
    """Number of a raw spelling's canonical word, -1 if no evaluation item has it."""

    def __init__(self, vocabulary: dict[str, int], canon: Canon):
        super().__init__()
        self.vocabulary, self.canon = vocabulary, canon

    def word(self, raw: str) -> str:
        return self.canon(raw)

    def __missing__(self, raw: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[raw] = self.vocabulary.get(self.canon(raw), -1)
        return code


def grams(ids: np.ndarray) -> np.ndarray:
    """A hash for each window of GRAM numbers; 0 where a number is negative."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h, ok = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            part = ids[k : k + n]
            ok &= part >= 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.where(ok, h | np.uint64(1), np.uint64(0))


class Items:
    """A block of evaluation items, indexed by the hash of every window of GRAM words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.canon = Canon(fold_case=True)
        vocabulary: dict[str, int] = {}
        self.words: dict[int, list[str]] = {}
        self.ids: dict[int, np.ndarray] = {}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = [self.canon(w) for w in WORD.findall(spoken(HIDDEN.sub("", text)))]
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64)
            self.words[item], self.ids[item] = words, ids
            for at, h in enumerate(grams(ids)):
                self.places[int(h)].append((item, at))
        self.hashes = np.array(sorted(self.places), dtype=np.uint64)
        self.vocabulary = vocabulary


def stretch(kind: np.ndarray, end: np.ndarray | None = None) -> tuple[int, int] | None:
    """Longest window of words (0 same, 1 misspelt, 2 different) that is a case, the first among equals; None if there is none.

    ``end`` tells which words may be first or last: those that are the same, unless given. A window is a case if it has
    :data:`LEAST` words, none different, and at most one in :data:`PER_ERROR` misspelt, so if ``n - 8 * wrong`` is not
    negative; the starts worth trying are those of a new least prefix sum, so time grows as ``n log n``.
    """
    end = kind == 0 if end is None else end
    best, at = None, 0
    for stop in [*np.flatnonzero(kind == 2).tolist(), len(kind)]:
        if stop - at >= LEAST:
            total, starts, lows = 0, [], []
            for i in range(at, stop):
                if end[i] and (not lows or -total > lows[-1]):
                    starts.append(i), lows.append(-total)
                total += 1 - PER_ERROR * int(kind[i])
                if end[i] and lows and (j := bisect_left(lows, -total)) < len(starts):
                    n = i + 1 - starts[j]
                    if n >= LEAST and (best is None or n > best[1] - best[0]):
                        best = (starts[j], i + 1)
        at = stop + 1
    return best


def slip(a: str, b: str) -> bool:
    """A misspelling that is one for certain, without like neighbours: one edit of five letters and more, two of eight."""
    n = min(len(a), len(b))
    return n >= 5 and edits(a, b, most := 1 + (n >= 8)) <= most


def verify(items: Items, words: list[str], ids: np.ndarray, seeds: np.ndarray, hashes: np.ndarray) -> dict[int, tuple[int, int]]:
    """From seed places in one document to ``item: (first, last + 1)`` of its longest case, in words."""
    found: dict[int, tuple[int, int]] = {}
    done: set[tuple[int, int]] = set()
    for p in seeds:
        for item, q in items.places[int(hashes[p])]:
            shift = int(p) - q
            if (item, shift) in done:
                continue
            done.add((item, shift))
            own = items.ids[item]
            a, b = max(0, -shift), min(len(own), len(ids) - shift)
            if b - a < LEAST:
                continue
            kind = np.where(own[a:b] == ids[a + shift : b + shift], 0, 2)
            end = kind == 0
            for i in np.flatnonzero(kind):
                own_word, word = items.words[item][a + i], items.canon(words[a + i + shift])
                if misspelt(own_word, word):
                    kind[i], end[i] = 1, slip(own_word, word)
            if (w := stretch(kind, end)) and (item not in found or w[1] - w[0] > found[item][1] - found[item][0]):
                found[item] = (w[0] + a + shift, w[1] + a + shift)
    return found


def _scanner(bc):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = bc.value
        codes = Codes(items.vocabulary, items.canon)
        gap = [-1] * GRAM
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                docs, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                clean = [spoken(HIDDEN.sub("", t)) for t in texts]
                words = [WORD.findall(c) for c in clean]
                flat: list[int] = []
                starts = []
                for w in words:
                    starts.append(len(flat))
                    flat.extend(map(codes.__getitem__, w))
                    flat.extend(gap)
                ids = np.array(flat, dtype=np.int64)
                hashes = grams(ids)
                hit = np.flatnonzero(hashes)
                if not len(items.hashes) or not len(hit):
                    continue
                spot = np.minimum(np.searchsorted(items.hashes, hashes[hit]), len(items.hashes) - 1)
                hit = hit[items.hashes[spot] == hashes[hit]]
                rows = []
                owner = np.searchsorted(starts, hit, side="right") - 1
                for d in np.unique(owner):
                    rows += _document(items, codes, docs[d], texts[d], clean[d], hit[owner == d] - starts[d], hashes[starts[d] : starts[d] + len(words[d])], words[d])
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "n_words", "start", "stop"])

    return scan


def _document(items: Items, codes: Codes, doc: int, text: str, clean: str, seeds, hashes, words) -> list[tuple[int, ...]]:
    """Cases of one document that has seeds, with their places in the text as stored.

    Speaker labels may stand in the middle of a passage or be part of it, so the words are tried with and without them.
    """
    best: dict[int, tuple[int, int, int]] = {}

    def add(form: str, words: list[str], seeds, hashes) -> None:
        ids = np.array([codes[w] for w in words], dtype=np.int64)
        cases = verify(items, words, ids, seeds, hashes)
        if not cases:
            return
        spans = [m.span() for m in WORD.finditer(form)]
        for item, (a, b) in cases.items():
            if item not in best or b - a > best[item][0]:
                best[item] = (b - a, spans[a][0], spans[b - 1][1])

    add(clean, words, seeds, hashes)
    bare = LABEL.sub(_blank, clean)
    if bare != clean:
        less = WORD.findall(bare)
        h = grams(np.array([codes[w] for w in less], dtype=np.int64))
        add(bare, less, [p for p in np.flatnonzero(h) if int(h[p]) in items.places], h)
    if not best:
        return []
    kept = np.array([i for i, c in enumerate(text) if not HIDDEN.match(c)] or [0])
    return [(item, doc, n, int(kept[a]), int(kept[b - 1]) + 1) for item, (n, a, b) in best.items()]


def find_leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(item_id, doc_id, n_words, start, stop)``: documents that contain an item's passage, fully or partly.

    A case is a stretch of at least :data:`LEAST` consecutive words of the item among the spoken words of the document,
    of which one in :data:`PER_ERROR` may be misspelt (an edit distance of 2, or a third of the longer word). The longest
    is given, ``start`` and ``stop`` being its place in the stored text. It begins and ends with a right word or one
    that is misspelt for certain (:func:`slip`). Of scripts without blanks each character is a word. Letter case, punctuation, line breaks, cue
    numbers and times, markup, bracketed sounds, speaker labels and look-alike characters do not matter.

    Any such stretch has :data:`GRAM` consecutive words right, so a broadcast hash set of the items' windows misses
    none; hits are verified word by word. Null ids or texts, and items under :data:`LEAST` words, give nothing. A row
    given again counts once. The set is broadcast in blocks of some ``block_chars`` characters; every document is scanned whole
    for each block, and nothing of the corpus is shuffled.
    """
    src = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    known = items.select(F.col("item_id").cast("long"), "text").dropna().distinct()
    total = int(known.agg(F.sum(F.length("text"))).first()[0] or 0)
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    spark, out = docs.sparkSession, None
    src = widen(src, "doc_id")
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # bounded by block_chars
        bc = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows]))
        hits = src.mapInArrow(_scanner(bc), "item_id long, doc_id long, n_words long, start long, stop long")
        out = hits if out is None else out.union(hits)
    best = F.max(F.struct("n_words", F.col("start"), "stop")).alias("b")
    return out.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "b.n_words", "b.start", "b.stop")


def remove_spans(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """``(doc_id, text, n_removed)``: every document, without the leaked spans.

    Overlapping spans are removed once; documents without a leak stay as they are, null texts included. A document has
    at most one span per item, so what is gathered for one is bounded by the items.
    """
    spans = leaks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))).alias("s"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    # Fold the spans from left to right: what is kept so far, and up to where the text is used.
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "s",
        start,
        lambda acc, x: F.struct(
            F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))).alias("kept"),
            F.greatest(acc["at"], x["stop"]).alias("at"),
        ),
        lambda acc: F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.col("s").isNull(), F.col("text")).otherwise(cut)
    return joined.select("doc_id", text.alias("clean"), "text").select(
        "doc_id", F.col("clean").alias("text"), (F.coalesce(F.length("text") - F.length("clean"), F.lit(0))).alias("n_removed")
    )


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked stretches with their length and place."""
    return _leaks(spark, sf_dir)


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the length left after its leaked spans are removed."""
    docs = read(spark, sf_dir, "documents")
    out = remove_spans(docs, _leaks(spark, sf_dir))
    return out.select("doc_id", F.length("text").alias("n_chars_left"), "n_removed")


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_cleaned": p8_cleaned}
