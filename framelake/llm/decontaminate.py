"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased words. A mask ignores some of the word positions under it; a seed is the hash of
the others. Seeds of benchmark and documents are joined, and every hit names a document, an item and
the diagonal on which they lie. The diagonal is then compared word by word: an overlap is a stretch
covered by windows of ``WINDOW`` aligned words with at most ``SUBSTITUTIONS`` differences (for items
of 8 to 14 words the whole item, with at most a fifth of its words; for shorter ones without any).
The three masks hit every such window wherever its substitutions are. Three words in a row do so for
shorter items, several times on one diagonal, and the shortest items are seeds as a whole.

Documents are not shuffled for it: a filter of the benchmark's seeds, of bounded size, goes to the
tasks that read them, and only texts with a seed that passes (suspects) go on. Equal texts and equal
items are matched once. A hot seed spreads over tasks like any skewed join key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, small_batches, tidied

WINDOW, SUBSTITUTIONS = 15, 3
MASKS = ("1111011", "11001000111", "11010110001")
#: For items shorter than the window: of their words, less a fifth, some three lie together.
SHORT_MASK = "111"
#: Items of fewer words are found without substitutions.
EXACT_BELOW = 8
#: Bits of the seed filter per seed, and the most that it has altogether (32 MB).
SEED_BITS, MAX_BITS = 256, 28
#: Words whose hashes a task keeps.
CACHE_WORDS = 150_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash at every position of the words under the mask's ones; different masks have different hashes."""
    n = max(len(words) - len(mask) + 1, 0)
    h = np.full(n, int(mask, 2) << 8 | len(mask), np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            h = (h + words[at : at + n]) * _MIX
            h ^= h >> np.uint64(29)
    return h


def masks_for(n: int) -> tuple[str, ...]:
    """Masks whose seeds an item of ``n`` words has."""
    return MASKS if n >= WINDOW else (SHORT_MASK,) if n >= EXACT_BELOW else ("1" * n,) if n else ()


def window_of(n: int) -> tuple[int, int]:
    """Window and substitutions allowed in it for an item of ``n`` words."""
    return (WINDOW, SUBSTITUTIONS) if n >= WINDOW else (n, n // 5 if n >= EXACT_BELOW else 0)


def needed_hits(n: int) -> int:
    """Seeds that an overlap of an item of ``n`` words hits at least on its diagonal: each substitution spoils three in a row."""
    return max(1, n - 2 - 3 * (n // 5)) if EXACT_BELOW <= n < WINDOW else 1


def stretches(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Overlaps of an item and the words aligned to it (0: none there): first and last position (end exclusive), equal words."""
    window, allowed = window_of(len(item))
    same = np.concatenate([[0], np.cumsum(item == doc)])
    good = np.flatnonzero((same[window:] - same[:-window] >= window - allowed))
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > window) + 1
    return [(int(g[0]), int(g[-1]) + window, int(same[g[-1] + window] - same[g[0]])) for g in np.split(good, cut)]


# -------------------------------------------------------------------- the benchmark


def _seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, seeds, at, need = [], [], [], []
        for key, raw in zip(b.column("item").to_pylist(), b.column("words").to_pylist(), strict=True):
            words = np.frombuffer(raw, np.uint64)
            for mask in masks_for(len(words)):
                h = seed_hashes(words, mask)
                seeds.append(h.view(np.int64))
                at.append(np.arange(len(h), dtype=np.int32))
                keys += [key] * len(h)
                need.append(np.full(len(h), needed_hits(len(words)), np.int32))
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(flat(seeds, np.int64)), pa.array(keys, pa.string()), pa.array(flat(at, np.int32)), pa.array(flat(need, np.int32))], names=["seed", "item", "at", "need"])


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``item_id, item`` of every row of the benchmark, and ``item, words`` (hashes) of every distinct text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(words_of(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([xxhash.xxh128_hexdigest(w) for w in words], pa.string()), pa.array(words, pa.binary())], names=["item_id", "item", "words"])

    rows = id_text(benchmark, "item_id").mapInArrow(run, "item_id long, item string, words binary").where(F.octet_length("words") > 0)
    rows = checkpointed(rows)
    return rows.select("item_id", "item"), rows.select("item", "words").dropDuplicates(["item"])


class _Filter:
    """Which seeds may be the benchmark's: three bits of every seed are set."""

    def __init__(self, bits: np.ndarray, log: int, masks: tuple[str, ...]) -> None:
        self.bits, self.log, self.masks = bits, log, masks

    def passes(self, h: np.ndarray) -> np.ndarray:
        found = self._has(h >> np.uint64(64 - self.log))
        at = np.flatnonzero(found)
        for shift in (0, 18):
            at = at[self._has((h[at] >> np.uint64(shift)) & np.uint64((1 << self.log) - 1))]
        return at

    def _has(self, bit: np.ndarray) -> np.ndarray:
        return (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _filter_of(seeds: DataFrame, items: DataFrame, max_bits: int) -> _Filter:
    """The filter, made by one aggregation; what comes to the driver is no larger than ``2 ** max_bits`` bits allow."""
    lengths = [r.n for r in items.select((F.octet_length("words") / 8).cast("int").alias("n")).select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()]
    masks = tuple(sorted({m for n in lengths for m in masks_for(n)}))
    log = min(max_bits, max(16, (SEED_BITS * seeds.count()).bit_length()))
    bit = F.explode(F.array(F.shiftrightunsigned("seed", 64 - log), *[F.shiftrightunsigned("seed", k).bitwiseAND((1 << log) - 1) for k in (0, 18)]))
    octets = seeds.select(bit.alias("b")).groupBy(F.shiftright("b", 3).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("b").bitwiseAND(7).cast("int"))).alias("v")).toArrow()
    bits = np.zeros(1 << (log - 3), np.uint8)
    bits[octets.column("at").to_numpy()] = octets.column("v").to_numpy().astype(np.uint8)
    return _Filter(bits, log, masks)


# -------------------------------------------------------------------- documents


def hits_of(texts: list[str], known: _Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of the texts that pass the filter: number of the text, position there, seed."""
    words = [words_of(t) for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    flat = word_hashes([w for ws in words for w in ws])
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for mask in known.masks:
        h = seed_hashes(flat, mask)
        at = known.passes(h)
        text = np.searchsorted(start, at, "right") - 1
        inside = at + len(mask) <= start[text] + size[text]
        at, text = at[inside], text[inside]
        out.append((text, at - start[text], h[at].view(np.int64)))
    text, at, seed = (np.concatenate([o[k] for o in out]) for k in range(3))
    order = np.argsort(text, kind="stable")
    return text[order], at[order], seed[order]


_HITS = "array<struct<seed:long,at:int>>"


def _suspects(docs: DataFrame, known: _Filter, text_col: str) -> DataFrame:
    """``row`` (all columns), ``text``, ``hits`` of the documents with seeds that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast((known.bits, known.log, known.masks))  # bounded by MAX_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(*shared.value)
        for b in batches:
            text, at, seed = hits_of(b.column("text").to_pylist(), known)
            rows, first = np.unique(text, return_index=True)
            offsets = pa.array(np.append(first, len(text)).astype(np.int32))
            hits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(seed), pa.array(at.astype(np.int32))], names=["seed", "at"]))
            chosen = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(chosen), b.column("text").take(chosen), hits], names=["row", "text", "hits"])
        _HASHES.clear()

    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return named.mapInArrow(tidied(run), f"row {named.schema['row'].dataType.simpleString()}, text string, hits {_HITS}").withColumn("key", F.md5(F.encode("text", "UTF-8")))


#: Diagonals of a text that one row carries, about, and bytes of words that a task holds beside items.
DIAGONALS, PART_BYTES = 1000, 4 << 20
CUT = {"key": pa.string(), "item": pa.string(), "shift": pa.int32(), "part": pa.binary()}
FOUND = {"key": pa.string(), "item": pa.string(), "doc_start": pa.int32(), "item_start": pa.int32(), "n_aligned": pa.int32(), "n_equal": pa.int32()}


def _matches(suspects: DataFrame, items: DataFrame, seeds: DataFrame) -> DataFrame:
    """``key, item, doc_start, item_start, n_aligned, n_equal`` of the distinct suspect texts."""
    texts = suspects.dropDuplicates(["key"])
    met = texts.select("key", F.inline("hits")).join(seeds.withColumnRenamed("at", "__i"), "seed")
    diagonals = met.groupBy("key", "item", (F.col("at") - F.col("__i")).alias("shift")).agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need")
    wanted = diagonals.join(items.select("item", (F.octet_length("words") / 8).cast("int").alias("size")), "item")
    counted = wanted.groupBy("key").agg(F.count("*").alias("all"))
    dealt = wanted.join(counted, "key").withColumn("part", F.pmod(F.xxhash64("item", "shift"), F.ceil(F.col("all") / DIAGONALS)))
    per_text = dealt.groupBy("key", "part").agg(F.collect_list(F.struct("item", "shift", "size")).alias("wanted")).drop("part")  # about DIAGONALS of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a text that each diagonal puts beside its item, in batches of bounded size."""
        for b in batches:
            rows, held = [], 0
            for key, text, wanted in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                words = word_hashes(words_of(text))
                for w in wanted:
                    part = np.zeros(w["size"], np.uint64)
                    lo, hi = max(0, w["shift"]), min(len(words), w["shift"] + w["size"])
                    part[lo - w["shift"] : hi - w["shift"]] = words[lo:hi]
                    rows.append((key, w["item"], w["shift"], part.tobytes()))
                    held += 8 * w["size"]
                    if held > PART_BYTES:
                        yield made(rows, CUT)
                        rows, held = [], 0
            yield made(rows, CUT)

    def made(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, item, shift, part, words in zip(*(b.column(c).to_pylist() for c in ("key", "item", "shift", "part", "words")), strict=True):
                rows += [(key, item, a + shift, a, e - a, n) for a, e, n in stretches(np.frombuffer(words, np.uint64), np.frombuffer(part, np.uint64))]
            yield made(rows, FOUND)

    parts = checkpointed(texts.select("key", "text").join(per_text, "key").mapInArrow(tidied(cut), "key string, item string, shift int, part binary"))  # one Python worker a task
    beside = parts.join(items, "item").select("key", "item", "shift", "part", "words")
    return beside.mapInArrow(verify, "key string, item string, doc_start int, item_start int, n_aligned int, n_equal int")


OVERLAP_SCHEMA = "doc_id long, item_id long, doc_start int, item_start int, n_aligned int, n_equal int"


def _prepared(docs: DataFrame, benchmark: DataFrame, text_col: str, max_bits: int):
    small_batches(docs.sparkSession)
    ids, items = _items(benchmark)
    seeds = checkpointed(items.mapInArrow(_seeds_of, "seed long, item string, at int, need int"))
    known = _filter_of(seeds, items, max_bits)
    return ids, items, seeds, known


def overlaps(docs: DataFrame, benchmark: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``, benchmark item and stretch of aligned words that overlap: where (in
    words), and how much. An item may lie in a document several times, on several diagonals.

    Null or empty texts overlap nothing; repeated rows are found again, and so are items that repeat;
    without items: no rows. Texts of any length are compared as wholes; further columns are ignored.
    """
    ids, items, seeds, known = _prepared(docs, benchmark, "text", max_bits)
    suspects = checkpointed(_suspects(id_text(docs), known, "text"))
    found = _matches(suspects, items, seeds).join(ids, "item")
    cols = ["doc_start", "item_start", "n_aligned", "n_equal"]
    return suspects.select("row.doc_id", "key").join(found, "key").select("doc_id", "item_id", *cols)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least_words: int = EXACT_BELOW, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, unchanged, that overlap no benchmark item by ``least_words`` aligned words.

    A whole item of fewer words is found by ``overlaps`` but says nothing about a text that holds it,
    so that it drops none unless ``least_words`` is lower. Null texts stay.
    """
    _, items, seeds, known = _prepared(docs, benchmark, text_col, max_bits)
    suspects = checkpointed(_suspects(docs, known, text_col))
    dirty = _matches(suspects, items, seeds).where(F.col("n_aligned") >= least_words).select("key").distinct()
    shared = docs.sparkSession.sparkContext.broadcast((known.bits, known.log, known.masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(*shared.value)
        for b in batches:
            text = hits_of([t or "" for t in b.column(text_col).to_pylist()], known)[0]
            free = np.ones(b.num_rows, bool)
            free[text] = False
            yield pa.RecordBatch.from_struct_array(pc.filter(b.to_struct_array(), pa.array(free)))
        _HASHES.clear()

    return docs.mapInArrow(tidied(run), docs.schema).unionByName(suspects.join(dirty, "key", "left_anti").select("row.*"))
