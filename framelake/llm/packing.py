"""Best-fit packing of tokenized documents by hierarchical residual packing.

Documents become token ids and are cut only where they are longer than a sequence. Every partition
packs its pieces best-fit, largest first; bins that are nearly full are done. The underfull ones
become items of their own, meet those of other partitions in a tree of merge rounds, and are packed
best-fit again; what is still underfull then is opened and its pieces are packed anew. Bins into which
not even the smallest piece left fits retire. Groups of a round grow by ``FAN_IN``, but hold ``BLOCK``
pieces at most on average: the tree ends with as many groups as that takes, or when a round joins nothing.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, small_batches, tidied

CAPACITY = 2048
END = np.zeros(1, "<u4").tobytes()
#: A bin this full takes no part in later rounds.
NEARLY_FULL = 0.995
#: Groups that meet in one of the next merge round; pieces packed at once.
FAN_IN, BLOCK = 8, 200_000
#: Texts that are encoded together.
ROWS = 250
#: Words whose ids a worker keeps, and their greatest length: longer ones are encoded where they occur.
CACHE_WORDS, CACHE_LENGTH = 240_000, 40

Encode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _worker() -> dict:
    """What lives as long as the Python worker, whichever task runs in it."""
    return sys.modules.setdefault("_framelake_worker", types.ModuleType("_framelake_worker")).__dict__


def word_encoder(path: str) -> Encode:
    """Ids of whole texts (all ids end to end, and how many each text has) under a tokenizer that never
    looks across white space, lower-cases, keeps runs of letters apart from other characters, and marks the
    last piece of a run by the model's suffix. Each distinct run of characters other than space and line
    feed is encoded once a batch, and remembered by the worker if it is short.
    """
    state = _worker()

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if ("encoder", path) not in state:
            state["encoder", path] = _Words(path)
        return state["encoder", path].encode(texts)

    return encode


#: Signs that a space is put before behind a letter or digit: the tokenizer parts them there anyway.
_SIGNS = np.isin(np.arange(256), list(b".,!?;:*$#%&"))
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: A-Z in lower case, line feeds as spaces.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[10] = 32


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with fewer distinct words and the same ids: A-Z lower-cased, signs apart from letters and digits."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = _PLAIN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    before = _ALNUM[data]
    letter = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin-1 letters
    before[1:] |= letter
    cut = np.zeros(len(data), np.int64)
    cut[1:] = before[:-1] & _SIGNS[data[1:]]
    at = np.cumsum(cut)
    out = np.full(len(data) + (int(at[-1]) if len(at) else 0), 32, np.uint8)
    out[np.arange(len(data)) + at] = data
    moved = ends - ends[0]
    moved = moved + np.concatenate([[0], at])[moved]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(moved.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])


def _strings(words: pa.Array) -> list[str]:
    """The words, of which none holds a space, as strings: one long string is made and cut, which is faster than one by one."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, pa.scalar(" ", words.type))[0].as_py().split(" ")


class _Words:
    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # for letters in lower case and normal form, the normalizer and the splitting pattern change nothing
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.whole.get_vocab(), self.whole.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(_spaced(texts), " ")
        coded = lists.flatten().dictionary_encode()
        parts = self._known(_strings(coded.dictionary))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        of = coded.indices.to_numpy()
        n = size[of]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(first[of] - (ends - n), n) + np.arange(total)]
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        return out, np.diff(at)

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of the words; short ones are kept in two generations, of which the older goes when the younger is full."""
        young, old = self.young, self.old
        found = list(map(young.get, words))
        gone = [k for k, ids in enumerate(found) if ids is None]
        fresh = []
        for k in gone:
            w = words[k]
            ids = old.get(w)
            if ids is None:
                fresh.append(k)
            else:
                found[k] = young[w] = ids
        learnt = self._learnt([words[k] for k in fresh])
        for k in fresh:
            w = words[k]
            found[k] = ids = learnt[w]
            if len(w) <= CACHE_LENGTH:
                young[w] = ids
        if len(young) > CACHE_WORDS // 2:
            self.young, self.old = {}, young
        return found

    def _learnt(self, fresh: list[str]) -> dict[str, bytes]:
        new = {}
        plain = [w for w in fresh if w.isalpha() and (w.islower() if w.isascii() else w == w.lower() and unicodedata.is_normalized("NFC", w))]
        for at in range(0, len(plain), 5000):
            words = plain[at : at + 5000]
            ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(words):
                continue  # left for the whole tokenizer
            raw, low = ids.tobytes(), 0
            for w, high in zip(words, (4 * ends).tolist(), strict=True):
                new[w] = raw[low:high]
                low = high
        rest = [w for w in fresh if w not in new]
        for at in range(0, len(rest), 20_000):
            words = rest[at : at + 20_000]
            for w, e in zip(words, self.whole.encode_batch_fast(words, add_special_tokens=False), strict=True):
                new[w] = np.array(e.ids, "<u4").tobytes()
        return new


PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, encode: Encode, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and one closing id 0, cut every ``capacity`` ids.

    Null text counts as empty (one piece of one id); repeated rows are cut again. ``with_ids`` adds
    the ids as a binary column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            flat, sizes = encode(b.column("text"))
            raw, rows, low = memoryview(flat.astype("<u4").tobytes()), [], 0
            for doc_id, n in zip(b.column("doc_id").to_pylist(), (4 * sizes).tolist(), strict=True):
                for k, at in enumerate(range(0, n + 4, 4 * capacity)):
                    part = bytes(raw[low + at : low + min(at + 4 * capacity, n)])
                    if at + 4 * capacity > n:
                        part += END
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                low += n
            types_ = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types_)], names=names)

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(tidied(run), PIECE_SCHEMA + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin: largest first, each into the fullest bin that has room."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has room for exactly r more
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fit = (open_ >> n) << n
        if fit:
            r = (fit & -fit).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, at = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += n
        if r > n:
            room[r - n].append(at)
            open_ |= 1 << (r - n)
    return bins, offsets, np.array(fills, np.int64)


def _pack_partition(capacity: int):
    """Packs the rows of a partition best-fit by ``length``, ``BLOCK`` at a time; adds bin, its fill, and the
    offset there. Bins are numbered by partition and order, so a task that runs again numbers them alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, n = 0, [], 0
        base = (1 << 58) | (TaskContext.get().partitionId() << 34)

        def flush() -> pa.RecordBatch:
            nonlocal made
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets, fills = best_fit(whole.column("length").to_numpy(), capacity)
            out = [*whole.columns, pa.array(bins + base + made), pa.array(fills[bins].astype(np.int32)), pa.array(offsets)]
            made += len(fills)
            return pa.RecordBatch.from_arrays(out, names=[*whole.schema.names, "bin", "fill", "offset"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BLOCK:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def merged(bins: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, capacity: int, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin (from 0), offset and fill of every piece after a round over underfull bins.

    First the bins are items of a best-fit of their own. Those that are still underfull are opened and
    their pieces packed best-fit anew, which stays if it takes fewer bins.
    """
    _, first, item = np.unique(bins, return_index=True, return_inverse=True)
    fill = np.bincount(item, sizes).astype(np.int64)
    into, shift, fills = best_fit(fill, capacity)
    to, at = into[item], shift[item] + offsets
    loose = np.flatnonzero(fills[to] < full)
    again, places, new = best_fit(sizes[loose], capacity)
    if len(new) < (fills < full).sum():
        to[loose], at[loose] = again + len(fills), places
        fills = np.concatenate([fills, new])
    return to, at, fills[to]


def _merge_partition(capacity: int, full: int, level: int):
    """A merge round over the pieces (``bin, offset, size``) of a partition, ``BLOCK`` bins' worth at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, n = (level << 58) | (TaskContext.get().partitionId() << 34), 0, [], 0

        def flush(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made
            to, at, fill = merged(*(rows.column(c).to_numpy().astype(np.int64) for c in ("bin", "offset", "size")), capacity, full)
            _, first, number = np.unique(to, return_index=True, return_inverse=True)
            part = rows.column("part").to_numpy()[first][number]  # partitions hold several groups: a bin goes on as one
            out = [*(rows.column(c) for c in ("item", "place", "size")), pa.array(part), pa.array(number + base + made), pa.array(at), pa.array(fill.astype(np.int32))]
            made += int(number.max()) + 1
            return pa.RecordBatch.from_arrays(out, names=["item", "place", "size", "part", "bin", "offset", "fill"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= 2 * BLOCK:  # the last bin may go on in the next batch
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                of = whole.column("bin").to_numpy()
                cut = int(np.flatnonzero(of != of[-1])[-1]) + 1 if of[0] != of[-1] else len(of)
                yield flush(whole.slice(0, cut))
                held, n = ([whole.slice(cut)], len(of) - cut) if cut < len(of) else ([], 0)
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


MERGED = "item long, place long, size int, part long, bin long, offset long, fill int"


def pack(found: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, fan_in: int = FAN_IN) -> DataFrame:
    """``found`` (rows with ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset`` added
    (columns of these names are replaced; ``bin`` and ``fill`` may be among the others).

    Rows of a sequence are gapless from offset 0. Equal lengths go in the order of their rows; repeated
    rows are packed one by one; an empty table gives an empty one.
    """
    found = found.drop("sequence_id", "offset")
    cols, full = found.columns, int(capacity * nearly_full)
    renamed = found.select(F.col("length").cast("int").alias("length"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    local = checkpointed(renamed.mapInArrow(_pack_partition(capacity), f"length int, row {renamed.schema['row'].dataType.simpleString()}, bin long, fill int, offset long"))
    groups, level = local.rdd.getNumPartitions(), 2
    loose = local.where(F.col("fill") < full).select(
        F.col("bin").alias("item"), F.col("offset").alias("place"), F.col("length").alias("size"), F.floor(F.shiftright("bin", 34) % (1 << 24)).alias("part"), "bin", "offset", "fill"
    )
    finals = []
    while True:
        fit = capacity - F.col("fill") >= F.lit(loose.agg(F.min("size")).first()[0] or 1)  # no piece fits into the others any more
        n, bins = loose.where(fit).agg(F.count("*"), F.count_distinct("bin")).first()
        fewer = max(1, -(-groups // fan_in), -(-n // BLOCK))
        if not n or level > 2 and fewer >= groups:
            break
        dealt = loose.where(fit).withColumn("part", F.floor(F.col("part") * fewer / groups)).repartition(fewer, "part").sortWithinPartitions("part", "bin", "offset")
        packed = checkpointed(dealt.mapInArrow(_merge_partition(capacity, full, level), MERGED))
        finals += [packed.where(F.col("fill") >= full)] + [loose.where(~fit)] * (level > 2)
        loose, groups, level = packed.where(F.col("fill") < full), fewer, level + 1
        if packed.agg(F.count_distinct("bin")).first()[0] >= bins:  # nothing joined
            break
    if level == 2:
        return local.select("row.*", F.col("bin").alias("sequence_id"), "offset")
    moves = reduce(DataFrame.unionByName, [*finals, loose]).select("item", "place", F.col("bin").alias("to"), F.col("offset").alias("at"))
    placed = local.join(moves, (F.col("bin") == F.col("item")) & (local["offset"] == F.col("place")), "left")
    return placed.select("row.*", F.coalesce("to", "bin").alias("sequence_id"), F.coalesce("at", local["offset"]).alias("offset"))
