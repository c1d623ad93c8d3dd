"""Evaluation passages inside training texts, whole or in part, with words changed.

CGK embedding: a random walk over the words of a window copies a word per step
and moves on by a coin drawn from the word, so windows a few edits apart agree
in most steps (edit distance becomes Hamming distance). Locality-sensitive keys
sample a few of the steps, many times over. Windows are as long as the items,
in classes of length: an item offers the windows of the longest class that fits
into it, a text offers a window of every class at each of its words, unless too
few of the window's word pairs occur in any item for an edited copy to be there.
Quotes, which are shorter than items, share a run of RUN words; runs collide by
a key over all their words. The corpus is read once: keys that pass a bit table
of all item keys, of fixed size, are joined to the item keys, and what meets
there is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.session import discard, materialize

RUN = 12  # successive words that count as a leak
EDITS = 0.2  # edits per item word up to which an edited copy counts; one in seven may be changed
WALKS, SETS = 10, 4  # independent walks, samples of steps of each
TAKEN = 4  # steps in a sample; one fewer in windows under RUN words
EXACT = 5  # items of fewer words must occur unchanged
BITS = 26  # the bit table of item keys has 2 ** BITS bits, whatever the number of items
CELLS = 8_000_000  # steps of walks held at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """Words of a text without case, punctuation, markup, quoting marks and line-end hyphens."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*[>#|*]+[ \t]*", "")
    t = F.regexp_replace(t, r"(?<=\p{L})[-‐­]\s*\n\s*(?=\p{L})", "")
    t = F.regexp_replace(t, r"(?i)</?(?:span|b|i|em|strong|a|u|mark|font|code|sup|sub)\b[^<>]*>", "")
    t = F.regexp_replace(t, r"<[^<>]*>|&nbsp;|&#160;| ", " ")
    t = F.regexp_replace(t, r"&[a-zA-Z]+;|[^\p{L}\p{N}\s]", "")
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def coded(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, w)``: the words of each text as 64-bit codes; null keys and texts are left out."""
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w")
    )


def _classes(longest: int) -> list[int]:
    """Window lengths, each about a fifth longer than the one before."""
    out, n = [], 1
    while n <= longest:
        out.append(n)
        n = max(n + 1, n * 6 // 5)
    return out


def _steps(width: int, seed: int = 3) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Per walk: its coins, and the steps of each sample. Same everywhere for one width."""
    rng = np.random.default_rng([seed, width])
    length = max(2, 2 * width - 2)
    taken = TAKEN if width >= RUN else TAKEN - 1
    return [
        (
            rng.integers(0, 1 << 32, length, dtype=np.uint32) | np.uint32(1),
            [np.sort(rng.choice(length, min(taken, length), replace=False)) for _ in range(SETS)],
        )
        for _ in range(WALKS)
    ]


def _salt(n: int) -> np.uint64:
    return np.uint64(n * int(_MIX) % (1 << 64))


def run_keys(flat: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A key over all ``width`` words from each start."""
    key = np.full(len(starts), _salt(width))
    for j in range(width):
        key = (key ^ flat[starts + j].view(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return key


def walk_keys(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Keys of the windows of ``width`` words, none beyond ``ends``: (WALKS * SETS, len(starts))."""
    symbols = (flat >> 32).astype(np.uint32)
    end = np.minimum(starts + width, ends)
    out = np.empty((WALKS * SETS, len(starts)), np.uint64)
    for r, (coins, sets) in enumerate(_steps(width)):
        last = max(int(s[-1]) for s in sets)
        seen = np.empty((last + 1, len(starts)), np.uint32)
        at = starts.copy()
        for j in range(last + 1):
            inside = at < end
            seen[j] = np.where(inside, symbols[np.minimum(at, end - 1)], np.uint32(0))
            at += ((seen[j] * coins[j]) >> np.uint32(31)).astype(at.dtype) & inside
        for q, taken in enumerate(sets):
            key = np.full(len(starts), _salt(1_000_003 + (width * WALKS + r) * SETS + q))
            for j in taken:
                key = (key ^ seen[j]) * _MIX
                key ^= key >> np.uint64(29)
            out[r * SETS + q] = key
    return out


class Filter:
    """Bits of a set of keys, two per key."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << (BITS - 3), np.uint8) if bits is None else bits

    @staticmethod
    def _places(keys: np.ndarray) -> Iterator[np.ndarray]:
        for shift in (0, 32):
            yield (keys >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(keys.shape, bool)
        for at in self._places(keys):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return out


def item_windows(offsets: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, item, spot)`` of a batch of items: their runs (spot: first word) and their windows (spot: -1)."""
    size = np.diff(offsets)
    out = []

    def spots(which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Item and place of every window that lies whole in one of the items ``which``."""
        many = size[which] - width + 1
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(which, many), at

    runs = np.where(size >= EXACT, RUN, size)
    for run in np.unique(runs[(runs > 0) & (size >= runs)]).tolist():
        item, at = spots(np.flatnonzero((runs == run) & (size >= run)), run)
        out.append((run_keys(flat, offsets[item] + at, run), item, at))
    classes = np.array(_classes(int(size.max(initial=1))))
    widths = np.where(size >= EXACT, classes[np.searchsorted(classes, np.maximum(size, 1), "right") - 1], 0)
    for width in np.unique(widths[widths > 0]).tolist():
        item, at = spots(np.flatnonzero(widths == width), width)
        for got in walk_keys(flat, offsets[item] + at, offsets[item + 1], width):
            out.append((got, item, np.full(len(item), -1)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, item, spot = (np.concatenate(c) for c in zip(*out))
    once = np.unique(np.stack([item.astype(np.uint64), key, spot.astype(np.int64).view(np.uint64)]), axis=1, return_index=True)[1]
    return key[once], item[once], spot[once]


def pair_codes(words: np.ndarray) -> np.ndarray:
    """A code for each two neighbouring words."""
    w = words.view(np.uint64)
    return (w[:-1] * _MIX) ^ (w[1:] >> np.uint64(1))


def text_hits(offsets: np.ndarray, flat: np.ndarray, keys: Filter, pairs: Filter, widths: list[int], runs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(key, start)`` of the windows of a batch that may meet an item: text d has words flat[offsets[d]:offsets[d + 1]]."""
    size = np.diff(offsets)
    ends = np.repeat(offsets[1:], size)
    every = np.arange(len(flat))
    found, at = [], []

    def keep(got: np.ndarray, starts: np.ndarray) -> None:
        hit = np.flatnonzero(keys.holds(got))
        found.append(got[hit])
        at.append(starts[hit])

    for run in runs:
        starts = every[every + run <= ends]
        keep(run_keys(flat, starts, run), starts)
    if widths and len(flat):
        known = np.concatenate([[0], np.cumsum(pairs.holds(pair_codes(flat)))])
        for width in widths:
            # an edit takes two pairs from a copy; a copy may end with the text
            edits = int(EDITS * (width * 6 // 5 + 1))
            end = np.minimum(every + width, ends)
            starts = every[(known[end - 1] - known[every] >= end - every - 1 - 2 * edits) & (end - every >= width - edits)]
            step = CELLS // (2 * width)
            for piece in (starts[i : i + step] for i in range(0, len(starts), step)):
                for got in walk_keys(flat, piece, ends[piece], width):
                    keep(got, piece)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(at)


def within(item: np.ndarray, text: np.ndarray) -> int:
    """Fewest word edits that turn ``item`` into some stretch of ``text``."""
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        new[0] = i + 1
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def leaked(text: np.ndarray, item: np.ndarray, spots: list[tuple[int, int]]) -> bool:
    """Whether ``text`` holds a run or an edited copy of ``item`` where windows met: (start, first word of the run or -1)."""
    run = RUN if len(item) >= EXACT else len(item)
    for start, first in spots:
        if first >= 0 and np.array_equal(text[start : start + run], item[first : first + run]):
            return True
    allowed = int(len(item) * EDITS)
    reach = len(item) + allowed + 1
    needed = frozenset(item.tolist())
    begin = end = None
    for start in [*sorted({s for s, _ in spots}), None]:
        if end is not None and (start is None or start - reach > end):
            part = text[max(0, begin - reach) : end + reach]
            # each edit touches one word: too few of the item's words in reach rule a copy out
            if len(needed.difference(part.tolist())) <= allowed and within(item, part) <= allowed:
                return True
            begin = None
        if start is not None:
            begin, end = start if begin is None else begin, start
    return False


def _arrays(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.to_numpy()[offsets[0] : offsets[-1]]


def leaks(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str, item_text: str) -> DataFrame:
    """``(doc, item)`` of every document that holds RUN successive words of an item or an edited copy of it.

    An edited copy is within EDITS word edits per word of the whole item;
    items of fewer than EXACT words must occur unchanged. Null keys and null,
    empty or wordless texts give no rows; repeated rows give one. Texts of any
    length are read whole, and items of any number are found in one pass over
    the documents.
    """
    spark = documents.sparkSession
    wanted = materialize(coded(items, item, item_text).distinct().where(F.size("w") > 0), "items")

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, item, spot = item_windows(*_flat(batch.column(1)))
                yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(item)), pa.array(spot)], ["key", "item", "spot"])

    offered = materialize(wanted.mapInArrow(offer, "key long, item long, spot long"), "offered")
    sizes = [r["n"] for r in wanted.select(F.size("w").alias("n")).distinct().collect()]  # item lengths, few
    if not sizes:
        return spark.createDataFrame([], "doc long, item long")
    widths = sorted({max(c for c in _classes(n) if c <= n) for n in sizes if n >= EXACT})
    runs = sorted({RUN if n >= EXACT else n for n in sizes})
    keys = spark.sparkContext.broadcast(_filter(offered.select("key")))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _arrays(batch.column(1)):
                yield pa.record_batch([pa.array(pair_codes(w).view(np.int64))], ["key"])

    pairs_of_items = spark.sparkContext.broadcast(_filter(wanted.mapInArrow(beside, "key long")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = _flat(lists)
            if not len(flat):
                continue
            key, start = text_hits(offsets, flat, keys.value, pairs_of_items.value, widths, runs)
            if not len(key):
                continue
            row = np.searchsorted(offsets, start, "right") - 1
            order = np.argsort(row, kind="stable")
            row, key, start = row[order], key[order], start[order] - offsets[row[order]]
            rows, first = np.unique(row, return_index=True)
            cuts = pa.array(np.append(first, len(row)).astype(np.int32))
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows)),
                    lists.take(pa.array(rows)),
                    pa.ListArray.from_arrays(cuts, pa.array(key.view(np.int64))),
                    pa.ListArray.from_arrays(cuts, pa.array(start)),
                ],
                ["doc", "w", "keys", "starts"],
            )

    met = materialize(
        coded(documents, doc, text).mapInArrow(search, "doc long, w array<long>, keys array<long>, starts array<long>")
        .withColumn("text", F.xxhash64("doc", "w")),
        "met",
    )
    pairs = (
        met.select("text", F.explode(F.arrays_zip("keys", "starts")).alias("k"))
        .select("text", F.col("k.keys").alias("key"), F.col("k.starts").alias("start"))
        .join(offered, "key")
        .groupBy("text", "item")
        .agg(F.collect_set(F.struct("start", "spot")).alias("spots"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, passages = _arrays(batch.column(2)), _arrays(batch.column(3))
            spots = batch.column(4).to_pylist()
            good = [leaked(t, p, [(s["start"], s["spot"]) for s in where]) for t, p, where in zip(texts, passages, spots)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.join(met.select("text", "doc", "w"), "text")
        .join(wanted.select(F.col("id").alias("item"), F.col("w").alias("passage")), "item")
        .select("doc", "item", "w", "passage", "spots")
        .mapInArrow(verify, "doc long, item long")
        .distinct()
    )


def _filter(keys: DataFrame) -> Filter:
    """The bit table of a column of keys: one per partition, united here."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter()
        for batch in batches:
            own.add(np.unique(batch.column(0).to_numpy()).view(np.uint64))
        yield pa.record_batch([pa.array([own.bits.tobytes()], pa.binary())], ["bits"])

    out = Filter()
    for row in keys.coalesce(64).mapInArrow(mark, "bits binary").toLocalIterator():
        out.bits |= np.frombuffer(row["bits"], np.uint8)
    return out
