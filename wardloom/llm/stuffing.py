"""Keyword-stuffed pages and link lists, told from sentences by word statistics of the corpus.

Pages are cut into words once. Words, and pairs of neighbouring words, are
counted exactly over all documents. A page is cut into blocks (lines; runs of
short lines together). Per block two figures count: the mean normalised
pointwise mutual information of its neighbouring words, taken from the other
documents only, which is low where words follow each other without grammar;
and the chance that two of its words are the same uncommon word (times the
squared share of words that are no numbers), which is high where keywords are
repeated beyond any sentence. One limit holds on the log of
that chance less SLOPE times the information, so the looser the words fit, the
less repetition is spam; a second one on the information alone finds word
salad. Links with their captions and hash tags are counted apart.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import discard, materialize

HELD = 4_000_000  # counts up to which every worker holds them all
COMMON = 0.006  # words above this share of all words are nobody's keyword
SHORT = 16  # lines of fewer words join their neighbours in one block
LEAST = 6  # words a block needs to be judged
CAPTION = 6  # words that may belong to a link beside them
PRODUCT = 3  # words beside a link up to which they are a product tag, counted with it, not a reference
REPEATS = 3  # times the most frequent uncommon word of a block must occur to be a keyword
# Limits on blocks:
SLOPE, REPEATED = 4.0, -5.1  # log of the chance of equal uncommon words, less SLOPE times the mean NPMI
SALAD = 0.22  # mean NPMI below that of lists of words
WORDY = 0.8  # least share of words that are no numbers or letters in word salad: tables of values fit loosely too

_LINK = re.compile(
    r"<a\b[^>]*>.*?(?:</a>|$)|\[[^\]\n]*\]\([^)\n]*\)?|https?://\S*|\bwww\.\S+"
    r"|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/\S*|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\.[a-z]{2,}\b",
    re.I,
)
_MARKUP = re.compile(r"<(?!a\b|/a>)[^<>]*>")
_TOKEN = re.compile(r"#\w+|[^\W_]+(?:[_'’][^\W_]+)*")
_codes: dict[str, int] = {}


def _code(word: str) -> int:
    got = _codes.get(word)
    if got is None:
        if len(_codes) > 500_000:
            _codes.clear()
        naming = len(word) > 1 and not word.isdigit()  # the last bit: letters alone and numbers are nobody's keyword
        got = _codes[word] = xxhash.xxh3_64_intdigest(word) >> 2 << 1 | naming
    return got


def read(text: str) -> tuple[int, int, list[list[list[int]]]]:
    """(links with words of product captions, hash tags, blocks) of a page; a block: lines of word codes."""
    text = _MARKUP.sub("", html.unescape(text)) if "<" in text or "&" in text else text
    links = tags = 0
    blocks: list[list[list[int]]] = []
    joining = False
    for line in text.split("\n"):
        here = 0
        if "." in line or "<a" in line or "](" in line or "http" in line:
            line, here = _LINK.subn(" ", line)
        words = []
        for token in _TOKEN.findall(line.lower()):
            if token[0] == "#":
                tags += 1
            else:
                words.append(_code(token))
        if here:
            links += here
            if len(words) <= PRODUCT * here:
                links += len(words)
                continue
            if len(words) <= CAPTION * here + 2:
                continue
        if not words:
            continue
        if len(words) < SHORT:
            if joining:
                blocks[-1].append(words)
            else:
                blocks.append([words])
            joining = True
        else:
            blocks.append([words])
            joining = False
    return links, tags, blocks


class Batch:
    """The words of a batch of pages, flat."""

    def __init__(self, texts: list[str | None]):
        pages = [read(t) if t else (0, 0, []) for t in texts]
        lines = [[words for block in blocks for words in block] for _, _, blocks in pages]
        self._lay(
            np.array([p[0] for p in pages], np.int64),
            np.array([p[1] for p in pages], np.int64),
            np.array([w for page in lines for words in page for w in words], np.int64),
            np.array([sum(map(len, page)) for page in lines], np.int64),
            np.array([len(words) for page in lines for words in page], np.int64),
            np.array([len(page) for page in lines], np.int64),
            np.array([len(block) for _, _, blocks in pages for block in blocks], np.int64),
            np.array([len(blocks) for _, _, blocks in pages], np.int64),
        )

    def _lay(self, links, tags, words, words_of, line_words, lines_of, block_lines, blocks_of) -> None:
        self.pages, self.links, self.tags = len(links), links, tags
        self.raw = (words, words_of, line_words, lines_of, block_lines, blocks_of)
        self.word = words.view(np.uint64)
        self.line = np.repeat(np.arange(len(line_words)), line_words)
        self.blocks = len(block_lines)
        self.block = np.repeat(np.repeat(np.arange(self.blocks), block_lines), line_words)
        self.doc = np.repeat(np.arange(self.pages), words_of)
        pair = np.flatnonzero(self.line[1:] == self.line[:-1])
        self.left, self.right = pair, pair + 1
        self.pair = self.word[self.left] * np.uint64(0x9E3779B97F4A7C15) + self.word[self.right]

    def stored(self, ids: pa.Array) -> pa.RecordBatch:
        """Columns TOKENS."""
        words, words_of, line_words, lines_of, block_lines, blocks_of = self.raw
        lists = [
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(x))
            for x, n in ((words, words_of), (line_words.astype(np.int32), lines_of), (block_lines.astype(np.int32), blocks_of))
        ]
        return pa.record_batch([ids, pa.array(self.links), pa.array(self.tags), *lists], ["id", "links", "tags", "words", "lines", "blocks"])

    @classmethod
    def read_back(cls, record: pa.RecordBatch) -> Batch:
        """From columns TOKENS."""
        out = cls.__new__(cls)
        flat = [(c.flatten().to_numpy().astype(np.int64), c.value_lengths().to_numpy().astype(np.int64)) for c in record.columns[3:6]]
        out._lay(record.column(1).to_numpy(), record.column(2).to_numpy(), *(x for pair in flat for x in pair))
        return out


TOKENS = "id long, links long, tags long, words array<long>, lines array<int>, blocks array<int>"


def tokens(texts: DataFrame) -> DataFrame:
    """Columns TOKENS of ``texts(id, text)``: each page's words as codes, words per line, lines per block; pages without any are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for i in range(0, record.num_rows, 500):
                piece = record.slice(i, 500)
                b = Batch(piece.column(1).to_pylist())
                some = pa.array(b.links + b.tags + b.raw[1] > 0)
                yield b.stored(piece.column(0)).filter(some)

    return texts.mapInArrow(cut, TOKENS)


class Counts:
    """Exact counts of words (kind 0) and pairs (kind 1): sorted codes and their counts. A code that isn't listed counts once."""

    def __init__(self, kinds: np.ndarray, codes: np.ndarray, n: np.ndarray, total: tuple[int, int]):
        self.total, self.listed = total, []
        for kind in (0, 1):
            c, m = codes[kinds == kind].view(np.uint64), n[kinds == kind]
            order = np.argsort(c)
            self.listed.append((c[order], m[order]))

    def count(self, kind: int, codes: np.ndarray) -> np.ndarray:
        known, n = self.listed[kind]
        if not len(known):
            return np.ones(len(codes))
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, n[at], 1).astype(float)


def _pieces(columns: list[np.ndarray], names: list[str], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), size):
        yield pa.record_batch([pa.array(c[i : i + size]) for c in columns], names)


def count_corpus(pages: DataFrame) -> DataFrame:
    """``(kind, code, n)``: how often each word and pair stands in the pages (TOKENS), added up per batch, per task, then in all."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            b = Batch.read_back(record)
            for kind, codes in ((0, b.word), (1, b.pair)):
                code, n = np.unique(codes, return_counts=True)
                yield from _pieces([np.full(len(code), kind, np.int32), code.view(np.int64), n.astype(np.int64)], ["kind", "code", "n"])

    return pages.mapInArrow(tally, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def with_counts(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``pages`` (TOKENS) with ``known``: the counts of each page's own words and pairs, by joins, for tables no worker holds."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for i in range(record.num_rows):
                b = Batch.read_back(record.slice(i, 1))
                for kind, found in ((0, b.word), (1, b.pair)):
                    code = np.unique(found).view(np.int64)
                    page = np.full(len(code), record.column(6)[i].as_py(), np.int64)
                    yield from _pieces([page, np.full(len(code), kind, np.int32), code], ["page", "kind", "code"])

    marked = pages.withColumn("page", F.xxhash64("words", "lines", "blocks"))
    needed = marked.dropDuplicates(["page"]).mapInArrow(codes, "page long, kind int, code long")
    known = needed.join(counts, ["kind", "code"]).groupBy("page").agg(F.collect_list(F.struct("kind", "code", "n")).alias("known"))
    return marked.join(known, "page", "left").select(*pages.columns, "known")


def judge(b: Batch, counts: Counts) -> pd.DataFrame:
    """Per page of a batch: words (a link or tag counts as one), words in spam, and the lowest NPMI of a block."""
    n = np.bincount(b.block, minlength=b.blocks).astype(float)
    doc_of = np.zeros(b.blocks, np.int64)
    doc_of[b.block] = b.doc

    def own(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often a page itself holds each code."""
        if not len(codes):
            return np.zeros(0)
        order = np.lexsort((codes, doc))
        c, d = codes[order], doc[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        group = np.cumsum(new) - 1
        out = np.empty(len(c))
        out[order] = np.bincount(group)[group]
        return out

    total = max(float(counts.total[0]), 2.0)
    words = np.maximum(counts.count(0, b.word) - own(b.word, b.doc), 1.0)
    pairs = np.maximum(counts.count(1, b.pair) - own(b.pair, b.doc[b.left]), 0.1)
    npmi = np.log(pairs * total / (words[b.left] * words[b.right])) / -np.log(np.minimum(pairs / total, 0.5))
    at = b.block[b.left]
    m = np.bincount(at, minlength=b.blocks)
    mean = np.where(m > 0, np.bincount(at, npmi, minlength=b.blocks) / np.maximum(m, 1), 1.0)
    # keywords: the most frequent uncommon word, and the chance that two words of the block are the same uncommon one
    naming = b.word & np.uint64(1) == 1
    rare = (counts.count(0, b.word) < COMMON * total) & naming
    in_block = own(b.word, b.block)
    top = np.zeros(b.blocks)
    np.maximum.at(top, b.block[rare], in_block[rare])
    equal = np.bincount(b.block, np.where(rare, in_block - 1, 0.0), minlength=b.blocks) / np.maximum(n * (n - 1), 1)
    wordy = np.bincount(b.block, naming.astype(float), minlength=b.blocks) / np.maximum(n, 1)
    equal = equal * wordy * wordy  # numbers and units repeat in tables of values
    stuffed = (top >= REPEATS) & (np.log(np.maximum(equal, 1e-9)) - SLOPE * mean >= REPEATED)
    spam = (n >= LEAST) & (stuffed | ((mean < SALAD) & (m >= LEAST) & (wordy >= WORDY)))
    fixed = b.links + b.tags
    return pd.DataFrame(
        {
            "words": np.bincount(doc_of, n, minlength=b.pages).astype(np.int64) + fixed,
            "spam": np.bincount(doc_of, n * spam, minlength=b.pages).astype(np.int64) + fixed,
            "links": b.links,
            "tags": b.tags,
        }
    )


def stuffed(documents: DataFrame, key: str, text: str, held: int = HELD) -> DataFrame:
    """``(id, words, spam, links, tags)`` of every page with words.

    A page is spam where ``spam * 2 > words``. Null keys and null, empty or
    wordless texts give no row; repeated rows stay. Pages of any length are
    read whole. Counts of more than ``held`` words and pairs are joined to the
    pages, fewer are sent to all workers; the results are the same.
    """
    texts = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    pages = materialize(tokens(texts), "tokens")
    counts = materialize(count_corpus(pages), "counts")
    size, *sums = counts.agg(F.count("*"), *(F.sum(F.when(F.col("kind") == k, F.col("n"))) for k in (0, 1))).first()
    total = (sums[0] or 0, sums[1] or 0)
    out = "id long, words long, spam long, links long, tags long"

    def judged(record: pa.RecordBatch, known: Counts) -> pa.RecordBatch:
        found = judge(Batch.read_back(record), known)
        kept = np.flatnonzero(found["words"].to_numpy() > 0)
        part = found.iloc[kept]
        return pa.record_batch([record.column(0).take(pa.array(kept))] + [pa.array(part[c].to_numpy()) for c in part], ["id", *part.columns])

    if size > held:

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in batches:
                flat = record.column(6).flatten()
                kind, code, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                _, at = np.unique(np.stack([kind.astype(np.int64), code]), axis=1, return_index=True)
                yield judged(record, Counts(kind[at], code[at], n[at], total))

        return with_counts(pages, counts).mapInArrow(run_joined, out)

    table = counts.toArrow()  # at most ``held`` rows
    discard(counts)
    known = Counts(*(table.column(c).to_numpy() for c in ("kind", "code", "n")), total)
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            yield judged(record, shared.value)

    return pages.mapInArrow(run, out)
