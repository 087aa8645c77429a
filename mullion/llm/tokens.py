"""Encoding of a corpus with a public tokenizer, and decoding.

Method: pre-tokens of all texts with their positions; each distinct word encoded once over the whole corpus; ids joined
back and put together by position. Words are gathered by block of documents first, with all positions of a word in the
block in one row, which combines repeats before anything is shuffled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mullion.scale import Scratch

#: Documents and characters of a block; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_CHARS = 1024, 4_000_000
#: Pieces of texts whose words a task remembers at a time, and characters of a piece that is worth it.
REMEMBERED, LONGEST = 200_000, 64
#: Words, and characters of words, after which a task begins to number them anew.
NUMBERED, NUMBERED_CHARS = 1_000_000, 50_000_000
#: Words with at least this share of all positions are joined by broadcast; at most 1 / HOT_SHARE words can have it.
HOT_SHARE = 0.001


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Place of a public vocabulary file: the folder given, else that of the installed package."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


@lru_cache(maxsize=1)
def _splitter() -> Callable[[str], list[str]]:
    """The pre-tokens of a text."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


@lru_cache(maxsize=1)
def _cutter() -> Callable[[str], list[str]]:
    """Cuts a text before every blank that a character other than white space follows; the blank itself is left out.

    No pre-token reaches over such a place, whatever stands around it: one that begins with a blank begins there, and
    white space before it is a pre-token that ends there. So pieces have their words by themselves, and as most come
    again and again, few texts need the pattern.
    """
    import regex

    white = "".join(regex.findall(r"\s", "".join(map(chr, range(0xD800)))))
    double, cut = re.compile(f" (?:[{white}]|$)"), re.compile(f" (?=[^{white}])")
    return lambda text: cut.split(text) if double.search(text) else text.split(" ")


class _Remembered(dict):
    """A function's values by piece; long pieces are not kept, and when there are too many all are forgotten."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, piece: str):
        value = self.f(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = value
        return value


class _Coder:
    """Numbers of words, given as they come up, and the numbers of a piece's words."""

    def __init__(self):
        self.split, self.cut = _splitter(), _cutter()
        self.forget()

    def forget(self) -> None:
        self.words, self.code, self.chars = [], {}, 0
        # Pieces after the first begin with the blank that the cut left out.
        self.after = _Remembered(lambda piece: self.coded(" " + piece))

    def coded(self, piece: str) -> list[int]:
        code, out = self.code, []
        for w in self.split(piece):
            c = code.get(w)
            if c is None:
                c = code[w] = len(self.words)
                self.words.append(w)
                self.chars += len(w)
            out.append(c)
        return out


_WORDS = pa.schema([("block", pa.int64()), ("word", pa.string()), ("at", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64()))])


def _block_rows(block: int, ids: list[int], texts: list[str | None], coder: _Coder) -> pa.RecordBatch:
    """One row per distinct word of the block with its positions, and one frame row with the documents' lengths.

    The frame has a null word; its docs are the document ids, its positions the numbers of words of each.
    """
    if len(coder.words) > NUMBERED or coder.chars > NUMBERED_CHARS:
        coder.forget()
    all_codes: list[int] = []
    counts, cut, after = [], coder.cut, coder.after.__getitem__
    for text in texts:
        before = len(all_codes)
        if text:
            first, *rest = cut(text)
            all_codes.extend(coder.coded(first))
            all_codes.extend(chain.from_iterable(map(after, rest)))
        counts.append(len(all_codes) - before)
    codes = np.asarray(all_codes, dtype=np.int32)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    inside = codes[order]
    starts = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)
    words = [coder.words[c] for c in inside[starts].tolist()]
    offsets = np.concatenate((starts, [len(codes), len(codes) + len(ids)])).astype(np.int32)
    at = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate((order, np.asarray(counts, dtype=np.int32)))))
    docs = pa.ListArray.from_arrays(np.concatenate((np.zeros(len(words) + 1), [len(ids)])).astype(np.int32), pa.array(ids, pa.int64()))
    return pa.record_batch([pa.array(np.full(len(words) + 1, block)), pa.array([*words, None], pa.string()), at, docs], schema=_WORDS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder, part = _Coder(), TaskContext.get().partitionId()
    k, ids, texts, chars = 0, [], [], 0

    def number() -> int:
        return (part << 32) | k

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(text or "")
            if ids and (len(ids) >= BLOCK_DOCS or chars + n > BLOCK_CHARS):
                yield _block_rows(number(), ids, texts, coder)
                k, ids, texts, chars = k + 1, [], [], 0
            ids.append(i)
            texts.append(text)
            chars += n
    if ids:
        yield _block_rows(number(), ids, texts, coder)


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], names=["word", "ids", "n"])

    return run


def _reassemble(table: pa.Table) -> pa.Table:
    """The documents of one block from its words' ids and positions."""
    frame = table.filter(pa.compute.is_null(table.column("word"))).combine_chunks()
    words = table.filter(pa.compute.is_valid(table.column("word"))).combine_chunks()
    docs = frame.column("docs").combine_chunks().values if frame.num_rows else pa.array([], pa.int64())
    counts = np.concatenate([np.asarray(x) for x in frame.column("at").to_pylist()]).astype(np.int64)
    total = int(counts.sum())
    ids_col = words.column("ids").combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
    at_col = words.column("at").combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
    ids, id_off = np.asarray(ids_col.flatten()), np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(ids_col), dtype=np.int64))))
    at, n_at = np.asarray(at_col.flatten(), dtype=np.int64), np.asarray(pa.compute.list_value_length(at_col), dtype=np.int64)
    word_at = np.empty(total, dtype=np.int64)
    word_at[at] = np.repeat(np.arange(len(n_at)), n_at)
    lengths = (id_off[1:] - id_off[:-1])[word_at] if total else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    n_ids = int(ends[-1]) if total else 0
    starts = ends - lengths
    take = np.arange(n_ids) + np.repeat(id_off[word_at] - starts, lengths) if total else np.zeros(0, dtype=np.int64)
    word_ends = np.concatenate(([0], np.cumsum(counts)))
    all_ends = np.concatenate(([0], ends))
    offsets = all_ends[word_ends].astype(np.int32)
    return pa.table({"doc_id": docs, "ids": pa.ListArray.from_arrays(offsets, pa.array(ids[take] if total else [], pa.int32()))})


def encode(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, ids array<int>) of every document by the vocabulary at `path`, without special tokens.

    Strings that look like special tokens are ordinary text. A null or an empty text has an empty list. Texts are taken
    whole and exactly as stored. Rows that repeat a doc_id give a row each. Other columns are never read.
    """
    scratch = Scratch(documents.sparkSession)
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = scratch.keep(source.mapInArrow(_blocks, "block long, word string, at array<int>, docs array<long>"), "words")
    distinct = words.where("word is not null").groupBy("word").agg(F.sum(F.size("at")).alias("n"))
    coded, _, total = scratch.keep_counted(distinct.mapInArrow(_encode_words(path), "word string, ids array<int>, n long"), "dictionary", F.sum("n"))
    total = total or 0
    hot = coded.where(F.col("n") >= F.lit(total * HOT_SHARE)).select("word", F.col("ids").alias("hot_ids"))
    marked = words.where("word is not null").join(F.broadcast(hot), "word", "left")
    common = marked.where("hot_ids is not null").select("block", "word", "at", F.col("hot_ids").alias("ids"))
    rare = marked.where("hot_ids is null").select("block", "word", "at").join(coded.where(F.col("n") < F.lit(total * HOT_SHARE)).select("word", "ids"), "word").select("block", "word", "at", "ids")
    none = F.lit(None)
    frames = words.where("word is null").select("block", "word", "at", none.cast("array<int>").alias("ids"), "docs")
    rows = common.unionAll(rare).select("*", none.cast("array<long>").alias("docs")).unionAll(frames)
    return rows.groupBy("block").applyInArrow(_reassemble, "doc_id long, ids array<int>")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Array:
    """The bytes of every token of a byte-level vocabulary by id; no bytes for ids that it lacks."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
    back = {c: b for b, c in letter.items()}
    held = {i: bytes(back[c] for c in t) for t, i in _tokenizer(path).get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
    return pa.array([held.get(i, b"") for i in range(max(held) + 1)], pa.large_binary())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): each batch's ids are looked up in the table of the tokens' bytes.

    The table's size is the vocabulary's, so that nothing is shuffled. An empty list gives an empty text; a null list a
    null. Null ids and ids that the vocabulary lacks give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten()
            known = pa.compute.if_else(pa.compute.and_kleene(pa.compute.greater_equal(ids, 0), pa.compute.less(ids, len(table))), ids, None)
            pieces = pa.compute.fill_null(table.take(known), b"")
            sizes = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.binary_length(pieces), dtype=np.int64))))
            whole = b"".join(pieces.to_pylist())
            ends = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64))))
            places = sizes[ends]
            texts = [whole[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(places, places[1:], lists.is_valid().to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) without a shuffle, for operators that need sizes only; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, split, cut = _tokenizer(path), _splitter(), _cutter()
        size = _Remembered(lambda word: len(tok.encode(word, add_special_tokens=False).ids))
        first = lambda piece: sum(map(size.__getitem__, split(piece)))
        after = _Remembered(lambda piece: first(" " + piece))
        for batch in batches:
            counts = []
            for x in batch.column(1).to_pylist():
                head, *rest = cut(x or "")
                counts.append(first(head) + sum(map(after.__getitem__, rest)))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
