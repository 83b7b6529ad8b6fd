"""Problem 7: encoding of a whole corpus with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.session import spread

#: Fixed value: the published pattern that splits text before the merges of the byte-BPE rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Between the two characters no piece of PATTERN can reach across: a single space between visible
#: characters, or the end of a run of letters or of digits.
_BOUNDARY = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?= [\p{L}\p{N}\p{P}\p{S}])|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])")
SPLIT_AT, BATCH_CHARS = 50_000, 1 << 21

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a rank file's bytes, built once per process."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding(key[:12], pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def split_safely(text: str, at: int = SPLIT_AT) -> list[str]:
    """Pieces of about `at` characters whose encodings joined are the text's; a stretch without a
    safe boundary stays whole."""
    pieces, start = [], 0
    while len(text) - start > at:
        found = _BOUNDARY.search(text, start + at)
        if not found:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    return [*pieces, text[start:]]


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    """The ids of a text without special tokens; none for empty and null."""
    if not text:
        return []
    if len(text) <= SPLIT_AT:
        return enc.encode_ordinary(text)
    return [i for piece in split_safely(text) for i in enc.encode_ordinary(piece)]


def decode_bytes(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The exact bytes that the ids stand for, also where a cut leaves half a character."""
    return enc.decode_bytes(ids)


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str | None]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        ids.append(i)
        texts.append(t)
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def token_ids(docs: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row.

    Empty and null texts give an empty list; a null doc_id keeps its row; repeated rows repeat.
    Very long texts are encoded whole, in pieces cut at safe boundaries. The rank file (below
    1 MB) is read on the driver and broadcast. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for batch in batches:
            for ids, texts in _batches(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([encode(enc, t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, n_chars) of every row; 0 for empty and null texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for batch in batches:
            sources, at = batch.column("source"), 0
            for ids, texts in _batches(batch):
                counts = [len(encode(enc, t)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), sources.slice(at, len(ids)), pa.array(counts, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "source", "n_tokens", "n_chars"])
                at += len(ids)

    return spread(docs.select("doc_id", "text", "source")).mapInArrow(run, "doc_id long, source string, n_tokens long, n_chars long")


def decoded(ids: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """(doc_id, raw binary): the bytes of each id list, the way back."""
    shared = ids.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for batch in batches:
            raw = [None if x is None else decode_bytes(enc, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def length_report(docs: DataFrame) -> DataFrame:
    """Per source: documents, tokens, tokens per character and the longest, over all rows, counted in one pass; repeated
    rows and rows without an id count too."""
    counts = token_counts(docs)
    return counts.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"), F.try_divide(F.sum("n_tokens"), F.sum("n_chars")).alias("tokens_per_char"))
