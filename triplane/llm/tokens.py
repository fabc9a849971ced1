"""Encoding of a corpus with a public byte-level BPE vocabulary.

The vocabulary (ranks of byte strings) is serialised directly as a sentencepiece BPE model: every
piece is the byte string with each byte mapped to one printable character, its score is the negative
rank, and the normaliser is the identity. A pre-token is encoded by that model; ids are decoded by
the inverse mapping. Merging by the best score is merging by the lowest rank, so the ids are those of
the vocabulary's own tokenizer.

A text is split once by the vocabulary's pre-token pattern; each worker remembers the ids of the
words and pre-tokens it has met, so the model runs once for a distinct pre-token and worker.
"""

from __future__ import annotations

import base64
import os
import struct
from array import array
from collections.abc import Iterator
from hashlib import blake2b
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..runtime import table

#: Where the vocabulary files are; a parameter of every function here.
TOKENIZERS = os.environ.get("TRIPLANE_TOKENIZERS", "/opt/tokenizers")
#: The characters of the Unicode property White_Space, and the public pre-token pattern of this vocabulary over given classes.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"
#: Pre-tokens, and words, a worker remembers before it starts anew (memory bound only; the ids don't depend on it).
REMEMBERED = 400_000
#: Longer words are encoded anew each time instead of being remembered.
LONGEST_REMEMBERED = 64
#: Rows encoded together.
SLICE = 500
ID_SCHEMA = T.ArrayType(T.IntegerType(), False)


def byte_alphabet() -> list[str]:
    """One printable character for each byte: bytes that print stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in alphabet:
            alphabet[b] = chr(spare)
            spare += 1
    return [alphabet[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a base64 byte string and its rank on each line."""
    return ranks_of(Path(path).read_bytes())


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protocol-buffer field: varint, length-delimited or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a rank vocabulary; the free id after the last rank is the unknown piece."""
    alphabet = byte_alphabet()
    pieces = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must run from 0 without gaps")
    out = [
        _field(1, _field(1, "".join(alphabet[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1))
        for rank, piece in enumerate(pieces)
    ]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    trainer += _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, b"<unk>")
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Texts to ids and back; made once in each worker process.

    No pre-token holds a space but as its first character, unless it is white space only. So a text
    without white space on both sides of a space is the concatenation of its words, each with the
    space before it, and a word's ids don't depend on its neighbours: they are remembered by word.
    Any other text is split by the pattern as a whole. Ids are kept as packed int32.
    """

    def __init__(self, vocabulary: bytes):
        import re

        import regex
        import sentencepiece

        ranks = ranks_of(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        classes = {"{L}": r"\p{L}", "{N}": r"\p{N}", "{W}": WHITE}, {"{L}": "A-Za-z", "{N}": "0-9", "{W}": r"\t-\r "}
        any_text, ascii_text = (re.sub(r"\{[LNW]\}", lambda m: c[m[0]], PATTERN) for c in classes)
        split_any, split_ascii = regex.compile(any_text).findall, re.compile(ascii_text).findall
        self.split = lambda text: split_ascii(text) if text.isascii() else split_any(text)
        self.entangled = re.compile(r"\s \s| \Z").search
        self.map = dict(enumerate(byte_alphabet()))
        self.pieces = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def mapped(self, token: str) -> str:
        # A lone surrogate can't be UTF-8; it becomes a question mark.
        return token.encode("utf-8", "replace").decode("latin-1").translate(self.map)

    def _learn(self, tokens: set[str]) -> None:
        new = list(tokens.difference(self.known))
        for token, ids in zip(new, self.model.encode([self.mapped(t) for t in new], num_threads=1)) if new else ():
            self.known[token] = array("i", ids).tobytes()

    def _forget(self, memory: dict[str, bytes]) -> None:
        if len(memory) > REMEMBERED:
            memory.clear()

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed as int32; none for an empty and for a null text."""
        self._forget(self.known)
        self._forget(self.words)
        whole: dict[int, list[str]] = {}
        apart: dict[int, list[str]] = {}
        for at, text in enumerate(texts):
            if text and self.entangled(text):
                whole[at] = self.split(text)
            elif text:
                apart[at] = text.split(" ")
        words = set().union(*(x[1:] for x in apart.values())).difference(self.words)
        split_words = {word: self.split(" " + word) for word in words}
        first = {at: self.split(x[0]) for at, x in apart.items()}
        self._learn(set().union(*whole.values(), *split_words.values(), *first.values()))
        ids, join = self.known.__getitem__, b"".join
        for word, tokens in split_words.items():
            self.words[word] = join(map(ids, tokens))
        word_ids, out = self.words.__getitem__, [b""] * len(texts)
        for at, tokens in whole.items():
            out[at] = join(map(ids, tokens))
        for at, x in apart.items():
            out[at] = join(map(ids, first[at])) + join(map(word_ids, x[1:]))
        for word in split_words:
            if len(word) > LONGEST_REMEMBERED:
                del self.words[word]
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.encode_packed([text])[0]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the inverse byte mapping."""
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(name: str, vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary, made once in each worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


def encoder(path: str) -> Encoder:
    return worker_encoder(path, Path(path).read_bytes())


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>) for every row of `documents`, in one pass without a shuffle.

    The vocabulary file, about a megabyte, is read on the driver and broadcast: executors need no copy of it.
    Null and empty texts have the empty list, repeated rows give repeated rows, an empty table an
    empty result; other columns are not read. Null keys stay null.
    """
    import pyarrow as pa

    raw = Path(vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken").read_bytes()
    shared, name = documents.sparkSession.sparkContext.broadcast(raw), blake2b(raw, digest_size=16).hexdigest()
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("ids", ID_SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = worker_encoder(name, shared.value).encode_packed
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                packed = encode(part.column(1).to_pylist())
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
                values = np.frombuffer(b"".join(packed), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    return documents.select(key, text).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode_corpus(table(spark, directory, "documents"))


def p6_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens, characters and documents of each source: what a training mix is planned with."""
    from pyspark.sql import functions as F

    documents = table(spark, directory, "documents")
    ids = encode_corpus(documents.select(F.struct("source", "n_chars").alias("about"), "text"), "about")
    return ids.groupBy(F.col("about.source").alias("source")).agg(
        F.count("*").alias("n_documents"),
        F.sum(F.size("ids")).alias("n_tokens"),
        F.coalesce(F.sum("about.n_chars"), F.lit(0)).alias("n_chars"),
    )


QUERIES = {"p6_ids": p6_ids, "p6_sizes": p6_sizes}
ORACLE_SQL: dict[str, str] = {}
