"""Operator 5: byte-level BPE encoding and decoding by a sentencepiece model.

The rank file of a byte-level vocabulary is serialised straight into a
sentencepiece BPE model: each piece is the byte string with every byte mapped
to one printable character, its score is its negative rank, and normalisation
is the identity.  Sentencepiece merges the adjacent pair whose union scores
highest, leftmost first, which is the order of rank merges.  A text is cut into
pre-tokens by the vocabulary's pattern and each distinct pre-token of a batch is
encoded once; a pre-token that is itself a piece keeps that id, as rank
encoders do.  Decoding is the inverse mapping of ids to bytes.

Defined results: a null text is an empty text; an empty text has no ids and
decodes to no bytes; bytes that are not UTF-8 are read as U+FFFD; other columns
are untouched and may have any name but ``ids`` and ``decoded``.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.shared import arrow_map, table

#: Distinct space-led chunks remembered by a Python worker before it forgets all.
CACHE_CHUNKS = 400_000
#: Texts are handed to Arrow in slices of about this many characters.
SLICE_CHARS = 4_000_000
_MARKS = frozenset(".,;:!?")
_INT = struct.Struct("<i")


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it prints, else U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto, written field by field in protobuf's wire format.

    pieces = 1 {piece = 1, score = 2, type = 3}, trainer_spec = 2 {model_type = 3},
    normalizer_spec = 3 {name = 1, add_dummy_prefix = 3, remove_extra_whitespaces = 4,
    escape_whitespaces = 5}.  Piece ids are ranks; the unknown piece comes last.
    """
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for piece, rank in by_rank:
        text = "".join(chars[b] for b in piece).encode()
        out += _field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + b"\x18\x01")
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")
    out += _field(2, b"\x18\x02")
    out += _field(3, _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00")
    return bytes(out)


class Codec:
    """Encodes and decodes on one Python worker; built once and kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.map = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.chunks: dict[str, list[int]] = {}
        self.odd_space = re.compile(r" [\s\x85\x1c-\x1f]| \Z")

    def _pieces(self, pre_tokens: set[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, as little-endian 32-bit integers."""
        known, rest, mapped = {}, [], []
        for t in pre_tokens:
            raw = t.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is None:
                rest.append(t)
                mapped.append(raw.decode("latin-1").translate(self.map))
            else:
                known[t] = _INT.pack(rank)
        for t, ids in zip(rest, self.model.encode(mapped, num_threads=1) if rest else ()):
            known[t] = struct.pack(f"<{len(ids)}i", *ids)
        return known

    def _pre_tokens(self, chunk: str) -> list[str]:
        """The pattern's matches.  A word of Latin letters, with a space before it
        or one mark behind it, needs no search: letters are one match and the mark
        another."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha() and max(body) < "\u0250":
            return [chunk]
        if body[-1:] in _MARKS and (word := body[:-1]).isalpha() and max(word) < "\u0250":
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _cut(self, text: str) -> list[str]:
        """Chunks whose pre-tokens are those of the text: before each space that a
        visible character follows, no pre-token goes on.  Else the text itself."""
        if self.odd_space.search(text):
            return [text]
        if not text.startswith(" "):
            head, _, text = text.partition(" ")
            return [head, *[" " + x for x in text.split(" ")]] if text else [head]
        return [" " + x for x in text[1:].split(" ")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit integers.  The model is called once for
        all pre-tokens that are not remembered."""
        cuts = [self._cut(t) for t in texts]
        cuts = [cut if len(cut) > 1 else self.pattern.findall(t) for cut, t in zip(cuts, texts)]
        every = set().union(*cuts)
        if len(self.chunks) + len(every) > CACHE_CHUNKS and len(self.chunks.keys() | every) > CACHE_CHUNKS:
            self.chunks = {}
        new = {c: self._pre_tokens(c) for c in every.difference(self.chunks)}
        ids = self._pieces({t for ts in new.values() for t in ts})
        known = self.chunks
        for c, ts in new.items():
            known[c] = ids[ts[0]] if len(ts) == 1 else b"".join([ids[t] for t in ts])
        return [np.frombuffer(b"".join(map(known.__getitem__, cut)), dtype="<i4") for cut in cuts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, which every executor can read by its path."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows of about SLICE_CHARS characters, so that memory is bounded by it and the longest text."""
    column = batch.column(batch.schema.get_field_index(text))
    start, rows, size = 0, [], 0
    for k in range(len(column)):
        rows.append(x := column[k].as_py())
        size += len(x or "")
        if size >= SLICE_CHARS:
            yield batch.slice(start, k + 1 - start), rows
            start, rows, size = k + 1, [], 0
    if rows:
        yield batch.slice(start), rows


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) of every whole text and, if asked, the
    bytes ``decoded`` from those ids.  A narrow step: no shuffle, any key skew."""
    names = [c for c in df.columns if c != text]
    out = T.StructType([f for f in df.schema if f.name != text] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] + [T.StructField("decoded", T.BinaryType(), False)] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part, rows in _slices(batch, "_text"):
                ids = own.encode([(x or b"").decode("utf-8", "replace") for x in rows])
                columns = [part.column(part.schema.get_field_index(f"c{k}")) for k in range(len(names))]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])
        own.chunks = {}  # a worker that waits for its next task holds no memory for this one

    plain = df.select(F.col(f"`{text}`").cast("binary").alias("_text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    return arrow_map(plain, run, out)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with the bytes ``decoded`` from an array of ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            coded = batch.column(batch.schema.get_field_index(ids))
            yield batch.append_column("decoded", pa.array([own.decode(np.array(x.as_py() or [], dtype=np.int32)) for x in coded], pa.binary()))

    return arrow_map(df, run, T.StructType([*df.schema, T.StructField("decoded", T.BinaryType(), False)]))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decode=True))
