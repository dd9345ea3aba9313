"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary crosses from a word into the whitespace marker of the next
(checked when the model is loaded), so each distinct marked word is segmented once in a
worker, and the ids of a text are those of its words joined back by position. Decoding is
the library's own decode(ids) over all ids of a text. There is no shuffle: the table is
kept by each Python worker, bounded, since the distinct words of a corpus are not.

A null text is empty; an empty text has the begin and end ids alone. Repeated rows give
repeated results, null ids stay null, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import small_batches, worker_cache
from .token_counts import balanced



class PieceCodec:
    def __init__(self, path: str) -> None:
        self.model = chunks.piece_processor(path)
        # encode("") has no marker, so what stands for a marker alone is found behind a word
        self.marker = self.model.encode("a ")[len(self.model.encode("a")) :]
        self.table = chunks.ChunkTable(self._segment)
        self.begin, self.end = (np.array([x], "<u4").tobytes() for x in (self.model.bos_id(), self.model.eos_id()))

    def _segment(self, words: list[str]) -> list[bytes]:
        return [np.array(ids if word else self.marker, "<u4").tobytes() for word, ids in zip(words, self.model.encode(words, num_threads=1), strict=True)]

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        codecs = worker_cache("piece_codec")
        if path not in codecs:
            codecs[path] = cls(path)
        return codecs[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for run in balanced(texts):
            parts = [chunks.marked_chunks(x) if x else None for x in run]
            ids = self.table.fill([x for x in parts if x])
            out += [self.begin + (b"".join(map(ids.__getitem__, x)) if x else b"") + self.end for x in parts]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return [self.model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


def _codec(model: str) -> PieceCodec:
    import public_tokenizers

    return PieceCodec.of(public_tokenizers.path(model))


def encode_pieces(docs: DataFrame, model: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit, with begin and end)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.encode([x or "" for x in batch.column(1).to_pylist()]), pa.binary())], [id_column, "ids"])

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{id_column} long, ids binary")


def decode_pieces(encoded: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """id, ids and the text that the library decodes from them."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codec.decode(batch.column(1).to_pylist()), pa.string())], [id_column, "ids", "decoded"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"{id_column} long, ids binary, decoded string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    decoded = decode_pieces(encode_pieces(docs, model), model)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
