"""Token counts: batch encoding that returns lengths only.

Texts are cut at safe boundaries (see chunks), gathered to batches balanced by bytes, and
the distinct chunks of a batch that the worker has not met yet go to the tokenizers library
in one call. Nothing but the lengths is kept. There is no shuffle.

Special strings inside a text count as the library's default has them (one token each).
A null text is empty, an empty text has no tokens. Rows are independent of each other:
repeated rows give repeated results, null ids stay null, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import small_batches, worker_cache

BATCH_BYTES = 1 << 20


def _lengths(path: str) -> tuple[chunks.ChunkTable, chunks.ChunkTable]:
    """Of chunks at the start of a text, and of chunks after a space; kept in the worker."""
    tables = worker_cache("token_counts")
    if path not in tables:
        model = chunks.byte_tokenizer(path)
        count = lambda xs: [len(e) for e in model.encode_batch_fast(xs, add_special_tokens=False)]
        tables[path] = chunks.ChunkTable(count), chunks.ChunkTable(lambda xs: count([" " + x for x in xs]))
    return tables[path]


def balanced(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` bytes; one long text is a run."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x) if x.isascii() else len(x.encode("utf-8", "replace"))
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_lengths(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text."""
    first_table, rest_table = _lengths(path)
    out: list[int] = []
    for run in balanced(texts):
        parts = [chunks.space_chunks(x) for x in run]
        firsts = first_table.fill([[first for first, _ in parts]])
        rests = rest_table.fill([rest for _, rest in parts])
        out += [firsts[first] + sum(map(rests.__getitem__, rest)) for first, rest in parts]
    return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row.

    tokenizer: the file name of a public tokenizer, found again on each executor.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = public_tokenizers.path(tokenizer)
        for batch in batches:
            found = [x or "" for x in batch.column(1).to_pylist()]
            counts = token_lengths(found, path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in found], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                [id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{id_column} long, n_bytes long, n_tokens long, over_limit boolean")
