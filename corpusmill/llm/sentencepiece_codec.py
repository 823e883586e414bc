"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of the vocabulary has a whitespace mark behind another character, merges never cross the place between a
word and the mark that follows it. Each distinct marked word is then segmented once per task and its ids are joined back
by position; that equals encoding the whole text. A vocabulary with such pieces is encoded text by text.

Edge cases: a null text counts as empty and has no ids; an empty list and null decode to ''. Rows are neither dropped nor
merged, so repeated rows and an empty table pass through. Only the columns named by the caller are read and returned; a kept
column that is named like a result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunk_table import ChunkTable, chunk_bounds, flat
from .common import row_slices
from .words import SLICE_CHARS, text_bytes

MARK = "▁"


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The marked words of many texts, each without its first mark, as ChunkTable.encode() takes them. The library puts a
    mark before a text, so that encoding a chunk alone gives it that mark back. Of marks in a row the first parts words."""
    data, bounds = text_bytes(pc.replace_substring(pc.fill_null(texts, ""), MARK, " "))
    space = data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = False
    return data, *chunk_bounds(bounds, np.flatnonzero(cut))


def splits_at_marks(processor) -> bool:
    """Whether no piece has a mark right behind another character, so that words are segmented independently."""
    pieces = map(processor.id_to_piece, range(processor.vocab_size()))
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def _load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", max_chunks: int = 200_000) -> DataFrame:
    """The columns ``keep`` and the token ids of each text, an array of int, without begin and end ids.

    ``model`` is the path of a SentencePiece model on every worker; ``max_chunks`` bounds a task's table.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c != ids)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _load(model)
        lone = [processor.piece_to_id(MARK)]
        by_chunk = splits_at_marks(processor)

        def encode_many(chunks: pa.Array, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            chunks = chunks.to_pylist()
            out = processor.encode(chunks, num_threads=1)
            return flat([lone if not c else i for c, i in zip(chunks, out)])  # '' stands for a mark at the end of a text

        def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            data, bounds = text_bytes(texts)
            return data, *chunk_bounds(bounds, np.empty(0, np.int64))

        table = ChunkTable(encode_many, max_chunks if by_chunk else 1)
        for cut in row_slices(batches, text, SLICE_CHARS):
            values, lengths = table.encode(*(chunks_of if by_chunk else whole)(cut.column(text)))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in keep), pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))], names=[*keep, ids])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids"), text: str = "decoded") -> DataFrame:
    """The columns ``keep`` and the text that the library decodes from each row's ids."""
    keep = tuple(c for c in dict.fromkeys(keep) if c != text)
    schema = T.StructType([*(tokens.schema[c] for c in keep), T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _load(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                cut = batch.slice(start, 256)
                out = [processor.decode(x) if x else "" for x in cut.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, text])

    return tokens.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
