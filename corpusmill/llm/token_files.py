"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending doc_id order, each in a zstandard frame of its own, followed by an index frame and a
seek table, a skippable frame as in zstandard's public seekable format:

    frame of document 1 ... frame of document n | index frame | seek table

- A document's frame holds its ids as little-endian unsigned 32-bit integers.
- The index frame holds n doc_ids and n token counts, as little-endian signed 64-bit integers.
- The seek table has, for each frame, compressed size, decompressed size and checksum (the low 32 bits of the XXH64 of the
  decompressed data), each an unsigned 32-bit integer, and ends with the frame count, a descriptor byte and a magic number.

A reader takes the seek table and index from the file's end and then decompresses only the frames of wanted documents,
whose checksums it compares. Files are in doc_id order too; how many ids stand before a file is in the manifest.

Edge cases: a null or empty text has the end id alone. Rows with the same doc_id are each written, in the order of their
texts' hashes; a null doc_id sorts first and is stored as the smallest 64-bit integer, which is read back as null. An empty
table makes no file. Other columns aren't read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_table import ChunkTable, chunk_bounds, flat, runs, strings
from .common import checkpoint, partitions, row_slices, scratch
from .files import new_file, open_input
from .words import SLICE_CHARS, text_bytes

END_ID, LEVEL = 0, 3
NO_ID = -(1 << 63)
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY = struct.Struct("<III")
#: White space beyond ASCII behind a space: such texts take the whole way.
_FAR_SPACE = " [" + "".join(chr(c) for c in range(128, 0x3001) if chr(c).isspace()) + "]"
#: Bytes before which no text is cut at a space.
_NO_CUT = np.array([chr(b).isspace() and b < 128 for b in range(256)])


def chunks_of(texts: pa.Array, whole: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of many texts that a byte-level vocabulary with the usual pre-token pattern encodes independently, as
    ChunkTable.encode() takes them: each but a text's first starts with the space before a word, which is left out here: such a
    space starts a pre-token, whatever stands before it. Texts that hold any of ``whole`` are one piece each."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _FAR_SPACE).to_numpy(zero_copy_only=False)
    for w in whole:
        odd = odd | pc.match_substring(texts, w).to_numpy(zero_copy_only=False)
    data, bounds = text_bytes(texts)
    cut = data == 32
    cut[:-1] &= ~_NO_CUT[data[1:]]
    full = bounds[1:] > bounds[:-1]
    cut[bounds[:-1][full]] = False
    cut[bounds[1:][full] - 1] = False
    cuts = np.flatnonzero(cut)
    if odd.any():
        cuts = cuts[~odd[np.searchsorted(bounds, cuts, "right") - 1]]
    return data, *chunk_bounds(bounds, cuts)


#: Marks that may stand behind a letter run as a pre-token of their own.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


#: The letter that stands for a space.
_SPACE_LETTER = "\u0120"


def _byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary names bytes: printable ones stand for themselves, others follow."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkEncoder:
    """Encodes chunks with the library. A letter run behind a space, and the marks behind it, are pre-tokens: runs go to a
    tokenizer of the same model that parts them at spaces alone, which saves the bookkeeping of the library's pattern; other
    chunks take the whole way."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.plain = Tokenizer.from_file(tokenizer), Tokenizer.from_file(tokenizer)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.plain.encode_special_tokens = True  # it sees words alone
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for piece, k in vocabulary.items():
            self.begins[k] = piece[:1] == _SPACE_LETTER
        self.letters, self.marks = _byte_letters(), {}
        probe, none = pa.array(["don", "\u00e9t\u00e9,", "a)", "Wort-", "x--", "\u00ffz"], pa.large_string()), np.zeros(6, bool)
        self.direct = False
        want = [x.tolist() for x in self(probe, none)]
        self.direct = True  # a vocabulary of another kind takes the whole way
        self.direct = [x.tolist() for x in self(probe, none)] == want

    def _whole(self, chunks: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.library.encode_batch_fast([c if f else f" {c}" for c, f in zip(chunks, first)], add_special_tokens=False)])

    def _words(self, words: pa.Array, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The ids of letter runs behind a space, and how many each has."""
        ascii_only = pc.string_is_ascii(words).to_numpy(zero_copy_only=False).tolist()
        named = [w if a else w.encode().decode("latin-1").translate(self.letters) for w, a in zip(words.to_pylist(), ascii_only)]
        blocks = [" ".join(_SPACE_LETTER + w for w in named[k : k + block]) for k in range(0, len(named), block)]
        out = self.plain.encode_batch_fast(blocks, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in out]) if out else np.empty(0, np.int32)
        return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))

    def __call__(self, chunks: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one chunk's after another, and how many each has."""
        word = pc.utf8_rtrim(chunks, _MARKS)
        plain = np.zeros(len(chunks), bool)
        if self.direct:
            plain = pc.and_(pc.utf8_is_alpha(word), pc.match_substring_regex(word, r"^[\x00-\x{24F}]+$")).to_numpy(zero_copy_only=False) & ~first
        begin, length = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)  # of a word's ids and its marks'
        ids = np.empty(0, np.int32)
        if plain.any():
            mine = pa.array(plain)
            coded = word.filter(mine).dictionary_encode()
            ids, lengths = self._words(coded.dictionary)
            at = coded.indices.to_numpy(zero_copy_only=False)
            begin[plain, 0], length[plain, 0] = (np.cumsum(lengths) - lengths)[at], lengths[at]
            data, bounds = text_bytes(chunks.filter(mine))
            size = np.diff(text_bytes(word.filter(mine))[1])
            tails = strings(data, bounds[:-1] + size, np.diff(bounds) - size).dictionary_encode()
            some = tails.dictionary.to_pylist()
            if len(self.marks) > 100_000:
                self.marks.clear()
            for t in some:
                if t not in self.marks:
                    self.marks[t] = [x.id for x in self.library.model.tokenize(t)] if t else []
            more, lengths = flat([self.marks[t] for t in some])
            at = tails.indices.to_numpy(zero_copy_only=False)
            begin[plain, 1], length[plain, 1] = len(ids) + (np.cumsum(lengths) - lengths)[at], lengths[at]
            ids = np.concatenate([ids, more])
        if not plain.all():
            more, lengths = self._whole(chunks.filter(pa.array(~plain)).to_pylist(), first[~plain])
            begin[~plain, 0], length[~plain, 0] = len(ids) + np.cumsum(lengths) - lengths, lengths
            ids = np.concatenate([ids, more])
        return ids[runs(begin.ravel(), length.ravel())], length.sum(1)


#: A worker's tables, which stay for its later tasks.
_TABLES: dict[tuple[str, int], ChunkTable] = {}


def _table(tokenizer: str, max_chunks: int) -> ChunkTable:
    if (tokenizer, max_chunks) not in _TABLES:
        _TABLES[tokenizer, max_chunks] = ChunkTable(ChunkEncoder(tokenizer), max_chunks)
    return _TABLES[tokenizer, max_chunks]


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file; documents are added in ascending doc_id order."""

    def __init__(self, stream, level: int = LEVEL):
        import zstandard

        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=level).compress
        self.entries: list[bytes] = []
        self.doc_ids: list[int] = []
        self.counts: list[int] = []

    def _frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.stream.write(packed)
        self.entries.append(ENTRY.pack(len(packed), len(data), _checksum(data)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.astype("<u4").tobytes())
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))

    def finish(self) -> None:
        self._frame(np.array([*self.doc_ids, *self.counts], "<i8").tobytes())
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Reads one file from its end; documents are decompressed one by one."""

    def __init__(self, file):
        import zstandard

        self.file, self.decompress = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a token file: no seek table at its end")
        file.seek(size - 9 - n * ENTRY.size)
        self.entries = np.frombuffer(file.read(n * ENTRY.size), "<u4").reshape(-1, 3)
        self.places = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        index = np.frombuffer(self.frame(n - 1), "<i8")
        self.doc_ids, self.counts = index[: n - 1], index[n - 1 :]
        self.starts = np.cumsum(self.counts) - self.counts

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.places[k]))
        data = self.decompress(self.file.read(int(self.entries[k, 0])), max_output_size=int(self.entries[k, 1]))
        if _checksum(data) != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged: its checksum differs")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, int, bytes]]:
        """(doc_id, ids before it in the file, number of ids, ids) of all or of the wanted documents."""
        at = range(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted))).tolist()
        for k in at:
            i = int(self.doc_ids[k])
            yield None if i == NO_ID else i, int(self.starts[k]), int(self.counts[k]), self.frame(k)


MANIFEST = "part int, file string, documents long, tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int | None = END_ID, files: int | None = None, level: int = LEVEL, max_chunks: int = 700_000) -> DataFrame:
    """Encode texts, write them to files in ``folder``, and return the manifest: part, file, documents, tokens and start,
    the number of ids in all files before it. ``tokenizer`` is the path of a tokenizers JSON file on every worker."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(files or partitions(spark), "doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        table = _table(tokenizer, max_chunks)
        part = TaskContext.get().partitionId()
        writer = None
        added, slices = table.encode_many.added, row_slices(batches, "text", SLICE_CHARS)
        first = next(slices, None)
        if first is None:
            return
        with new_file(folder, f"part-{part:06d}", ".ids.zst") as (path, stream):
            writer = FrameWriter(stream, level)
            for cut in (x for xs in ((first,), slices) for x in xs):
                ids, lengths = table.encode(*chunks_of(cut.column("text"), added), first=True)
                ends = np.cumsum(lengths)
                for i, a, b in zip(cut.column("doc").to_pylist(), ends - lengths, ends):
                    own = ids[a:b]
                    writer.add(i, own if end_id is None else np.append(own, end_id))
            writer.finish()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [path], "documents": [len(writer.counts)], "tokens": [sum(writer.counts)]})

    written = checkpoint(dealt.mapInArrow(run, MANIFEST))
    start, out = 0, []
    for r in written.orderBy("part").collect():  # one row for each file
        out.append((r.part, r.file, r.documents, r.tokens, start))
        start += r.tokens
    return spark.createDataFrame(out, f"{MANIFEST}, start long")


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the manifest's files, or of the wanted ones: start counts the ids
    of all documents before, ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with open_input(path) as file:
                    held, size = [], 0
                    for i, before, n, ids in FrameReader(file).documents(wanted):
                        held.append((i, start + before, n, ids))
                        size += len(ids)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    dealt = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, **options))
