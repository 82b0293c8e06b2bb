"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of a range of documents one after the other, in 16 bits if the vocabulary allows,
else in 32; where the documents end, as an Elias-Fano sequence; and the document ids as another.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from boxoffice.functions.scale import materialize, shared_dir
from boxoffice.llm.batches import small_batches
from boxoffice.llm.elias_fano import EliasFano
from boxoffice.llm.files import Reader, Writer, unique_name
from boxoffice.llm.textkit import Memo, fingerprints, first_of_each, slices, text_bytes
from boxoffice.llm.token_fst import Splitter, byte_of_char

READ_IDS = 1 << 20
CHAR_OF_BYTE = np.zeros(256, "<u2")
for _char, _byte in byte_of_char().items():
    CHAR_OF_BYTE[_byte] = ord(_char)


class Encoder:
    """The library's ids of texts. Pieces are independent of each other, so each is encoded once and
    kept, until ``max_pieces`` are and the table starts anew."""

    def __init__(self, path: str, max_pieces: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.splitter, self.max_pieces = Tokenizer.from_file(path), Splitter(path), max_pieces
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.pool, self.used = Memo(), np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        if self.splitter.added:
            data, offsets = text_bytes(pa.array(self.splitter.added))
            ids = [[self.library.token_to_id(token.decode())] for token in self.splitter.added]
            self._keep(fingerprints(data, offsets[:-1], offsets[1:]), ids)

    def _keep(self, prints: np.ndarray, found: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for piece in found for i in piece), np.uint32, int(lengths.sum()))
        first = self.pieces.size
        while first + len(found) > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[first : first + len(found)] = lengths
        self.begin[first : first + len(found)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.pieces.add(prints, np.arange(first, first + len(found)))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end_id``, and the number of each."""
        if self.pieces.size > self.max_pieces:
            self._reset()
        starts, ends, at = self.splitter.pieces(data, offsets)
        prints = fingerprints(data, starts, ends)
        piece = self.pieces.find(prints)
        missing = np.flatnonzero(piece < 0)
        if len(missing):
            new, place = first_of_each(prints[missing])
            where = missing[place]
            # The model reads bytes as the characters that stand for them.
            chars, model = CHAR_OF_BYTE[data].tobytes().decode("utf-16-le"), self.library.model
            spans = zip(starts[where].tolist(), ends[where].tolist(), strict=True)
            self._keep(new, [[token.id for token in model.tokenize(chars[a:b])] for a, b in spans])
            piece[missing] = self.pieces.find(prints[missing])
        length = self.length[piece].astype(np.int64)
        upto = np.append(0, np.cumsum(length))
        ids = self.pool[np.arange(upto[-1]) + np.repeat(self.begin[piece] - upto[:-1], length)]
        return np.insert(ids, upto[at[1:]], end_id), upto[at[1:]] - upto[at[:-1]] + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of whole texts, each closed by ``end_id``, in ascending order of ``id_col``, and
    return the manifest: one row per file with path, first_id (null: a document without id comes
    first), n_docs and n_ids.

    Ids may be negative or null (null first); equal ids stay together, ordered by text. A null text
    counts as empty and gives the end id alone. An empty table gives no file. Other columns are
    ignored. A task keeps the lengths and ids of the documents of one file, and one slice of text.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, lengths, names, nulls = None, [], [], 0
        for part in slices(batches, "text"):
            if not part.num_rows:
                continue
            coder = encoder(tokenizer)
            if writer is None:
                kind = np.uint16 if max(coder.vocabulary - 1, end_id) < 1 << 16 else np.uint32
                writer = Writer(unique_name(folder, "tokens"))
                writer.begin("ids", kind)
            ids, counts = coder.encode(*text_bytes(part.column(1)), end_id)
            writer.append(ids.astype(kind))
            lengths.append(counts)
            nulls += part.column(0).null_count
            names.append(part.column(0).drop_null().to_numpy())
        if writer is None:
            return
        writer.end()
        ends, ids = np.cumsum(np.concatenate(lengths)), np.concatenate(names)
        first = int(ids[0]) if len(ids) else 0
        writer.add_parts("ends", EliasFano(ends).parts())
        # Differences of 64-bit ids fit into an unsigned 64-bit integer.
        writer.add_parts("names", EliasFano(ids.astype(np.uint64) - np.uint64(first % (1 << 64))).parts())
        writer.close(n_docs=len(ends), n_ids=int(ends[-1]), nulls=nulls, first=first)
        row = [[writer.path], [None if nulls else first], [len(ends)], [int(ends[-1])]]
        yield pa.record_batch([pa.array(row[0]), *(pa.array(x, pa.int64()) for x in row[1:])], names=["path", "first_id", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    manifest = ordered.mapInArrow(write, "path string, first_id long, n_docs long, n_ids long")
    with small_batches(docs.sparkSession):
        return materialize(manifest, "token-manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the files of a manifest: per document ``id_col``, start (ids of all documents before it),
    n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers). The manifest, a row
    per file, is read by the driver to order the files."""
    spark = manifest.sparkSession
    files = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.path))
    start, plan = 0, []
    for file in files:
        plan.append((file.path, start))
        start += file.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                ends = EliasFano.of(file.parts("ends"))
                names = EliasFano.of(file.parts("names"))
                nulls, first = file.meta["nulls"], np.uint64(file.meta["first"] % (1 << 64))
                at = begin = 0
                while at < ends.n:
                    # As many documents as fit in a block, or one longer one.
                    to = max(at + 1, int(ends.successor(np.array([begin + READ_IDS]))[0]))
                    stops = ends.get(np.arange(at, to)).astype(np.int64)
                    starts = np.append(begin, stops[:-1])
                    raw = memoryview(file.get("ids", begin, int(stops[-1])).astype("<u4")).cast("B")
                    crcs = [zlib.crc32(raw[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                    own = np.arange(max(at, nulls), to) - nulls
                    ids = pa.array([None] * (to - at - len(own)) + (names.get(own) + first).astype(np.int64).tolist(), pa.int64())
                    rest = [starts + base, stops - starts, np.array(crcs, np.int64)]
                    yield pa.record_batch([ids, *map(pa.array, rest)], names=[id_col, "start", "n_tokens", "ids_crc32"])
                    at, begin = to, int(stops[-1])

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    table = spark.createDataFrame(plan, "path string, base long")
    return table.repartition(max(1, len(plan))).mapInArrow(read, schema)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return unique_name(shared_dir(spark), "token-files")
