"""Token ids as binary: frequency-ranked ids in a byte-aligned variable-length code.

The ids of the whole corpus are ranked by frequency (ties: smaller id first), so that the
commonest 256 take one byte. A segment keeps the two-bit lengths of four ranks in one
control byte, apart from the data bytes; both are decoded by numpy table lookup.

Layout of a segment (little endian): ``BFT1``, u32 docs, u64 ids, docs x i64 doc_id
(with a u8 null flag each), docs x u64 ids of that document, control bytes, data bytes.
Segments are rows of a Parquet table in ascending order, because Spark's own commit
protocol then writes them on any file system and survives lost executors;
``export_segments`` makes plain files of them. The ranking lies beside the segments.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import archives, files
from . import common

MAGIC = b"BFT1"
#: Ids that one segment holds, about; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 20
END_ID = 2
#: Distinct units that a worker keeps ids of before it starts anew: bounded memory.
CACHE_UNITS = 1_000_000

# The pieces into which the vocabulary's own file splits lower-case text, for
# text of Latin code points below U+0250. Anything else goes through the library as it is.
_LETTER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct unit encoded once.

    The vocabulary never merges across white space or across its own pieces, so the ids of
    a text are those of its units in order: runs of letters, and runs of other visible
    characters (which take the letters after an apostrophe with them). Units are found and
    looked up by numpy on a block's bytes; only unknown ones reach the library. A text with
    anything unusual (code points beyond the plain Latin ones, special tokens) is encoded
    whole.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.pieces = Tokenizer(self.tokenizer.model)  # for pieces already split and lowered
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.slot_of = np.zeros(self.SLOTS, np.int32)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        ids = np.asarray(self.pieces.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            return [self.whole(p) for p in pieces]
        stops = stops.tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``first`` of the units' hashes, -1 where unknown."""
        shift, out = np.uint64(43), np.full(len(hashes), -1, np.int64)
        slots, todo = (hashes >> shift).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            have = self.keys[slots]
            hit = have == hashes[todo]
            out[todo[hit]] = self.slot_of[slots[hit]]
            on = ~hit & (have != 0)
            todo, slots = todo[on], (slots[on] + 1) & (self.SLOTS - 1)
        return out

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        split = [_PIECE.findall(u) for u in units]
        flat = [p for parts in split for p in parts]
        own = [x for at in range(0, len(flat), 20_000) for x in self._encode_pieces(flat[at : at + 20_000])]
        sizes, at = np.zeros(len(units), np.int64), 0
        for k, parts in enumerate(split):
            sizes[k] = sum(len(own[j]) for j in range(at, at + len(parts)))
            at += len(parts)
        base = len(self.first) - 1
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, *own))
        slots, todo = (hashes >> np.uint64(43)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = hashes[todo[free]]
            placed = self.keys[slots] == hashes[todo]
            self.slot_of[slots[placed]] = base + todo[placed]
            todo, slots = todo[~placed], (slots[~placed] + 1) & (self.SLOTS - 1)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Per text its ids, in order."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        original = column
        for row, data, off in common.blocks(pc.utf8_lower(pc.fill_null(column, ""))):
            odd = _unusual(data, off)
            starts, stops, hashes, first = _units(data, off)
            if len(self.first) > CACHE_UNITS:
                self.clear()
            at = self._find(hashes)
            unknown = np.flatnonzero(at < 0)
            if len(unknown):
                unknown = unknown[~odd[np.searchsorted(first, unknown, "right") - 1]]
                new, pick = np.unique(hashes[unknown], return_index=True)
                raw, pick = data.tobytes(), unknown[pick]
                self._learn(new, [raw[a:b].decode() for a, b in zip(starts[pick].tolist(), stops[pick].tolist())])
                at[unknown] = self._find(hashes[unknown])
            known = np.maximum(at, 0)
            sizes = np.where(at < 0, 0, self.first[known + 1] - self.first[known]) if len(self.first) > 1 else np.zeros(len(at), np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            ids = self.ids[np.repeat(self.first[known] - ends[:-1], sizes) + np.arange(ends[-1])]
            cuts = ends[first]
            for k in range(len(off) - 1):
                yield self.whole(original[row + k].as_py() or "") if odd[k] else ids[cuts[k] : cuts[k + 1]]


_SPACE = np.zeros(256, bool)
_SPACE[9:14] = _SPACE[32] = True
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[97:123] = _LETTER_BYTE[0x80:0xCA] = True
_LETTER_BYTE[0xC2] = False
_FINE = np.zeros(256, bool)
_FINE[9:14] = _FINE[32:127] = _FINE[0x80:0xCA] = _FINE[0xE2] = True


def _after(data: np.ndarray, lead: int, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Where a lead byte stands, and the byte ``k`` after it."""
    at = np.flatnonzero(data == lead)
    return at, data[np.minimum(at + k, len(data) - 1)]


def _unusual(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold something that is better left to the library whole."""
    bad = ~_FINE[data]
    at, byte = _after(data, 0xC2)
    bad[at[np.isin(byte, (0xAA, 0xB5, 0xBA))]] = True  # letters beside signs
    at, byte = _after(data, 0xC4)
    bad[at[byte == 0xB0]] = True  # its lower case is two code points
    at, byte = _after(data, 0xCC)
    at, byte = _after(data, 0xE2)
    third = data[np.minimum(at + 2, len(data) - 1)] if len(at) else byte
    bad[at[(byte != 0x80) | (third < 0x90) | (third > 0xA7)]] = True  # dashes, quotes, dots
    at, byte = _after(data, 60)
    bad[at[byte == 124]] = True  # <|
    sums = np.concatenate(([0], np.cumsum(bad)))
    return sums[off[1:]] > sums[off[:-1]]


def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and hashes of the units, and each text's first unit."""
    n = len(data)
    kind = np.where(_SPACE[data], 0, np.where(_LETTER_BYTE[data], 1, 2)).astype(np.int8)
    at, byte = _after(data, 0xC2)
    follow = np.minimum(at + 1, n - 1)
    kind[follow] = np.where(np.isin(byte, (0x85, 0xA0)), 0, 2)
    kind[at] = kind[follow]
    at, byte = _after(data, 0xC3)
    at = at[np.isin(byte, (0x97, 0xB7))]
    kind[at] = kind[at + 1] = 2
    at = np.flatnonzero(data == 0xE2)
    for k in range(3):
        kind[np.minimum(at + k, n - 1)] = 2
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    quote = np.flatnonzero(data[: n - 1] == 39) + 1
    edge[quote[kind[quote] == 1]] = False  # letters after an apostrophe stay with it
    edge[off] = True
    places = np.flatnonzero(edge)
    starts, stops = places[:-1], places[1:]
    seen = kind[starts] != 0
    starts, stops = starts[seen], stops[seen]
    return starts, stops, common.span_hashes(data, starts, stops) | np.uint64(1), np.searchsorted(starts, off)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary, kept across tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- the code

#: Of each control byte: the four lengths, and their sum.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    keys = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    keys[: len(values)] = extra
    keys = keys.reshape(-1, 4)
    control = keys[:, 0] | keys[:, 1] << 2 | keys[:, 2] << 4 | keys[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def segment(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = MAGIC + np.uint32(len(doc_ids)).tobytes() + np.uint64(len(ranks)).tobytes()
    ids = np.asarray([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.asarray([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join((head, ids, nulls, np.asarray(counts, "<u8").tobytes(), control, data))


def read_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and ranks of a segment; ValueError if it isn't whole."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, n = int(np.frombuffer(raw, "<u4", 1, 4)[0]), int(np.frombuffer(raw, "<u8", 1, 8)[0])
    at = 16
    ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    nulls = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(raw, "<u8", docs, at := at + docs).astype(np.int64)
    at += 8 * docs
    stop = at + -(-n // 4)
    ranks = unpack(raw[at:stop], raw[stop:], n)
    if counts.sum() != n:
        raise ValueError("a segment's counts do not add up")
    return [None if z else i for i, z in zip(ids, nulls)], counts, ranks


# ---------------------------------------------------------------- on Spark


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and ids (zlib-free little-endian u16, or u32 for large vocabularies)."""
    common.ship(docs.sparkSession)
    wide = encoder(vocabulary).size > 1 << 16 or end_id >= 1 << 16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.uint32(end_id)
        for batch in common.bounded(batches):
            ids = [np.append(x, end) for x in enc.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4" if wide else "<u2").tobytes() for x in ids], pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def ranking(tokens: DataFrame, size: int) -> np.ndarray:
    """The ids 0 to size-1 from the most to the least frequent in the whole corpus.

    Bounded by the vocabulary: each task sums its own counts, Spark sums the tasks'.
    """
    width = "<u4" if size > 1 << 16 else "<u2"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in common.bounded(batches):
            for raw in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(raw, width), minlength=size) if len(raw) > 4096 else 0
                if len(raw) <= 4096:
                    np.add.at(total, np.frombuffer(raw, width), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    return np.lexsort((np.arange(size), -counts)).astype(np.uint32)


def write_segments(docs: DataFrame, vocabulary: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> tuple[DataFrame, np.ndarray]:
    """Encode and write the corpus; a scan of the segment table, and the ranking to decode it.

    Odd input as in ``encode_documents``; repeated rows are written each.

    Segment table: part (int, ascending with doc_id), seq (int, within the part), n_docs,
    n_ids, start (ids of all documents before the segment), raw (the segment). Only ids,
    not texts, are dealt out by ranges of doc_id; each task packs its sorted range.
    """
    spark = docs.sparkSession
    size = max(encoder(vocabulary).size, end_id + 1)
    tokens = common.written(token_ids(docs, vocabulary, end_id), "token-ids")
    order = ranking(tokens, size)
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    width = "<u4" if size > 1 << 16 else "<u2"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, parts, held = [], [], [], 0

        def flush():
            nonlocal seq, before, ids, counts, parts, held
            raw = segment(ids, counts, shared.value[np.concatenate(parts)])
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "before": pa.array([before], pa.int64()), "raw": pa.array([raw], pa.binary())})
            seq, before, ids, counts, parts, held = seq + 1, before + held, [], [], [], 0
            return row

        for batch in common.bounded(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                own = np.frombuffer(raw, width)
                if ids and held + len(own) > segment_ids:
                    yield flush()
                ids.append(doc_id)
                counts.append(len(own))
                parts.append(own)
                held += len(own)
        if ids:
            yield flush()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Documents of one doc_id, or of none, are dealt on by length, hash and place in the table.
    placed = tokens.withColumn("hash", F.xxhash64("ids")).withColumn("place", F.monotonically_increasing_id())
    by = ("doc_id", "n_tokens", "hash", "place")
    ordered = placed.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("hash", "place")
    table = common.written(ordered.mapInArrow(build, "part int, seq int, n_docs long, n_ids long, before long, raw binary"), "segments")
    # One number per task goes to the driver and back: bounded by the number of partitions.
    sums = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [], 0
    for part, count in sums:
        starts.append((part, total))
        total += count
    starts = spark.createDataFrame(starts, "part int, part_start long")
    return table.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start", "before"), order


def read_back(segments: DataFrame, order: np.ndarray) -> DataFrame:
    """Per document, from the segments alone: doc_id, start, n_tokens, ids_crc32."""
    shared = segments.sparkSession.sparkContext.broadcast(order.astype("<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("raw")):
                doc_ids, counts, ranks = read_segment(raw.as_py())
                ids = shared.value[ranks]
                stops = np.cumsum(counts)
                crcs = [zlib.crc32(ids[b - n : b]) for b, n in zip(stops.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + stops - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("start", "raw").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_segments(segments: DataFrame, folder: str) -> None:
    """Plain files ``part-<part>-<seq>.bft`` in a folder of any store that pyarrow knows (a
    path without a scheme: the executors' disk). A file is written beside its place and moved
    there whole."""
    target = files.qualified(folder)

    def save(rows) -> None:
        store, inside = archives.opened(target)
        store.create_dir(inside, recursive=True)
        for r in rows:
            name = f"{inside}/part-{r['part']:05}-{r['seq']:05}.bft"
            with store.open_output_stream(f"{name}.tmp") as f:
                f.write(r["raw"])
            store.move(f"{name}.tmp", name)

    segments.select("part", "seq", "raw").foreachPartition(save)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write every document's ids and read them back; see ``read_back``.

    Null text: no ids but the end id. Null doc_id: first, in the order of nulls. Equal
    doc_ids: in order of length, then of a hash of their ids. Other columns are ignored. An empty
    table gives no rows.
    """
    segments, order = write_segments(docs, vocabulary or default_vocabulary())
    return read_back(segments, order)
