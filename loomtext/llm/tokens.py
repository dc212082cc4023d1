"""Token ids: a word-wise encoder over the tokenizers library, binary record files with an index, and packing."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEPT, alone, blocks, id_text, shared_path, stored

END_ID = 1
#: Pieces and words that a worker keeps with their ids; beyond it they are learnt anew, which costs time and changes nothing.
KEPT_WORDS = 500_000
#: Most rows of partition totals that are broadcast (16 bytes each); beyond it they are joined by a shuffle.
MOST_TOTALS = 1_000_000
#: Marks that are a piece of their own behind a word of letters. Not among them: the apostrophe, which begins pieces like
#: 's, and what special tokens are written with.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: The normaliser and the cut into pieces under which words can be encoded one by one; other files' texts go whole.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ENCODERS: dict[str, "Encoder"] = KEPT.setdefault("tokens", {})


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write the letters from U+0080 to U+00FF: each byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = dict(zip(printable, map(chr, printable), strict=True))
    letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class Encoder:
    """ids of texts as little-endian 32-bit bytes.

    A space or line feed always ends a piece of the tokenizers used here (white space is dropped, no merge and no
    normalisation crosses it), so each word is encoded once and its ids are kept. Words of ASCII and Latin-1 letters,
    which normalising only lower-cases, and runs of MARKS behind them are single pieces: they go to the merges directly.
    All other words go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.wordwise = all(rules[k] == v for k, v in WORDWISE.items()) and rules["model"]["type"] == "BPE"
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def piece(self, text: str) -> bytes:
        """ids of a piece of lower-case letters up to U+00FF, or of marks."""
        found = [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else text.translate(self.letters))]
        ids = self.known[text] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def singly(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """ids of each word."""
        if len(self.known) > KEPT_WORDS:
            self.known = {"": b""}
        get, piece, rest = self.known.get, self.piece, []
        out = list(map(get, words))
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                base = word.rstrip(MARKS)
                if not base or base.isalpha() and (base.isascii() or max(base) < "\u0100"):
                    low, tail = base.lower(), word[len(base) :]
                    out[i] = (get(low) or piece(low)) + (get(tail) or piece(tail)) if tail else get(low) or piece(low)
                else:
                    rest.append(i)
        odd = [words[i] for i in rest]
        for i, word, ids in zip(rest, odd, self.singly(odd), strict=True):
            out[i] = self.known[word] = ids
        return out

    def encode_all(self, texts: list[str] | pa.Array) -> list[bytes]:
        """ids of each text; each distinct word of the texts is looked up once."""
        if not self.wordwise:
            return self.singly(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        known = self.words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = list(map(known.__getitem__, coded.indices.to_numpy().tolist()))
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False)).tolist()
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, ids as 32-bit bytes with the end id) by blocks of rows."""
    alone("tokens")
    encoder, end = Encoder.of(path), struct.pack("<I", end_id)
    for batch in blocks(batches):
        yield batch.column("doc_id").to_pylist(), [x + end for x in encoder.encode_all(batch.column("text"))]


def narrow(ids: bytes) -> bytes:
    """A width byte and the ids in 16 bits where all fit, else in 32."""
    values = np.frombuffer(ids, "<u4")
    return b"\x02" + values.astype("<u2").tobytes() if not len(values) or values.max() < 1 << 16 else b"\x04" + ids


def widened(data: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


#: Parts whose totals are summed in one task.
PARTS_AT_ONCE = 1_000


def with_bases(rows: DataFrame, part: str, size: str) -> DataFrame:
    """Add `base`: the sum of `size` over all parts (numbers) before the row's part.

    The totals have one row a part. They are summed up within runs of PARTS_AT_ONCE parts, and these runs' totals, a
    thousandth of the parts, in one more window.
    """
    totals = rows.groupBy(part).agg(F.sum(size).alias("_n")).withColumn("_run", F.expr(f"`{part}` div {PARTS_AT_ONCE}"))
    runs = totals.groupBy("_run").agg(F.sum("_n").alias("_n"))
    runs = runs.select("_run", F.coalesce(F.sum("_n").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inner = totals.withColumn("_i", F.coalesce(F.sum("_n").over(W.partitionBy("_run").orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    bases = inner.join(runs, "_run").select(part, (F.col("_b") + F.col("_i")).alias("base"))
    small = totals.count() <= MOST_TOTALS
    return rows.join(F.broadcast(bases) if small else bases, part)


# ---- binary records -------------------------------------------------------------------------------------------
# A record: length of the payload (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of the
# payload (4), line feed (1). A payload: document id (8 bytes, signed), width of an id (1), ids. All little-endian.
HEAD, TAIL = 12, 5
#: Added to a rotated checksum, so that checksums of data holding checksums stay sound; fixed value.
MASK = 0xA282EAD8


def masked_crc(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    """A record without its line feed, which the text sink writes."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def records(data: bytes | memoryview) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each record of a file; a wrong length or checksum raises ValueError."""
    view, at = memoryview(data), 0
    while at < len(view):
        (length,), (crc,) = struct.unpack_from("<Q", view, at), struct.unpack_from("<I", view, at + 8)
        if masked_crc(view[at : at + 8]) != crc:
            raise ValueError(f"length checksum differs at byte {at}")
        payload = view[at + HEAD : at + HEAD + length]
        if masked_crc(payload) != struct.unpack_from("<I", view, at + HEAD + length)[0]:
            raise ValueError(f"payload checksum differs at byte {at}")
        yield at, payload
        at += HEAD + length + TAIL


def write_records(docs: DataFrame, tokenizer: str, path: str, file_bytes: int = 16 << 20, **cols: str) -> None:
    """Write every document's ids, in ascending id order over files part-00000 and on, then the index beside them.

    A null or empty text has the end id only; repeated rows give repeated records; an empty table gives no records.
    One shuffle of the texts by ranges of ids; files hold about file_bytes of text. The index (path + "/index",
    Parquet): file, doc_id, offset, n_bytes, n_tokens, ids_crc32, before (ids before it in its file).
    """
    texts = id_text(docs, **cols)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in encoded(batches, tokenizer):
            yield pa.RecordBatch.from_arrays([pa.array([framed(struct.pack("<q", i) + narrow(x)) for i, x in zip(ids, data, strict=True)], pa.binary())], ["value"])

    ordered = texts.repartitionByRange(max(1, -(-size // file_bytes)), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(frames, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").text(f"{path}/data")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for at, payload in records(content.as_buffer()):
                    values = widened(payload[8:])
                    rows.append((name, struct.unpack_from("<q", payload)[0], at, HEAD + len(payload) + TAIL, len(values), zlib.crc32(values), before))
                    before += len(values)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "doc_id", "offset", "n_bytes", "n_tokens", "ids_crc32", "before"])

    files = docs.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content")
    files.mapInArrow(entries, "file string, doc_id long, offset long, n_bytes long, n_tokens long, ids_crc32 long, before long").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with start: the ids of all documents before, over all files."""
    index = spark.read.parquet(f"{path}/index").withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    return with_bases(index, "part", "n_tokens").withColumn("start", F.col("base") + F.col("before"))


def read_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the index rows in `wanted` (any order or choice of them, such as a shuffled epoch)."""
    rows = wanted.select("file", "offset", "n_bytes").groupBy("file").agg(F.collect_list(F.struct("offset", "n_bytes")).alias("at"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column("content"), batch.column("at").to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                got = [next(records(view[x["offset"] : x["offset"] + x["n_bytes"]]))[1] for x in at]
                yield pa.RecordBatch.from_arrays([pa.array([struct.unpack_from("<q", p)[0] for p in got], pa.int64()), pa.array([widened(p[8:]).tolist() for p in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.join(rows, "file").mapInArrow(cut, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, **cols: str) -> DataFrame:
    """Write, read back, and return doc_id, start, n_tokens, ids_crc32 as the files have them."""
    spark = docs.sparkSession
    write_records(docs, tokenizer, path := shared_path(spark, "records"), **cols)
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


# ---- packing -----------------------------------------------------------------------------------------------------
def pack(docs: DataFrame, tokenizer: str, length: int = 2048, **cols: str) -> DataFrame:
    """Concatenate all documents and cut every `length` ids: one row a piece, no padding but in the last sequence.

    First pass: each partition encodes its documents once and stores the ids with the running total inside the
    partition. Second pass: prefix sums over the partition totals give every document's global offset, and the pieces
    are cut where it crosses a multiple of `length`. Nothing is shuffled but the totals. A null or empty text is the
    end id alone; repeated rows are packed each; an empty table gives no pieces.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit little-endian bytes).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for ids, data in encoded(batches, tokenizer):
            sizes = np.array([len(x) // 4 for x in data], np.int64)
            before = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), pa.array(before), pa.array(sizes), pa.array(ids, pa.int64()), pa.array([narrow(x) for x in data], pa.binary())], ["part", "before", "n", "doc_id", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, at, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "data")), strict=True):
                ids, done = memoryview(widened(data).tobytes()), 0
                while done < n:
                    here = at + done
                    size = min(n - done, length - here % length)
                    piece = bytes(ids[4 * done : 4 * (done + size)])
                    rows.append((doc, done, size, zlib.crc32(piece), n, here // length, here % length, piece))
                    done += size
                if len(rows) > 4096:
                    yield pieces(rows)
                    rows = []
            if rows:
                yield pieces(rows)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64()] * 7 + [pa.binary()]

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    tokens = stored(id_text(docs, **cols).mapInArrow(encode, "part long, before long, n long, doc_id long, data binary"), "tokens")
    placed = with_bases(tokens, "part", "n").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "data")
    return placed.mapInArrow(cut, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names))
