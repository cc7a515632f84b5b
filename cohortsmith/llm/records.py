"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record is: payload length (u64), masked checksum of those 8 bytes (u32), payload, masked
checksum of the payload (u32), one closing 0x0A. Integers are little-endian. A checksum is
crc32 rotated right by 15 bits plus a constant, so that the checksum of data that holds
checksums stays meaningful. Payload: document id (i64), flags (u8: 1 = the id is null,
2 = ids are u32, else u16), ids. Spark's own writer puts the bytes in place, so an attempt
that is lost with its executor leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir, task_count
from .common import FORGET, byte_chunks, map_arrow, map_batches

HEAD = struct.Struct("<QI")
START = struct.Struct("<qB")
TAIL = struct.Struct("<I")
MASK = 0xA282EAD8
#: Pieces a worker remembers before it forgets the longer half, which come up least.
REMEMBERED = 400_000

#: Text bytes that go to one file; its records have about half as many.
FILE_BYTES = 128 << 20
#: Bytes of text that are encoded at once; more costs a worker memory and saves no time.
CHUNK = 1 << 20

#: White space beside other white space, but for a line end and the blank of the piece that follows it.
_odd_spaces = re.compile(r"[^\S\n]\s|\s\n|\n[^\S ]").search
#: The same for a column of texts: two characters that count as white space there.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = _SPACE + _SPACE
_workers: dict[tuple[str, bool], "PieceEncoder"] = {}
FORGET.append(_workers.clear)


def _byte_signs() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others in order from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


_SIGNS = _byte_signs()
_BLANK = chr(_SIGNS[32])


def _shown(word: str, blank: bool) -> str:
    """A word of letters, and the blank before it, as the vocabulary writes them."""
    own = word if word.isascii() else word.encode().decode("latin-1").translate(_SIGNS)
    return _BLANK + own if blank else own


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload)), b"\n"))


def payload_head(doc_id: int, flags: int) -> bytes:
    return START.pack(doc_id, flags)


def unframe(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, framed length, payload) of each record; a damaged one raises."""
    at = 0
    while at < len(data):
        size, check = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"length checksum differs at byte {at}")
        payload = data[at + 12 : at + 12 + size]
        end = at + 12 + size + 5
        if len(payload) != size or end > len(data) or TAIL.unpack_from(data, end - 5)[0] != masked(payload) or data[end - 1] != 10:
            raise ValueError(f"payload checksum differs at byte {at}")
        yield at, end - at, payload
        at = end


class PieceEncoder:
    """Ids of whole texts from a byte-level BPE file, as the library's own call gives them, each
    distinct piece encoded once.

    The pre-tokenizer never joins a character to white space that follows it. Cut before single
    blanks and single line ends, a text therefore encodes piece by piece to the same ids, and a word
    of letters with a sign at its end as the word and the sign. A text with
    adjoining white space, or with the string of an added token, goes to the library in one piece.
    With `literal`, the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.simple = len(line_end) == 1
        self.line_id = line_end[0] if self.simple else -1
        self.skip = self.dtype.itemsize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The pattern of this pre-tokenizer parts letters from the signs that follow them.
        pre, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        pattern = json.loads(pre.__getstate__()) if pre is not None else {}
        parted = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space") and normal is None
        self.model = self.tokenizer.model
        self.line_end = np.array(line_end, self.dtype).tobytes()
        self.signs = {c: self._whole(c) for c in (".,!?;:" if parted else "")}
        self.lead = len(self._whole(" ")) + len(self.line_end)
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Words of letters go to the library's model as they are; other pieces are encoded in one
        row, in which each begins with a line end, its own or one put before its blank, and no id
        spans one."""
        rest, known, kind, tokenize = [], self.known, self.dtype.char, self.model.tokenize
        for p in pieces:
            own = p[:1] == "\n"
            word = p.lstrip("\n") if own else p
            if not self.signs or not word.isalpha():
                rest.append(p)
                continue
            data = array(kind, [t.id for t in tokenize(_shown(word, not own))]).tobytes()
            known[p] = self.line_end + data if own else data
        for i in range(0, len(rest), 512):
            part = rest[i : i + 512]
            row = "".join(p if p[:1] == "\n" else f"\n {p}" for p in part)
            if not _odd_spaces(row):  # else an empty piece or odd white space
                ids = np.array(self.tokenizer.encode_batch_fast([row], add_special_tokens=False)[0].ids, self.dtype)
                data, cuts = ids.tobytes(), np.flatnonzero(ids == self.line_id) * self.skip
                if len(cuts) == len(part):
                    ends = [*cuts[1:].tolist(), len(data)]
                    own = (data[a if p[:1] == "\n" else a + self.skip : b] for p, a, b in zip(part, cuts.tolist(), ends))
                    self.known.update(zip(part, own))
                    continue
            self.known.update((p, self._whole(p if p[:1] == "\n" else f" {p}")) for p in part)

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, those not known learnt first."""
        if len(self.known) > REMEMBERED:
            middle = sorted(map(len, self.known))[len(self.known) // 2]
            for p in [p for p in self.known if len(p) >= middle]:
                del self.known[p]
        known, signs = self.known, self.signs
        values = list(map(known.get, pieces))
        new, ends, others = {}, [], []
        for i, v in enumerate(values):
            if v is not None:
                continue
            p = pieces[i]
            if p[-1:] in signs and p[:-1].strip("\n").isalpha():
                # Not remembered: it follows from the word.
                ends.append(i)
                if p[:-1] not in known:
                    new[p[:-1]] = None
            else:
                others.append(i)
                new[p] = None
        self._learn(list(new))
        for i in ends:
            p = pieces[i]
            values[i] = known[p[:-1]] + signs[p[-1]]
        for i in others:
            values[i] = known[pieces[i]]
        return values

    def encode(self, texts: pa.StringArray | list[str]) -> list[bytes]:
        """Ids of each text as bytes. Texts are cut, and their pieces told apart, as whole columns:
        only different pieces become objects here."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        for token in self.added:
            odd = odd | np.asarray(pc.match_substring(texts, token))
        if not self.simple:
            odd[:] = True
        # An empty piece and a line end are put before each text, and taken from its ids again.
        lines = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        pieces = pc.split_pattern(pc.binary_join_element_wise(" \n", lines, ""), " ")
        words = pieces.flatten().dictionary_encode()
        values, codes = self._values(words.dictionary.to_pylist()), np.asarray(words.indices)
        # There are no more ids than bytes of a column, whose offsets are of 32 bits.
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // self.skip
        first, size = (np.cumsum(sizes, dtype=np.int32) - sizes)[codes], sizes[codes]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(first - (ends - size), size)
        at += np.arange(len(at), dtype=np.int32)
        data = np.frombuffer(b"".join(values), self.dtype)[at].tobytes()
        cuts = (np.append(0, ends.astype(np.int64))[np.asarray(pieces.offsets) - pieces.offsets[0].as_py()] * self.skip).tolist() if len(pieces) else [0]
        plain = iter(zip(cuts, cuts[1:]))
        whole = iter(texts.filter(pa.array(odd)).to_pylist())
        out = []
        for o in odd.tolist():
            if o:
                out.append(self._whole(next(whole)))
            else:
                x, y = next(plain)
                out.append(data[x + self.lead : y])
        return out


def _encoder(path: str, literal: bool) -> PieceEncoder:
    if (path, literal) not in _workers:
        _workers[path, literal] = PieceEncoder(path, literal)
    return _workers[path, literal]


def write_records(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
    literal: bool = False,
) -> None:
    """Writes `path`/data: the framed ids of every whole text, in ascending id order over all files.
    There are files enough that one holds the records of about FILE_BYTES of text, and one for each
    task at least.

    A null text counts as empty and gives one record with the end id alone; null ids come
    first; rows with equal ids are ordered by their text. Repeated rows give repeated
    records, an empty table no record. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(task_count(spark), -(-size // FILE_BYTES))
    placed = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def to_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, literal)
        end = np.array([end_id], enc.dtype).tobytes()
        wide = 2 * enc.wide
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in _column_chunks(texts):
                heads = (payload_head(i or 0, (i is None) + wide) for i in ids[lo:hi])
                records = [frame(h + g + end)[:-1] for h, g in zip(heads, enc.encode(texts[lo:hi]))]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    frames = map_arrow(placed.select("doc_id", "text"), to_frames, "record binary")
    # The writer closes every row with 0x0A, the last byte of a frame.
    frames.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")


def _column_chunks(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Slices that hold about CHUNK bytes; a longer text stands alone."""
    sizes = np.asarray(pc.binary_length(texts))
    return byte_chunks([range(n) for n in sizes.tolist()], CHUNK)


def _tokens(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = START.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=START.size)
    return None if flags & 1 else doc_id, ids


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads every file of `path`/data, checks all frames, and writes `path`/index: one row a
    record with file, offset, length, doc_id, n_tokens, ids_crc32, and in start the ids of all
    records before it. A task holds one file at a time, whose size the writer bounds."""
    files = spark.read.format("binaryFile").load(f"{path}/data").select("path", "content")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for name, content in zip(d["path"], d["content"]):
                file = name.rsplit("/", 1)[-1]
                part, rows, before = int(re.search(r"part-(\d+)", file)[1]), [], 0
                for offset, length, payload in unframe(content):
                    doc_id, ids = _tokens(payload)
                    rows.append((file, part, offset, length, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before += len(ids)
                out = pd.DataFrame(rows, columns=["file", "part", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "before"])
                yield out.astype({"doc_id": "Int64"})

    schema = "file string, part int, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"
    map_batches(files, scan, schema).write.parquet(f"{path}/scan")
    rows = spark.read.schema(schema).parquet(f"{path}/scan")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = totals.select("part", (F.sum("n").over(upto) - F.col("n")).alias("offset_ids"))
    placed = rows.join(offsets, "part").withColumn("start", F.col("before") + F.col("offset_ids"))
    out = placed.select("file", "offset", "length", "doc_id", "start", "n_tokens", "ids_crc32")
    out.write.parquet(f"{path}/index")
    return spark.read.schema(out.schema).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the index rows asked for, by seeking to their offsets: a shuffled read
    takes the index rows in any grouping it likes and touches only their files."""
    files = spark.read.format("binaryFile").load(f"{path}/data")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    spots = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("spots"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for content, spots in zip(d["content"], d["spots"]):
                got = [_tokens(next(unframe(content[s["offset"] : s["offset"] + s["length"]]))[2]) for s in spots]
                out = pd.DataFrame({"doc_id": [g[0] for g in got], "ids": [g[1].astype(np.int64) for g in got]})
                yield out.astype({"doc_id": "Int64"})

    return map_batches(named.join(spots, "file").select("content", "spots"), pick, "doc_id long, ids array<long>")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for one run's files, inside the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/records/{uuid.uuid4().hex}"
