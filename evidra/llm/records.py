"""Token ids as length-delimited binary records with an offset index.

A record is: length as unsigned 64 bits, masked CRC32C of these 8 bytes as unsigned 32 bits, the
payload, masked CRC32C of the payload (all little-endian). The payload is the document's id as
signed 64 bits and its token ids, 16 bits each where the vocabulary fits, else 32. The index has
one entry per record: offset and length of the record and its number of ids, as unsigned 64 bits,
so that a reader can take records in any order.

Documents are dealt to files by ranges of the id, one file per range, in ascending order. A task
writes to a name of its own attempt and renames at the end, so repeated attempts do no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._common import materialize, runs, shared_dir, tidied

END_ID = 2
#: Distinct chunks that a worker keeps encoded; beyond that number only the newest half stays.
CACHE = 900_000
#: Characters of texts whose new chunks are encoded at once, and chunks that are encoded as one text.
SLICE, TOGETHER = 1 << 22, 20_000
#: White space as the tokenizer's rules see it; str.split() would also split at \\x1c to \\x1f.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = "\x1c\x1d\x1e\x1f"
MASK_DELTA = 0xA282EAD8
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("n_ids", "<u8")])


@lru_cache
def _crc_table() -> np.ndarray:
    """CRC32C (Castagnoli polynomial, reflected 0x82F63B78) of single bytes."""
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, n >> np.uint32(1) ^ np.uint32(0x82F63B78), n >> np.uint32(1))
    return n


@lru_cache
def _zeros_operator(n: int) -> np.ndarray:
    """Table of four times 256 entries that moves a CRC state over n zero bytes."""
    table = _crc_table()
    states = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(n):
        states = table[states & np.uint32(255)] ^ (states >> np.uint32(8))
    return states.reshape(4, 256)


LANE = 128


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """CRC32C of each part. All parts' lanes of LANE bytes advance together, byte by byte.

    A state of zero stays zero over zero bytes, so parts are filled up in front; the usual first
    state is the same as inverting the first four bytes.
    """
    if not parts:
        return np.zeros(0, np.uint32)
    short = [n for n, p in enumerate(parts) if len(p) < 4]
    lengths = np.array([max(4, len(p)) for p in parts])
    lanes = -(-lengths // LANE)
    ends = np.cumsum(lanes * LANE)
    grid = np.zeros(ends[-1], np.uint8)
    for p, n, end in zip(parts, lengths.tolist(), ends.tolist()):
        if len(p) >= 4:
            grid[end - n : end] = np.frombuffer(p, np.uint8)
            grid[end - n : end - n + 4] ^= 0xFF
    grid = np.ascontiguousarray(grid.reshape(-1, LANE).T)
    table = _crc_table()
    states = np.zeros(grid.shape[1], np.uint32)
    for column in grid:
        states = table[(states ^ column) & np.uint32(255)] ^ (states >> np.uint32(8))
    move = _zeros_operator(LANE)
    first, out = np.cumsum(lanes) - lanes, np.zeros(len(parts), np.uint32)
    active = np.arange(len(parts))
    for k in range(int(lanes.max())):
        active = active[lanes[active] > k]
        c = out[active]
        moved = move[0][c & 255] ^ move[1][c >> 8 & 255] ^ move[2][c >> 16 & 255] ^ move[3][c >> 24]
        out[active] = moved ^ states[first[active] + k]
    out ^= np.uint32(0xFFFFFFFF)
    for n in short:
        crc = 0xFFFFFFFF
        for b in parts[n]:
            crc = int(table[(crc ^ b) & 255]) ^ crc >> 8
        out[n] = crc ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    """The records of payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    h, c = (masked(crc32c_many(x)).astype("<u4") for x in (heads, payloads))
    return [a + x.tobytes() + p + y.tobytes() for a, x, p, y in zip(heads, h, payloads, c)]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads of whole records; ValueError where a length or checksum is wrong."""
    if any(len(r) < 16 or struct.unpack_from("<Q", r)[0] != len(r) - 16 for r in records):
        raise ValueError("record with a wrong length")
    payloads = [r[12:-4] for r in records]
    for parts, sums in (([r[:8] for r in records], [r[8:12] for r in records]), (payloads, [r[-4:] for r in records])):
        if (masked(crc32c_many(parts)) != np.frombuffer(b"".join(sums), "<u4")).any():
            raise ValueError("record with a wrong checksum")
    return payloads


class Encoder:
    """Whole texts to ids, each distinct chunk between white space encoded once per task.

    The tokenizer drops white space and its rules never join characters across it, so a text's
    ids are those of its chunks in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with a special token's string, in any case, are encoded by the library as a whole.
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE).search
        #: Numbers of the known chunks in order; their ids lie in flat, one chunk's behind the other's.
        self.places: defaultdict[str, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lengths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(piece.removesuffix("</w>"))  # a character per byte of the text
        self.flat, self.sizes, self.starts = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self, n: int) -> None:
        """Drop the n oldest chunks; the others are numbered anew."""
        kept = list(islice(self.places, n, None))
        self.places.clear()
        self.places.update(zip(kept, range(len(kept))))
        self.flat, self.sizes = self.flat[self.starts[n] if n < len(self.starts) else len(self.flat) :].copy(), self.sizes[n:].copy()
        self.starts = np.cumsum(self.sizes) - self.sizes

    def chunks(self, text: str) -> list[str]:
        return [c for c in SPACE.split(text) if c] if any(c in text for c in ODD) else text.split()

    def _learn(self, new: list[str]) -> None:
        """Encode chunks, the next ones by number. Those of simple letters go together, and are told apart by their bytes.

        Up to U+017F, normalising keeps a chunk's number of bytes. Where the ids' bytes don't end with
        each chunk's, as may be for U+0130, and for all other chunks, each is encoded on its own.
        """
        found: dict[str, bytes] = {}
        simple = [c for c in new if c.isascii() or max(c) < "\u0180"]
        for k in range(0, len(simple), TOGETHER):
            part = simple[k : k + TOGETHER]
            ids = np.array(self._ids([" ".join(part)])[0], self.dtype)
            sizes, want = self.lengths[ids], np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in part])
            ends = np.cumsum(sizes)
            if len(ids) and ends[-1] == want[-1] and (sizes > 0).all():
                at = np.searchsorted(ends, want)
                if (ends[at] == want).all():
                    raw, stops = ids.tobytes(), ((at + 1) * self.dtype.itemsize).tolist()
                    found.update(zip(part, map(raw.__getitem__, map(slice, [0, *stops], stops))))
        rest = [c for c in new if c not in found]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            found.update((c, np.array(ids, self.dtype).tobytes()) for c, ids in zip(part, self._ids(part)))
        raw = list(map(found.__getitem__, new))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        self.flat, self.sizes = np.concatenate([self.flat, np.frombuffer(b"".join(raw), self.dtype)]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Per text its ids as bytes of self.dtype, END_ID last."""
        end = np.array([END_ID], self.dtype).tobytes()
        at = 0
        while at < len(texts):
            known, rows, total = len(self.places), [], 0
            while at < len(texts) and total < SLICE:
                text = texts[at] or ""
                if self.special(text):
                    rows.append(np.array(self._ids([text])[0], self.dtype))
                else:
                    parts = self.chunks(text)
                    rows.append(np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts)))
                total += len(text) + 64
                at += 1
            if len(self.places) > known:
                self._learn(list(islice(self.places, known, None)))
            for row in rows:
                yield (row if row.dtype == self.dtype else runs(self.flat, self.starts, self.sizes, row)).tobytes() + end
            if len(self.places) > CACHE:
                self._forget(len(self.places) - CACHE // 2)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, with the chunks that its earlier tasks have encoded."""
    return Encoder(path)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _batches(rows: list, size) -> Iterator[list]:
    """rows in parts of about a few MB."""
    part, total = [], 0
    for r in rows:
        part.append(r)
        total += size(r)
        if total >= 4 << 20:
            yield part
            part, total = [], 0
    if part:
        yield part


def write_records(docs: DataFrame, tokenizer: str, out_dir: str, files: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Plan of the write; evaluating it writes. One row per file: part, path, n_records, n_ids.

    Ids are 64-bit integers; null ids come first, null texts are empty, repeated documents are
    written each. Ranges are quantiles of all ids, so a file holds about n / files documents,
    more only where one id repeats. Empty tables write no file.
    """
    key = F.col(doc).cast("long")
    found = docs.select(F.percentile_approx(key, [k / files for k in range(1, max(2, files))], 10_000)).first()[0] or []
    ends = np.array(sorted(set(found)), np.int64)
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dtype = Encoder(tokenizer).dtype

    def encode(batches):
        encoder = encoder_of(tokenizer)
        for b in batches:
            ids = pa.array(list(encoder.encode(b.column(1).to_pylist())), pa.binary())
            known = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            part = np.searchsorted(ends, known).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), ids], ["part", "doc_id", "ids"])

    def write(batches):
        attempt, (store, top) = uuid.uuid4().hex, _store(out_dir)
        now, out, entries, at = None, None, [], 0

        def close():
            name = f"{top}/part-{now:06d}"
            with store.open_output_stream(f"{name}.idx.{attempt}") as f:
                f.write(np.array(entries, ENTRY).tobytes())
            out.close()
            for kind in ("rec", "idx"):
                store.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
            n = sum(e[2] for e in entries)
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "path": [f"{out_dir}/part-{now:06d}"], "n_records": pa.array([len(entries)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(3)))
            for part in _batches(list(rows), lambda r: len(r[2])):
                framed = frames([struct.pack("<BBq", d is None, dtype.itemsize, d or 0) + ids for _, d, ids in part])
                for (p, _, ids), record in zip(part, framed):
                    if p != now:
                        if out is not None:
                            yield close()
                        store.create_dir(top, recursive=True)
                        now, entries, at = p, [], 0
                        out = store.open_output_stream(f"{top}/part-{p:06d}.rec.{attempt}", buffer_size=1 << 20)
                    out.write(record)
                    entries.append((at, len(record), len(ids) // dtype.itemsize))
                    at += len(record)
        if out is not None:
            yield close()

    encoded = rows.mapInArrow(tidied(encode), "part int, doc_id long, ids binary")
    dealt = encoded.repartitionById(max(1, files), F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    return dealt.mapInArrow(tidied(write), "part int, path string, n_records long, n_ids long")


def read_index(path: str) -> np.ndarray:
    """The index of a file: offset, length and number of ids of each record."""
    store, top = _store(path)
    with store.open_input_stream(f"{top}.idx") as f:
        return np.frombuffer(f.read(), ENTRY)


def read_records(path: str, which: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, token ids) of a file's records, all in order or those of the given numbers."""
    index = read_index(path)
    index = index if which is None else index[which]
    store, top = _store(path)
    with store.open_input_file(f"{top}.rec") as f:
        for part in _batches(index.tolist(), lambda e: e[1]):
            for p in unframe([f.read_at(length, offset) for offset, length, _ in part]):
                null, width, d = struct.unpack_from("<BBq", p)
                yield (None if null else d), np.frombuffer(p, f"<u{width}", offset=10)


def token_digests(manifest: DataFrame, files: int) -> DataFrame:
    """Read written files back: doc_id, start, n_tokens, ids_crc32 of each record.

    manifest has a row per file, so its running sum of ids is small; each file is read by the task
    that its number is dealt to.
    """
    start = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("start", F.coalesce(start, F.lit(0)))

    def read(batches):
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for d, ids in read_records(path):
                    rows.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    placed = placed.select("path", "start", "part").repartitionById(max(1, files), F.col("part")).select("path", "start")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read_back(docs: DataFrame, tokenizer: str, out_dir: str | None = None, files: int | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents as records in out_dir (default: the shared folder) and digest what the files hold.

    See write_records() and token_digests() for nulls, repeated documents and empty tables. Of docs
    only id and text are read.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = materialize(write_records(docs, tokenizer, out_dir or shared_dir(spark), files, doc, text))
    return token_digests(manifest, files)
