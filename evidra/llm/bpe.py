"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

A text is cut into words by the tokenizer's pattern. The byte array of a word becomes an array of
token ids, and a fold merges, again and again, the adjacent pair of the lowest rank.

The fold is a Spark expression of higher-order functions (fold_word). The rank map is the result of
scalar subqueries: pairs (left id, right id) that form a token lie in one array by a perfect hash, so a
pair's rank is in its cell if the cell names the pair.

The commonest words of a bounded sample are folded first and broadcast, so that tasks don't fold
them again. Then three steps follow each other inside one task, without a shuffle. The first cuts
texts into words and gives each distinct word of the task a number; it hands on new words, in
arrays, and behind them the rows with their words' numbers. Spark folds the arrays of words. The
last step looks the numbers up in the folded ids. Only words of over LONG bytes, where the fold's time grows with the
square, merge all places of the lowest pair at once in the last step, with the same ids. Decoding
concatenates the ids' binary pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm._common import discard, fresh, materialize, runs, settle, tidied

#: Words of over so many bytes merge all places of the lowest pair at once.
LONG = 96
#: Ids have 16 bits in the rank map's cells; the last value is for empty ones.
MOST_IDS = (1 << 16) - 1
#: What an empty cell holds; no pair has it.
NO_PAIR = 1 << 62
#: The rank of a pair that forms no token.
NO_RANK = MOST_IDS + 1
#: In the fold's elements a rank stands above so many bits, an index above an id's 16.
RANK_BITS, INDEX = 40, 1 << 16
#: Fixed factors of a pair's cell and bucket; products of ids and these fit 31 bits.
FIRST, SECOND = (15731, 11149), (7919, 15013)
#: Words of an array to fold.
WORDS_PER_ROW = 2048
#: Characters of texts that are cut before their words are handed on.
SLICE = 1 << 23
#: Distinct words after which a task starts its numbers anew, and the bytes that they may take.
MOST_WORDS, MOST_BYTES = 400_000, 1 << 26
#: The commonest words of about so many documents are folded once for all tasks, up to so many words.
SAMPLE_DOCS, COMMON_WORDS = 65_536, 600_000
#: Tasks that fold them.
FOLDERS = 8
#: Texts are written out in batches of about so many tokens.
BATCH_TOKENS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines: token in base64, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMap:
    """A vocabulary's tables: byte ids, pieces, and the rank of each pair that forms a token."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        if top > MOST_IDS or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary with all single bytes and at most 65535 ids is needed")
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        pieces, pairs = [b""] * top, {}
        for token, rank in ranks.items():
            pieces[rank] = token
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """shifts and cells: pair (l, r) is in cell (FIRST . (l, r) + shifts[SECOND . (l, r) mod their number]) mod theirs.

        Buckets of pairs with the same shift are placed one by one, the largest first, with the
        first shift that finds all their cells free. A cell holds l << 32 | r << 16 | rank, or NO_PAIR.
        """
        left, right = self.keys >> 16, self.keys & 0xFFFF
        n_cells, n_shifts = int(1.25 * len(left)) + 3 | 1, len(left) // 4 + 1
        place = left * FIRST[0] + right * FIRST[1]
        bucket = (left * SECOND[0] + right * SECOND[1]) % n_shifts
        order = np.argsort(bucket, kind="stable")
        first, counts = np.searchsorted(bucket[order], np.arange(n_shifts)), np.bincount(bucket, minlength=n_shifts)
        taken, shifts, cells = np.zeros(n_cells, bool), np.zeros(n_shifts, np.int64), np.full(n_cells, NO_PAIR, np.int64)
        for b in np.argsort(-counts, kind="stable").tolist():
            own = order[first[b] : first[b] + counts[b]]
            for shift in range(0, n_cells, 256):
                at = (place[own] + np.arange(shift, shift + 256)[:, None]) % n_cells
                fits = np.flatnonzero(~taken[at].any(1))
                if len(fits):
                    break
            at = at[fits[0]]
            if len(set(at.tolist())) < len(own):
                raise ValueError("two pairs of a bucket have the same cell")
            shifts[b] = shift + fits[0]
            taken[at] = True
            cells[at] = self.keys[own] << 16 | self.ranks[own]
        return shifts, cells

    def fold(self, word: bytes) -> list[int]:
        """The ids of a word: the leftmost pair of the lowest rank is merged until none is left.

        All places of that pair are merged at once, in as many steps as there are different merges.
        """
        ids = np.array([self.byte_ids[b] for b in word], np.int64)
        while len(ids) > 1 and len(self.keys):
            asked = ids[:-1] << 16 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            found = np.where(self.keys[at] == asked, self.ranks[at], MOST_IDS)
            least = found.min()
            if least == MOST_IDS:
                break
            places = np.flatnonzero(found == least)
            # In a run such as aaaa only the first, third and so on are merged.
            new_run = np.concatenate([[True], np.diff(places) > 1])
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
            ids[places] = least
            ids = np.delete(ids, places + 1)
        return ids.tolist()


@lru_cache
def rank_map(path: str) -> RankMap:
    return RankMap(read_ranks(path))


@lru_cache
def _tables(path: str) -> tuple[list[int], ...]:
    """byte ids, shifts and cells."""
    tables = rank_map(path)
    return (tables.byte_ids, *(x.tolist() for x in tables.hashed()))


def _literal(values: list[int]) -> Column:
    """An array of integers in the plan; the optimizer folds the parsing away."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def _with_tables(df: DataFrame, names: list[str], ranks_path: str) -> DataFrame:
    """df and the three tables as columns of these names, each the one row of a scalar subquery.

    A plan names a subquery and doesn't hold its result, so that texts of plans stay short; the text of an
    array as a literal stands in that of each expression around it and takes the driver hundreds of MB.
    """
    arrays = [pa.array([t], pa.list_(pa.int64())) for t in _tables(ranks_path)]
    rows = df.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, names=names))
    return df.withColumns({c: rows.select(c).scalar() for c in names})


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; an element of a transformed array would ask for body's type with each word."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def fold_word(word: Column, ranks_path: str, names: list[str] | None = None) -> Column:
    """RankMap.fold() as a Spark expression over a column of words that aren't empty: array<int>.

    names: the columns of _with_tables(); without them the tables are literals.

    An element holds the rank of the pair that begins there, its index and its id, from the high bits to
    the low, so the least element is the first pair of the lowest rank and names its own index. A step
    merges it and ranks only the two pairs that are new. Where none is left, a step finds the least and no more.
    """
    byte_ids, shifts, cells = map(F.col, names) if names else map(_literal, _tables(ranks_path))
    # Named once each, the subqueries of _with_tables() move in here; a projection below would copy the tables into every row.
    return _let(byte_ids, lambda b: _let(shifts, lambda s: _let(cells, lambda c: _folded(word, ranks_path, b, s, c))))


def _folded(word: Column, ranks_path: str, byte_ids: Column, shifts: Column, cells: Column) -> Column:
    """fold_word() with the tables as columns."""
    _, n_shifts, n_cells = map(len, _tables(ranks_path))
    # The word's bytes as characters U+0000 to U+00FF.
    start = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(byte_ids, F.ascii(c)))
    id_of = lambda x: x.bitwiseAND(F.lit(MOST_IDS))

    def element(left: Column, right: Column, index: Column) -> Column:
        """left, the pair's rank and the index; rank NO_RANK for a pair that forms no token, as another pair's cell differs in its high bits."""
        shift = F.get(shifts, (left * SECOND[0] + right * SECOND[1]) % n_shifts)
        cell = F.get(cells, (left * FIRST[0] + right * FIRST[1] + shift) % n_cells)
        rank = F.least(cell.bitwiseXOR((left * (1 << 16) + right) * (1 << 16)), F.lit(NO_RANK))
        return F.shiftleft(rank, RANK_BITS) + left + index * INDEX

    def merged(now: Column, p: Column, new: Column) -> Column:
        """now with the elements p and p + 1 as one of id new."""
        placed = lambda x, i: (
            F.when(i > p, x - INDEX)
            .when(i < p - 1, x)
            .when(i == p, element(new, id_of(F.get(now, p + 2)), i))
            .otherwise(element(id_of(x), new, i))
        )
        return F.transform(_let(p + 1, lambda q: F.filter(now, lambda x, i: i != q)), placed)

    def step(now: Column, _: Column) -> Column:
        index = lambda least: F.shiftright(least, 16).bitwiseAND(F.lit((1 << RANK_BITS - 16) - 1)).cast("int")
        merge = lambda least: _let(index(least), lambda p: _let(F.shiftright(least, RANK_BITS), lambda new: merged(now, p, new)))
        return _let(F.array_min(now), lambda least: F.when(least < NO_RANK << RANK_BITS, merge(least)).otherwise(now))

    ranked = lambda ids: F.transform(ids, lambda x, i: element(x, F.get(ids, i + 1), i))
    folded = _let(start, lambda ids: F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), ranked(ids), step))
    return F.transform(folded, lambda x: id_of(x).cast("int"))


def decode(ids: np.ndarray, tables: RankMap) -> bytes:
    """The bytes that token ids stand for: their binary pieces, concatenated."""
    return runs(tables.bytes, tables.starts, tables.lengths, ids).tobytes()


def _java(pattern: str) -> str:
    """The pattern with white space as Unicode has it; Java's \\s is ASCII only."""
    spaces = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return pattern.replace(r"[^\s", "[^" + spaces).replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")


#: Letters, numbers and white space of U+0000 to U+00FF, fixed values.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r \x85\xa0"}


def _latin(pattern: str) -> str | None:
    """The pattern for texts of U+0000 to U+00FF without properties, which a faster module takes; None if it has others."""

    def inside(found: str) -> str:
        for name, members in LATIN.items():
            found = found.replace(name, members)
        return found

    def outside(part: str) -> str:
        for name, members in LATIN.items():
            if name == r"\s":
                part = part.replace(r"\S", f"[^{members}]")
            part = part.replace(name, f"[{members}]")
        return part

    parts = regex.split(r"(\[[^\]]*\])", pattern)
    whole = "".join(inside(x) if k % 2 else outside(x) for k, x in enumerate(parts))
    return None if regex.search(r"\\(?![trnx])", whole) else whole


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts a text into words."""
    find, latin = regex.compile(pattern).findall, _latin(pattern)
    if latin is None:
        return find
    narrow, wide = re.compile(latin).findall, re.compile("[^\0-\xff]").search
    return lambda text: narrow(text) if text.isascii() or not wide(text) else find(text)


def packed_words(rows: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by U+0000, their ids and numbers of ids, from words and ids with spaces between.

    Only Arrow and numpy hold them, as an object for each word and id takes some hundred MB of the driver.
    """
    words, ids, lengths = [], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for b in rows.to_batches():
        if not b.num_rows:
            continue
        whole = lambda c, by: pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c), by)[0]
        words.append(whole(b.column(0), "\0").as_buffer().to_pybytes())
        ids.append(np.fromstring(whole(b.column(1), " ").as_py(), np.int64, sep=" ").astype(np.uint16))
        lengths.append(pc.count_substring(b.column(1), " ").to_numpy().astype(np.int64) + 1)
    return b"\0".join(words), np.concatenate(ids), np.concatenate(lengths)


def common_words(docs: DataFrame, ranks_path: str, pattern: str, text: str, sample_docs: int = SAMPLE_DOCS, most: int = COMMON_WORDS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The commonest words of about sample_docs documents, drawn by a hash of the text: the words, their ids and numbers of ids.

    Of rows that repeat a drawn text, at most 2 * sample_docs count. The words change no result.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    place = F.pmod(F.xxhash64(text), F.lit(1 << 52)) / float(1 << 52)
    drawn = docs.select(text).where(place < share).limit(2 * sample_docs)
    found = drawn.select(F.explode(F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(0))).alias("w"))
    counted = found.where((F.octet_length("w") <= LONG) & ~F.col("w").contains("\0")).groupBy("w").count().where("count > 1")
    # Written first, so that no plan but one scan carries the tables.
    written = materialize(counted)
    settle(docs.sparkSession)
    sizes = written.groupBy("count").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("count")).collect()
    least, total = 0, 0
    for r in sizes:  # the least count whose words are all few enough
        total += r["words"]
        if total > most:
            break
        least = r["count"]
    tables = ["byte_ids", "shifts", "cells"]
    ids = F.array_join(fold_word(F.col("w"), ranks_path, tables).cast("array<string>"), " ")
    chosen = written.where(F.col("count") >= least) if least else written.orderBy(F.desc("count"), "w").limit(most)
    rows = _with_tables(chosen.repartition(FOLDERS), tables, ranks_path).select("w", ids.alias("ids")).toArrow()
    discard(written)
    return packed_words(rows)


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, text: str, row, fields: list[tuple[T.StructField, pa.DataType]], common: int, most_words: int) -> DataFrame:
    """docs without the text column, and the fields that row(ids, tables) gives for each text."""
    shared = docs.sparkSession.sparkContext.broadcast((rank_map(ranks_path), *common_words(docs, ranks_path, pattern, text, min(SAMPLE_DOCS, common // 8), common)))
    settle(docs.sparkSession)
    names = [c for c in docs.columns if c != text]
    optional = [T.StructField(c, docs.schema[c].dataType) for c in names]
    new_words, from_anew, in_row, ids_of_words, long_words, *tables = fresh(docs, "bpe_words", "bpe_anew", "bpe_places", "bpe_ids", "bpe_long", "bpe_byte_ids", "bpe_shifts", "bpe_cells")
    handed = [T.StructField(new_words, T.ArrayType(T.StringType())), T.StructField(from_anew, T.BooleanType()), T.StructField(in_row, T.BinaryType())]

    def cut(batches):
        common = [w for w in shared.value[1].decode().split("\0") if w]
        find, places, size, anew = cutter(pattern), defaultdict(), 0, True
        places.default_factory = places.__len__
        places.update(zip(common, range(len(common))))
        kinds = None
        for b in batches:
            texts, rest = b.column(b.schema.get_field_index(text)), [b.column(b.schema.get_field_index(c)) for c in names]
            kinds = kinds or [c.type for c in rest]
            start = 0
            while start < b.num_rows:
                known, rows, total = len(places), [], 0
                while start + len(rows) < b.num_rows and total < SLICE:
                    t = texts[start + len(rows)].as_py() or ""
                    words = find(t)
                    rows.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)).tobytes())
                    total += len(t) + 64
                new = list(islice(places, known, None))
                for k in range(0, len(new), WORDS_PER_ROW):
                    part = pa.array([new[k : k + WORDS_PER_ROW]], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([part, pa.array([anew]), pa.nulls(1, pa.binary()), *[pa.nulls(1, t) for t in kinds]], [f.name for f in handed] + names)
                    anew = False
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.bool_()), pa.array(rows, pa.binary()), *[c.slice(start, n) for c in rest]], [f.name for f in handed] + names)
                start += n
                size += sum(map(len, new))
                if len(places) > most_words + len(common) or size > MOST_BYTES:
                    places.clear()
                    places.update(zip(common, range(len(common))))
                    size, anew = 0, True

    words = F.col(new_words)
    folded = F.transform(words, lambda w: F.when(F.octet_length(w) <= LONG, fold_word(w, ranks_path, tables)))
    left = F.filter(words, lambda w: F.octet_length(w) > LONG)

    def look_up(batches):
        tables, _, flat, lengths = shared.value
        common, starts, waiting = (flat, lengths), np.cumsum(lengths) - lengths, []
        for b in batches:
            is_row = np.asarray(b.column(3).is_valid())
            bounds = [*np.flatnonzero(np.concatenate([[True], is_row[1:] != is_row[:-1]])).tolist(), b.num_rows] if b.num_rows else []
            for s, e in zip(bounds, bounds[1:]):
                if not is_row[s]:
                    for k in range(s, e):
                        if b.column(2)[k].as_py():
                            (flat, lengths), waiting = common, []
                        ids, rest = b.column(0)[k].values, iter(b.column(1)[k].as_py())
                        if ids.null_count:
                            waiting += [np.array(x.as_py() if x.is_valid else tables.fold(next(rest).encode()), np.uint16) for x in ids]
                        else:
                            waiting.append((ids.flatten().to_numpy().astype(np.uint16), np.diff(np.asarray(ids.offsets))))
                    continue
                if waiting:
                    parts = [x if isinstance(x, tuple) else (x, np.array([len(x)])) for x in waiting]
                    flat, lengths, waiting = np.concatenate([flat, *(p[0] for p in parts)]), np.concatenate([lengths, *(p[1] for p in parts)]), []
                    starts = np.cumsum(lengths) - lengths
                while s < e:
                    rows, n = [], 0
                    while n < BATCH_TOKENS and s + len(rows) < e:
                        ids = runs(flat, starts, lengths, np.frombuffer(b.column(3)[s + len(rows)].as_py(), np.uint32))
                        n += len(ids) + 64
                        rows.append(row(ids, tables))
                    own = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)]
                    yield pa.RecordBatch.from_arrays([c.slice(s, len(rows)) for c in b.columns[4:]] + own, [f.name for f in schema])
                    s += len(rows)

    schema = T.StructType(optional + [f for f, _ in fields])
    numbered = _with_tables(docs.mapInArrow(tidied(cut), T.StructType(handed + optional)), tables, ranks_path)
    return numbered.select(folded.alias(ids_of_words), left.alias(long_words), from_anew, in_row, *[F.col(f"`{c}`") for c in names]).mapInArrow(tidied(look_up), schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "token_ids", common: int = COMMON_WORDS, most_words: int = MOST_WORDS) -> DataFrame:
    """docs, all columns but the text, and the token ids of each whole text, array<int>.

    Null and empty texts have no ids. Special tokens' strings are ordinary text. Repeated rows stay,
    empty tables give no rows, words of any length are encoded whole. A column named like `into` is
    replaced.
    """
    field = T.StructField(into, T.ArrayType(T.IntegerType()))
    rest = docs.select([c for c in docs.columns if c != into or c == text])
    return _mapped(rest, ranks_path, pattern, text, lambda ids, _: (ids.astype(np.int32),), [(field, pa.list_(pa.int32()))], common, most_words)


def decode_ids(ids: Column, ranks_path: str) -> Column:
    """Token ids back to bytes, as a Spark expression: binary pieces concatenated. Null for null."""
    tables = rank_map(ranks_path)
    whole, ends = tables.bytes.tobytes().hex(), np.cumsum(tables.lengths).tolist()
    pieces = F.split(F.lit(" ".join(whole[2 * a : 2 * b] for a, b in zip([0, *ends], ends))), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, doc: str = "doc_id", text: str = "text", common: int = COMMON_WORDS, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: its id, n_tokens, ids_sha256, decoded_sha256; the cases are those of encode().

    The ids are hashed as little-endian unsigned 32-bit integers, then decoded, and the decoded
    bytes are hashed. Null ids of documents stay null. Of docs only id and text are read.
    """

    def row(ids, tables):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, tables)).hexdigest()

    fields = [(T.StructField("n_tokens", T.LongType()), pa.int64()), (T.StructField("ids_sha256", T.StringType()), pa.string()), (T.StructField("decoded_sha256", T.StringType()), pa.string())]
    rows = docs.select(F.col(doc), F.col(text).alias("whole_text"))
    return _mapped(rows, ranks_path, pattern, "whole_text", row, fields, common, most_words)
