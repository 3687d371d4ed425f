"""Packing documents into training sequences: shortest-pack-first over the histogram of lengths.

Each document becomes the ids of its text and an end id. It is cut into pieces: as many full sequences as it fills, and
the rest. The histogram of piece lengths (at most as many bins as a sequence has tokens) is packed on the driver: lengths
are placed longest first, each into the packs that are shortest so far and still have room, with counts for each packing
pattern rather than single documents. The placements are joined back to the pieces by their rank among pieces of their
length. Ranks come from counts for each (length, hash slice), so that a length that a third of all pieces have is spread
over many tasks.

Cases: a null or empty text has the end id alone and is packed like any other; a very long text is cut into full sequences
and a rest; pieces of one length are told apart by slice, doc_id, start and checksum, and of those alike in all any may come first; repeated rows and repeated ids are packed
each; an empty table gives no piece. Columns of other names are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, release, remembered, slices, written

#: Rows of one hash slice of a length, about; placements up to which they are broadcast.
SLICE, BROADCAST = 2_000, 200_000


#: Marks of ASCII but the apostrophe: a run of them after a letter, at the end of a word, is a token text of its own.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

#: Text bytes whose words are told apart at once.
AT_ONCE = 4 << 20


#: Letters before this one are composed, and lower-case one by one, but for the dotted capital.
LATIN_END, DOTTED = "\u0250", "\u0130"


def _ranges(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranges of values, end to end: counts[k] of them from starts[k] on."""
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of these sizes, end to end in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Ids:
    """Token ids as little-endian 32-bit bytes. White space never lies within a token, nor does the border between a letter and marks, so words are encoded once and remembered (a bounded number of them). The words of many texts are told apart and looked up in Arrow arrays; Python sees new ones only."""

    def __init__(self, vocabulary: str, most: int):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.bare = Tokenizer(self.tokenizer.model)  # without normalising and splitting, which lower-case Latin letters don't need
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Over the tasks of a Python worker: the words, where the ids of each begin (and the last end), and the ids. The first word is the empty one.
        self.kept = remembered("packing").setdefault(vocabulary, {"words": pa.array([b""], pa.binary()), "starts": np.zeros(2, np.int64), "ids": np.zeros(0, np.uint32)})
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words. Words of letters alone are encoded in one text, as each of them ends with the next token that ends a word; the others one by one."""
        read = [x.decode("utf-8", "replace") for x in words]
        letters = [k for k, x in enumerate(read) if x.isalpha()]
        latin = [k for k in letters if max(read[k]) < LATIN_END and DOTTED not in read[k]]
        for k in latin:
            read[k] = read[k].lower()
        out: list = [None] * len(words)
        for tokenizer, those in ((self.bare, latin), (self.tokenizer, sorted(set(letters).difference(latin)))):
            for at in range(0, len(those), 1000):
                some = those[at : at + 1000]
                ids = tokenizer.encode_batch_fast([" ".join([read[k] for k in some])], add_special_tokens=False)[0].ids
                stops = [k + 1 for k, i in enumerate(ids) if i in self.ends]
                if len(stops) == len(some):
                    packed, start = array("I", ids).tobytes(), 0
                    for k, stop in zip(some, stops, strict=True):
                        out[k] = packed[4 * start : 4 * stop]
                        start = stop
        rest = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([read[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word up to the marks after its last letter, and those marks; or the whole word and nothing."""
        stems = pc.ascii_rtrim(words, MARKS)
        sizes, whole = pc.binary_length(stems).to_numpy(), pc.binary_length(words).to_numpy()
        data, starts = flat(pa.RecordBatch.from_arrays([words], ["word"]), "word")
        last = data[np.maximum(starts[:-1] + sizes - 1, 0)] if len(data) else np.zeros(len(words), np.uint8)
        special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)  # special tokens end with marks
        apart = (sizes > 0) & (sizes < whole) & (last >= ord("a")) & (last <= ord("z")) & ~special
        sizes = np.where(apart, sizes, whole)
        return _binary(_ranges(data, starts[:-1], sizes), sizes), _binary(_ranges(data, starts[:-1] + sizes, whole - sizes), whole - sizes)

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place of each word among those remembered; new ones are learned."""
        kept = self.kept
        for fewer in (max(self.most // 2, 1), 1):  # the words learned first are the frequent ones; all go if long ones are among them
            if len(kept["words"]) > self.most or kept["words"].nbytes > 64 * self.most:
                kept["words"], kept["starts"] = pa.concat_arrays([kept["words"][:fewer], kept["words"][:0]]), kept["starts"][: fewer + 1].copy()
                kept["ids"] = kept["ids"][: kept["starts"][-1]].copy()
        n, found = len(kept["words"]), pc.index_in(words, value_set=kept["words"])
        new = words.filter(found.is_null())
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            ids = self._learn(new.to_pylist())
            at[found.is_null().to_numpy(zero_copy_only=False)] = np.arange(n, n + len(new))
            kept["words"] = pa.concat_arrays([kept["words"], new])
            kept["starts"] = np.concatenate([kept["starts"], kept["starts"][-1] + np.cumsum([len(x) // 4 for x in ids])])
            kept["ids"] = np.concatenate([kept["ids"], np.frombuffer(b"".join(ids), np.uint32)])
        return at

    def of(self, some: pa.Array) -> list[bytes]:
        """The ids of each text; a null one has none."""
        some = some.cast(pa.binary()).fill_null(b"").view(pa.string())
        # The vocabulary is of lower case; only its special tokens are told by case.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(some, "<|"), some, pc.ascii_lower(some)))
        words = lists.flatten().dictionary_encode()
        stems, marks = self._parts(words.dictionary)
        parts = pa.concat_arrays([stems, marks]).dictionary_encode()
        known = self._known(parts.dictionary)[parts.indices.to_numpy().reshape(2, -1).T.ravel()]  # stem and marks of each word in turn
        starts, ids = self.kept["starts"], self.kept["ids"]
        sizes = starts[known + 1] - starts[known]
        ids, sizes = _ranges(ids, starts[known], sizes), sizes.reshape(-1, 2).sum(1)  # of the different words
        codes = words.indices.to_numpy()
        firsts, counts = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        del lists, words, stems, marks, parts, known, codes
        pa.default_memory_pool().release_unused()
        packed = _ranges(ids, firsts, counts).astype("<u4", copy=False).tobytes()
        return [packed[4 * a : 4 * b] for a, b in itertools.pairwise(ends.tolist())]


def _gathered(batches):
    """The rows in batches of AT_ONCE text bytes, about (or one row): small ones would have the remembered words read again for each."""
    held, size = [], 0
    for part in (part for batch in batches for part in slices(batch, AT_ONCE)):
        n = part.column("text").nbytes
        if held and size + n > AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int, with_ids: bool = False, words: int = 600_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; with_ids also the ids. vocabulary: a path, or the name of a public vocabulary."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        release("packing")
        encoder = Ids(_vocabulary(vocabulary), words)
        for batch in _gathered(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.of(batch.column("text")), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n) + ((np.frombuffer(piece, "<u4").tolist(),) if with_ids else ()))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)
        release("packing")

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def place(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Shortest-pack-first over the histogram. Placements (length, first rank, count, first sequence, offset): the pieces of ranks from the first on go to the sequences from the first on, one each.

    A group of packs alike is (first sequence, count, filled). Of equally short groups the one with the first sequence is filled first.
    """
    out, packs, fresh = [], [], 0  # packs: heap of (filled, first sequence, count); the shortest has the most room
    for n, left in sorted(histogram.items(), reverse=True):
        rank = 0
        while left:
            if packs and packs[0][0] + n <= room:
                filled, first, count = heappop(packs)
                used = min(left, count)
                if used < count:
                    heappush(packs, (filled, first + used, count - used))
            else:
                filled, first, used = 0, fresh, left
                fresh += left
            out.append((n, rank, used, first, filled))
            if filled + n < room:
                heappush(packs, (filled + n, first, used))
            rank, left = rank + used, left - used
    return out


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", length: int = 4096, end_id: int = 2, with_ids: bool = False, words: int = 600_000) -> DataFrame:
    """The pieces of docs with the sequence and the offset at which each lies. words: how many a Python worker remembers."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, length, end_id, with_ids, words), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    parts = spark.createDataFrame([(n, -(-c // SLICE)) for n, c in histogram.items()] or [(0, 1)], "length long, _slices long")
    sliced = cut.join(F.broadcast(parts), "length").withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start"), F.col("_slices"))).drop("_slices")
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sliced.groupBy("length", "_slice").count().select("length", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = sliced.withColumn("_rank", F.row_number().over(within)).join(firsts, ["length", "_slice"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    rows = place(histogram, length)
    placed = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "_length long, _first long, _count long, _sequence long, offset long")
    placed = F.broadcast(placed) if len(rows) <= BROADCAST else placed
    joined = ranked.join(placed, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")))
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset", *["ids"] * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=1_000_000)
