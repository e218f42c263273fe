"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut at the sequence size; what is kept of
each piece is its place, length and checksum.  Only the histogram of lengths,
at most one count for each length, reaches the driver.  It is packed there by
pattern: lengths are placed longest first, each into the pattern with the
fewest tokens, whose count is split as needed.  Patterns are then joined back
to the pieces by rank: the pieces of one length are numbered over the whole
table, and each slot of a pattern takes a range of these numbers.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.llm.words import released, text_slices
from subsidia.session import materialize

SIZE = 1024
#: Pieces of one length that a task numbers at a time, about.
PER_BUCKET = 100_000
#: Bytes that a worker's remembered chunks may take, and the longest chunk that is remembered.
CACHE_BYTES, CACHED_LENGTH = 40_000_000, 64
#: Bytes of text tokenised at once, and documents in one Arrow batch.
SLICE, BATCH_ROWS = 2 << 20, 2000
#: All that a tokenizer may take for white space, and a few more; for the patterns of Arrow.
_SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NEWLINE = 198


def _load(tokenizer_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def special_tokens(tokenizer_path: str) -> list[str]:
    return [t.content for t in _load(tokenizer_path).get_added_tokens_decoder().values()]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Chunks:
    """Ids of chunks that a worker has met, in one buffer; when that is full, only those of the last slice stay."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.start, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.bytes = 0

    def add(self, chunks: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.place.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size, self.flat = np.concatenate([self.size, sizes]), np.concatenate([self.flat, flat])
        # A dictionary entry, its string of one to four bytes a character, and the three arrays.
        self.bytes += 4 * len(flat) + sum(map(len, chunks)) + 180 * len(chunks)


class ByteLevelTokenizer:
    """Ids of a byte-level BPE vocabulary.

    A blank or line feed between two characters that are no white space always
    begins a pre-token, so a text without other runs of white space is divided
    there, and each distinct chunk of a slice of texts is encoded once: all of
    them in one call, joined by line feeds, or taken from those remembered.
    Other texts are encoded whole, those that contain a special token by the
    ``tokenizers`` file, which knows it and is loaded when the first such text
    is met.
    """

    _LONG_RUN = re.compile(r"\s{1000}")
    _WHOLE = rf"^[{_SPACES}]|[{_SPACES}][{_SPACES}]$| $|[{_SPACES}][{_SPACES}][{_SPACES}]| [{_SPACES}]|[{_SPACES}] "

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str, special: list[str] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokenizer_path, self.tokenizer = tokenizer_path, None
        self.special = special_tokens(tokenizer_path) if special is None else special
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # Only where the vocabulary has a line feed as an id of its own can chunks be joined by it.
        self.plain = self.encode("\n") == [_NEWLINE]
        self.chunks = _Chunks()

    def whole(self, text: str) -> list[int]:
        """Ids of one text; ``tiktoken`` does not stand very long runs of white space."""
        if any(s in text for s in self.special) or self._LONG_RUN.search(text):
            self.tokenizer = self.tokenizer or _load(self.tokenizer_path)
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.encode(text)

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by ``end``, and how many each has with that."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        alone = pc.match_substring_regex(texts, self._WHOLE)
        for special in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, special))
        alone = alone.to_numpy(zero_copy_only=False) | (not self.plain)
        if not alone.any():
            return self._divided(texts, end)
        each = [np.array([*self.whole(t), end], np.uint32) for t in texts.filter(pa.array(alone)).to_pylist()]
        flat, sizes = np.concatenate(each), np.empty(len(texts), np.int64)
        sizes[alone] = [len(e) for e in each]
        starts = np.empty(len(texts), np.int64)
        starts[alone] = np.cumsum(sizes[alone]) - sizes[alone]
        if not alone.all():
            divided, sizes[~alone] = self._divided(texts.filter(pa.array(~alone)), end)
            starts[~alone] = len(flat) + np.cumsum(sizes[~alone]) - sizes[~alone]
            flat = np.concatenate([flat, divided])
        return flat[_ranges(starts, sizes)], sizes

    def _divided(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that can be divided.

        Each text gets a line feed in front and each line feed a blank, so that
        every chunk says itself whether a line feed or a blank was before it.
        The first line feed's id of a text makes room for the last text's end.
        """
        line, none = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(line, texts, none), "\n", " \n"), " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes = lists.flatten().dictionary_encode()
        sizes, starts, flat = self._of_chunks(codes.dictionary)
        codes = codes.indices.to_numpy()
        each = sizes[codes]
        out = flat[_ranges(starts[codes], each)]
        own = np.add.reduceat(each, bounds[:-1])
        out[(np.cumsum(own) - own)[1:]] = end
        return np.append(out[1:], np.uint32(end)), own

    def forget(self) -> None:
        """Lets go of the chunks met, so that a worker holds none while it does other work."""
        self.chunks = _Chunks()

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each chunk has, where they begin, and the ids."""
        names = chunks.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.chunks.place.get, names, repeat(-1)), np.int64, len(names))
        new, known = np.flatnonzero(place < 0), place >= 0
        sizes, starts = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        sizes[known], starts[known] = self.chunks.size[place[known]], self.chunks.start[place[known]]
        sizes[new], starts[new], fresh = self._encoded(chunks.take(pa.array(new)))
        starts[new] += len(self.chunks.flat)
        flat = np.concatenate([self.chunks.flat, fresh])
        if self.chunks.bytes > CACHE_BYTES:
            self.chunks, new = _Chunks(), np.arange(len(names))
        kept = new[pc.binary_length(chunks).to_numpy()[new] <= CACHED_LENGTH]
        self.chunks.add([names[i] for i in kept.tolist()], sizes[kept], flat[_ranges(starts[kept], sizes[kept])])
        return sizes, starts, flat

    def _encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for new chunks: one call for all, joined by line feeds, and one each for those with other white space."""
        line = pc.starts_with(chunks, "\n")
        bare = pc.if_else(line, pc.utf8_slice_codeunits(chunks, 1), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), chunks, pa.scalar("", pa.large_string())))
        odd = pc.or_(pc.match_substring_regex(chunks, f"(?s)^.?$|.[{_SPACES}]|^[^\n][{_SPACES}]"), pc.match_substring_regex(bare, f"^[{_SPACES}]$"))
        line, odd = line.to_numpy(zero_copy_only=False), np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        bare = bare.to_numpy(zero_copy_only=False).tolist()
        singly = [np.array((_NEWLINE,) * bool(line[k]) + tuple(self.encode(bare[k])) if bare[k] != " " else [], np.uint32) for k in odd.tolist()]
        for k in odd.tolist():
            bare[k] = "x"
        joined = np.array(self.encode("\n" + "\n".join([*bare, "x"])), np.uint32)
        cuts = np.flatnonzero(joined == _NEWLINE)
        starts, sizes = cuts[: len(bare)] + ~line, np.diff(cuts, append=0)[: len(bare)] - ~line
        sizes[odd] = [len(x) for x in singly]
        starts[odd] = len(joined) + np.cumsum(sizes[odd]) - sizes[odd]
        return sizes, starts, np.concatenate([joined, *singly])


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used.

    Lengths go longest first, each piece into the pack with the fewest tokens
    if it fits there (if not, it fits in none) and else into a new pack, which
    then takes more pieces of that length while they fit.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    used: list[int] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        total = sum(pattern)
        if not open_packs[total]:
            heapq.heappush(used, total)
        open_packs[total].append((pattern, count))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not used or used[0] + length > size:
                most = size // length
                full, over = divmod(left, most)
                if full:
                    put((length,) * most, full)
                if over:
                    put((length,) * over, 1)
                break
            total = used[0]
            pattern, count = open_packs[total].pop()
            taken = min(count, left)
            if count > taken:
                open_packs[total].append((pattern, count - taken))
            elif not open_packs[total]:
                heapq.heappop(used)
            put((*pattern, length), taken)
            left -= taken
    return [pack for packs in open_packs.values() for pack in packs]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length, for ranges of ranks in order: first rank, sequence of the first rank, offset."""
    rows, sequence, ranks = defaultdict(list), 0, defaultdict(int)
    for pattern, count in sorted(patterns, reverse=True):
        offset = 0
        for length in pattern:
            rows[length].append((ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, np.int64).T) for length, x in rows.items()}


_TOKENIZERS: dict[str, ByteLevelTokenizer] = {}


def _tokenizer(*at) -> ByteLevelTokenizer:
    """One tokenizer for all tasks of a worker."""
    key = repr(at)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = ByteLevelTokenizer(*at)
    return _TOKENIZERS[key]


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, *, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``size`` tokens.

    Each document's ids are followed by ``end_id``; documents of more than
    ``size`` tokens are cut there.  Returns one row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset.  A null or empty text
    is the end id alone.  Repeated rows are packed each, as are rows that share
    an id or have none, however many; very long texts are tokenised whole; an
    empty table gives no pieces; other columns are ignored.
    """
    id_type, special = dict(docs.dtypes)[id_col], special_tokens(tokenizer_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, made = _tokenizer(tokenizer_path, ranks_path, pattern, special), 0
        for batch in batches:
            for at, to in text_slices(batch["text"], SLICE):
                flat, own = tokenizer.ids(batch["text"].slice(at, to - at), end_id)
                pieces = (own + size - 1) // size
                which = np.repeat(np.arange(len(own)), pieces)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(own[which] - start, size)
                data, first = memoryview(flat.astype("<u4")).cast("B"), (np.cumsum(own) - own)[which] + start
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(which + at)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(own[which]), pa.array(np.arange(made, made + len(which)))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number"])
                made += len(which)
        tokenizer.forget()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(released(cut), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, number long"), "pieces", arrow_rows=BATCH_ROWS)
    buckets = max(64, pieces.count() // PER_BUCKET)
    # Pieces that are equal in all else are told apart by their number within the task that made them, so no bucket gets them all.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "number"), F.lit(buckets)))
    histogram = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("pieces")), "histogram")
    counts = {r["length"]: r["n"] for r in histogram.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(pack_histogram(counts, size)))

    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = histogram.select("length", "bucket", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "number")))
    ranked = ranked.join(materialize(offsets, "offsets"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before") - 1)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                first, base, at = slots.value[int(lengths[some[0]])]
                k = np.searchsorted(first, ranks[some], "right") - 1
                sequence[some], offset[some] = base[k] + ranks[some] - first[k], at[k]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInPandas(released(placed), schema).withColumnRenamed("doc_id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_public(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_public(docs: DataFrame) -> DataFrame:
    """Packing with the public byte-level vocabulary."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
