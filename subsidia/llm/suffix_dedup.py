"""Removal of strings that stand earlier in the corpus, by prefix-free parsing.

A rolling hash over ``GRAM`` bytes sets triggers: in each string of ``length``
bytes the position with the least hash, the first of equals, is its trigger.
Triggers depend on the string alone, so equal strings have theirs at the same
place.  The strings with one trigger are consecutive; the text they cover is a
phrase.  A string that starts in a phrase is a suffix of what leads to the
trigger, and then what follows it, so two strings can be equal only in
phrases with the same trigger.

Phrases with a trigger that occurs once hold nothing repeated.  Equal phrases
are one entry of the dictionary: all strings of the later ones stand earlier.
What is left are entries with the same trigger and unlike surroundings.  They
are halved down: parts of 16, 4 and at last 1 string starts are compared the
same way, each time without those whose common core no other entry shares.
The single strings that remain are put in corpus order, first by the suffix up
to the trigger, then by what follows it; as no such suffix is the beginning of
another, this is their order as strings, and equal ones are neighbours.

Only equality within ``length`` bytes decides, so entries are told apart by
hashes of 128 bits until the last step, which compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.llm.exact_dedup import from_files, located
from subsidia.llm.words import BATCH_ROWS, raw_bytes, released, scrambled, text_slices
from subsidia.session import materialize

LENGTH, GRAM = 100, 32
#: Starts in one part of an entry, from level to level.
PARTS = (16, 4, 1)
#: Triggers, or parts of documents, that are broadcast at most, counted first; more are joined by a shuffle.
MAX_BROADCAST = 4_000_000
#: Bytes of a very long text worked on at once.
PIECE = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolled(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place, by doubling."""
    out, base, size = data.astype(np.uint64) + np.uint64(1), int(_BASE), 1
    while size < GRAM:
        out = out[:-size] * np.uint64(base) + out[size:]
        base, size = base * base % 2**64, size * 2
    return scrambled(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def phrases(rolled: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger of each phrase of the texts that end at ``ends`` (with a leading 0).

    The starts of all strings of ``length`` bytes within a text are divided
    among its phrases.
    """
    width = length - GRAM + 1
    count = len(rolled) - width + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3
    least = _least(rolled, width)
    crossing = np.zeros(count + 1, np.int64)
    stop = np.minimum(ends[1:], count)
    np.add.at(crossing, np.minimum(np.maximum(ends[:-1], ends[1:] - length + 1), count), 1)
    np.add.at(crossing, stop, -1)
    valid = np.cumsum(crossing)[:count] == 0
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (rolled[: count - 1] == least[:-1]) | (least[1:] != least[:-1])
    first = valid.copy()
    first[1:] &= ~valid[:-1] | last[:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    trigger = last.copy()
    for at in np.array_split(np.flatnonzero(rolled[last] != least[last]), max(1, len(last) // 20_000)):
        trigger[at] += rolled[last[at][:, None] + np.arange(width)].argmin(1)
    return first, last, trigger


def _pieces(rolled: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes that cover ``length`` bytes from each start."""
    return [rolled[start + k] for k in [*range(0, length - GRAM, GRAM), length - GRAM]]


def _mixed(parts: list[np.ndarray], seed: int) -> np.ndarray:
    out = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        out = scrambled(out * _BASE + part)
    return out


def _keys(rolled: np.ndarray, start: np.ndarray, more: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the text that ``more`` + 1 strings from ``start`` cover; ``more`` is below ``length``."""
    parts = [*_pieces(rolled, start, length), *_pieces(rolled, start + more, length), more.astype(np.uint64)]
    return _mixed(parts, 1), _mixed(parts, 2)


def _pieced(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int | None]]:
    """Rows from and to, their bytes and ends; of texts longer than ``PIECE`` one piece after the other, with where it begins.

    Starts of strings belong to the piece in whose first ``PIECE`` bytes they
    lie; what a string needs beyond follows.
    """
    for at, to in text_slices(texts):
        data, ends = raw_bytes(texts.slice(at, to - at))
        if to == at + 1 and len(data) > PIECE + 2 * length:
            for shift in range(0, len(data), PIECE):
                piece = data[shift : shift + PIECE + 2 * length]
                if len(piece) >= length:
                    yield at, to, piece, np.array([0, len(piece)]), shift
        elif len(data) >= length:
            yield at, to, data, ends, None


def _within(found: tuple[np.ndarray, ...], whole: bool) -> tuple[np.ndarray, ...]:
    """Phrases without the starts that belong to the next piece."""
    if whole:
        return found
    start, last, trigger = found
    own = start < PIECE
    return start[own], np.minimum(last[own], PIECE - 1), trigger[own]


def _settled(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of the equal entries of a batch the first, and of the later ones their texts, joined where they touch.

    ``doc_id`` is with ``no_id``, true for rows without one, which come last.
    """
    order = np.lexsort((rows["start"], rows["place"], rows["doc_id"], rows["no_id"], rows["two"], rows["one"]))
    one, two = rows["one"][order], rows["two"][order]
    later = np.zeros(len(order), bool)
    later[order[1:]] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    sure = {k: v[later] for k, v in rows.items()}
    order = np.lexsort((sure["start"], sure["place"], sure["doc_id"], sure["no_id"]))
    sure = {k: v[order] for k, v in sure.items()}
    if len(order):
        end = sure["start"] + sure["more"]
        same = (sure["place"][1:] == sure["place"][:-1]) & (sure["doc_id"][1:] == sure["doc_id"][:-1]) & (sure["no_id"][1:] == sure["no_id"][:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same | (sure["start"][1:] > end[:-1] + 1)]))
        tail = np.append(head[1:], len(end)) - 1
        sure = {k: v[head] for k, v in sure.items()} | {"more": end[tail] - sure["start"][head]}
    return {k: v[~later] for k, v in rows.items()}, sure


def _entries(batch: pa.RecordBatch, length: int, part: int, chosen: np.ndarray | None) -> dict[str, np.ndarray]:
    """Entries of all texts of a batch: whole phrases with a chosen trigger, or the parts of the entries in ``entries``."""
    out: list[dict] = []
    ids = batch["doc_id"]
    no_id, ids, places = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).cast(pa.int64()).to_numpy(), batch["place"].to_numpy()
    for at, to, data, ends, shift in _pieced(batch["text"], length):
        rolled = _rolled(data)
        if part == 0:
            start, last, trigger = _within(phrases(rolled, ends, length), shift is None)
            core = rolled[trigger]
            if chosen is not None:
                kept = chosen[np.minimum(np.searchsorted(chosen, core), max(0, len(chosen) - 1))] == core if len(chosen) else np.zeros(len(core), bool)
                start, last, trigger, core = (x[kept] for x in (start, last, trigger, core))
            more, doc = last - start, np.searchsorted(ends, start, "right") - 1
        else:
            own = batch["entries"].slice(at, to - at)
            doc = np.repeat(np.arange(to - at), np.diff(own.offsets.to_numpy()))
            start, more, trigger = (own.flatten().field(k).to_numpy().astype(np.int64) for k in ("start", "more", "trigger"))
            if shift is not None:
                mine = (start >= shift) & (start < shift + PIECE)
                start, more, trigger, doc = start[mine] - shift, more[mine], trigger[mine] - shift, doc[mine]
            # Distances to the trigger: from near to far, in parts of so many.
            trigger, far = trigger + ends[doc], trigger - start
            near = far - more
            count = far // part - near // part + 1
            which = np.repeat(np.arange(len(far)), count)
            block = near[which] // part + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            doc, trigger = doc[which], trigger[which]
            near, far = np.maximum(near[which], block * part), np.minimum(far[which], block * part + part - 1)
            start, more = trigger - far, far - near
            # All strings of a part have these bytes in common, also those that this entry does not have.
            core = _mixed(_pieces(rolled, trigger - block * part, length - part + 1), 3)
        before = ends[doc] - (shift or 0)
        one, two = _keys(rolled, start, more, length)
        row = {"one": one, "two": two, "core": core, "doc_id": ids[at:to][doc], "no_id": no_id[at:to][doc], "place": places[at:to][doc], "start": start - before, "more": more, "trigger": trigger - before}
        if part == 1:
            row["suffix"] = np.array([data[a : t + GRAM].tobytes() for a, t in zip(start.tolist(), trigger.tolist())] + [None], object)[:-1]
            row["following"] = np.array([data[t : a + length].tobytes() for a, t in zip(start.tolist(), trigger.tolist())] + [None], object)[:-1]
        out.append(row)
    return {k: np.concatenate([r[k] for r in out]) for k in out[0]} if out else {}


def _found(rows: DataFrame, length: int, part: int, id_type: str, chosen=None) -> DataFrame:
    """One row for each entry, ``sure`` if an equal one stands earlier in its batch.

    Rows that are sure have keys of their own: nothing about them is open, so
    they don't go to the task of a frequent entry.
    """
    texts = ", suffix binary, following binary" if part == 1 else ""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _entries(batch, length, part, chosen.value if chosen is not None else None)
            if not rows:
                continue
            for group, sure in zip(_settled(rows), (False, True)):
                if sure:
                    group["one"], group["two"] = _mixed([group["place"].view(np.uint64), group["start"].astype(np.uint64)], 4), group["doc_id"].view(np.uint64)
                columns = {k: pa.array(group[k].view(np.int64)) for k in ("one", "two", "core")}
                columns |= {"doc_id": pa.array(group["doc_id"], mask=group["no_id"]).cast(kinds[id_type]), "place": pa.array(group["place"])}
                columns |= {k: pa.array(group[k].astype(np.int32)) for k in ("start", "more", "trigger")} | {"sure": pa.array(np.full(len(group["one"]), sure))}
                if part == 1:
                    columns |= {k: pa.array([None] * len(group[k]) if sure else group[k].tolist(), pa.binary()) for k in ("suffix", "following")}
                yield pa.RecordBatch.from_pydict(columns)

    kinds = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    return rows.mapInArrow(released(made), f"one long, two long, core long, doc_id {id_type}, place long, start int, more int, trigger int, sure boolean{texts}")


def _triggers(rows: DataFrame, length: int) -> DataFrame:
    """Hashes of the triggers of more than one phrase."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, data, ends, shift in _pieced(batch["text"], length):
                rolled = _rolled(data)
                found.append(rolled[_within(phrases(rolled, ends, length), shift is None)[2]])
            core, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["core", "n"])

    counted = rows.select("text").mapInArrow(released(made), "core long, n int").groupBy("core").agg(F.sum("n").alias("n"))
    return materialize(counted.where("n > 1").select("core"), "suffix-triggers", arrow_rows=BATCH_ROWS)


def _compared(found: DataFrame, part: int, name: str) -> DataFrame:
    """(core, doc_id, place, start, more, trigger, first): the first of equal entries, and the later ones."""
    keys = ["suffix", "following", F.when(F.col("sure"), F.col("one"))] if part == 1 else ["one", "two"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "place", "start")) == 1
    found = found.withColumn("first", first & ~F.col("sure"))
    return materialize(found.select("doc_id", "place", "start", "more", "first", *[F.when(F.col("first"), F.col(c)).alias(c) for c in ("core", "trigger")]), name, arrow_rows=BATCH_ROWS)


def _by_document(rows: DataFrame, values: list[str], name: str) -> tuple[DataFrame, int]:
    own = rows.groupBy("doc_id", "place").agg(F.collect_list(F.struct(*values)).alias("entries"))
    own = materialize(own.select(F.col("doc_id").alias("own_id"), F.col("place").alias("own_place"), "entries"), name)
    return own, own.agg(F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()[0]


def _joined(rows: DataFrame, own: DataFrame, how: str, few: bool) -> DataFrame:
    """Rows with what belongs to their document; where that is little, texts stay where they are."""
    side = F.broadcast(own) if few else own
    return rows.join(side, (F.col("place") == F.col("own_place")) & F.col("doc_id").eqNullSafe(F.col("own_id")), how).drop("own_id", "own_place")


def repeated_runs(rows: DataFrame, id_type: str, length: int = LENGTH, most: int = MAX_BROADCAST) -> tuple[DataFrame, bool]:
    """Maximal repeated runs (start, end) of each document that has any, from (doc_id, place, text); and if they are few."""
    triggers = _triggers(rows, length)
    if triggers.count() <= most:
        chosen = rows.sparkSession.sparkContext.broadcast(np.sort(triggers.toArrow()["core"].to_numpy().view(np.uint64)))
        found = _found(rows, length, 0, id_type, chosen)
    else:
        found = _found(rows, length, 0, id_type).join(triggers, "core", "left_semi")
    levels = [_compared(found, 0, "suffix-phrases")]
    for part in PARTS:
        entries = levels[-1].where("first")
        shared = entries.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        own, size = _by_document(entries.join(shared, "core", "left_semi"), ["start", "more", "trigger"], f"suffix-open-{part}")
        if size == 0:
            break
        levels.append(_compared(_found(_joined(rows, own, "inner", size <= most), length, part, id_type), part, f"suffix-parts-{part}"))
    repeats = None
    for level in levels:
        later = level.where("NOT first").select("doc_id", "place", "start", (F.col("start") + F.col("more") + length).alias("end"))
        repeats = later if repeats is None else repeats.unionByName(later)
    return _merged(repeats, most)


def _merged(repeats: DataFrame, most: int) -> tuple[DataFrame, bool]:
    own, _ = _by_document(repeats, ["start", "end"], "suffix-repeats")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["entries"]
            counts = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(counts)), counts)
            start, end = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in ("start", "end"))
            order = np.lexsort((start, doc))
            start, end, doc = start[order], end[order], doc[order]
            # The furthest end so far in each document: documents are set apart by a large step.
            step = int(end.max()) + 1 if len(end) else 1
            reach = np.maximum.accumulate(end + doc * step) - doc * step
            head = np.ones(len(start), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
            at = np.flatnonzero(head)
            tail = np.append(at[1:], len(start))[: len(at)] - 1
            values = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array(reach[tail].astype(np.int32))], ["start", "end"])
            offsets = pa.array(np.searchsorted(doc[at], np.arange(len(counts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["own_id"], batch["own_place"], pa.ListArray.from_arrays(offsets, values)], ["own_id", "own_place", "runs"])

    id_type = dict(own.dtypes)["own_id"]
    runs = materialize(own.mapInArrow(released(made), f"own_id {id_type}, own_place long, runs array<struct<start:int,end:int>>"), "suffix-runs")
    return runs, (runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]) <= most


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MAX_BROADCAST) -> DataFrame:
    """Documents without the bytes that a string of ``length`` bytes covers which also starts earlier.

    Returns one row for each input row: id, n_bytes (of the text in UTF-8),
    runs (start and end of what is removed, apart from one another) and kept
    (the other bytes).  Earlier is a smaller id, or the same row and an earlier
    start; strings are those of the input, and none crosses documents.  Null
    ids come last; rows of one id come in an order that is fixed but arbitrary,
    so of repeated rows one keeps its text.  Null counts as the empty text,
    which has nothing to remove, as have texts below ``length`` bytes.  Very
    long texts are read whole, piece by piece; an empty table gives an empty
    result, and other columns are ignored.  Ids are whole numbers.
    """
    if length < GRAM + max(PARTS):
        raise ValueError(f"length must be {GRAM + max(PARTS)} at least")
    id_type = dict(docs.dtypes)[id_col]
    rows = located(from_files(docs), [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")])
    rows = rows.select("doc_id", "text", F.xxhash64("file", "row").alias("place"))
    runs, few = repeated_runs(rows, id_type, length, most)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, runs in zip(batch["text"], batch["runs"]):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if runs.is_valid:
                    change = np.zeros(len(data) + 1, np.int8)
                    change[runs.values.field("start").to_numpy()] = 1
                    change[runs.values.field("end").to_numpy()] -= 1
                    data = data[np.cumsum(change[:-1], dtype=np.int8) == 0]
                kept.append(data.tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t.as_buffer()) for t in batch["text"]], pa.int64()), batch["runs"], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "runs", "kept"])

    out = _joined(rows, runs, "left", few).select("doc_id", "text", "runs").mapInArrow(released(made), f"doc_id {id_type}, n_bytes long, runs array<struct<start:int,end:int>>, kept binary")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")).alias("runs"), "kept")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
