"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its frequent letter n-grams.  The filters
are bit-sliced: a slot holds one bit for each language, so the AND of an
n-gram's slots is the set of all languages that contain it.  Counting the bits
by language gives each language's share of a text's n-grams; the share is
corrected for the filter's false positives, and the largest one decides.

The filters are fitted on a bounded sample: about ``docs_per_language``
documents of each language, chosen by a hash of their id.  Prediction reads
every text whole; pieces of very long ones count each n-gram once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.llm.exact_dedup import from_files, located, without_rows
from subsidia.llm.words import BATCH_ROWS, release_memory, released
from subsidia.session import materialize

UNKNOWN = "und"
#: Bounds of the model: languages, n-grams of each, slots and hashes of the filters.
GRAMS, SLOT_BITS, HASHES = 20_000, 20, 3
#: Documents of each language that the filters are fitted on, on average.
DOCS_PER_LANGUAGE = 1500
#: Languages that are learned at most: 128 MB of filters.
MAX_LANGUAGES = 1024
SIZES = (3, 4)
#: A language has an n-gram if it is at least this many times as frequent there as where it is most frequent.
DISTINCT = 0.2
#: Characters worked on at once.
PIECE = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_LETTERS: list[np.ndarray] = []


def _codes(lowered: str) -> np.ndarray:
    """Code points of the text with everything but letters as 0."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_LETTERS[0][points], points, 0).astype(np.uint32)


class _Run(NamedTuple):
    """Codes, each text between zeros; where each text begins in them, which text it is, and how many positions count."""

    codes: np.ndarray
    starts: np.ndarray
    which: np.ndarray
    counted: int


def _pieces(texts: list[str | None]) -> Iterator[_Run]:
    """Runs of texts of about ``PIECE`` characters.

    A longer text is a row of runs of its own, which together count every
    n-gram once, by its first character: each but the last is followed by the
    characters that its last n-grams need, and those begin no n-gram there.
    """
    zero, ahead = np.zeros(1, np.uint32), max(SIZES) - 1
    codes, starts, which, size = [], [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        lowered = text.lower()
        if len(lowered) > PIECE:
            # Positions are those of the text with a zero before and after it.
            for at in range(0, len(lowered) + 2, PIECE):
                part = _codes(lowered[max(0, at - 1) : at + PIECE + ahead - 1])
                part = np.concatenate([*([zero] if at == 0 else []), part, *([zero] if at + PIECE + ahead >= len(lowered) + 2 else [])])
                yield _Run(part, np.zeros(1, np.int64), np.array([k]), min(PIECE, len(part)))
            continue
        starts.append(size)
        which.append(k)
        codes += [zero, _codes(lowered)]
        size += len(lowered) + 1
        if size >= PIECE:
            yield _Run(np.concatenate([*codes, zero]), np.array(starts, np.int64), np.array(which, np.int64), size + 1)
            codes, starts, which, size = [], [], [], 0
    if codes:
        yield _Run(np.concatenate([*codes, zero]), np.array(starts, np.int64), np.array(which, np.int64), size + 1)


def _grams(codes: np.ndarray, n: int, counted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-grams whose inner characters are all letters; the ends may be word ends."""
    codes = codes if counted is None else codes[: counted + n - 1]
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = codes[1 : len(codes) - n + 2] != 0
    for k in range(2, n - 1):
        inner = inner & (codes[k : len(codes) - n + 1 + k] != 0)
    at = np.flatnonzero(inner)
    hashed = np.full(len(at), n, np.uint64)
    for k in range(n):
        hashed = (hashed ^ codes[at + k].astype(np.uint64)) * _MIX
        hashed ^= hashed >> np.uint64(29)
    return at, hashed


class LanguageFilters(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # (words of 64 languages, slots)
    false_rate: np.ndarray  # by language


def _slots_of(hashed: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((hashed >> np.uint64(SLOT_BITS * j)) & mask).astype(np.int64) for j in range(HASHES)]


def build_filters(languages: list[str], grams: list[np.ndarray]) -> LanguageFilters:
    slots = np.zeros(((len(languages) + 63) // 64 or 1, 1 << SLOT_BITS), np.uint64)
    rate = np.zeros(len(languages))
    for i, hashed in enumerate(grams):
        used = np.unique(np.concatenate(_slots_of(hashed))) if len(hashed) else np.empty(0, np.int64)
        slots[i // 64, used] |= np.uint64(1 << (i % 64))
        rate[i] = (len(used) / (1 << SLOT_BITS)) ** HASHES
    return LanguageFilters(languages, slots, rate)


def predict(filters: LanguageFilters, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text.

    The score is the best language's corrected share of the sum of all shares.
    A text that is null or has no letter is ``und`` with score 0, as is any text
    where no language was learned; where no
    language has an n-gram of the text, the first language is given, score 0.
    Languages stand by number of training documents, so the more frequent one
    wins a tie.
    """
    n = len(filters.languages)
    if not n:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    hits, total, letters = np.zeros((len(texts), n), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for codes, starts, which, counted in _pieces(texts):
        np.logical_or.at(letters, which, np.add.reduceat(codes != 0, starts) > 0)
        for size in SIZES:
            at, hashed = _grams(codes, size, counted)
            if not len(at):
                continue
            a, b, c = _slots_of(hashed)
            owner = np.searchsorted(starts, at, "right") - 1
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            into = which[owner[edges]]
            np.add.at(total, into, np.diff(edges, append=len(at)))
            for word in range(filters.slots.shape[0]):
                found = filters.slots[word, a] & filters.slots[word, b] & filters.slots[word, c]
                for bit in range(min(64, n - 64 * word)):
                    np.add.at(hits[:, 64 * word + bit], into, np.add.reduceat(((found >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), edges))
    share = np.clip((hits / np.maximum(total, 1)[:, None] - filters.false_rate) / (1 - filters.false_rate), 0, 1)
    best = share.argmax(1)
    top, sums = share[np.arange(len(texts)), best], share.sum(1)
    score = np.where(letters & (sums > 0), top / np.where(sums > 0, sums, 1), 0.0)
    return [filters.languages[b] if k else UNKNOWN for b, k in zip(best, letters)], score.tolist()


def held_out(ident: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_filters(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, min_count: int = 3, most_languages: int = MAX_LANGUAGES) -> LanguageFilters:
    """Filters from labelled documents.

    Languages are counted over all rows and every one is learned; the n-grams
    come from a sample by hash of the text of about ``docs_per_language`` whole
    documents each, of which equal ones count once, so ids have no part in it.
    What reaches the driver is at most ``GRAMS`` hashes for each language, and
    the filters take 8 MB for each 64 of them.  More than ``most_languages``
    are an error: the column then holds something else, or the bound is to be
    raised with the workers' memory.
    """
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values; clean it or raise most_languages")
    languages = [r["lang"] for r in counts]
    if not languages:
        return build_filters([], [])
    share = {r["lang"]: min(1.0, docs_per_language / r["count"]) for r in counts}
    limits = F.create_map(*[F.lit(x) for lang, p in share.items() for x in (lang, int(p * (1 << 31)))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < F.coalesce(F.element_at(limits, F.col("lang")), F.lit(0))).dropDuplicates(["lang", "text"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for codes, _, _, counted in _pieces(list(texts)):
                    keys, n = np.unique(np.concatenate([_grams(codes, size, counted)[1] for size in SIZES]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})

    grams = sample.select("lang", "text").mapInPandas(released(counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = grams.withColumn("rate", rate).withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= F.col("most") * DISTINCT)
    ranked = rated.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= GRAMS)
    top = ranked.select("lang", "gram").toPandas()
    return build_filters(languages, [top.loc[top["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64) for lang in languages])


def language_column(spark: SparkSession, text: Column, filters: LanguageFilters) -> Column:
    """``predict`` as a column, a struct of lang_pred and score; only the text goes to Python."""
    model = spark.sparkContext.broadcast(filters)

    def judged(texts: pd.Series) -> pd.DataFrame:
        lang, score = predict(model.value, list(texts))
        release_memory()
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(judged, "lang_pred string, score double")(text)


def identify_languages(docs: DataFrame, filters: LanguageFilters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of each row.

    A null or empty text, or one without a letter, is ``und``; ties go to the
    language with more training documents; very long texts are judged whole.
    Repeated rows are judged each; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), language_column(docs.sparkSession, F.col(text_col), filters).alias("judged"))
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "judged.lang_pred", "judged.score")


def keep_known_languages(docs: DataFrame, filters: LanguageFilters, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has no letter, or none of whose n-grams belongs to any language.

    Each row is judged by its own text and told apart by its place, so null
    and repeated ids do no harm; columns may have any names.
    """
    found = from_files(docs)
    judged = located(found, [language_column(docs.sparkSession, F.col(text_col), filters).alias("judged")])
    rejected = judged.where((F.col("judged.lang_pred") == UNKNOWN) | (F.col("judged.score") == 0)).select("file", "row")
    return without_rows(found, materialize(rejected, "rejected", arrow_rows=BATCH_ROWS)).toDF(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Written here with small batches of texts, whatever the session's setting.
    return materialize(identify_languages(docs, fit_filters(docs.where(~held_out(F.col("doc_id"))))), "languages", arrow_rows=BATCH_ROWS)
