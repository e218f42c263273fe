"""License scans: ordered signature rules over whole texts.

A cheap search for the rules' keywords decides which texts are looked at; only
those are normalised, and of the rules only those run whose keyword occurs.
Detections may overlap: one that lies inside a detection of higher priority,
or inside a longer one of the same priority, is suppressed.  Everything
happens inside the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.llm.columns import ascii_lower, let, match_spans, prefix_maxima
from subsidia.llm.license_rules import Rule, license_rules

#: Words are runs of letters, digits and all characters beyond ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases of the base labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def any_of(words: list[str]) -> str:
    """A pattern of one group for all the words, as a tree by letter, so that most places fail at once."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [c + pattern(below) for c, below in sorted(node.items()) if c]
        if "" in node:
            return f"(?:{'|'.join(ways)})?" if ways else ""
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return pattern(tree)


def _words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ ]+")).cast("bigint")


def _detections(norm: Column, keywords: Column, rules: list[Rule]) -> Column:
    """Array of (start, back, order, end, priority, label, weight), so sorted that whatever contains a detection stands before it."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.weight).alias("weight")) for i, r in enumerate(rules)])
    wanted = F.filter(table, lambda r: F.array_contains(keywords, r["keyword"]) & F.regexp_like(norm, r["pattern"]))
    order = lambda r: (F.lit(10) - r["priority"]) * 10_000 + r["i"]
    each = F.transform(wanted, lambda r: F.transform(match_spans(norm, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), order(r).alias("order"), s["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"))))
    return F.array_sort(F.flatten(each))


def _surviving(detections: Column) -> Column:
    """Detections that no other of the same or a higher priority contains: none before them reaches as far.

    The furthest ends before each detection are prefix maxima, one array for each priority.
    """
    reach = F.array(*[prefix_maxima(F.transform(detections, lambda d: F.when(d["priority"] >= p, d["end"]).otherwise(F.lit(-1).cast("bigint")))) for p in range(1, 5)])  # noqa: B023
    marked = let(reach, lambda ends: F.transform(detections, lambda d, i: F.struct((F.get(F.get(ends, d["priority"] - 1), i) < d["end"]).alias("stays"), d.alias("d"))))
    return F.transform(F.filter(marked, lambda m: m["stays"]), lambda m: F.struct(*[m["d"][c].alias(c) for c in ("start", "end", "priority", "label", "weight")]))


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, phrases: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in each text.

    Returns one row per input row: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and ``detections``, an array of (start, end,
    priority, label, weight) with offsets in the normalised text.  ``score`` is
    the greatest weight of a surviving detection or base phrase, 0 if there is
    none.  A null text counts as empty: no words, no labels, null positions.
    Very long texts are scanned whole, n detections in one costing n**1.5;
    detections of equal span and priority stay once, that of the earlier rule.
    Repeated rows are scanned each; an empty table gives an empty result; other
    columns are ignored.
    """
    rules = license_rules() if rules is None else rules
    phrases = PHRASES if phrases is None else phrases
    gate = "(?i)(?<![a-z0-9])" + any_of([r.keyword for r in rules] + [p.split()[0] for p, _ in phrases])
    finder = f"(?<= ){any_of([r.keyword for r in rules])}(?= )"
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), _GAP, " ")), F.lit(" "))
    rows = rows.select("id", F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("n_words"), F.when(text.rlike(gate), norm).alias("norm"))
    rows = rows.withColumn("keywords", F.array_distinct(F.regexp_extract_all("norm", F.lit(finder), F.lit(0))))
    found = F.when(F.size("keywords") > 0, let(_detections(F.col("norm"), F.col("keywords"), rules), _surviving))
    counts = [F.coalesce(F.regexp_count("norm", F.lit(f"(?= {p} )")).cast("bigint"), F.lit(0)) for p, _ in phrases]
    rows = rows.withColumns({"detections": found, "places": F.when(F.col("norm").isNotNull(), F.array(*counts)).otherwise(F.array(*[F.lit(0).cast("bigint") for _ in phrases]))})
    backwards = F.reverse("norm")
    firsts, lasts, labels = [], [], []
    for i, (phrase, label) in enumerate(phrases):
        here = F.get("places", F.lit(i)) > 0
        firsts.append(F.when(here, _words_in(F.substring("norm", F.lit(1), F.instr("norm", f" {phrase} ")))))
        tail = F.instr(backwards, f" {phrase} "[::-1]) + len(phrase)
        lasts.append(F.when(here, _words_in(F.substring("norm", F.lit(1), F.length("norm") - tail))))
        labels.append(F.when(here, F.lit(label)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,priority:int,label:string,weight:double>>")
    rows = rows.withColumns({"base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), "firsts": F.array_min(F.array(*firsts)), "lasts": F.array_max(F.array(*lasts)), "detections": F.coalesce("detections", none)})
    every = F.array_sort(F.array_union("base", F.array_distinct(F.transform("detections", lambda d: d["label"]))))
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.aggregate("places", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_base"), F.col("firsts").alias("first_word"), F.col("lasts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.alias("score"), "detections",
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
