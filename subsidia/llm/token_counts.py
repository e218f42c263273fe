"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is held as a trie with two roots, one for pieces that begin a
word and one for pieces that continue it.  Each node has a failure link: the
node that the scan continues from when the next byte has no edge, after the
longest pieces on the way have been popped.  Only their number is needed, so
each link carries a precomputed count and a word's length in pieces is found
in one pass over its bytes, without building the pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Words whose counts a task remembers before it starts anew, and the most bytes of such a word: some 80 MB in all.
CACHED_WORDS, CACHED_LENGTH = 400_000, 64


class LongestMatchAutomaton:
    """Greedy longest-match piece counts over byte strings.

    ``initial`` are the pieces that can begin a word, ``continuing`` those that
    can follow.  ``count`` returns -1 for a word that the pieces can't spell.
    """

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.edge: dict[int, int] = {}
        self.link, self.popped = [-1, -1], [0, 0]
        ends, parent, byte, depth = [False, False], [-1, -1], [0, 0], [0, 0]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for b in piece:
                    to = self.edge.get(node << 8 | b)
                    if to is None:
                        to = self.edge[node << 8 | b] = len(ends)
                        ends.append(False)
                        parent.append(node)
                        byte.append(b)
                        depth.append(depth[node] + 1)
                    node = to
                if piece:
                    ends[node] = True
        self.link += [-1] * (len(ends) - 2)
        self.popped += [0] * (len(ends) - 2)
        for node in sorted(range(2, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.link[node], self.popped[node] = 1, 1
                continue
            at, popped = self.link[parent[node]], self.popped[parent[node]]
            while at >= 0 and (to := self.edge.get(at << 8 | byte[node])) is None:
                popped += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = to, popped

    def count(self, word: bytes) -> int:
        edge, link, popped = self.edge, self.link, self.popped
        node = total = 0
        for b in word:
            while (to := edge.get(node << 8 | b)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return -1
            node = to
        while node > 1:
            total += popped[node]
            node = link[node]
        return total if node >= 0 else -1


class _Counts(dict):
    """Counts by word, bounded: it starts anew when full."""

    def __init__(self, automaton: LongestMatchAutomaton, marker: bytes):
        super().__init__()
        self.automaton, self.marker = automaton, marker

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.marker + word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


def bpe_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary of lines ``base64 rank``; those with a leading blank begin words."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def count_tokens(docs: DataFrame, initial: list[bytes], continuing: list[bytes], *, marker: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces per text under greedy longest match.

    Words are the runs of other characters than blanks, tabs, line feeds,
    vertical tabs, form feeds and carriage returns; ``marker`` is put before
    each.  A word that can't be spelled counts as one unknown token.

    Returns one row per input row: id, n_words, n_tokens, n_unknown.  Null and
    empty texts have zeros; very long texts and words are counted whole, in
    time that grows with their length; repeated rows are counted each; an empty
    table gives an empty result; other columns are ignored.

    The vocabulary is a parameter that does not grow with the documents.  Each
    worker holds an automaton of it, of some hundred bytes for each byte.
    """
    pieces = docs.sparkSession.sparkContext.broadcast((initial, continuing))
    id_type = dict(docs.dtypes)[id_col]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = None
        for batch in batches:
            counts = counts if counts is not None else _Counts(LongestMatchAutomaton(*pieces.value), marker)
            words, tokens, unknown = [], [], []
            for text in batch["text"]:
                split = text.encode("utf-8", "surrogatepass").split() if text else []
                each = list(map(counts.__getitem__, split))
                bad = each.count(-1)
                words.append(len(split))
                tokens.append(sum(each) + 2 * bad)
                unknown.append(bad)
            yield pd.DataFrame({id_col: batch["id"], "n_words": words, "n_tokens": tokens, "n_unknown": unknown})

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInPandas(counted, f"`{id_col}` {id_type}, n_words long, n_tokens long, n_unknown long")


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    initial, continuing = bpe_pieces(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), initial, continuing)
