import hashlib
from collections import Counter

import numpy as np
import pytest

from subsidia.llm import suffix_dedup


def brute(docs, length=100):
    """id -> sorted (n_bytes, runs, kept) of its rows, None last."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            if data[a : a + length] in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(data[a : a + length])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]]).astype(int)))
        out.append((str(i), len(data), tuple(map(tuple, edges.reshape(-1, 2).tolist())), bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out)


def found(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, place int, start int, core int").repartition(3)
    return sorted((str(r.doc_id), r.n_bytes, tuple((x.start, x.end) for x in r.runs), bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame, **options).collect())


def corpus(seed, n=80):
    """Texts that share passages of every length about 100, also shifted and with one byte changed, from few and many letters."""
    rng = np.random.default_rng(seed)
    word = lambda k, letters: "".join(rng.choice(list(letters), k))
    passages = [word(int(k), letters) for k in (99, 100, 101, 130, 168, 169, 170, 260, 700) for letters in ("ab", "abcdefghé ")]
    docs = []
    for i in rng.permutation(n).tolist():
        parts = []
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist()) if rng.random() < 0.5 else (0, len(p))
            p = p[a:b]
            if rng.random() < 0.3 and p:
                k = int(rng.integers(len(p)))
                p = p[:k] + "X" + p[k + 1 :]
            parts += [word(int(rng.integers(0, 120)), "abcdefghijklmnopqrstuvwxyz"), p]
        docs.append((i, "".join(parts)))
    return docs


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"most": 0}), (3, {"length": 64})])
def test_runs_equal_brute_force(spark, seed, options):
    docs = corpus(seed)
    assert found(spark, docs, **options) == brute(docs, options.get("length", 100))


def test_odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, periodic and very long texts, copies in one document."""
    passage = "".join(chr(97 + i * i % 26) for i in range(250))
    docs = [(1, passage), (1, passage), (2, None), (3, ""), (None, "x" + passage), (4, "a" * 1000), (5, "ab" * 300), (6, passage + "-" + passage), (7, "é" * 400), (8, "b" + "ab" * 200), (None, None)]
    assert found(spark, docs) == brute(docs)
    assert found(spark, []) == []


def test_long_texts_in_pieces(spark, monkeypatch):
    """Pieces give what whole texts give; the workers inherit nothing, so the function is asked itself."""
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    data[3000:4000] = data[1000:2000]
    whole = suffix_dedup.phrases(suffix_dedup._rolled(data), np.array([0, len(data)]), 100)
    starts = lambda f, l: np.concatenate([np.arange(a, b + 1) for a, b in zip(f, l)])
    assert starts(*whole[:2]).tolist() == list(range(4901))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([7]), "place": pa.array([9]), "text": pa.array([data.tobytes().decode()])})
    got = suffix_dedup._entries(batch, 100, 0, None)
    assert starts(got["start"], got["start"] + got["more"]).tolist() == list(range(4901))
    trigger = dict(zip(starts(*whole[:2]).tolist(), np.repeat(whole[2], whole[1] - whole[0] + 1).tolist()))
    assert all(trigger[a] == t for a, t in zip(got["start"].tolist(), got["trigger"].tolist()))


def test_triggers_depend_on_their_string_alone():
    rng = np.random.default_rng(5)
    string = rng.integers(97, 100, 100).astype(np.uint8)
    offsets = Counter()
    for n in (0, 1, 50, 333):
        data = np.concatenate([rng.integers(97, 100, n).astype(np.uint8), string, rng.integers(97, 100, 200).astype(np.uint8)])
        first, last, trigger = suffix_dedup.phrases(suffix_dedup._rolled(data), np.array([0, len(data)]), 100)
        offsets[int(trigger[(first <= n) & (n <= last)][0] - n)] += 1
    assert len(offsets) == 1


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((int(i), n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for i, n, runs, kept in brute(docs))
    assert sorted(tuple(r) for r in suffix_dedup.op13_suffix_dedup(spark, sf_dir).collect()) == want
