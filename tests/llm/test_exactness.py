"""Hashes only propose: texts that algebraic hashes confuse, refinement, signatures and the index against brute force."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from emberline.llm import common, near_dedup, repeats  # noqa: E402
from emberline.llm import decontaminate as dc  # noqa: E402
from emberline.llm import substring_dedup as sd  # noqa: E402
from emberline.llm.suffix_dedup import suffix_dedup  # noqa: E402


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


TWINS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


def test_span_and_gram_hashes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    values = common.byte_values(data)
    for n in (1, 2, 3, 7, 26, 50):
        h = common.gram_hash(values, n)
        at = np.arange(len(data) - n + 1)
        for h in (h, common.span_hash(values, at, at + n)):
            groups = {}
            for i in at.tolist():
                groups.setdefault(data[i : i + n].tobytes(), set()).add(int(h[i]))
            assert all(len(x) == 1 for x in groups.values()) and len(set().union(*groups.values())) == len(groups)
    for x, y in TWINS:
        both = common.byte_values(np.frombuffer((x + y).encode(), np.uint8))
        a, b = common.span_hash(both, np.array([0, len(x)]), np.array([len(x), len(x) + len(y)]))
        assert a != b
    assert len(common.gram_hash(values[:3], 5)) == 0 and len(common.span_hash(values, at[:0], at[:0])) == 0


def test_equal_spans():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    assert common.equal_spans(data, np.array([0, 0, 3, 1]), data, np.array([6, 3, 3, 7]), np.array([3, 3, 2, 0])).tolist() == [True, False, True, True]


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_refined_buckets_equal_brute_force(kind):
    rng = random.Random(7)
    for window in (1, 3, 8, 13, 50):
        texts = []
        for _ in range(40):
            if texts and rng.random() < 0.5:
                t = list(rng.choice(texts))
                t[rng.randrange(len(t))] = rng.choice("ab")
            else:
                t = [rng.choice("ab") for _ in range(rng.randint(window, window + 30))]
            texts.append(t)
        doc = np.array([rng.randint(0, 9) for _ in texts])
        pieces = ["".join(t).encode() if kind == "bytes" else " ".join(t).encode() for t in texts]
        buckets = repeats._byte_buckets if kind == "bytes" else repeats._word_buckets
        name, sizes, q = buckets(b"".join(pieces), np.array([len(p) for p in pieces], np.int32), window)
        got = repeats.refine_buckets(name, sizes, doc, q, window)
        first: dict = {}
        for t, d in zip(texts, doc.tolist(), strict=True):
            for i in range(len(t) - window + 1):
                first[tuple(t[i : i + window])] = min(first.get(tuple(t[i : i + window]), d), d)
        want = [i + window <= len(t) and first[tuple(t[i : i + window])] < d for t, d in zip(texts, doc.tolist(), strict=True) for i in range(len(t))]
        assert got.tolist() == want


def test_twins_of_words_stay(spark):
    """Documents of words that differ in one long word, alike to polynomial hashes, and true copies of them."""
    rng = random.Random(2)
    common_words = [f"w{rng.randrange(1000)}" for _ in range(49)]
    rows, at = [], 0
    for x, y in TWINS:
        for t in (x, y, x):
            rows.append((at, " ".join([*common_words[:20], t, *common_words[20:]])))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for got, kind in ((suffix_dedup(docs), "bytes"), (sd.substring_dedup(docs), "words")):
        items = [(d, list(t.encode()) if kind == "bytes" else t.split()) for d, t in rows]
        want = brute.repeated(items, 50)
        assert {r.doc_id: r.n_removed for r in got.collect()} == {d: sum(x) for d, x in want.items()}
    bench = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(TWINS)], "item_id long, text string")
    found = {r.doc_id: r["__dc_items"] for r in dc.find(docs, bench).collect()}
    assert found == {d: [] if d % 3 == 1 else [str(d // 3)] for d, _ in rows}


def test_vocabulary_that_collides_gets_another_salt(monkeypatch):
    real = dc.word_hash
    monkeypatch.setattr(dc, "word_hash", lambda low, s, e, salt=0: real(low, s, e, salt) % np.uint64(2 if salt < 3 else 2**61))
    text = b"one two three four five"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    block = dc.block_of(["7"], data, offsets, 3)
    assert block.salt == 3
    shard = dc.Shard.of(np.frombuffer(b"x two three four y two three five", np.uint8), np.array([0, 33]))
    which, first, n = shard.occurrences(dc.Block.of(block.row().to_pylist()[0], 3))
    assert (first.tolist(), n.tolist(), [block.items[block.starts[w]] for w in which]) == ([1], [3], ["7"])


def test_hash_alike_is_not_yet_a_word_of_the_vocabulary(monkeypatch):
    block = dc.block_of(["1"], np.frombuffer(b"aa bb", np.uint8), np.array([0, 5]), 2)
    shard = dc.Shard.of(np.frombuffer(b"aa bb aa bc", np.uint8), np.array([0, 11]))
    order = [1, 2] if block.words[:2].tobytes() == b"aa" else [2, 1]
    monkeypatch.setattr(dc.Shard, "symbols", lambda self, b: np.array(order * 2, np.int32))  # as if "bc" had the hash of "bb"
    _, first, _ = shard.occurrences(block)
    assert first.tolist() == [0]


def weighted(rng: random.Random, n: int) -> dict[int, float]:
    return {rng.randrange(60): rng.choice([0.25, 0.5, 1, 1, 2, 3, 3.5, 17, 40.75]) for _ in range(n)}


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = random.Random(3)
    for _ in range(6):
        a, size = weighted(rng, 40), 4000
        b = {k: w if rng.random() < 0.8 else w * 2 for k, w in a.items() if rng.random() < 0.9} | weighted(rng, 3)
        text = np.repeat([0, 1], [len(a), len(b)])
        x = common.mix64(np.array([*sorted(a), *sorted(b)], np.uint64))
        w = np.array([*(a[k] for k in sorted(a)), *(b[k] for k in sorted(b))], float)
        one, two = near_dedup.signatures(text, x, w, 3, size)[:2]
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        assert abs((one == two).mean() - true) < 4 * (true * (1 - true) / size) ** 0.5 + 0.002
        assert (near_dedup.signatures(text, x, w, 3, size)[2] == 0).all()


def test_regions_grow_with_the_logarithm_of_a_weight():
    of, _, low = near_dedup.regions(np.arange(3, dtype=np.uint64), np.array([1.0, 1000.0, 1e6]))
    assert np.bincount(of).tolist() == [1, 10, 20] and low[0] == 0


def test_merged_runs():
    rng = np.random.default_rng(5)

    def run(n: int) -> list[np.ndarray]:
        k, v, doc = rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 100, n)
        order = np.lexsort((doc, v, k))
        k, v, doc = k[order], v[order], doc[order]
        keep = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
        return [k[keep], v[keep], doc[keep], doc[keep].astype(np.int32), doc[keep].astype(np.int32)]

    for _ in range(20):
        a, b = run(60), run(50)
        want: dict = {}
        for x in (a, b):
            for k, v, d in zip(*(y.tolist() for y in x[:3]), strict=True):
                want[k, v] = min(want.get((k, v), d), d)
        k, v, doc, first, _ = sd.merged(a, b)
        assert list(zip(k.tolist(), v.tolist(), strict=True)) == sorted(want) and [want[x] for x in sorted(want)] == doc.tolist() == first.tolist()
        held = sd.earliest_held(a, *(np.array(x, np.uint64) for x in zip(*sorted(want), strict=True)))
        own = {(k, v): d for k, v, d in zip(*(y.tolist() for y in a[:3]), strict=True)}
        assert held.tolist() == [own.get(x, np.iinfo(np.int64).max) for x in sorted(want)]


def test_index_opens_again(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(400)]
    rows = []
    for i in range(50):
        at = rng.randrange(300)
        rows.append((i, " ".join([f"own{i}"] * 5 + base[at : at + rng.randint(20, 100)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index, settled = sd.FingerprintIndex(spark, max_runs=2, parts=3), []
    for low in range(0, 50, 10):
        settled.append(index.ingest(docs.filter(f"doc_id between {low} and {low + 9}")))
        assert len(index.runs) <= 2
        index = sd.FingerprintIndex.open(spark, index.folder, max_runs=2)
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    got = {r.doc_id: r.n_removed for r in sd.verify_and_cut(docs, every, parts=index.parts).collect()}
    want = brute.repeated([(d, t.split()) for d, t in rows], 50)
    assert got == {d: sum(x) for d, x in want.items()} and any(got.values())


def test_the_query_compacts():
    assert sd.BATCHES > sd.MAX_RUNS


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
