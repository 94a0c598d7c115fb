"""Suffix and substring deduplication, decontamination and near-duplicates against brute force."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from emberline.llm import decontaminate as dc  # noqa: E402
from emberline.llm.near_dedup import near_classes, near_dedup  # noqa: E402
from emberline.llm.substring_dedup import FingerprintIndex, substring_dedup, verify_and_cut  # noqa: E402
from emberline.llm.suffix_dedup import suffix_dedup  # noqa: E402

DOCS = "doc_id long, text string, source string, u string, m string, spans string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose with copies, near copies, a passage that many share, repetitive, empty and null texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, out = text(70), []
    for i in range(n):
        t = text(rng.randint(3, 160))
        kind = rng.randint(0, 9)
        if kind == 0:
            t = text(20) + "\n" + shared + "  " + text(20)
        elif kind == 1 and out:
            t = rng.choice(out)[1]
        elif kind == 2 and out and rng.choice(out)[1]:
            w = (rng.choice([x[1] for x in out if x[1]])).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = "ab " * rng.randint(1, 200)
        out.append((i, t))
    out += [(n, ""), (n + 1, None), (n + 2, " \t\n")]
    return [(d, t, "s", "u", "m", "x") for d, t in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_suffix_dedup(spark, rows):
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(rows, DOCS), with_text=True).collect()}
    want = brute.repeated([(d, list((t or "").encode())) for d, t, *_ in rows], 50)
    assert len(got) == len(rows) and any(any(x) for x in want.values())
    for d, t, *_ in rows:
        data = (t or "").encode()
        kept = bytes(b for b, x in zip(data, want[d], strict=True) if not x)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.kept_sha256, bytes(r.kept)) == (len(data), sum(want[d]), brute.sha(kept), kept)


def test_substring_dedup_in_batches(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    items = [(d, brute.SPACE_WORDS.findall(t or "")) for d, t, *_ in rows]
    want = brute.repeated(items, 50)
    for batches in (1, 3):
        got = {r.doc_id: r for r in substring_dedup(docs, batches).collect()}
        for d, words in items:
            kept = " ".join(w for w, x in zip(words, want[d], strict=True) if not x)
            assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(words), sum(want[d]), brute.sha(kept.encode()))


def test_index_compacts_without_changing_results(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    index = FingerprintIndex(spark, max_runs=1)
    settled = [index.ingest(docs.filter(f"doc_id between {a} and {b}")) for a, b in ((0, 20), (21, 40), (41, 99))]
    assert len(index.runs) == 1
    got = {r.doc_id: r.n_removed for r in verify_and_cut(docs, settled[0].unionByName(settled[1]).unionByName(settled[2])).collect()}
    want = brute.repeated([(d, brute.SPACE_WORDS.findall(t or "")) for d, t, *_ in rows], 50)
    assert got == {d: sum(x) for d, x in want.items()}


def test_null_ids_repeated_rows_long_texts_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (3, long)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed > 0) for r in suffix_dedup(docs).collect()}
    assert got == {(1, False), (None, False), (2, True), (3, False)}
    assert {(r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()} == {(1, 0), (None, 0), (2, 60), (3, 0)}
    empty = docs.limit(0)
    assert suffix_dedup(empty).count() == substring_dedup(empty).count() == near_classes(empty).count() == 0


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = rng.integers(0, 4, rng.integers(1, 50))
        index = dc.FMIndex(text)
        for n in (1, 2, 4):
            p = rng.integers(1, 4, (4, n))
            low, high = index.search(np.concatenate((np.full((4, 1), -1), p), axis=1))
            for q, a, b in zip(p, low, high, strict=True):
                occ = [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == q.tolist()]
                assert max(b - a, 0) == len(occ)
                if occ:
                    assert sorted(index.locate(np.arange(a, b)).tolist()) == occ


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_decontaminate(spark, rows, size, monkeypatch):
    """Also with a benchmark that takes several blocks."""
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    bench = [(1, " ".join(texts[0].split()[5:25])), (2, texts[1].upper()), (3, "short item"), (4, None), (5, "..."), (6, texts[0])]
    docs = spark.createDataFrame([*rows, (900, "a short, ITEM here", "s", "", "", ""), (901, texts[0] + "! tail", "s", "", "", "")], DOCS)
    monkeypatch.setattr(dc, "BLOCK_BYTES", size)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    windows: dict = {}
    for i, t in bench:
        w = brute.low(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(str(i))
    got = {r.doc_id: r for r in dc.find(docs, benchmark).collect()}
    for r in docs.collect():
        w, hit, items = brute.low(r.text), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= own
        g = got[r.doc_id]
        assert g["__dc_words"] == len(w) and sorted(g["__dc_items"]) == sorted(items)
        assert {x for a, b in zip(g["__dc_starts"], g["__dc_ends"], strict=True) for x in range(a, b)} == hit
    clean = {r.doc_id: r.text for r in dc.decontaminate(docs, benchmark).collect()}
    assert clean[901] == "! tail" and rows[-2][0] in clean and clean[rows[-2][0]] is None
    assert all(clean[d] == t for d, t, *_ in rows if d in got and not got[d]["__dc_items"])


def test_empty_benchmark_changes_nothing(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(dc.decontaminate(docs, none).collect(), key=lambda r: r.doc_id) == sorted(docs.collect(), key=lambda r: r.doc_id)


def near_corpus() -> list[tuple[int, str]]:
    """A large group of near copies of one text with from no to many changed words, and unrelated texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    out = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    out += [(100 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40)))) for i in range(20)]
    out += [(200, out[3][1].replace(" ", "\n")), (201, ""), (202, " "), (203, None), (204, "one two"), (205, "one  two")]
    return out


def test_near_classes(spark):
    rows = near_corpus()
    docs = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    assert got.pop(None) is None
    assert got == brute.near(rows)
    stay = {r.doc_id for r in near_dedup(docs).collect()}
    assert stay == {d for d, c in got.items() if d == c} | {None}
