"""Filter audit, quality and source divergence: edge cases against SQL, plain versions and held-out accuracy."""

from __future__ import annotations

import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberline.llm import divergence, filter_audit, quality
from emberline.llm.common import table
from emberline.llm.oracle import ORACLE_SQL
from emberline.llm.queries import QUERIES

MORE = "/root/testdata/sf0.01"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("mask", pa.string()), ("term", pa.string()), ("n", pa.int32())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("mask", pa.string())])


def odd_tables(folder, rows: int = 400) -> str:
    """Nulls in every column, empty and very long texts, rows that repeat, a hot text, labels that repeat, and clashing columns."""
    rng = random.Random(5)
    words = ["Ab", "straße", "x", "漢字", "A#", "der", "DER", "foo", "bar", "it's", " ", "zz9y"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = [None, "", " ", "\t\n", "hot text " * 40, "hot text " * 40, "SHOUT " * 300, "a|b " * 10, "$", "é" * 9, "word " * 200_000, " ".join(rng.choice(words) for _ in range(30_000))]
    docs, labels = [], []
    for i in range(rows):
        text = rng.choice(texts) if rng.random() < 0.4 else " ".join(rng.choice(words[: rng.choice([8, 60, 200])]) for _ in range(rng.choice([1, 50, 199, 200, 300])))
        if rng.random() < 0.1 and docs:
            text = docs[-1]["text"]
        d = {"doc_id": None if rng.random() < 0.03 else i, "text": text, "lang": rng.choice(["en", "de", None, "", "e n", "alone"] if i < rows - 3 else ["few"]), "source": rng.choice(["s1", "s2", "s3", None, "", "ß"]), "n_chars": None, "mask": "m", "term": "t", "n": i % 3}
        docs.append(d)
        if rng.random() < 0.05:
            docs.append(d)
        if rng.random() < 0.6:
            labels.append({"doc_id": None if rng.random() < 0.05 else i, "quality": rng.choice([0, 1, 1, None]), "toxic": rng.choice([0, 0, 1, None]), "mask": "m"})
        if labels and rng.random() < 0.05:
            labels.append(labels[-1] | {"quality": 1})
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.Table.from_pylist(docs, DOCUMENTS), f"{folder}/documents.parquet")
    pq.write_table(pa.Table.from_pylist(labels, LABELS), f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_divergence"])
@pytest.mark.parametrize("rows", [0, 1, 400])
def test_odd_rows_equal_sql(spark, tmp_path, name, rows):
    sf, con = odd_tables(tmp_path, rows), duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, sf).select(columns).collect()))) == sorted(map(repr, want.fetchall()))


# ---- the filter audit


def test_survivors_of_all_subsets():
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 6):
        masks = rng.choice(1 << k, rng.integers(1, (1 << k) + 1), replace=False)
        counts = rng.integers(0, 100, (len(masks), 2))
        want = [[counts[(masks & s) == 0, c].sum() for c in range(2)] for s in range(1 << k)]
        assert filter_audit.survivors(masks, counts, k).tolist() == want


def test_audit_of_other_filters(spark):
    """Any filters and outcomes, in every order, document by document."""
    filters = {"X": lambda text, words: F.size(words) > 2, "Y": lambda text, words: text.contains("y")}
    rows = [(1, "a y", "p", 1), (2, "a b c", "p", 0), (3, "a b c y", "p", 1), (4, "a b c y", "q", 1), (5, "b", "q", 0)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, worth int")
    got = filter_audit.audit(docs, labels, {"worth": F.col("worth") == 1}, filters, copies="Z").collect()
    fails = {1: "Y", 2: "X", 3: "XY", 4: "XYZ", 5: ""}
    assert len(got) == 2 * 6 * 3
    removed = {}
    for r in got:
        ids = [x for x in rows if x[2] == r.part]
        f, before = r.filter_order[r.step - 1], set(r.filter_order[: r.step - 1])
        here = [x for x in ids if f in fails[x[0]] and not before & set(fails[x[0]])]
        removed[r.part, f] = removed.get((r.part, f), 0) + len(here)
        assert r.removed == len(here) and r.worth_lost == sum(x[3] for x in here)
        assert r.kept == sum(1 for x in ids if not (before | {f}) & set(fails[x[0]]))
        assert r.redundant == sum(1 for x in ids if f in fails[x[0]]) - len(here) and r.unique_fails == sum(1 for x in ids if fails[x[0]] == f)
    assert all(r.shapley == removed[r.part, r.filter_order[r.step - 1]] for r in got)
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {}, dict.fromkeys(map(str, range(7)), filters["X"]))


# ---- quality


def plain_statistics(text: str) -> list[float]:
    data = text.encode()
    space, signs = set(b" \t\n\x0b\x0c\r"), {b for b in range(128) if chr(b) not in ".,;:?'\"()-" and not chr(b).isalnum()} - set(b" \t\n\x0b\x0c\r")
    kinds = [range(97, 123), range(65, 91), range(48, 58), space, b".,;:?'\"()-", signs, range(128, 256)]
    n = [sum(b in kind for b in data) for kind in kinds]
    words = [w for w in "".join(chr(b) for b in data).translate({b: " " for b in space}).split(" ") if w]
    lines = [x for x in "".join(chr(b) for b in data).replace("\r", "\n").split("\n") if x]
    per = lambda a, b: a / max(b, 1)
    shares = [data.count(b) / len(data) for b in set(data)]
    same = lambda x: sum(a == b for a, b in zip(x, x[1:], strict=False))
    return [
        np.log1p(len(data)), *(per(x, len(data)) for x in n), per(n[1], n[0] + n[1] + n[6]), np.log1p(len(words)), per(sum(map(len, words)), len(words)), per(len(set(words)), len(words)),
        per(same(words), len(words)), per(sum(any(ord(c) in signs for c in w) for w in words), len(words)), per(sum(not any("a" <= c <= "z" for c in w) for w in words), len(words)), per(sum(len(w) == 1 for w in words), len(words)),
        np.log1p(per(len(words), sum(data.count(b) for b in b".!?"))), -sum(p * np.log2(p) for p in shares), per(len(set(lines)), len(lines)), per(same(lines), len(lines)),
    ]


def test_statistics_equal_plain_ones(spark, tmp_path):
    docs = table(spark, odd_tables(tmp_path, 120), "documents").select("doc_id", "text")
    rows = quality.measured(docs, keep_text=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        np.testing.assert_allclose(r["__ql_x"], plain_statistics(r.text or ""), atol=1e-9)
    assert all(len(r["__ql_x"]) == quality.STATS for r in rows)


def test_long_texts_are_measured_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["one", "two", "three,", "FOUR", "five\nsix"]) for _ in range(5000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = quality.statistics(quality.measure(data, np.array([0, len(data)])))
    monkeypatch.setattr(quality, "PIECE_BYTES", 1000)
    pieces = quality.statistics(quality.measure_long(data))
    assert np.abs(whole - pieces)[0, :-2].max() < 0.01  # lines and neighbours that a piece's end cuts
    assert quality.measure_long(np.frombuffer(b"a" * 5000, np.uint8)).counts[0, 0] == 5000


def test_pooled_shares_never_fall():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 20, 60).astype(float)
    good = np.minimum(n, rng.integers(0, 20, 60)).astype(float)
    got = quality.pool(n, good)
    # the plain min-max form of isotonic regression
    mean = lambda i, j: good[i : j + 1].sum() / n[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    np.testing.assert_allclose(got, want)


def test_equations_equal_one_fit(spark):
    """Sums of partitions and folds give the fit of all rows together, and each row is calibrated by a fit without its fold."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, quality.STATS))
    y, fold = (x[:, 0] + 0.3 * rng.standard_normal(600) > 0).astype(int), rng.integers(0, quality.FOLDS, 600)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "__ql_x array<double>, __ql_y int, __ql_fold int").repartition(5)
    model = quality.train(rows)
    z = quality.fourier(x, model)
    for k in range(quality.FOLDS + 1):
        own = fold != k
        ridge = np.diag([quality.RIDGE * own.sum()] * quality.FEATURES + [1e-9])
        np.testing.assert_allclose(z @ model.weights[k], z @ np.linalg.solve(z[own].T @ z[own] + ridge, z[own].T @ y[own]), atol=1e-6)
    kernel = quality.fourier(x[:50], model)[:, :-1] @ quality.fourier(x[:50], model)[:, :-1].T
    s = (x[:50] - model.centre) / model.scale
    want = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(kernel - want).mean() < 0.06
    assert (np.diff(model.share) >= 0).all() and model.share[0] < 0.2 and model.share[-1] > 0.8


@pytest.mark.skipif(not os.path.isdir(MORE), reason="tables are not there")
def test_op12_quality(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_quality"](spark, MORE).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, MORE, "labels").collect()}
    assert len(rows) == table(spark, MORE, "documents").count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[d], r.score, r.predicted) for d, r in rows.items() if r.held_out and labels.get(d) is not None]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    above = sum((g > b) + 0.5 * (g == b) for g, b in itertools.product(good, bad)) / (len(good) * len(bad))
    assert above > 0.9 and sum(p for y, _, p in held if y == 1) / len(good) > 0.97


def test_quality_of_odd_rows(spark, tmp_path):
    sf = odd_tables(tmp_path, 200)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = QUERIES["op12_quality"](spark, sf).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert set(quality.keep_good(docs, labels).columns) == set(docs.columns)
    assert {r["__ql_score"] for r in quality.score(quality.measured(docs), quality.train(quality.labelled(quality.measured(docs), labels.limit(0)))).collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    one = quality.train(quality.labelled(quality.measured(docs), labels.withColumn("quality", F.lit(1))))
    assert all(r["__ql_score"] > 0.99 for r in quality.score(quality.measured(docs), one).collect())


def test_labels_of_held_out_rows_change_nothing_in_op12(spark, tmp_path):
    sf = odd_tables(tmp_path / "a", 200)
    before = sorted((str(r.doc_id), r.score) for r in QUERIES["op12_quality"](spark, sf).collect())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = table(spark, sf, "labels").filter(~held).toArrow()
    pq.write_table(other, f"{sf}/labels.parquet")
    spark.catalog.clearCache()
    after = sorted((str(r.doc_id), r.score) for r in QUERIES["op12_quality"](spark, sf).collect())
    assert [a[0] for a in before] == [b[0] for b in after]
    np.testing.assert_allclose([a[1] for a in before], [b[1] for b in after], atol=1e-9)


# ---- divergence


def test_slices_of_the_vocabulary_change_nothing(spark, monkeypatch):
    docs = table(spark, MORE, "documents").select("lang", "source", "text")
    whole = sorted(map(repr, map(tuple, divergence.divergence(docs).collect())))
    monkeypatch.setattr(divergence, "SLICE_TERMS", 1000)
    assert sorted(map(repr, map(tuple, divergence.divergence(docs).collect()))) == whole


def test_keys_equal_plain_terms():
    texts = ["Ab-straße x2y", None, "", "漢字 Ünicode ÀB 3", "--", "z" * 5000]
    langs = ["en", "de", "", "e n", "en", "ß"]
    keys, text = divergence.keys_of(pa.record_batch({"text": pa.array(texts, pa.string()), "lang": pa.array(langs)}))
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    want = [(i, f"{low(w)} {langs[i]}") for i, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    assert list(zip(text.tolist(), keys.to_pylist(), strict=True)) == want


@pytest.mark.parametrize("min_df", [1, 3, 10])
def test_fit_gets_few_keys_with_all_counts_and_enough_rows(monkeypatch, min_df):
    """Common keys go to the fit min_df times, or once for each source, not once for each text; weights keep the counts."""
    monkeypatch.setattr(divergence, "SLICE_BYTES", 20_000)
    rng = random.Random(7)
    names = [f"w{chr(97 + i)}" for i in range(26)]
    docs = [(" ".join(rng.choices(names, [2.0**-i for i in range(26)], k=rng.choice([0, 1, 30, 90]))), rng.choice(["en", "de"]), rng.choice(["", "s", "t"])) for _ in range(600)] + [("", "en", "s"), ("wa " * 30_000, "de", "t")]
    batch = pa.record_batch([pa.array(x, pa.string()) for x in zip(*docs, strict=True)], ["text", "lang", "source"])
    times, texts = Counter(), Counter()
    for text, lang, source in docs:
        for w in text.split():
            times[source, f"{w} {lang}"] += 1
        texts.update({f"{w} {lang}" for w in text.split()})
    frequent = {k for k, n in texts.items() if n >= min_df}
    known = divergence.hashes(pa.array(sorted(frequent), pa.large_string()))
    for parts in (1, 3):
        got, rows, keys = Counter(), Counter(), 0
        for out in divergence._condensed(lambda h: np.isin(h, known), parts, min_df)(iter([batch])):
            for r in out.to_pylist():
                assert len(set(r["keys"])) == len(r["keys"]) and r["weight"] > 0
                assert {int(h % parts) for h in divergence.hashes(pa.array(r["keys"], pa.large_string()))} == {r["part"]}
                for k in r["keys"]:
                    got[r["source"], k] += r["weight"]
                    rows[k] += 1
                    keys += 1
        assert got == Counter({c: n for c, n in times.items() if c[1] in frequent})
        assert all(min(min_df, texts[k]) <= rows[k] <= texts[k] for k in frequent)
        assert keys < (0.2 if min_df < 10 else 0.5) * sum(texts.values())


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_slices_of_a_task_are_condensed_together(monkeypatch, held):
    """A key that comes in many slices goes to the fit once for each source, or min_df times, for the whole task; also when only few sums are held, counts stay whole."""
    monkeypatch.setattr(divergence, "SLICE_BYTES", 500)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(3)
    names = [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(" ".join(rng.choices(names, [2.0**-i for i in range(20)], k=40)), rng.choice(["en", "de"]), rng.choice("rst")) for _ in range(400)]
    batch = pa.record_batch([pa.array(x, pa.string()) for x in zip(*docs, strict=True)], ["text", "lang", "source"])
    times, texts, rows, got, hashed = Counter(), Counter(), Counter(), Counter(), Counter()
    for text, lang, source in docs:
        times.update((source, f"{w} {lang}") for w in text.split())
        texts.update({f"{w} {lang}" for w in text.split()})
    for out in divergence._condensed(lambda h: np.ones(len(h), bool), 1, 4)(iter([batch.slice(0, 150), batch.slice(150)])):
        for r in out.to_pylist():
            rows.update(r["keys"])
            for k in r["keys"]:
                got[r["source"], k] += r["weight"]
    assert got == times
    assert all(min(4, texts[k]) <= rows[k] <= texts[k] for k in texts)
    assert held == 50 or all(rows[k] <= max(4, len({s for s, key in times if key == k})) for k in texts)
    for out in divergence._hashed(iter([batch])):
        assert held == 50 or len(set(out.column("hash").to_pylist())) == out.num_rows == len(texts)
        for h, n in zip(out.column("hash").to_pylist(), out.column("n").to_pylist(), strict=True):
            hashed[h] += n
    keys = sorted(texts)
    assert hashed == dict(zip(divergence.hashes(pa.array(keys, pa.large_string())).view(np.int64).tolist(), (texts[k] for k in keys), strict=True))


def test_rows_for_the_vectorizer_are_short(monkeypatch):
    """However many keys a task has of a source with equal weights, a row has ROW_KEYS at most and a key stands in one of them."""
    monkeypatch.setattr(divergence, "ROW_KEYS", 8)
    names = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    docs = [(" ".join(names), "en", s) for s in "rst"] + [(" ".join(names[:20] * 3), "en", "r")]
    batch = pa.record_batch([pa.array(x, pa.string()) for x in zip(*docs, strict=True)], ["text", "lang", "source"])
    for parts in (1, 3):
        got, rows = Counter(), Counter()
        for out in divergence._condensed(lambda h: np.ones(len(h), bool), parts, 2)(iter([batch])):
            for r in out.to_pylist():
                assert len(r["keys"]) == len(set(r["keys"])) <= 8
                rows.update(r["keys"])
                got.update({(r["source"], k): r["weight"] for k in r["keys"]})
        assert got == Counter({(s, f"{w} en"): 1 + 3 * (s == "r" and w in names[:20]) for s in "rst" for w in names}) and set(rows.values()) == {3}


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_vectors_are_summed_by_term(monkeypatch, held):
    """Weighted vectors of several tasks, dealt out in blocks, give each term its sources and their sums once."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "TERM_ROWS", 7)
    rng, want, blobs = random.Random(8), Counter(), {}
    for task in range(3):
        rows = [(rng.choice(["", "s", "t"][task:] + ["u"]), rng.randint(1, 9), sorted(rng.sample(range(90), rng.choice([0, 1, 30])))) for _ in range(40)]
        for source, weight, at in rows:
            want.update({(a, source): weight for a in at})
        batch = pa.record_batch({"source": pa.array([r[0] for r in rows]), "weight": pa.array([r[1] for r in rows]), "at": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "x": pa.array([[1.0] * len(r[2]) for r in rows], pa.list_(pa.float64()))})
        for out in divergence._summed(5)(iter([batch.slice(0, 0), batch])):
            for r in out.to_pylist():
                blobs.setdefault(r["block"], []).append(r["cells"])
    got, seen = Counter(), set()
    for own in blobs.values():
        for out in divergence._by_term(iter([pa.record_batch({"cells": pa.array(own, pa.binary())})])):
            for r in out.to_pylist():
                assert r["at"] not in seen and r["n_lang"] == sum(g["n"] for g in r["groups"])
                seen.add(r["at"])
                got.update({(r["at"], g["source"]): g["n"] for g in r["groups"]})
    assert got == want and len(blobs) == 5
    assert not list(divergence._by_term(iter([])))


def test_pairs_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([("x", f"s{i % 37}", " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(1 + i % 9))) for i in range(300)], "lang string, source string, text string")
    whole = sorted(map(repr, map(tuple, divergence.divergence(docs, min_df=2).collect())))
    monkeypatch.setattr(divergence, "BLOCK", 5)
    assert sorted(map(repr, map(tuple, divergence.divergence(docs, min_df=2).collect()))) == whole
    assert len([x for x in whole if "'pair'" in x]) == 37 * 36


def test_pair_sums_are_held_within_bounds(monkeypatch):
    """Terms of many groups go block by block, and sums leave the task when there are too many."""
    monkeypatch.setattr(divergence, "HELD_PAIRS", 50)
    rng = random.Random(6)
    p0 = [rng.randint(1, 10**9) for _ in range(40)]
    terms = [(rng.choice("xy"), sorted(rng.sample(range(40), rng.choice([1, 2, 2, 3, 17, 40])))) for _ in range(30)]
    groups = [[{"id": i, "p": rng.randint(1, 10**9), "p0": p0[i]} for i in ids] for _, ids in terms]
    batch = pa.record_batch({"lang": pa.array([x for x, _ in terms]), "groups": pa.array(groups, pa.list_(pa.struct([(c, pa.int64()) for c in ("id", "p", "p0")])))})
    f, want, got, batches = lambda p, q: (p - q) ** 2 // (p + q), {}, {}, 0
    for (lang, _), own in zip(terms, groups, strict=True):
        for a, b in itertools.combinations(own, 2):
            key = lang, a["id"], b["id"]
            want[key] = want.get(key, 0) + f(a["p"], b["p"]) - f(a["p"], b["p0"]) - f(a["p0"], b["p"]) + f(a["p0"], b["p0"])
    for out in divergence._shared_terms(iter([batch])):
        batches += 1
        for r in out.to_pylist():
            got[r["lang"], r["a"], r["b"]] = got.get((r["lang"], r["a"], r["b"]), 0) + r["value"]
    assert got == want and batches > 2


def test_shares_of_very_large_counts(spark):
    n, total, terms = 7 * 10**12, 9 * 10**14, 10**9
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms)).alias("p"), divergence._share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * terms) and row.none == 0
