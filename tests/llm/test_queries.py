"""The registered queries that SQL can't express, over a whole table, against plain versions."""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from math import log2
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from emberline.llm import language_id, packing, toxicity  # noqa: E402
from emberline.llm.common import table  # noqa: E402
from emberline.llm.queries import QUERIES, tokenizer_path  # noqa: E402

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
CLASHING = ["rank", "part", "before", "text", "key", "h", "doc", "c", "n", "lang", "score", "lang_pred", "toxic", "p", "__flag", "bucket", "spans"]


def documents(spark, sf: str = SF) -> dict[int, str]:
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


def test_op4_pack(spark):
    from tokenizers import Tokenizer

    pytest.importorskip("public_tokenizers")
    t, pieces, sequences = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_pack"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts, total = documents(spark), 0
    assert set(pieces) == set(texts)
    for d, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        own, at = sorted(pieces[d], key=lambda r: r.piece), 0
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        for r in own:
            assert r.start == at and (r.length == 1024 or r.piece == 0) and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        total += at
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    # a plain packer: the longest first, each where it fits best
    rooms: Counter = Counter()
    plain = 0
    for n in sorted((r.length for own in pieces.values() for r in own), reverse=True):
        room = min((k for k, c in rooms.items() if c and k >= n), default=None)
        if room is None:
            plain, room = plain + 1, 1024
        else:
            rooms[room] -= 1
        rooms[room - n] += 1
    assert -(-total // 1024) <= len(sequences) <= plain * 1.005 + 1


def near_pairs(texts: dict[int, str]) -> list[tuple[int, int]]:
    """All pairs of documents with a similarity of 0.8 or more, by a sum over shared shingles."""
    sets, at = {}, defaultdict(list)
    for d, t in texts.items():
        w = brute.SPACE_WORDS.findall(t)
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter({(): 1})
        for k, n in sets[d].items():
            at[k].append((d, n))
    both: Counter = Counter()
    for own in at.values():
        for i, (a, n) in enumerate(own):
            for b, m in own[:i]:
                both[a, b] += min(n, m)
    size = {d: sum(s.values()) for d, s in sets.items()}
    return [(a, b) for (a, b), n in both.items() if n >= 0.8 * (size[a] + size[b] - n) - 1e-9]


@pytest.mark.parametrize("sf", [SF, MORE])
def test_op8_near_dedup_loses_no_link(spark, sf):
    texts = documents(spark, sf)
    parent = {d: d for d in texts}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    pairs = near_pairs(texts)
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.doc_id: r.class_id for r in QUERIES["op8_near_dedup"](spark, sf).collect()}
    print(f"{sf}: {sum(got[a] == got[b] for a, b in pairs)} of {len(pairs)} links within a class")
    assert got == {d: root(d) for d in texts}


WORD = re.compile(rb"[a-z*0-9@$\x80-\xff]+")


def edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_quoted(data: bytes, at: int) -> bool:
    """Straight, curly and angled marks, opened at most 300 bytes before and closed after."""
    marks = [m.start() for m in re.finditer(b'"', data)]
    before = [m for m in marks if m < at]
    if len(before) % 2 and at - before[-1] <= 300 and len(before) < len(marks):
        return True
    for opening, closing in ((("“", "„"), ("”",)), (("„",), ("“",)), (("«",), ("»",))):
        o = max((m.start() for q in opening for m in re.finditer(q.encode(), data) if m.start() < at), default=None)
        c = [m.start() for q in closing for m in re.finditer(q.encode(), data)]
        if o is not None and at - o <= 300 and any(x >= at for x in c) and not any(o < x < at for x in c):
            return True
    return False


def plain_score(model: toxicity.Model, terms: list[bytes], stems: list[bytes], text: str, cache: dict) -> float:
    raw = text.encode()
    data = toxicity.fold(np.frombuffer(raw, np.uint8)).tobytes()
    words = [(m.start(), m[0]) for m in WORD.finditer(data)]
    cues = dict(zip(model.cues.tolist(), model.cue_weights.tolist(), strict=True))
    total = 0.0
    for i, (at, w) in enumerate(words):
        if w not in cache:
            spelt = [(e, k) for k, t in enumerate(terms) if abs(len(t) - len(w)) <= 2 and (e := edits(w, t)) <= toxicity.edits_for(t)]
            stem = [len(terms) + k for k, s in enumerate(stems) if w.startswith(s)]
            cache[w] = min(spelt) if spelt and (min(spelt)[0] == 0 or not stem) else (0, max(stem, key=lambda k: len(stems[k - len(terms)]))) if stem else None
        if cache[w]:
            e, k = cache[w]
            context = model.quoted if plain_quoted(raw, at) else 1.0
            for j in [*range(max(0, i - 6), i), *range(i + 1, min(len(words), i + 7))]:
                if cues:
                    v = np.frombuffer(words[j][1], np.uint8)
                    key = int(toxicity.span_hash(toxicity.byte_values(v), np.array([0]), np.array([len(v)]))[0])
                    context = min(context, cues.get(key, 1.0))
            total += (model.exact if e == 0 else model.fuzzy)[k] * context
    a, b, c = model.curve
    return 1 / (1 + np.exp(-(a + b * min(1, total / max(1, len(raw) / toxicity.TOXIC_BYTES)) + c * np.log1p(total))))


def test_op9_toxicity(spark):
    docs, labels = table(spark, MORE, "documents"), table(spark, MORE, "labels")
    seen = docs.filter(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1))
    toxic, clean = toxicity.sample(seen, labels)
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    texts = documents(spark, MORE)
    for label, own in ((1, toxic), (0, clean)):
        assert {r.text for r in own.collect()} <= {texts[d] for d, y in known.items() if y == label and d in texts and crc(d) % 3 != 1}
    terms, stems = toxicity.learn_terms(toxic.withColumn("toxic", F.lit(True)).unionByName(clean.withColumn("toxic", F.lit(False))))
    model, cache = toxicity.train(toxic, clean), {}
    assert terms or stems
    rows = QUERIES["op9_toxicity"](spark, MORE).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        assert abs(r.score - plain_score(model, terms, stems, texts[r.doc_id], cache)) < 1e-6, r.doc_id


@pytest.mark.parametrize("change", ["removed", "flipped"])
def test_labels_of_held_out_rows_change_nothing_in_op9(spark, change):
    """The bound binds here: there are more labelled rows than wanted, so their number steers the sample."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs, labels = table(spark, MORE, "documents"), table(spark, MORE, "labels")
    other = labels.filter(~held) if change == "removed" else labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    wanted, before, after = 20, toxicity.sample(docs.filter(~held), labels, 20), toxicity.sample(docs.filter(~held), other, 20)
    for a, b in zip(before, after, strict=True):
        assert sorted(r.text for r in a.collect()) == sorted(r.text for r in b.collect())
        assert 0.9 * wanted <= a.count() <= wanted  # equal texts count once
    rows = [{(r.doc_id, r[1]) for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(*x)).collect()} for x in (before, after)]
    assert rows[0] == rows[1]


def test_op10_language_id(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    learnt: dict[str, dict[bytes, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for r in rows:
        if crc(r.doc_id) % 4 != 2 and r.lang is not None and r.text is not None:
            data = r.text.encode()
            for i in range(len(data)):
                for n in range(min(i, 3) + 1):
                    learnt[r.lang][data[i - n : i]][data[i]] += 1
    assert max(Counter(r.lang for r in rows).values()) <= language_id.TRAIN_DOCS
    alphabet = {b for tree in learnt.values() for b in tree[b""]}
    cache: dict = {}

    def chance(lang: str, context: bytes, b: int) -> float:
        if (lang, context, b) not in cache:
            own = learnt[lang].get(context)
            shorter = lambda x: chance(lang, context[1:], x) if context else 1 / (len(alphabet) + 1)
            if not own:
                cache[lang, context, b] = shorter(b)
            else:
                n, kinds = sum(own.values()), len(own)
                cache[lang, context, b] = own[b] / (n + kinds) if b in own else shorter(b) * kinds / (n + kinds) / (1 - sum(map(shorter, own)))
        return cache[lang, context, b]

    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    for r in rows[:60]:
        data, answer = (r.text or "").encode()[:100_000], got[r.doc_id]
        assert answer.held_out == (crc(r.doc_id) % 4 == 2)
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (answer.lang_pred, answer.score) == ("und", 0)
            continue
        bits = {k: -sum(log2(chance(k, data[max(0, i - 3) : i], data[i])) for i in range(len(data))) for k in sorted(learnt)}
        best = min(bits, key=lambda k: (bits[k], k))
        assert answer.lang_pred == best and abs(answer.score - 1 / sum(2.0 ** -min(x - bits[best], 1000) for x in bits.values())) < 1e-6
    held = [(got[r.doc_id].lang_pred == r.lang) for r in rows if got[r.doc_id].held_out and r.lang and r.text]
    assert sum(held) >= 0.95 * len(held)


def test_clashing_columns_and_very_long_texts(spark):
    """Every operator on documents takes columns of any name outside its own prefix, and one text of megabytes."""
    from emberline.llm import decontaminate, exact_dedup, near_dedup, substring_dedup, suffix_dedup

    long = " ".join(f"word{i % 5000} more{i % 777}" for i in range(120_000))
    rows = [(1, "some plain text of a few words here"), (2, long), (3, long + " tail"), (4, ""), (5, None), (1, "some plain text of a few words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHING:
        docs = docs if name in docs.columns else docs.withColumn(name, F.lit("clash"))
    bench = spark.createDataFrame([(1, "word7 more7 word8 more8 word9 more9 word10 more10 word11 more11")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    assert suffix_dedup.suffix_dedup(docs).count() == substring_dedup.substring_dedup(docs).count() == 6
    assert sorted(exact_dedup.exact_dedup(docs).columns) == sorted(docs.columns)
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}
    assert near_dedup.near_dedup(docs).columns == docs.columns
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.filter("text like '%word7 more7 word8%'").count() == 0
    assert toxicity.reject_toxic(docs, labels).columns == docs.columns
    model = language_id.train({"aa": [b"some plain text"], "bb": [b"word more word"]})
    named = language_id.identify(docs, model)
    assert set(named.columns) == set(docs.columns) - {"text"} and {r.doc_id: r.lang_pred for r in named.collect()}[4] == "und"
    pytest.importorskip("public_tokenizers")
    packed = packing.pack(docs, tokenizer_path())
    assert {r.doc_id for r in packed.collect()} == {1, 2, 3, 4, 5}
