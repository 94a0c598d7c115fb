"""Chat formatting, packing, exact deduplication, archives, toxicity and language against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from emberline.llm import bloom, chat, exact_dedup, language_id, packing, toxicity, warc
from emberline.llm.oracle import ORACLE_SQL
from emberline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>", "\\", "a\\<|end|>", "<<SYS>>", "[<|a|>]\n", "", None, "é" * 5]
    rows = [(1, i, role, t) for i, t in enumerate(tricky) for role in ("user", "assistant")] + [(2, None, None, "no reply"), (2, 1, "us|er", "b"), (None, 0, "assistant", "x"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.expand(turns)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == 1), key=lambda x: (x[1], x[2])) if c == 1]
    assert back[1].loss == "".join(t or "" for t in tricky)
    assert back[2].loss == "" and [t.text for t in back[2].turns] == ["no reply", "b"]
    assert len(back[3].turns) == 2 and back[None].loss == "x"
    examples = chat.expand(turns).filter("conv_id = 1").orderBy("example").collect()
    assert len(examples) == len(tricky) + 1 and examples[-1].loss_start is None and all(r.loss_end >= r.loss_start for r in examples[:-1])
    assert chat.expand(turns.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    plan = QUERIES["op3_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@settings(max_examples=25, deadline=None)
@given(hs.lists(hs.text(alphabet=" \t\n 　aé'sx1,.漢", max_size=30), min_size=1, max_size=6))
def test_word_ids_equal_the_tokenizer(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    words = _words()
    ids, bounds = words.ids(*packing.values(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


_CACHE: list = []


def _words():
    if not _CACHE:
        _CACHE.append(packing.WordIds(PATH))
    return _CACHE[0]


def test_special_strings():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endof", "text|>y", "<|endoftext|><|endoftext|>  ", "<|endoftext|", "so <|endoftext|>\n"]
    t = Tokenizer.from_file(PATH)
    for special in (True, False):
        t.encode_special_tokens = not special
        ids, bounds = packing.WordIds(PATH, special).ids(*packing.values(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_alike_in_hash_keep_their_ids(monkeypatch):
    """Also if every hash is the same: what is remembered is compared byte by byte."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [f"one {thue_morse(n, a, b)} two" for n in (1024, 2048, 4096) for a, b in ("ab", "ba")]
    t = Tokenizer.from_file(PATH)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    real = packing.span_hash
    for weak in (real, lambda v, s, e: np.ones(len(s), np.uint64), lambda v, s, e: real(v, s, e) % np.uint64(3)):
        monkeypatch.setattr(packing, "span_hash", weak)
        words = packing.WordIds(PATH)
        for _ in range(2):
            ids, bounds = words.ids(*packing.values(pa.array(texts)))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    for n in rng.integers(1, 257, 4000):
        counts[n] += 1
    plan = packing.Plan(counts, 256)
    used: dict[int, list] = {}
    seen = {n: [] for n in range(257)}
    for length, first, n, seq, each, offset in plan.rows:
        for k in range(n):
            used.setdefault(seq + k // each, []).append((offset + k % each * length, length))
            seen[length].append(first + k)
    assert all(sorted(v) == list(range(counts[n])) for n, v in seen.items())
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 256
    assert len(used) <= 1.02 * -(-int((counts * np.arange(257)).sum()) // 256) + 1


def test_pack(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "word " * 3000] + [" ".join(rng.choice(["ab", "cde", "f."]) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rank", F.lit("clash"))
    rows = packing.pack(docs, PATH, keep_ids=True).collect()
    from tokenizers import Tokenizer

    t, by_doc, by_seq = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        assert len(r.ids) == r.length <= 1024 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, text in enumerate(texts):
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == np.concatenate(([0], np.cumsum([r.length for r in own])[:-1])).tolist() and all(r.length == 1024 for r in own[1:])
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.concatenate(([0], np.cumsum([r.length for r in own])[:-1])).tolist() and sum(r.length for r in own) <= 1024
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (3, "x"), (4, None), (1, ""), (None, "a b"), (7, "y"), (7, "y"), (8, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__xd", F.lit("clash"))
    got = {(r["__xd_id"], r["__xd_keep"], r["__xd_size"]) for r in exact_dedup.group_equal(docs).collect()}
    assert got == {(5, 2, 4), (2, 2, 4), (9, 2, 4), (None, 2, 4), (3, 3, 1), (4, 1, 2), (1, 1, 2), (7, 7, 2), (8, 8, 1)}
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 8]
    assert exact_dedup.group_equal(docs.limit(0)).count() == exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_bloom_filter_misses_no_repeat():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    bits = np.zeros(1 << 10, np.uint8)
    bloom.put(bits, bloom.slots(h, 1 << 13))
    assert bloom.has(bits, bloom.slots(h, 1 << 13)).all()


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, None), (4, "u", ""), (5, "u", "é" * 400_000), (6, "u", "\r\n\r\n0\r\n")] + [(10 + i, "u", f"page {i} " * 50) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, index = warc.write_warc(pages, str(tmp_path / "warc"), frame_bytes=2048, bundle_bytes=256)
    got = {r.page_id: r for r in warc.read_warc(folder, index, with_payload=True).collect()}
    assert len(got) == len(rows) and index.select("bundle").distinct().count() > 3
    for page_id, _, html in rows:
        r, data = got[page_id], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.base32_sha1(data))
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else data)
    assert {p: got[p].refers_to for p in (1, 2, 3, 4)} == {1: None, 2: None, 3: 1, 4: 2}
    assert all(r.record_type == "response" for r in warc.read_warc(*warc.write_warc(pages, str(tmp_path / "w2"), min_bytes=1 << 30)).collect())
    one = warc.read_warc(folder, index.filter("record_id = 5")).collect()
    assert [r.page_id for r in one] == [5]
    empty = warc.write_warc(pages.limit(0), str(tmp_path / "w3"))
    assert warc.read_warc(*empty).count() == 0


def test_bundle_is_plain_zstandard_with_a_seek_table(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"text {i} " * 100) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    folder, index = warc.write_warc(pages, str(tmp_path / "z"), frame_bytes=2000)
    name = index.first().bundle
    data = (tmp_path / "z" / name).read_bytes()
    raw = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert raw.count(b"WARC/1.1\r\n") == 30
    store, base = warc.open_fs(folder)
    assert len(warc.seek_table(store.open_input_file(f"{base}/{name}"))) > 5


def edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    terms, stems = [b"idiot", b"scum", b"disgusting", b"moron"], [b"vequ"]
    automaton = toxicity.compile_terms(terms, stems)
    words = []
    for _ in range(1500):
        w = bytearray(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k, at = rng.randint(0, 2), rng.randrange(len(w) + 1)
            w[at : at + (k > 0)] = bytes([rng.choice(b"abdiotsx")]) if k < 2 else b""
        words.append(bytes(w) or b"x")
    words += [b"vequant", b"veqant", b"hello"]
    rows = np.zeros((len(words), 32), np.uint8)
    for i, w in enumerate(words):
        rows[i, : len(w)] = np.frombuffer(w, np.uint8)
    term, distance = toxicity.spell(automaton, rows)
    for w, t, e in zip(words, term.tolist(), distance.tolist(), strict=True):
        best = min((edits(w, x), i) for i, x in enumerate(terms))
        ok = [edits(w, x) for x in terms if edits(w, x) <= toxicity.edits_for(x)]
        if w.startswith(b"vequ"):
            assert t == len(terms)
        elif ok:
            assert t >= 0 and e == min(ok), (w, t, e, best)
        else:
            assert t == -1, (w, t)


def toxic_corpus(n: int = 900) -> list[tuple[int, str, int]]:
    rng = random.Random(4)
    words = ["".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["blorgface", "zwickster"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_and_separates(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d % 3 != 1], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.sample(docs, labels))
    got = {r.doc_id: r["__tx_score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[d] >= 0.7, y == 1) for d, _, y in rows if d % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.99 * len(held)
    filler = " ".join(["sand", "rim", "lot"] * 12)
    cases = [("plain", f"{filler} blorgface {filler} zwickster"), ("misspelt", f"{filler} bl0rgfase {filler} zwikster"), ("quoted", f'{filler} "blorgface" {filler}'), ("guillemets", f"{filler} «a blorgface» {filler}"), ("clean", filler), ("empty", ""), ("null", None)]
    s = {r.doc_id: r["__tx_score"] for r in toxicity.score(spark.createDataFrame(cases, "doc_id string, text string"), model).collect()}
    assert s["plain"] >= 0.7 and s["misspelt"] >= 0.7
    assert s["clean"] == s["empty"] == s["null"] < s["quoted"] < 0.7 and s["guillemets"] < 0.7
    kept = toxicity.reject_toxic(docs.withColumn("__x", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "__x"] and kept.filter("text like '%blorgface%'").count() == 0
    none = toxicity.train(*toxicity.sample(docs, labels.limit(0)))
    assert toxicity.score(docs, none).filter("__tx_score >= 0.7").count() == 0 and toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_reads_sampled_texts_whole(spark):
    rng = random.Random(8)
    rows = toxic_corpus()
    plain = [t for _, t, y in rows if not y]
    long = lambda: " ".join(rng.choice(plain) for _ in range(14))
    # abuse begins after 3000 bytes; "quibbling" stands in short toxic texts and late in long clean ones
    made = [(i, f"{long()[:3500]} {t} quibbling" if y else f"{long()[:3500]} {t} quibbling" if i % 2 else t, y) for i, t, y in rows]
    made += [(1000 + i, f"{rng.choice(plain)} quibbling {rng.choice(plain)}", 1) for i in range(40)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in made if d % 3 != 1], "doc_id long, toxic int")
    toxic, clean = toxicity.sample(docs, labels)
    terms, stems = toxicity.learn_terms(toxic.withColumn("toxic", F.lit(True)).unionByName(clean.withColumn("toxic", F.lit(False))))
    assert {b"blorgface", b"zwickster"} <= set(terms) and not any(x.startswith(b"quib") for x in [*terms, *stems])
    got = {r.doc_id: r["__tx_score"] for r in toxicity.score(docs, toxicity.train(toxic, clean)).collect()}
    held = [(got[d] >= 0.7, y == 1) for d, _, y in made if d % 3 == 1 and d < 1000]
    assert sum(a == b for a, b in held) >= 0.99 * len(held)


def test_code_lengths_equal_a_plain_context_tree():
    texts = {"x": [b"abracadabra", b"abba"], "y": [b"zzyzx", b"xyzzy"]}
    model = language_id.train(texts)
    alphabet = sorted({b for t in texts.values() for x in t for b in x}) + [-1]  # -1: a byte that training never saw

    def chance(lang: str, context: bytes) -> dict[int, float]:
        """Distribution over bytes after a context, by the escape rule."""
        parent = chance(lang, context[1:]) if context else {b: 1 / len(alphabet) for b in alphabet}
        seen: dict[int, int] = {}
        for t in texts[lang]:
            for i in range(len(t) - len(context)):
                if t[i : i + len(context)] == context:
                    seen[t[i + len(context)]] = seen.get(t[i + len(context)], 0) + 1
        if not seen:
            return parent
        n, kinds = sum(seen.values()), len(seen)
        rest = sum(p for s, p in parent.items() if s not in seen)
        return {s: seen[s] / (n + kinds) if s in seen else parent[s] * kinds / (n + kinds) / rest for s in alphabet}

    cases = [b"abrazzyq", b"", b"a", b"zz", b"qqqq", b"abracadabra" * 50]
    data, offsets = language_id._join(cases)
    bits = language_id.code_lengths(model, data, offsets)
    for j, text in enumerate(cases):
        for k, lang in enumerate(model.languages):
            want = sum(-np.log2(chance(lang, text[max(0, i - 3) : i])[b if b in alphabet else -1]) for i, b in enumerate(text))
            assert abs(bits[j, k] - want) < 1e-6


def test_language_id(spark):
    rng = random.Random(6)
    kinds = {"aa": ["the", "ing", "tion", "er"], "bb": ["ção", "que", "os", "de"], "cc": ["сть", "на", "ов", "ть"]}
    make = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    rows = [(i, make(k), k) for i, k in enumerate(list(kinds) * 40)] + [(900, None, "aa"), (901, "123 !", "aa"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample(language_id.learnable(docs, 4, 2)))
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:-3]) and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    none = language_id.train(language_id.sample(docs.limit(0)))
    assert none is None and {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_language_id_reads_sampled_texts_whole(spark):
    kinds = {"aa": "the thing there ", "bb": "que os dentes "}
    docs = spark.createDataFrame([(i, "0123456789 " * 400 + kinds[k] * 20, k) for i, k in enumerate(list(kinds) * 20)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample(docs))
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(kinds.values())), "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(2)] == list(kinds)


def test_language_counts_equal_those_of_whole_texts(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 90))), rng.choice("xy")) for i in range(300)] + [(i, "same", "x") for i in range(300, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {k: [t.encode() for _, t, y in rows if y == k] for k in "xy"}
    a, b = language_id.train(language_id.sample(docs, 1000)), language_id.train(texts)
    assert (a.languages, a.symbols) == (b.languages, b.symbols)
    for x, y in zip(a.trees, b.trees, strict=True):
        assert all((p == q).all() for own, other in zip(vars(x).values(), vars(y).values(), strict=True) for p, q in zip(own, other, strict=True))
    some = language_id.sample(docs, 50)
    assert all(0 < g.counts[0][1].sum() <= 50 * 180 for g in some.values())
