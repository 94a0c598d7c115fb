"""Toxicity by a lexicon that catches misspelt terms.

The lexicon is learnt from a sample of labelled texts, each read whole: full terms, and stems that take many
endings. Terms stand in a trie that is intersected with Levenshtein automata
(one edit for terms of five bytes, two from nine on; stems match exactly), and
the intersection is compiled into one deterministic automaton that runs over
all distinct words of a slice at once. Each hit is scored by the window around
it: marks of quotation and the words nearby, with weights learnt from hits in
toxic and in clean texts, tell abuse from its quotation. Misspelt hits count by
how far such spellings told toxic from clean texts in training. A logistic curve
over the summed hits gives the score.

Words are runs of letters, digits and @ $ * in lower case, with 0 1 3 4 5 7 @ $
read as o i e a s t a s. Edits are counted in UTF-8 bytes.

Defined results: null text is empty; a text without hits, an empty one too, gets
the curve's lowest score; without labelled toxic rows every score is that of a
text without hits; repeated rows are scored each, and texts alike score alike;
very long texts are read whole, one at a time; columns of the input may have any
name that does not start with `__tx_`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_values, chunks, span_hash, spans_within, text_or_empty, values, written

#: The training sample: rows of each label at most; their texts are read whole.
TRAIN_ROWS = 1600
#: A term needs so many toxic texts, different words before it (also as a share of the toxic texts), nats of evidence against chance, and must be so many times as common in toxic as in clean texts; at FULL times it counts in full, below in proportion to the logarithm.
MIN_TEXTS, MIN_BEFORE, SHARE, EVIDENCE, LIFT, FULL = 4, 6, 0.01, 8.0, 4, 50
#: Prefix lengths tried for stems.
STEMS = (4, 5, 6, 7, 8)
#: A quotation mark counts if it opens at most so many bytes before the hit; words on each side whose use as cues is learnt.
QUOTE_BYTES, CUE_WORDS = 300, 6
#: Before training says otherwise a quoted and a misspelt hit count so much, as if PRIOR texts had shown it; cues are words near hits of MIN_TEXTS clean texts that halve a hit or more.
QUOTED, FUZZY, PRIOR = 0.1, 0.5, 20
#: A text with a hit in every so many bytes is toxic throughout.
TOXIC_BYTES = 600
SLICE_BYTES = 2 << 20
#: Bytes of words that the automaton reads at once.
SPELL_BYTES = 8 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _from, _to in zip(b"013457@$", b"oieastas", strict=True):
    _FOLD[_from] = _to
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(97, 123), *b"*", *range(128, 256)]] = True
_IS_WORD[[*b"01345789@$26"]] = True


@dataclass
class Words:
    """Word spans of a slice and its folded text; its distinct words: hashes, and where each first stands."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    which: np.ndarray
    keys: np.ndarray
    first: np.ndarray

    def heads(self, words: np.ndarray, width: int) -> np.ndarray:
        """The first bytes of some distinct words as rows, 0 beyond the end; a longer word has 1, which is no letter, in its last place."""
        begin, size = self.starts[self.first[words]], (self.ends - self.starts)[self.first[words]]
        at = begin[:, None] + np.arange(width)
        rows = np.where(np.arange(width) < size[:, None], self.text[np.minimum(at, len(self.text) - 1)], 0)
        rows[size > width, width - 1] = 1
        return rows

    def name(self, word: int) -> bytes:
        i = self.first[word]
        return self.text[self.starts[i] : self.ends[i]].tobytes()


def fold(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # capital letters of Latin-1
    up = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[up] += 0x20
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    text = fold(data)
    starts, ends = spans_within(_IS_WORD[data] | (data >= 65) & (data <= 90), offsets)
    keys, first, which = np.unique(span_hash(byte_values(text), starts, ends), return_index=True, return_inverse=True)
    return Words(text, starts, ends, which, keys, first)


# ---- the automaton


def edits_for(term: bytes) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


@dataclass
class Automaton:
    """table[state * classes + class] -> state; term and edits of the best term that a word ending in each state spells."""

    classes: np.ndarray
    table: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    width: int
    reach: int  # bytes of a word that decide: no longer word spells a term


def compile_terms(terms: list[bytes], stems: list[bytes]) -> Automaton:
    """Trie of terms and stems intersected with Levenshtein automata, made deterministic. Number of a stem: len(terms) + its place."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    most: list[int] = [0]
    stem_of: list[int] = [-1]

    def put(word: bytes, edits: int) -> int:
        node = 0
        most[0] = max(most[0], edits)
        for b in word:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({}), ends.append(-1), most.append(0), stem_of.append(-1)
            node = children[node][b]
            most[node] = max(most[node], edits)
        return node

    for i, t in enumerate(terms):
        ends[put(t, edits_for(t))] = i
    for i, t in enumerate(stems):
        stem_of[put(t, 0)] = len(terms) + i
    alphabet = sorted({b for c in children for b in c})
    classes = np.full(256, len(alphabet), np.int32)
    classes[alphabet] = np.arange(len(alphabet))
    width = len(alphabet) + 1

    def closed(items: dict[int, int]) -> tuple:
        """Skipping a letter of a term is an edit too. items: node -> fewest edits."""
        todo = sorted(items.items(), key=lambda x: x[1])
        for node, e in todo:
            for nxt in children[node].values():
                if e + 1 <= most[nxt] and items.get(nxt, 9) > e + 1:
                    items[nxt] = e + 1
                    todo.append((nxt, e + 1))
        return tuple(sorted(items.items()))

    def step(state: tuple, letter: int | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, e in state:
            if letter is not None and (nxt := children[node].get(letter)) is not None and (e <= most[nxt]) and out.get(nxt, 9) > e:
                out[nxt] = e
            if e + 1 <= most[node] and out.get(node, 9) > e + 1:  # one letter too many
                out[node] = e + 1
            for b, nxt in children[node].items():
                if b != letter and e + 1 <= most[nxt] and out.get(nxt, 9) > e + 1:  # another letter
                    out[nxt] = e + 1
        return out

    start = (closed({0: 0}), -1)
    number, queue, table, term, edits = {start: 0}, [start], [], [], []
    for state, stem in queue:
        best = min(((e, ends[n]) for n, e in state if ends[n] >= 0 and e <= edits_for(terms[ends[n]])), default=None)
        term.append(best[1] if best and (best[0] == 0 or stem < 0) else stem)
        edits.append(best[0] if best and (best[0] == 0 or stem < 0) else 0)
        row = []
        for letter in [*alphabet, None]:
            items = step(state, letter)
            now = stem if stem >= 0 else max((stem_of[n] for n, e in items.items() if e == 0), default=-1)
            new = (closed(items), now)
            if new not in number:
                number[new] = len(queue)
                queue.append(new)
            row.append(number[new])
        table.append(row)
    return Automaton(classes, np.array(table, np.int32).ravel(), np.array(term, np.int32), np.array(edits, np.int8), width, max(map(len, [*terms, *stems]), default=0) + 4)


def spell(automaton: Automaton, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words as rows of bytes (0 beyond the end): the term each spells (-1: none) and the edits."""
    state = np.zeros(len(rows), np.int32)
    for i in range(rows.shape[1]):
        letter = rows[:, i]
        on = letter != 0
        if not on.any():
            break
        state = np.where(on, automaton.table[state * automaton.width + automaton.classes[letter]], state)
    return automaton.term[state], automaton.edits[state]


def in_quotation(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each place lies between an opening mark at most QUOTE_BYTES bytes before and a closing one in the same text."""
    three = lambda a, b, c: np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)) if len(data) > 2 else np.zeros(0, np.int64)
    two = lambda a, b: np.flatnonzero((data[:-1] == a) & (data[1:] == b)) if len(data) > 1 else np.zeros(0, np.int64)
    start, end = offsets[doc], offsets[doc + 1]

    def between(opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        if not len(opening) or not len(closing):
            return np.zeros(len(at), bool)
        o, c = np.searchsorted(opening, at) - 1, np.searchsorted(closing, at)
        last = np.where(o >= 0, opening[np.maximum(o, 0)], -1)
        nxt = np.where(c < len(closing), closing[np.minimum(c, len(closing) - 1)], len(data))
        shut = np.where(c > 0, closing[np.maximum(c - 1, 0)], -1)
        return (last >= start) & (at - last <= QUOTE_BYTES) & (nxt < end) & (shut < last)

    plain = np.flatnonzero(data == 0x22)
    n = np.searchsorted(plain, at)
    odd = (n - np.searchsorted(plain, start)) % 2 == 1
    found = np.zeros(len(at), bool)
    if len(plain):
        found = odd & (at - plain[np.maximum(n - 1, 0)] <= QUOTE_BYTES) & (n < np.searchsorted(plain, end))
    curly = between(np.union1d(three(0xE2, 0x80, 0x9C), three(0xE2, 0x80, 0x9E)), three(0xE2, 0x80, 0x9D)) | between(three(0xE2, 0x80, 0x9E), three(0xE2, 0x80, 0x9C))
    return found | curly | between(two(0xC2, 0xAB), two(0xC2, 0xBB))


@dataclass
class Model:
    automaton: Automaton | None = None
    exact: np.ndarray = field(default_factory=lambda: np.zeros(0))  # weight of a hit, by term
    fuzzy: np.ndarray = field(default_factory=lambda: np.zeros(0))  # weight of a misspelt hit
    quoted: float = QUOTED
    cues: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of words that show a quotation
    cue_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)


@dataclass
class Hits:
    """Of every hit in a slice: its text, term, edits, whether quotation marks enclose it, and its place among the slice's words."""

    text: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    quoted: np.ndarray
    word: np.ndarray


def hits(model: Model, w: Words, data: np.ndarray, offsets: np.ndarray) -> Hits:
    none = np.zeros(0, np.int64)
    if model.automaton is None or not len(w.starts):
        return Hits(none, none, none, np.zeros(0, bool), none)
    block = max(1, SPELL_BYTES // model.automaton.reach)
    spelt = [spell(model.automaton, w.heads(np.arange(i, min(i + block, len(w.keys))), model.automaton.reach)) for i in range(0, len(w.keys), block)]
    term, edits = (np.concatenate(x) for x in zip(*spelt, strict=True))
    at = np.flatnonzero(term[w.which] >= 0)
    doc = np.searchsorted(offsets, w.starts[at], "right") - 1
    return Hits(doc, term[w.which[at]], edits[w.which[at]].astype(np.int64), in_quotation(data, offsets, doc, w.starts[at]), at)


def near(w: Words, h: Hits, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit, distinct word) of the CUE_WORDS words on each side of every hit, within its text."""
    step = np.concatenate((np.arange(-CUE_WORDS, 0), np.arange(1, CUE_WORDS + 1)))
    at = h.word[:, None] + step
    low, high = np.searchsorted(w.starts, offsets[h.text]), np.searchsorted(w.starts, offsets[h.text + 1])
    hit, k = np.nonzero((at >= low[:, None]) & (at < high[:, None]))
    return hit, w.which[at[hit, k]]


def weights(model: Model, w: Words, h: Hits, offsets: np.ndarray) -> np.ndarray:
    """How much each hit counts: by its spelling, and by the strongest sign of quotation in its window."""
    context = np.where(h.quoted, model.quoted, 1.0)
    if len(model.cues) and len(h.text):
        hit, word = near(w, h, offsets)
        at = np.minimum(np.searchsorted(model.cues, w.keys[word]), len(model.cues) - 1)
        found = model.cues[at] == w.keys[word]
        np.minimum.at(context, hit[found], model.cue_weights[at[found]])
    return np.where(h.edits == 0, model.exact[h.term], model.fuzzy[h.term]) * context if len(h.text) else context


def amounts(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the summed weight of its hits, and that sum over the hits that a wholly toxic text of its length would have."""
    w = words_of(data, offsets)
    h = hits(model, w, data, offsets)
    amount = np.bincount(h.text, weights(model, w, h, offsets), minlength=len(offsets) - 1)
    return np.stack([amount, np.minimum(1, amount / np.maximum(1, np.diff(offsets) / TOXIC_BYTES))], axis=1)


def _features(amount: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(amount)), amount[:, 1], np.log1p(amount[:, 0])], axis=1)


def scores(model: Model, amount: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(amount) @ np.array(model.curve), -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge, classes weighted alike."""
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * 400
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.3, 0.3])
        b = b + np.linalg.solve(h, x.T @ (share * (y - p)) - np.array([0.1, 0.3, 0.3]) * b)
    return float(b[0]), float(max(b[1], 0)), float(max(b[2], 0))


def _mapped(texts: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """kernel over slices of whole texts (toxic boolean, text): its arguments are bytes, offsets and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", SLICE_BYTES):
                toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.record_batch(kernel(*values(batch.column("text")), toxic))

    return texts.select("toxic", "text").mapInArrow(run, schema)


def _stem_texts(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> dict[str, pa.Array]:
    """For each first n bytes of the words that have so many: how many toxic texts of the slice hold them, and how many clean ones outside quotations."""
    w = words_of(data, offsets)
    doc = np.searchsorted(offsets, w.starts, "right") - 1
    heads, size = w.heads(np.arange(len(w.keys)), 8), (w.ends - w.starts)
    plain = toxic[doc] | ~in_quotation(data, offsets, doc, w.starts)
    out: tuple[list[bytes], list[np.ndarray], list[np.ndarray]] = ([], [], [])
    for n in STEMS:
        long = np.flatnonzero(plain & (size >= n))
        head = np.zeros((len(w.keys), 8), np.uint8)
        head[:, :n] = heads[:, :n]
        if n == 8:  # the mark of a longer word stands in place of its eighth byte
            far = size[w.first] >= 8
            head[far, 7] = w.text[w.starts[w.first[far]] + 7]
        stem, of = np.unique(head.view(">u8").ravel().astype(np.uint64)[w.which[long]], return_inverse=True)
        which, text = np.divmod(np.unique(of * len(offsets) + doc[long]), len(offsets))
        bad = np.bincount(which, toxic[text], minlength=len(stem)).astype(np.int64)
        out[0].extend(int(x).to_bytes(8, "big")[:n] for x in stem.tolist())
        out[1].append(bad), out[2].append(np.bincount(which, minlength=len(stem)) - bad)
    return {"stem": pa.array(out[0], pa.binary()), "texts": pa.array(np.concatenate(out[1])), "rare": pa.array(np.concatenate(out[2]))}


def _spelt(stems: dict[bytes, float]):
    def kernel(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> dict[str, pa.Array]:
        """Words of toxic texts that begin with a stem (the one with most evidence counts), the hash of the word before (null: none), and how often the slice has both."""
        w = words_of(data, offsets)
        doc = np.searchsorted(offsets, w.starts, "right") - 1
        names = [w.name(i) for i in range(len(w.keys))]
        stem = [max((x[:n] for n in STEMS if len(x) >= n and x[:n] in stems), key=lambda y: (stems[y], -len(y)), default=None) for x in names]
        before = np.where(np.diff(doc, prepend=-1) == 0, np.roll(w.which, 1), -1) if len(doc) else doc
        on = np.array([x is not None for x in stem], bool)[w.which] & toxic[doc] if len(doc) else np.zeros(0, bool)
        pair, uses = np.unique(w.which[on] * (len(w.keys) + 1) + before[on] + 1, return_counts=True)
        word, before = np.divmod(pair, len(w.keys) + 1)
        keys = np.concatenate(([0], w.keys.view(np.int64)))[before]
        return {"stem": pa.array([stem[i] for i in word.tolist()], pa.binary()), "word": pa.array([names[i] for i in word.tolist()], pa.binary()), "before": pa.array(keys, mask=before == 0), "uses": pa.array(uses.astype(np.int64))}

    return kernel


def learn_terms(texts: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Terms and stems that many toxic texts (toxic, text) hold, each time after other words, and clean texts almost never outside quotations.

    The words before a term tell it from the rare words that copies of one text
    share. Executors count; the driver gets the stems that pass the tests, each
    held by MIN_TEXTS texts of the bounded sample or more.
    """
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return [], []
    counts = _mapped(texts, _stem_texts, "stem binary, texts long, rare long").groupBy("stem").agg(F.sum("texts").alias("texts"), F.sum("rare").alias("rare"))
    share = n_toxic / (n_toxic + n_clean)
    both, t, c = F.col("texts") + F.col("rare"), F.col("texts"), F.col("rare")
    evidence = t * F.log(t / (both * share)) + F.when(c > 0, c * F.log(c / (both * (1 - share)))).otherwise(0.0)
    good = (t >= max(MIN_TEXTS, SHARE * n_toxic)) & (evidence >= EVIDENCE) & (c * LIFT <= t * (n_clean / n_toxic))
    found = {bytes(r.stem): r.e for r in counts.filter(good).select("stem", evidence.alias("e")).collect()}
    spelt = _mapped(texts, _spelt(found), "stem binary, word binary, before long, uses long")
    spelt = spelt.groupBy("stem", "word", "before").agg(F.sum("uses").alias("uses")).groupBy("stem", "word").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("n"))
    words: dict[bytes, list] = {}
    for r in spelt.collect():
        words.setdefault(bytes(r.stem), []).append((r.uses, bytes(r.word), r.n))
    terms, stems = set(), set()
    for stem, own in words.items():
        if sum(n for _, _, n in own) >= max(MIN_BEFORE, SHARE * n_toxic):
            uses, word, _ = min(own, key=lambda x: (-x[0], x[1]))
            terms.add(word) if uses >= 0.6 * sum(u for u, _, _ in own) else stems.add(stem)
    return sorted(terms), sorted(stems)


def _contexts(shared):
    def kernel(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> dict[str, pa.Array]:
        """Toxic and clean texts of the slice by sign: 0 a term misspelt (toxic ones only if they hold no term in full), 1 a quoted hit, 2 a word near a hit, 3 a term outside quotations."""
        w = words_of(data, offsets)
        h = hits(shared.value, w, data, offsets)
        full = np.zeros(len(toxic), bool)
        full[h.text[h.edits == 0]] = True
        n = len(toxic)
        wrong = np.unique((h.term * n + h.text)[h.edits > 0])
        wrong = wrong[~(toxic & full)[wrong % n]] if len(wrong) else wrong
        quoted = np.unique(h.text[h.quoted])
        hit, word = near(w, h, offsets)
        cue = np.unique(word * n + h.text[hit])
        right = np.unique((h.term * n + h.text)[(h.edits == 0) & ~h.quoted])
        kind = np.repeat([0, 1, 2, 3], [len(wrong), len(quoted), len(cue), len(right)])
        key = np.concatenate((wrong // n, np.zeros(len(quoted), np.int64), w.keys.view(np.int64)[cue // n], right // n)).astype(np.int64)
        bad = toxic[np.concatenate((wrong % n, quoted, cue % n, right % n)).astype(np.int64)]
        return {"kind": pa.array(kind.astype(np.int32)), "key": pa.array(key), "good": pa.array(bad.astype(np.int64)), "bad": pa.array((~bad).astype(np.int64))}

    return kernel


def _amounts(shared):
    def kernel(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> dict[str, pa.Array]:
        amount = amounts(shared.value, data, offsets)
        return {"toxic": pa.array(toxic), "total": pa.array(amount[:, 0]), "dense": pa.array(amount[:, 1])}

    return kernel


def train(toxic: DataFrame, clean: DataFrame) -> Model:
    """Model from frames of whole texts (column text); executors read them, the driver gets counts and two numbers of each text."""
    texts = toxic.select(F.lit(True).alias("toxic"), "text").unionByName(clean.select(F.lit(False).alias("toxic"), "text"))
    terms, stems = learn_terms(texts)
    if not terms and not stems:
        return Model()
    n = len(terms) + len(stems)
    model = Model(compile_terms(terms, stems), np.ones(n), np.full(n, FUZZY))
    shared = texts.sparkSession.sparkContext.broadcast(model)
    signs = _mapped(texts, _contexts(shared), "kind int, key long, good long, bad long").groupBy("kind", "key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    told = {(r.kind, r.key): r for r in signs.filter((F.col("kind") != 2) | (F.col("bad") >= MIN_TEXTS) & (F.col("bad") > F.col("good"))).collect()}
    shared.destroy()
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    for t in range(n):
        good, bad = (told[3, t].good, told[3, t].bad) if (3, t) in told else (0, 0)
        lift = (good + 0.5) / (bad + 0.5) * sizes[False] / sizes[True]
        model.exact[t] = np.clip(np.log(lift) / np.log(FULL), 0, 1)
    for t in range(len(terms)):  # clean texts must not have the misspelt term
        good, bad = (told[0, t].good + 1, told[0, t].bad) if (0, t) in told else (1, 0)
        model.fuzzy[t] = model.exact[t] * (FUZZY * 2 * good / (good + 20 * bad) if bad else 0.9)
    if (1, 0) in told:
        model.quoted = (QUOTED * PRIOR + told[1, 0].good) / (PRIOR + told[1, 0].good + told[1, 0].bad)
    cues = sorted((np.int64(key).view(np.uint64), r.good / (r.good + r.bad)) for (kind, key), r in told.items() if kind == 2)
    model.cues, model.cue_weights = np.array([c for c, _ in cues], np.uint64), np.array([x for _, x in cues])
    shared = texts.sparkSession.sparkContext.broadcast(model)
    rows = sorted(_mapped(texts, _amounts(shared), "toxic boolean, total double, dense double").collect())
    shared.destroy()
    model.curve = _fit_curve(_features(np.array([[r.total, r.dense] for r in rows])), np.array([float(r.toxic) for r in rows]))
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """At most `rows` toxic and as many clean labelled texts, whole, each text once, picked by a hash of the id; of an id that several texts have, the smallest.

    Only ids of the sample come to the driver; the texts lie in the shared folder.
    """
    # only labels of documents that may be learnt from count, so a label of any other row changes nothing
    usable = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    known = labels.filter("toxic is not null and doc_id is not null").join(usable.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "toxicity-labels")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = F.abs(F.xxhash64("doc_id") % 1_000_000)
    bounds = {label: int(1_100_000 * rows / n) + 1 for label, n in sizes.items()}
    wanted = F.lit(False)
    for label, bound in bounds.items():
        wanted = wanted | ((F.col("toxic") == label) & (picked < bound))
    # the bound on the hash holds on both sides, so documents beyond it never leave their task
    usable = usable.filter(picked < max(bounds.values(), default=0))
    chosen = known.filter(wanted).select("doc_id", "toxic", picked.alias("p"))
    ids: tuple[list, list] = ([], [])
    for r in sorted(chosen.collect(), key=lambda r: (r.p, r.doc_id)):
        if len(ids[r.toxic == 0]) < rows:
            ids[r.toxic == 0].append(r.doc_id)
    spark, kind = docs.sparkSession, pa.field("doc_id", to_arrow_type(docs.schema["doc_id"].dataType))
    listed = pa.table([pa.array([*ids[0], *ids[1]], kind.type), pa.array([True] * len(ids[0]) + [False] * len(ids[1]))], schema=pa.schema([kind, pa.field("toxic", pa.bool_())]))
    # a local table, so the planner knows how small it is
    texts = usable.join(spark.createDataFrame(listed), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = written(texts.select("toxic", "text").distinct(), "toxicity-sample")
    return texts.filter("toxic"), texts.filter("not toxic")


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in chunks(whole, "__tx_text", SLICE_BYTES):
                data, offsets = values(batch.column("__tx_text"))
                rest = [c for c in batch.schema.names if c != "__tx_text"]
                yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(scores(model, amounts(model, data, offsets)))], [*rest, "__tx_score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with __tx_score, from 0 to 1; without the text unless it is to be kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(*rest, text_or_empty(text_col).alias("__tx_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "__tx_text")
    return rows.mapInArrow(_score(shared), f"{schema}, __tx_score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score, by a model learnt from the labelled ones among them, is below the threshold."""
    model = train(*sample(docs, labels))
    return score(docs, model, keep_text=True).filter(F.col("__tx_score") < threshold).select(docs.columns)
