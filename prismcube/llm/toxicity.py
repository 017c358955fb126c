"""Toxicity scores from a learned lexicon that is matched with misspellings and read in context.

Training takes a bounded sample of labelled documents (POSITIVE and NEGATIVE rows, chosen by a hash of the id, never
held-out ones). It picks lexicon entries, whole words and stems (a beginning that at least one more letter follows),
greedily by how many toxic documents each explains that no earlier one did. Words are compiled into one deterministic
automaton: the trie of the words intersected with the Levenshtein automaton of distance 1; stems into a second one.
The whole words behind a chosen stem that are as telling join the first, so an edit inside the stem is found, too.
Both run over all distinct words of a block at once, a letter at a time. A misspelling that is itself an ordinary word
(it occurs in several clean documents of the sample) is none. Each hit is then read in a window of words: quotation
marks around it or a reporting verb near it make it quoted, else it is abuse. A logistic model of the counts gives the
score; its prior holds quoted hits to count for less where the labels say nothing about them.

Scoring covers every whole text. Defined results: null and empty texts get the score of a text without hits; a null
doc_id is kept and not held out; repeated rows get equal scores; without labels of both kinds every score is the share
of toxic labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcube.llm.common import documents, stored, tidy

#: Labelled documents that training uses at most. All else follows from them: an entry needs a two-hundredth of the
#: toxic ones (LEAST of them), which bounds the lexicon.
POSITIVE, NEGATIVE, LEAST = 1500, 4500, 3
#: Lengths of stems, least length of a word that may be misspelled.
STEM, FUZZY = range(4, 11), 5
#: Words either side of a hit that its context takes.
CONTEXT = 6
#: Text bytes scored at a time.
PIECE_BYTES = 1 << 20

WORD = re.compile(r"\w+")
# Marks and verbs of quotation.
QUOTES = "\"'“”„«»‘’‚‹›"
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split())


class Entry(NamedTuple):
    text: str
    stem: bool


class Automaton(NamedTuple):
    """A deterministic automaton over letter classes: next state, and for every state what a word that ends there is."""

    letters: np.ndarray  # class of each code point below its length, 0 for others
    step: np.ndarray  # states x classes
    entry: np.ndarray  # number of the entry, or -1
    errors: np.ndarray


def trie_of(words: Iterable[tuple[int, str]]) -> tuple[list[dict[str, int]], dict[int, int]]:
    nodes: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for number, word in words:
        at = 0
        for c in word:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
            at = nodes[at][c]
        ends[at] = number
    return nodes, ends


def compile_words(words: list[tuple[int, str]], most: int) -> Automaton:
    """Trie x Levenshtein automaton, made deterministic; states are sets of (trie node, errors so far)."""
    nodes, ends = trie_of(words)
    letters = sorted({c for _, w in words for c in w})
    number = {c: i + 1 for i, c in enumerate(letters)}
    table = np.zeros(max(map(ord, letters), default=0) + 1, np.int32)
    for c, i in number.items():
        table[ord(c)] = i
    length = {n: len(w) for n, w in words}
    fuzzy = {at for at, n in ends.items() if length[n] >= FUZZY}
    reach = [False] * len(nodes)  # nodes with a word below them that may be misspelled
    for at in range(len(nodes) - 1, -1, -1):
        reach[at] = at in fuzzy or any(reach[x] for x in nodes[at].values())

    def closed(states: Iterable[tuple[int, int]]) -> frozenset:
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            at, e = todo.pop()
            if best.get(at, most + 1) <= e or e and not reach[at]:
                continue
            best[at] = e
            if e < most:
                todo += [(x, e + 1) for x in nodes[at].values()]
        return frozenset(best.items())

    def after(states: frozenset, c: str | None) -> frozenset:
        out = []
        for at, e in states:
            if c in nodes[at]:
                out.append((nodes[at][c], e))
            if e < most:
                out.append((at, e + 1))
                out += [(x, e + 1) for x in nodes[at].values()]
        return closed(out)

    start = closed([(0, 0)])
    known, order, steps = {start: 0}, [start], []
    for state in order:
        other = after(state, None)
        known.setdefault(other, len(order)) == len(order) and order.append(other)
        row = np.full(len(letters) + 1, known[other], np.int32)
        for c in {c for at, _ in state for c in nodes[at]} | {c for at, _ in state for x in nodes[at].values() for c in nodes[x]}:
            to = after(state, c)
            known.setdefault(to, len(order)) == len(order) and order.append(to)
            row[number[c]] = known[to]
        steps.append(row)
    entry, errors = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int8)
    for i, state in enumerate(order):
        hits = sorted((e, ends[at]) for at, e in state if at in ends and (e == 0 or at in fuzzy))
        if hits:
            errors[i], entry[i] = hits[0]
    return Automaton(table, np.array(steps), entry, errors)


def compile_stems(stems: list[tuple[int, str]]) -> Automaton:
    """States after a stem and one more letter keep accepting."""
    nodes, ends = trie_of(stems)
    letters = sorted({c for _, w in stems for c in w})
    table = np.zeros(max(map(ord, letters), default=0) + 1, np.int32)
    for i, c in enumerate(letters):
        table[ord(c)] = i + 1
    entries = sorted(set(ends.values()))
    size = len(nodes)
    step = np.full((size + 1 + len(entries), len(letters) + 1), size, np.int32)
    entry = np.full(len(step), -1, np.int32)
    for i, n in enumerate(entries):
        step[size + 1 + i] = size + 1 + i
        entry[size + 1 + i] = n
    for at, below in enumerate(nodes):
        if at in ends:
            step[at] = size + 1 + entries.index(ends[at])
            continue  # shortest stem wins
        for c, x in below.items():
            step[at, table[ord(c)]] = x
    return Automaton(table, step, entry, np.zeros(len(step), np.int8))


def run(a: Automaton, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Entry (or -1) and errors of every word; all words advance a letter at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    cls = np.where(points < len(a.letters), a.letters[np.minimum(points, len(a.letters) - 1)], 0)
    starts = np.cumsum(lengths) - lengths
    state = np.zeros(len(words), np.int32)
    by = np.argsort(-lengths, kind="stable")
    dead = np.flatnonzero((a.step == np.arange(len(a.step))[:, None]).all(1) & (a.entry < 0))
    live, at = by, 0
    while len(live):
        live = live[: np.searchsorted(-lengths[live], -at, side="left")] if at else live[lengths[live] > 0]
        if not len(live):
            break
        state[live] = a.step[state[live], cls[starts[live] + at]]
        live = live[~np.isin(state[live], dead)] if len(dead) else live
        at += 1
    return a.entry[state], a.errors[state]


class Model(NamedTuple):
    entries: list[Entry]
    weights: np.ndarray  # of entries
    words: Automaton
    stems: Automaton
    ordinary: frozenset  # misspellings that are words of their own
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    @classmethod
    def of(cls, entries: list[Entry], weights: np.ndarray) -> Model:
        words = compile_words([(i, e.text) for i, e in enumerate(entries) if not e.stem], 1)
        stems = compile_stems([(i, e.text) for i, e in enumerate(entries) if e.stem])
        return cls(entries, weights, words, stems, frozenset(), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))


#: Hits: exact plain, misspelled plain, stems plain, quoted; the weightiest; distinct entries; share of words.
FEATURES = 7


def hits(model: Model, words: list[str]) -> dict[str, tuple[int, int]]:
    """Of distinct words, those that hit: entry and kind (0 exact, 1 misspelled, 2 stem)."""
    entry, errors = run(model.words, words)
    stem, _ = run(model.stems, words)
    out = {}
    for i in np.flatnonzero((entry >= 0) | (stem >= 0)).tolist():
        if entry[i] >= 0 and errors[i] == 0:
            out[words[i]] = int(entry[i]), 0
        elif stem[i] >= 0:
            out[words[i]] = int(stem[i]), 2
        elif words[i] not in model.ordinary:
            out[words[i]] = int(entry[i]), 1
    return out


def quoted(text: str, spans: list[tuple[int, int]], tokens: list[str], i: int) -> bool:
    """Is word i inside quotation marks (of its window) or near a reporting verb?"""
    low, high = max(0, i - CONTEXT), min(len(tokens), i + CONTEXT + 1)
    if any(t in REPORTING for t in tokens[low:high] if t != tokens[i]):
        return True
    before, after = text[spans[low][0] : spans[i][0]], text[spans[i][1] : spans[high - 1][1] + 1]
    open_ = any(c in QUOTES and (k + 1 == len(before) or before[k + 1].isalnum()) and (k == 0 or not before[k - 1].isalnum()) for k, c in enumerate(before))
    close = any(c in QUOTES and (k == 0 or not after[k - 1].isspace()) and (k + 1 == len(after) or not after[k + 1].isalnum()) for k, c in enumerate(after))
    return open_ and close


def features(model: Model, texts: list[str]) -> np.ndarray:
    tokens = [WORD.findall(t.lower()) for t in texts]
    coded = pa.array([w for t in tokens for w in t], pa.large_string()).dictionary_encode()
    hit = hits(model, coded.dictionary.to_pylist())
    out = np.zeros((len(texts), FEATURES))
    for row, (text, words) in enumerate(zip(texts, tokens)):
        if hit.keys().isdisjoint(words):
            continue
        lower = text.lower()
        spans = [m.span() for m in WORD.finditer(lower)]
        seen, top = set(), 0.0
        for i, w in enumerate(words):
            if w not in hit:
                continue
            entry, kind = hit[w]
            if quoted(lower, spans, words, i):
                out[row, 3] += 1
                continue
            out[row, kind] += 1
            seen.add(entry)
            top = max(top, model.weights[entry] * (0.5 if kind == 1 else 1))
        out[row, :4] = np.log1p(out[row, :4])
        out[row, 4:] = top, np.log1p(len(seen)), np.log1p(100 * np.expm1(out[row, :3]).sum() / len(words))
    return out


def fit(x: np.ndarray, y: np.ndarray, prevalence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights around a prior, by Newton's method with halved steps; the constant moved to the true share of toxic labels."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    prior = np.array([0.0, 0.5, 0.3, 0.5, 0.05, 0.5, 0.3, 0.3])
    beta = prior.copy()
    loss = lambda b: (np.logaddexp(0, z @ b) - y * (z @ b)).sum() + ((b - prior) ** 2).sum() / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - (beta - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(beta)), grad)
        while loss(beta + step) > loss(beta) and np.abs(step).max() >= 1e-8:  # a full step may overshoot
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    beta[0] += np.log(prevalence / (1 - prevalence)) - np.log(share / (1 - share))
    return mean, scale, beta


def strings(text: str) -> set[str]:
    """What of a text may become an entry: whole words (marked by a blank at the end) and stems."""
    words = set(WORD.findall(text.lower()))
    return {f"{w} " for w in words if 3 <= len(w) <= 24} | {w[:n] for w in words for n in STEM if n < len(w)}


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model, or the share of toxic labels where one kind is missing. docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return float(total.get(1, 0) > 0)
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(pick(1, POSITIVE).union(pick(0, NEGATIVE)))  # at most POSITIVE + NEGATIVE ids
    sample = stored(docs.join(chosen, "doc_id").select("toxic", "text"), "labelled")

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(strings(t))
        entries = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *(pa.array([seen[y][e] for e in entries], pa.int64()) for y in (1, 0))], names=["entry", "c1", "c0"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return total[1] / (total[0] + total[1])
    least = max(LEAST, n1 // 200)
    each = sample.mapInArrow(lambda b: tidy(count(b)), "entry string, c1 long, c0 long").groupBy("entry").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    odds = F.log((F.col("c1") + 0.1) / n1) - F.log((F.col("c0") + 0.5) / n0)
    telling = [(r.entry, r.odds) for r in each.where(F.col("c1") >= least).select("entry", odds.alias("odds"), "c1").where("odds > 1.5").orderBy(F.desc(F.col("c1") * F.col("odds")), "entry").collect()]
    best = [e for e, _ in telling]
    wanted = spark.sparkContext.broadcast({e: i for i, e in enumerate(best)})  # of at most POSITIVE documents' strings

    def incidence(batches):
        for b in batches:
            got = [sorted(wanted.value[e] for e in strings(t) & wanted.value.keys()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(got, pa.list_(pa.int32()))], names=["toxic", "entries"])

    rows = sample.mapInArrow(lambda b: tidy(incidence(b)), "toxic int, entries array<int>").collect()
    hit = np.zeros((len(rows), max(1, len(best))), bool)
    for i, r in enumerate(rows):
        hit[i, r.entries] = True
    y = np.array([r.toxic for r in rows])
    entries, weights = greedy(hit, y, best, least)
    stems = tuple(e.text for e in entries if e.stem)
    behind = [(Entry(e.strip(), False), o) for e, o in sorted(telling) if e.endswith(" ") and e.startswith(stems)] if stems else []
    behind = [x for x in behind if x[0] not in entries]
    entries, weights = [*entries, *(e for e, _ in behind)], np.array([*weights, *(w for _, w in behind)])
    model = Model.of(entries, weights)

    def near(batches):
        clean: Counter = Counter()
        for b in batches:
            for t, toxic in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                words = sorted(set(WORD.findall(t.lower())))
                if not toxic and words:
                    clean.update(w for w, (_, kind) in hits(model, words).items() if kind == 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string()), pa.array(list(clean.values()), pa.int64())], names=["word", "n"])

    ordinary = sample.mapInArrow(near, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    model = model._replace(ordinary=frozenset(r.word for r in ordinary.collect()))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(features(model, b.column(1).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sample.mapInArrow(measure, "toxic int, x array<double>").collect()  # a few numbers for each row of the sample
    mean, scale, beta = fit(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float), total[1] / (total[0] + total[1]))
    return model._replace(mean=mean, scale=scale, beta=beta)


def greedy(hit: np.ndarray, y: np.ndarray, names: list[str], least: int) -> tuple[list[Entry], np.ndarray]:
    toxic, clean = hit[y == 1], hit[y == 0].sum(0)
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    left, entries, weights = np.ones(len(toxic), bool), [], []
    while names:  # every entry explains ``least`` documents more, so there are 200 at most
        new = toxic[left].sum(0)
        odds = np.log((new + 0.1) / n1) - np.log((clean + 0.5) / n0)
        value = np.where((new >= least) & (odds > 1.5), new * odds, 0)
        i = int(value.argmax())
        if not value[i]:
            break
        entries.append(Entry(names[i].strip(), not names[i].endswith(" ")))
        weights.append(np.log((toxic[:, i].sum() + 0.1) / n1) - np.log((clean[i] + 0.5) / n0))
        left &= ~toxic[:, i]
    # whole words that stand beside the chosen ones: as strong alone, though all their documents are explained
    total = toxic.sum(0)
    odds = np.log((total + 0.1) / n1) - np.log((clean + 0.5) / n0)
    for i in np.argsort(-total * odds, kind="stable") if names else ():
        word = Entry(names[i].strip(), not names[i].endswith(" "))
        if total[i] < max(2 * least, n1 // 50):
            break
        if odds[i] > 4 and word not in entries and not any(e.stem and word.text.startswith(e.text) for e in entries):
            entries.append(word)
            weights.append(odds[i])
    return entries, np.array(weights)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    x = (features(model, texts) - model.mean) / model.scale
    return 1 / (1 + np.exp(-(model.beta[0] + x @ model.beta[1:])))


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of bounded text and their texts, null ones empty."""
    first, size, column = 0, 0, batch.column(text)
    for i, t in enumerate(column):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size >= PIECE_BYTES or i + 1 == len(column):
            yield batch.slice(first, i + 1 - first), [x or "" for x in column.slice(first, i + 1 - first).to_pylist()]
            first, size = i + 1, 0


def trained(docs: DataFrame, labels: DataFrame, key: str, text: str) -> Model | float:
    return train(documents(docs, text, key), labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see the module's text."""
    rows, model = documents(docs, text, key), trained(docs, labels, key, text)
    if isinstance(model, float):
        scored = rows.select("doc_id", F.lit(model).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample bounds the lexicon and so the automata

        def scores(batches):
            for b in batches:
                for part, texts in pieces(b, 1):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probabilities(shared.value, texts), pa.float64())], names=["doc_id", "score"])

        scored = rows.mapInArrow(lambda b: tidy(scores(b)), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score under the threshold; no row is shuffled."""
    model = trained(docs, labels, key, text)
    if isinstance(model, float):
        return docs.where(F.lit(model < threshold))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def keep(batches):
        for b in batches:
            for part, texts in pieces(b, place):
                yield part.filter(pa.array(probabilities(shared.value, texts) < threshold))

    return docs.mapInArrow(lambda b: tidy(keep(b)), docs.schema)
