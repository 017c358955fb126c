"""Repeated bytes and words, near copies, vectors: against brute force."""

import hashlib
import random
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest

from prismcube.llm import common, components, embed_dedup, near_dedup, rounds, suffix_dedup, windows, word_dedup

LAST = 2**62


def by_row(rows):
    return sorted(rows, key=repr)


def marks(sequences, k):
    """For every (id, sequence) which symbols a k-window covers that also starts under a smaller id."""
    first = {}
    for i, s in sequences:
        for p in range(len(s) - k + 1):
            w = s[p : p + k] if isinstance(s, bytes) else tuple(s[p : p + k])
            first[w] = min(first.get(w, LAST), i)
    for i, s in sequences:
        hit = np.zeros(len(s), bool)
        for p in range(len(s) - k + 1):
            w = s[p : p + k] if isinstance(s, bytes) else tuple(s[p : p + k])
            if first[w] < i:
                hit[p : p + k] = True
        yield i, s, hit


def read(docs):
    return [(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


def expected_bytes(docs, k):
    out = []
    for i, s, hit in marks(read(docs), k):
        spans = sum(b and not a for a, b in pairwise([False, *hit.tolist()]))
        out.append((None if i == LAST else i, len(s), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(s, np.uint8)[~hit])).hexdigest()))
    return by_row(out)


def expected_words(docs, k):
    out = []
    for i, s, hit in marks([(i, s.split()) for i, s in read(docs)], k):
        out.append((None if i == LAST else i, len(s), int(hit.sum()), hashlib.sha256(b" ".join(w for w, h in zip(s, hit) if not h)).hexdigest()))
    return by_row(out)


@pytest.mark.parametrize("hot", [windows.HOT, 2])
def test_repeated_bytes(docs, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT", hot)
    assert by_row(map(tuple, suffix_dedup.repeated_bytes_digest(docs).collect())) == expected_bytes(docs, 50)


@pytest.mark.parametrize("hot", [windows.HOT, 2])
def test_repeated_words(docs, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT", hot)
    assert by_row(map(tuple, word_dedup.repeated_words_digest(docs).collect())) == expected_words(docs, 50)


def test_small_sheets_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(windows, "SHEET_BYTES", 3000)
    monkeypatch.setattr(windows, "PIECE_BYTES", 500)
    assert by_row(map(tuple, suffix_dedup.repeated_bytes_digest(docs).collect())) == expected_bytes(docs, 50)
    assert by_row(map(tuple, word_dedup.repeated_words_digest(docs, 20).collect())) == expected_words(docs, 20)


@pytest.mark.parametrize("method", [suffix_dedup.Bytes(), word_dedup.Words()])
def test_classes_are_found_among_few_strings_at_a_time(method, monkeypatch):
    """A part of any size gives the same answers range by range, and sorts CLASS_BYTES (and one key's strings) at a time."""
    rng, sheets = random.Random(5), []
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=150)) for _ in range(30)]
    for n in range(3):
        s = windows.Sheet(n)
        s.ids, s.texts = list(range(n, 60, 3)), [f"{rng.choice(passages)} {i} {rng.choice(passages)}".encode() for i in range(n, 60, 3)]
        sheets.append(s)
    rows = []
    for s in sheets:
        keys = windows.sheet_keys(s, method).key
        c = windows.candidates(s, pd.DataFrame({"kind": [0], "part": [0], "answer": [common.pack(np.ones(len(keys), np.uint8))]}), method, 1)
        own = c.strings.to_pylist()
        rows.append((0, s.number, 0, common.pack_planes(np.array([len(x) for x in own], np.uint32)), common.pack(b"".join(own)), common.pack_planes(np.diff(c.key, prepend=np.uint64(0))), common.pack_planes(c.low), common.pack_planes(c.high)))
    pdf, kinds = pd.DataFrame(rows, columns=["part", "sheet", "digest", "lengths", "strings", "keys", "low", "high"]), [np.uint32, np.uint32, np.uint32, np.int64]
    seen, classes = [], method.classes
    monkeypatch.setattr(type(method), "classes", lambda self, strings: seen.append(sum(map(len, strings))) or classes(strings))
    answers = []
    for ranges, size in ((1, 1 << 40), (4, 500)):
        monkeypatch.setattr(windows, "RANGES", ranges)
        monkeypatch.setattr(windows, "CLASS_BYTES", size)
        whole = max(seen, default=0)
        seen.clear()
        got = windows.runs_of(pdf, method, 1)["answer"]
        answers.append([[list(zip(*(y.tolist() for y in windows.unpack_sized(common.unpack(x), kinds))))] for x in got])
        assert ranges == 1 or len(seen) > 4 and max(seen) < whole / 2
    assert answers[0] == answers[1] and any(x for some in answers[0] for x in some)


def test_a_changed_sheet_is_noticed():
    common.check_digests(5, [5, 5])
    with pytest.raises(RuntimeError):
        common.check_digests(5, [5, 6])


def test_columns_sort_suffixes_and_count_common_prefixes():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) for _ in range(60)]
    c = suffix_dedup.Columns(strings, 12).build()
    got = [strings[s][len(strings[s]) - n :] for s, n in zip(c.rows["string"].tolist(), c.rows["length"].tolist())]
    assert got == sorted(got) and sorted(got) == sorted(s[i:] for s in strings for i in range(len(s)))
    common = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in pairwise(got)]
    assert c.rows["lcp"].tolist() == [min(n, 12) for n in common]


def test_texts_without_repeats_keep_their_columns(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept, before = ({r.rep: r for r in x.collect()} for x in (out, docs))
    assert len(kept) == len(before)
    assert all((kept[n].doc_id, kept[n].sheet, kept[n].rest, kept[n]["a b"]) == (r.doc_id, r.sheet, r.rest, r["a b"]) for n, r in before.items())
    assert kept[0].text == before[0].text and kept[2].text == ""
    spans = {r.doc_id: r.spans for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert [(s.start, s.end) for s in spans[3]] == [(0, len(before[2].text.encode()))]


def test_columns_of_any_type_come_back_as_they_were(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal

    passage = " ".join(f"word{i}" for i in range(40))
    schema = "t timestamp, doc_id int, n timestamp_ntz, b binary, d decimal(20,4), x double, text string, a array<string>, s struct<u:int,v:date>, n_chars long"
    row = lambda i, text: (dt.datetime(2024, 1, 2, 3, 4, 5, 123456), i, dt.datetime(1999, 12, 31, 23, 59, 59, 999999), bytearray(b"\x00\xff"), Decimal("12345.6789"), [1.5, float("nan"), None][i % 3], text, ["p", None] if i % 2 else None, (i, dt.date(2024, 2, 29)), 7)
    spark.createDataFrame([row(1, passage), row(2, f"é {passage} é"), row(3, None), row(4, "")], schema).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    out = suffix_dedup.without_repeats(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    kept, before = ({r.doc_id: r for r in x.collect()} for x in (out, docs))
    for i, r in before.items():
        assert repr([kept[i][c] for c in docs.columns if c not in ("text", "n_chars")]) == repr([r[c] for c in docs.columns if c not in ("text", "n_chars")])
    assert [(kept[i].text, kept[i].n_chars) for i in (1, 2, 3, 4)] == [(passage, len(passage)), ("é  é", 4), (None, None), ("", 0)]


def test_empty_tables(empty):
    assert suffix_dedup.repeated_bytes_digest(empty).collect() == word_dedup.repeated_words_digest(empty).collect() == near_dedup.near_duplicates(empty).collect() == []
    assert suffix_dedup.without_repeats(empty).collect() == near_dedup.without_duplicates(empty).collect() == []


def sets(docs):
    out = []
    for i, s in read(docs):
        w = s.lower().split()
        n = min(5, len(w))
        out.append((i, frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) if w else frozenset()))
    return out


def expected_components(docs):
    rows = sets(docs)
    own = {i: i for i, _ in rows}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            if x and y and LAST not in (i, j) and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(i), find(j)
                own[max(u, v)] = min(u, v)
    return by_row((None if i == LAST else i, len(s), None if i == LAST else find(i), i == LAST or find(i) == i) for i, s in rows)


def test_near_copies(docs):
    assert by_row(map(tuple, near_dedup.near_duplicates(docs).collect())) == expected_components(docs)


def test_near_copies_across_small_tiles(docs, monkeypatch):
    monkeypatch.setattr(rounds, "MEMBERS", 7)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert by_row(map(tuple, near_dedup.near_duplicates(docs).collect())) == expected_components(docs)
    kept = near_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in expected_components(docs) if k}


def test_threshold_is_exact_and_low_ones_are_refused(spark, docs):
    words = [f"w{i}" for i in range(104)]
    other = [*words[:90], *(f"v{i}" for i in range(12))]  # 100 and 98 shingles, 86 shared: 86 / 112 is over 0.75
    far = [*words[:88], *(f"u{i}" for i in range(16))]  # 84 / 116 is not
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))], "doc_id long, text string")
    assert [r.component_id for r in near_dedup.near_duplicates(frame).orderBy("doc_id").collect()] == [1, 1, 3]
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(docs, 70)


def test_a_cluster_of_a_third_of_the_rows(spark, monkeypatch):
    """Chains of edits: copies of copies, some over the threshold and most a little under it."""
    monkeypatch.setattr(rounds, "MEMBERS", 16)
    rng, words = random.Random(4), [f"w{i}" for i in range(120)]
    texts = [[w if rng.random() > share else f"{w}x{n}" for w in words] for n in range(60) for share in [rng.choice((0.01, 0.02, 0.04, 0.06))]]
    texts += [[f"o{n}y{rng.randrange(9999)}" for _ in range(60)] for n in range(120)]
    frame = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    expected = expected_components(frame)
    assert len({c for _, _, c, _ in expected}) < 170
    assert by_row(map(tuple, near_dedup.near_duplicates(frame).collect())) == expected


def test_likely_is_the_estimate_at_the_cut():
    rng = np.random.default_rng(6)
    n, m = rng.integers(5, 400, 500).astype(float), rng.integers(5, 400, 500).astype(float)
    more = rng.integers(0, 80, 500)
    less = rng.integers(0, 80, 500)
    got, value = near_dedup.likely(n, m, more, less), near_dedup.estimate(n, m, more, less, 2000)
    clear = np.abs(value - near_dedup.CUT) > 0.002
    assert (got[clear] == (value >= near_dedup.CUT)[clear]).all() and got[clear].any() and not got[clear].all()


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
        n = 1000
        both = round(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        got = near_dedup.estimate(np.array([n]), np.array([n]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))[0]
        assert abs(got - share) < 0.15
        assert (near_dedup.registers(np.union1d(a, b)) == np.maximum(x, y)).all()


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 70), (70, 60), (60, 60), (90, 80), (80, 90)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 50: 50, 60: 50, 70: 50, 80: 80, 90: 80}
    assert components.components(spark.createDataFrame([], "u long, v long"), few).collect() == []


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    out = []
    for n, v in enumerate(base):
        out += [((v + rng.normal(size=24) * s).astype(np.float32).tolist(), n % 3) for s in (0, 0.2, 0.3, 0.3, 0.45)]
    out += [(out[0][0], 0), (out[0][0], 1), (out[0][0], None), ([2 * x for x in out[0][0]], 0), ([0.0] * 24, 0), (None, 0), ([], 0), ([float("nan")] * 24, 0), ([float("inf")] + [0.0] * 23, 0), ([None] * 24, 0), ([1.0, 2.0], 0), ([1.0, 2.0], 0)]
    out += [([x * s for x in (1.0, 2.0, 0.5)], 0) for s in (1e-200, 3e-310, 1.0, 1e200, 1e300)] + [([0.0, 0.0, 1e-320], 0), ([-1e308, 1e308, 1e308], 0), ([-1e-200, 1e-200, 1e-200], 0)]
    return [(i, v, label, "x") for i, (v, label) in enumerate(out)]


def cosine(v, w):
    v, w = v / np.abs(v).max(), w / np.abs(w).max()
    return v @ w / np.sqrt((v @ v) * (w @ w))


@pytest.mark.parametrize("tile", [512, 5])
def test_vectors(spark, tile, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    good = [(i, np.array(v, float), y) for i, v, y, _ in rows if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(i, j) for i, v, y in good for j, w, z in good if i != j and y == z and len(v) == len(w) and cosine(v, w) >= 0.93]
    assert len(pairs) > 40
    own = {i: i for i, *_ in rows}
    for _ in rows:
        for i, j in pairs:
            own[i] = own[j] = min(own[i], own[j])
    expected = [(i, sum(a == i for a, _ in pairs), own[i], own[i] == i) for i, *_ in rows]
    assert sorted(map(tuple, embed_dedup.near_duplicates(frame).collect())) == expected


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
