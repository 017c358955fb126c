"""Tokens, packing, licences, urls, toxicity, images."""

import base64
import hashlib
import math
import re
import tracemalloc
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from prismcube.llm import bpe, licenses, media, packing, queries, toxicity, urls

RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))


def by_row(rows):
    return sorted(rows, key=repr)


def test_encoding_equals_the_library_and_decodes_back(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(RANKS).read_bytes().splitlines())}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in docs.collect():
        ids = whole.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert by_row(map(tuple, bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect())) == by_row(expected)


def test_splitter_equals_the_full_matcher():
    import random

    import regex

    split, whole = bpe.Splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(0)
    points = [*range(bpe.PLAIN), *" '\n\t"  * 9, *"'s", *"'ll", *"aé1½ "]
    for n in range(3000):
        text = "".join(c if isinstance(c, str) else chr(c) for c in rng.choices(points, k=30)) + ("日 本" if n % 7 == 0 else "")
        assert split(text) == whole(text)
    assert split.plain is not None and bpe.Splitter(r"\p{Lu}+|.").plain is None


def test_no_documents(empty):
    assert bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).collect() == []
    assert packing.pack_documents(empty, JSON, public_tokenizers.PATTERN).collect() == []
    assert licenses.scan(empty).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("chunk", [packing.CHUNK_IDS, 100])
def test_packing_loses_nothing_and_pads_nothing(docs, tokenizer, chunk, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_IDS", chunk)
    got = packing.pack_documents(docs.where("doc_id is not null and doc_id <> 17"), JSON, public_tokenizers.PATTERN).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    at: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids.items() if i not in (None, 17)}
    sequences: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())


def test_repeated_and_unnamed_documents_are_packed_each(docs):
    got = packing.pack_documents(docs.where("doc_id is null or doc_id = 17"), JSON, public_tokenizers.PATTERN).collect()
    assert sum(r.length for r in got if r.doc_id == 17) == 2 * next(r.doc_tokens for r in got if r.doc_id == 17)
    assert {r.doc_id for r in got} == {None, 17}


def test_encoder_falls_back_to_the_library(tokenizer):
    e = packing.Encoder(Path(JSON).read_text(), public_tokenizers.PATTERN)
    text = "don't <|endoftext|> stop\n\n  x" * 3
    fast = e(text)
    e.ranked = None
    assert (fast == e(text)).all() and fast.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_registered_packing_has_the_ids_of_the_unmodified_library(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| >", "plain don't", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(JSON)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, 1]
    for got in (queries.op10_packing(spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))):
        rows = got.collect()
        assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(x) for i, x in ids.items()}
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)


def test_hilbert_numbers_are_a_curve():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_licences_equal_counting_all_windows(spark, docs, tables, tmp_path):
    apache = next(t.text for t in licenses.TEMPLATES if t.text.startswith("Unless"))
    cut = " ".join(apache.split()[:-4]) + " or whatever"
    extra = [(500, "x " * 17 + "Released UNDER the MIT license!!"), (501, apache), (502, cut), (503, " ".join(apache.split()[:20])), (504, apache + " y" * 50 + apache), (505, "released under the mit"), (506, None)]
    frame = spark.createDataFrame(extra, "doc_id long, text string")
    frame = frame.unionByName(docs.select("doc_id", "text")).unionByName(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text"))
    path = str(tmp_path / "d")
    frame.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    expected = con.execute(f"select doc_id, license, n_windows, share from ({licenses.oracle()})").fetchall()
    got = licenses.scan(spark.read.parquet(path))
    assert by_row(map(tuple, got.collect())) == by_row(expected)
    assert {(i, name) for i, name, *_ in expected} >= {(500, "MIT"), (501, "Apache-2.0"), (502, "Apache-2.0"), (504, "Apache-2.0")}
    assert not {503, 505, 506} & {i for i, *_ in expected}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    with pytest.raises(ValueError):
        licenses.scan(docs, [licenses.Template("short", "too few words")])


PAGES = [
    (1, "http://a.com/x", '<a href="http://good.org/">'),
    (2, "http://A.COM", ""),
    (3, "https://b.example.com/en/1?q=/x", None),
    (4, "https://www.example.com/en/1#f", ""),
    (5, "http://c.net/es/", '<A HREF=//bad.org/y>'),
    (6, "http://c.net/fr/2", ""),
    (7, "http://near.org/", "<a href='http://c.net/es/'><a href='http://c.net/q'>"),
    (8, "http://good.org/", ""),
    (9, "no scheme", ""),
    (10, None, ""),
    (11, "http://com/", ""),
    (12, "ftp://xcom/?http://a.com/", ""),
    (13, "http://c.net/de/", ""),
    (13, "http://c.net/de/", ""),
    (14, "http://c.net/es/14", ""),
]


def propagated(pages):
    """Rounds of trust and distrust in plain Python."""
    seen = []
    for _, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        host, path = host.lower(), rest[len(host) :].split("?")[0].split("#")[0]
        best = None
        for r in queries.RULES:
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.host + r.path) > len(best.host + best.path)):
                best = r
        seen.append((host, path, best, html or ""))
    hosts = {h for h, *_ in seen if h}
    edges: dict = {}
    for h, _, _, html in seen:
        found = set()
        for part in html.lower().split("href=")[1:]:
            link = part.strip("\"'").split("//")
            if len(link) > 1:
                found.add(link[1].replace('"', "/").replace("'", "/").replace(">", "/").split("/")[0])
        for to in found - {h, ""}:
            edges[h, to] = edges.get((h, to), 0) + 1
    every = hosts | {v for _, v in edges}
    for h in every:
        up = h.partition(".")[2]
        if up in every and "." in up:
            edges[h, up], edges[up, h] = edges.get((h, up), 0) + 1, edges.get((up, h), 0) + 1
    out, into = ({x: sum(n for e, n in edges.items() if e[k] == x) for x in every} for k in (0, 1))
    share = lambda h, a: np.mean([r is not None and r.action == a for x, _, r, _ in seen if x == h]) if h in hosts else 0.0
    good, bad = ({h: 0.15 * share(h, a) for h in every} for a in ("allow", "block"))
    t, d = dict(good), dict(bad)
    for _ in range(urls.ROUNDS):
        t, d = {h: good[h] + 0.85 * sum(n / out[u] * t[u] for (u, v), n in edges.items() if v == h) for h in every}, {h: bad[h] + 0.85 * sum(n / into[v] * d[v] for (u, v), n in edges.items() if u == h) for h in every}
    verdict = lambda h, r: r.action if r else "block" if h and d[h] - t[h] >= 0.075 - 1e-9 else "allow"
    return [(i, h, p, r.host + r.path if r else None, verdict(h, r)) for (i, *_), (h, p, r, _) in zip(pages, seen)]


def test_urls(spark):
    got = urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"), queries.RULES)
    expected = propagated(PAGES)
    assert by_row(map(tuple, got.collect())) == by_row(expected)
    verdicts = {i: v for i, _, _, _, v in expected}
    assert verdicts[7] == "block" and verdicts[8] == "allow" and verdicts[13] == "block" and verdicts[9] == verdicts[10] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), queries.RULES).collect() == []


def test_scores_of_hosts_are_the_solved_system(spark):
    links = [("p.net", "q.org"), ("q.org", "p.net"), *(("hub.org", f"b{i}.net") for i in range(20)), ("c1.org", "hub.org"), *((f"c{i + 1}.org", f"c{i}.org") for i in range(1, 24))]
    share = {"p.net": 0.17, **{f"b{i}.net": 1.0 for i in range(20)}}
    hosts = sorted({h for e in links for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    into = {v: sum(e[1] == v for e in links) for _, v in links}
    back = np.zeros((len(hosts), len(hosts)))
    for u, v in links:
        back[at[u], at[v]] = 1 / into[v]
    distrust = np.linalg.solve(np.eye(len(hosts)) - 0.85 * back, [0.15 * share.get(h, 0.0) for h in hosts])
    rows = [(h, "/es/" if n < 100 * share.get(h, 0) else "/", "".join(f"<a href='http://{v}/'>" for u, v in links if u == h) if n == 99 else "") for h in hosts for n in range(100)]
    frame = spark.createDataFrame([(i, f"http://{h}{path}", html) for i, (h, path, html) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(frame, queries.RULES).collect()}
    assert got == {i: "block" if path == "/es/" or distrust[at[h]] >= 0.075 else "allow" for i, (h, path, _) in enumerate(rows)}
    assert distrust[at["q.org"]] >= 0.075 and distrust[at["c20.org"]] >= 0.075 > distrust[at["c23.org"]]


def test_automaton_accepts_what_is_one_edit_away():
    words = ["idiot", "idiom", "scum", "tart", "stärke"]
    a = toxicity.compile_words(list(enumerate(words)), 1)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != e)))
        return row[-1]

    tried = ["", "i", "zzzzzzzzzzzz", *words, *(w[:i] + c + w[i + k :] for w in words for i in range(len(w) + 1) for c in ("", "x", "t", "é") for k in (0, 1, 2))]
    entry, errors = toxicity.run(a, tried)
    for t, n, e in zip(tried, entry.tolist(), errors.tolist()):
        near = [(distance(t, w), i) for i, w in enumerate(words) if distance(t, w) <= (1 if len(w) >= toxicity.FUZZY else 0)]
        assert (n >= 0) == bool(near) and (not near or e == min(near)[0] and (e, n) in near), t
    stems = toxicity.compile_stems([(0, "abc"), (1, "xy")])
    assert toxicity.run(stems, ["abc", "abcd", "abcde", "ab", "xyz", "zabcd"])[0].tolist() == [-1, 0, 0, -1, 1, -1]


def test_quotation_is_told_from_abuse():
    model = toxicity.Model.of([toxicity.Entry("moron", False)], np.array([3.0]))
    x = toxicity.features(model, ["you are a moron", 'he said “you moron” to them', "the word moron", "you are a morron", "", "nothing here"])
    assert x[0, 0] > 0 and x[0, 3] == 0 and x[3, 1] > 0
    assert x[1, 3] > 0 and x[1, 0] == 0 and x[2, 3] > 0 and not x[4:].any()


def labelled(spark, n=900):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ban", "dor", "fel", "gis", "hum", "jat")]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 40))
        y = int(i % 5 == 0)
        if y:
            text[7] = rng.choice(["grobian", "lumpenx", "grobbian" if i > 100 else "grobian"])
        rows.append((i, " ".join(text), i))
        if i % 4:
            labels.append((i, y))
    return spark.createDataFrame([*rows, (None, "x", 0), (-1, None, 0), (5000, "", 0)], "doc_id long, text string, score int"), spark.createDataFrame([*labels, (None, 1), (1, 0)], "doc_id long, toxic int")


def test_toxicity_learns_only_from_rows_not_held_out(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 903
    for i in range(900):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3)
    held = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert got[None].held_out is False and got[-1].score == got[5000].score == got[None].score
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()} == {i: r.score for i, r in got.items()}
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def plain_score(model, text):
    """The score without automata: every word against every entry by dynamic programming, contexts word by word."""

    def within_one(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != e)))
        return row[-1] == 1

    def hit(w):
        exact = [i for i, e in enumerate(model.entries) if not e.stem and e.text == w]
        stems = [(len(e.text), i) for i, e in enumerate(model.entries) if e.stem and w.startswith(e.text) and len(w) > len(e.text)]
        near = [i for i, e in enumerate(model.entries) if not e.stem and len(e.text) >= toxicity.FUZZY and within_one(w, e.text)]
        if exact:
            return exact[0], 0
        return (min(stems)[1], 2) if stems else (near[0], 1) if near and w not in model.ordinary else None

    lower = (text or "").lower()
    spans = [m.span() for m in re.finditer(r"\w+", lower)]
    words = [lower[a:b] for a, b in spans]
    counts, seen, top = [0, 0, 0, 0], set(), 0.0
    for i, w in enumerate(words):
        found = hit(w)
        if not found:
            continue
        around = range(max(0, i - toxicity.CONTEXT), min(len(words), i + toxicity.CONTEXT + 1))
        reported = any(words[j] in toxicity.REPORTING and words[j] != w for j in around)
        before, after = lower[spans[around[0]][0] : spans[i][0]], lower[spans[i][1] : spans[around[-1]][1] + 1]
        opened = any(c in toxicity.QUOTES and before[k + 1 : k + 2] != "" and before[k + 1].isalnum() and not before[k - 1 : k].isalnum() or c in toxicity.QUOTES and k + 1 == len(before) and not before[k - 1 : k].isalnum() for k, c in enumerate(before))
        closed = any(c in toxicity.QUOTES and not after[k - 1 : k].isspace() and not after[k + 1 : k + 2].isalnum() if k else c in toxicity.QUOTES and not after[1:2].isalnum() for k, c in enumerate(after))
        if reported or opened and closed:
            counts[3] += 1
            continue
        counts[found[1]] += 1
        seen.add(found[0])
        top = max(top, model.weights[found[0]] * (0.5 if found[1] == 1 else 1))
    plain = sum(counts[:3])
    x = [*(math.log1p(c) for c in counts), top, math.log1p(len(seen)), math.log1p(100 * plain / len(words)) if words else 0.0] if any(counts) else [0.0] * 7
    z = model.beta[0] + sum(b * (v - m) / s for b, v, m, s in zip(model.beta[1:], x, model.mean, model.scale))
    return 1 / (1 + math.exp(-z))


def test_scores_equal_those_of_a_plain_scorer(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = toxicity.trained(docs, labels, "doc_id", "text")
    some = docs.where("length(text) < 4000").orderBy("doc_id").limit(150).collect()
    chosen = [r.text for r in some] + [e.text + "x" for e in model.entries[:5]] + [f'he wrote "{e.text}x" there' for e in model.entries[:5]] + ["", None]
    got = toxicity.probabilities(model, [t or "" for t in chosen])
    assert np.allclose(got, [plain_score(model, t) for t in chosen], atol=1e-9) and got.max() > 0.5


def test_toxicity_on_held_out_labels(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.6 * sum(r.toxic for r in rows) and hits >= 0.9 * sum(r.predicted for r in rows)  # of 14 toxic ones, some without a telling word


def test_a_licence_body_is_found_without_its_title(spark):
    parts = {}
    for t in licenses.TEMPLATES:
        parts.setdefault(t.name, []).append(t.text)
    plain = "some words of an ordinary text that stand before and after " * 3
    texts = [(name, plain + text + " " + plain) for name, some in parts.items() for text in some]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(10_000, plain)], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(frame).collect()}
    assert {(i, name) for i, (name, _) in enumerate(texts)} <= found and not any(i == 10_000 for i, _ in found)


def test_toxicity_finds_edits_inside_a_stem(spark):
    docs, labels = labelled(spark)
    plain = "kaban lodor mifel nugis pehum rajat " * 6
    edited = ["gobian", "krobian", "gorobian", "lmpenx", "luumpenx"]
    more = spark.createDataFrame([(7000 + i, f"{plain}{w} {plain}", 0) for i, w in enumerate(["kaban", *edited])], docs.schema)
    assert any(e.stem and "grobian".startswith(e.text) for e in toxicity.trained(docs, labels, "doc_id", "text").entries)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.union(more), labels).collect()}
    assert [got[7000 + i] for i in range(6)] == [0, 1, 1, 1, 1, 1]


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).collect() == [] and toxicity.clean(docs.limit(0), labels).collect() == []


def pictures():
    rng = np.random.default_rng(2)
    out = []
    for n in range(6):
        noise = rng.normal(size=(12, 12))
        at = (np.arange(96) + 0.5) / 8 - 0.5
        lo = np.clip(at.astype(int), 0, 10)
        f = np.clip(at - lo, 0, 1)
        big = noise[lo] * (1 - f)[:, None] + noise[lo + 1] * f[:, None]
        big = big[:, lo] * (1 - f) + big[:, lo + 1] * f
        image = np.clip(128 + 60 * big, 0, 255).astype(np.uint8)
        bright = np.clip(image * 0.8 + 25, 0, 255).astype(np.uint8)
        grainy = np.clip(image + rng.normal(0, 3, image.shape), 0, 255).astype(np.uint8)
        out += [image, image, image[6:90, 10:92], bright, grainy, np.rot90(image)]
    return [(i, p.shape[1], p.shape[0], bytearray(np.ascontiguousarray(p).tobytes())) for i, p in enumerate(out)]


def test_images(spark):
    odd = [(100, 4, 4, bytearray(16)), (101, None, 4, bytearray(16)), (102, 5, 5, bytearray(16)), (103, 4, 4, None), (104, 4, 4, bytearray(16)), (None, 96, 96, bytearray(96 * 96)), (None, 1, 1, None)]
    frame = spark.createDataFrame([*pictures(), *odd], "image_id long, width int, height int, pixels binary")
    got = {r.image_id: r for r in media.image_copies(frame).collect() if r.image_id is not None}
    assert [got[i].component_id for i in range(36)] == [6 * (i // 6) for i in range(36)]
    assert got[0].kept and not got[1].kept and got[0].n_points > 20
    assert [got[i].component_id for i in range(100, 105)] == [100, 101, 102, 103, 100] and got[100].n_points == 0
    assert media.image_copies(frame.limit(0)).collect() == []


def test_drawn_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (v + rng.normal(size=64) * 0.05).tolist()) for i, v in enumerate(base)] + [(200, None), (201, [float("nan")] * 4), (202, [])]
    got = {r.image_id: r.component_id for r in media.image_copies(media.drawn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()}
    assert len(got) == 63 and np.mean([got[100 + i] == i for i in range(30)]) >= 0.9
    assert [got[i] for i in range(30)] == list(range(30)) and [got[i] for i in (200, 201, 202)] == [200, 201, 202]


def test_pipeline_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    held, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.stored(stage(spark, held, tables), name)
        assert held.columns == docs.columns
        counts.append(held.count())
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert counts[1] == counts[0] - len(toxic) and counts[2] < counts[1] and counts[3] == counts[2]
    assert not toxic & {r.doc_id for r in held.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, held, tables)
    whole = corpus_pipeline.run(spark, tables)
    assert whole.columns == packed.columns
    total = lambda df: df.groupBy("doc_id").agg({"length": "sum"}).orderBy("doc_id").collect()
    assert total(packed) == total(whole)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "packing"]


def test_every_operator_is_registered_once():
    assert [sum(n.startswith(f"op{i}_") for n in queries.QUERIES) for i in range(1, 11)] == [1] * 10


def smooth(rng, side, cells=12):
    """A picture of random tones on a grid, smoothly joined."""
    tones = rng.random((cells + 1, cells + 1)) * 255
    at = np.linspace(0, cells - 1e-6, side)
    low = at.astype(int)
    part = (at - low) ** 2 * (3 - 2 * (at - low))
    tones = tones[low] * (1 - part)[:, None] + tones[low + 1] * part[:, None]
    return tones[:, low] * (1 - part) + tones[:, low + 1] * part


def warped(image, turn=0.0, scale=1.0):
    h, w = image.shape
    y, x = np.mgrid[: round(h * scale), : round(w * scale)].astype(float)
    y, x = (y - y.max() / 2) / scale, (x - x.max() / 2) / scale
    down = np.clip(y * np.cos(turn) - x * np.sin(turn) + (h - 1) / 2, 0, h - 1.001)
    across = np.clip(y * np.sin(turn) + x * np.cos(turn) + (w - 1) / 2, 0, w - 1.001)
    a, b = down.astype(int), across.astype(int)
    f, g = down - a, across - b
    return image[a, b] * (1 - f) * (1 - g) + image[a + 1, b] * f * (1 - g) + image[a, b + 1] * (1 - f) * g + image[a + 1, b + 1] * f * g


def test_edited_copies_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(21)
    edits = [
        lambda p: np.clip(p + rng.normal(0, 8, p.shape), 0, 255),
        lambda p: p[:112, 16:],
        lambda p: p[25:115, 12:102],
        lambda p: p[38:112, 25:99],
        lambda p: warped(p, np.radians(20)),
        lambda p: np.rot90(p),
        lambda p: warped(p, scale=0.8),
        lambda p: warped(p, scale=0.5),
        lambda p: np.clip(p * 0.8 + 20, 0, 255),
    ]
    pictures = [smooth(rng, 128) for _ in range(20)]
    images = [np.ascontiguousarray(x).astype(np.uint8) for p in pictures for x in (p, *(e(p) for e in edits))]
    rows = [(n, x.shape[1], x.shape[0], x.tobytes()) for n, x in enumerate(images)]
    got = {r.image_id: r.component_id for r in media.image_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    each = len(edits) + 1
    for k in range(1, each):
        assert sum(got[n * each + k] == n * each for n in range(20)) >= 18, k
    assert all(c // each == n // each for n, c in got.items())


def test_images_that_share_a_bucket_are_compared_or_joined(spark):
    """Against all pairs of a small set, in tiles of a few members."""
    rng = np.random.default_rng(22)
    images = []
    for _ in range(8):
        p = smooth(rng, 64, 8)
        images += [np.clip(p + rng.normal(0, s, p.shape), 0, 255).astype(np.uint8) for s in (0, 4, 8, 14)]
    (described,) = [[d for x in images for d in media.describe(x[None])]]
    own = [media.keys(p[s]) for p, s in described]
    some = media.read([media.payload(p, k) for (p, _), k in zip(described, own)])
    own = [set(k.tolist()) for k in own]
    root = list(range(len(images)))
    for i in range(len(images)):
        for j in np.flatnonzero(media.same(some, i, some, np.arange(len(images)))).tolist():
            if own[i] & own[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    rows = [(n, x.shape[1], x.shape[0], x.tobytes(), "name") for n, x in enumerate(images)]
    frame = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, payload string")
    assert [r.component_id for r in media.image_copies(frame).orderBy("image_id").collect()] == root and len(set(root)) == 8


def test_image_workers_hold_few_rows_of_a_batch(monkeypatch):
    """A worker's memory doesn't grow with the rows of an incoming batch; nothing of it is lost."""
    vectors = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([None, *np.random.default_rng(3).random((2999, 16))], pa.list_(pa.float64()))], names=["image_id", "vector"])
    images = list(media.draw(iter([vectors]), 2))
    assert [i for b in images for i in b.column(0).to_pylist()] == list(range(3000)) and max(b.num_rows for b in images) <= media.ROWS
    points = np.zeros(100, media.POINT)
    points["bits"] = np.random.default_rng(4).integers(0, 256, points["bits"].shape)
    monkeypatch.setattr(media, "describe", lambda stack: [(points, np.ones(100, bool))] * len(stack))
    peaks = []
    for n in (media.ROWS, 12 * media.ROWS):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *(pa.array([32] * n, pa.int32()),) * 2, pa.array([None, *[bytes(32 * 32)] * (n - 1)], pa.binary())], names=["image_id", "width", "height", "pixels"])
        tracemalloc.start()
        assert [i for b in media.pointed(iter([batch])) for i in b.column(0).to_pylist()] == list(range(n))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 3 * peaks[0]
    large = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([bytes(media.HELD + 1), None, b"x"], pa.binary())], names=["id", "pixels"])
    assert [b.num_rows for b in media.slices(iter([large]), 1)] == [1, 2]
