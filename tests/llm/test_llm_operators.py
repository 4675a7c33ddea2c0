"""Training-data operators against brute force, and on odd input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cloudloom.llm import bpe, decontaminate, graph, langid, licenses, neardup, packing, sharding, token_counts, topk, toxicity, warc
from cloudloom.llm.covertree import Best, Tree, search
from cloudloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, size int, hits string, kind int, id long, __hits int"


def docs(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, 1, "x", 2, 3, 4) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "null id"), (7, "word " * 30_000), (8, "x" * 100_000), (9, "don't <|endoftext|>  stop\n\n now"), (10, "日本語 é ß")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=3000):
    rng = random.Random(3)
    letters = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", ".", "é", "　", "<|endoftext|>", "\x1c", "ing", "́", "\r\n"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_heap_merges_count_as_the_library(library):
    m = bpe.HeapMerger(vocabulary(), cached=50)
    for t in odd_texts():
        assert m.count(t) == len(ids_of(library, t)), repr(t)


def test_chunks_join_to_the_text():
    for t in odd_texts(500):
        assert "".join(bpe.chunks(t)) == t


def test_token_counts(spark, library):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, ODD), vocabulary()).collect())
    want = sorted((i or 0, len((t or "").encode()), n := len(ids_of(library, t)), n > 512) for i, t in ODD)
    assert got == want
    assert token_counts.token_counts(docs(spark, []), vocabulary()).count() == 0


def test_packing_is_whole(spark, library):
    e = packing.ChunkEncoder(vocabulary(), cached=50)
    for t in odd_texts(1500):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(library, t), repr(t)
    rows = packing.pack(docs(spark, ODD), vocabulary()).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert r.length == r.bucket and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    texts = dict(ODD)
    for i, pieces in by.items():
        if i == 5:
            continue
        pieces.sort(key=lambda r: r.start)
        ids = [x for r in pieces for x in r.ids]
        assert ids == [*ids_of(library, texts[i]), 0] and all(r.doc_tokens == len(ids) for r in pieces)
    assert len(by[5]) == 2 * len({r.start for r in by[5]})
    assert packing.pack(docs(spark, []), vocabulary()).count() == 0


def test_sharding_against_brute_force(spark):
    texts = [(i, f"text {i % 40}") for i in range(400)] + [(500, None), (501, ""), (None, "z"), (3, "text 3")]
    rows = sharding.shard(docs(spark, texts), [1.0] * 7, cell_rows=10).collect()
    score = lambda k, s: -math.log((int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 1) / 2**52)
    slots = collections.defaultdict(list)
    for r in rows:
        k = "null" if r.doc_id is None else r.doc_id
        assert r.shard == min(range(7), key=lambda s: (score(k, s), s)) and r.grown_shard == min(range(8), key=lambda s: (score(k, s), s))
        assert r.grown_shard in (r.shard, 7) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    one = next(r for r in rows if r.doc_id == 500)
    assert one.size == 16 and one.text_crc32 == 0
    heavy = collections.Counter(r.shard for r in sharding.shard(docs(spark, [(i, "") for i in range(3000)]), [1.0, 3.0]).collect())
    assert 2.4 < heavy[1] / heavy[0] < 3.7
    assert sharding.shard(docs(spark, []), [1.0] * 3).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long, short = "L" * 1500, "s" * 10
    pages = [(1, "http://a/é x", long), (2, None, long), (3, "u", short), (4, "u", short), (5, "u\r\nX: y", None), (6, "u", "once " * 400), (None, "u", long), (7, "u", long), (7, "u", long)]
    df = spark.createDataFrame([(*p, 9, "q") for p in pages], "page_id long, url string, html string, kind int, digest string")
    path = f"file://{tmp_path}/a"
    manifest = warc.write(df, path, shard_bytes=2000, roll_bytes=300).collect()
    rows = warc.read(spark, path).collect()
    assert sum(m.records for m in manifest) == len(rows) == len(pages) and len(manifest) > 2
    for r in rows:
        html = {p[0]: p[2] for p in pages}[r.key] or ""
        repeats = html == long and r.key != 7
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 7) if repeats else ("response", None))
    again = warc.write(df.repartition(5), f"file://{tmp_path}/b", shard_bytes=2000, roll_bytes=300).collect()
    assert sorted(manifest) == sorted(again)
    damaged = next(f for f in (tmp_path / "a").iterdir() if f.name == manifest[0].file)
    damaged.write_bytes(damaged.read_bytes()[:-20])
    with pytest.raises(Exception, match="archive ends|incomplete|records"):
        warc.read(spark, path).collect()
    assert warc.write(df.limit(0), f"file://{tmp_path}/c").count() == 0 and warc.read(spark, f"file://{tmp_path}/c").count() == 0


def brute_components(rows, size, percent):
    sets, ids = {}, {i: i for i, _ in rows if i is not None}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if any(s and o and 100 * len(s & o) >= percent * len(s | o) for s in sets[a] for o in sets[b]):
                p, q = sorted((find(a), find(b)))
                ids[q] = p
    return {i: find(i) for i in ids}


def edited(rng, words, share):
    return [rng.choice(["zu", "vor", "am"]) + str(rng.randint(0, 9999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("paired", "posted"), [(24, 1024), (3, 1024), (1, 4)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, paired, posted):
    monkeypatch.setattr(neardup, "PAIRED", paired)
    monkeypatch.setattr(neardup, "POSTED", posted)
    rng = random.Random(5)
    rows = [(i, t) for i, t in ODD if i not in (7, None)]
    for g in range(8):
        base = [f"w{rng.randint(0, 800)}" for _ in range(120)]
        for c in range(9):
            rows.append((100 + 20 * g + c, " ".join(edited(rng, base, 0.004 * g))))
        rows.append((100 + 20 * g + 15, " ".join(base).upper() if g == 0 else "  ".join(base)))
    common = [f"p{i}" for i in range(60)]
    rows += [(1000 + i, " ".join(common + [f"q{rng.randint(0, 10**6)}" for _ in range(30)])) for i in range(25)]
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), size=4).collect()}
    want = brute_components(rows, 4, 80)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(k == (i == c) for i, (c, k) in got.items())


def test_near_duplicates_on_odd_input(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, ODD)).collect()}
    assert (1, 0, 1, True) in rows and (3, 0, 3, True) in rows and (4, 1, 4, True) in rows and (5, 1, 4, False) in rows
    assert (None, 1, None, True) in rows and (7, 1, 7, True) in rows
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_odd_sketch_follows_similarity():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for share in (1.0, 0.9, 0.8):
        o = np.concatenate([s[: int(1000 * share)], rng.integers(0, 2**63, 1000 - int(1000 * share)).astype(np.uint64)])
        a, b = (neardup.odd_sketch(neardup.minhashes(np.unique(x))) for x in (s, o))
        bits = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
        jaccard = share / (2 - share)
        estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * math.log(1 - 2 * bits / neardup.SKETCH_BITS)
        assert abs(estimate - jaccard) < 0.2


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_alignment_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a, b = [rng.randint(0, 6) for _ in range(rng.randint(1, 14))], [rng.randint(0, 6) for _ in range(rng.randint(1, 25))]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, begin, end = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == h.max()
        assert score == 0 or (begin < end and decontaminate.align(np.array(a, np.uint64), np.array(b[begin:end], np.uint64))[0] == score)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination(spark, block_bytes):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(3000)]
    item = {i: [rng.choice(words) for _ in range(40)] for i in range(6)}
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(10, " ".join(filler(50) + item[0] + filler(20))), (11, " ".join(item[1][:20] + ["extra"] + item[1][20:])), (12, "; ".join(edited(rng, item[2], 0.15)).upper()), (13, " ".join(filler(400)))]
    rows += [(20 + i, " ".join(filler(5) + item[3] + filler(5))) for i in range(40)] + [(1, None), (2, ""), (14, " ".join(filler(9000) + item[4] + filler(9000) + item[5])), (None, " ".join(item[5]))]
    items = spark.createDataFrame([(i, " ".join(w), "z") for i, w in item.items()] + [(7, None, "z"), (8, "  ", "z")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), items, block_bytes=block_bytes).collect()}
    assert got == {(10, 0), (11, 1), (12, 2), (14, 4), (14, 5), (None, 5)} | {(20 + i, 3) for i in range(40)}
    kept = decontaminate.clean(docs(spark, rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 13] and kept.columns == docs(spark, []).columns
    assert decontaminate.leaks(docs(spark, []), items).count() == 0 and decontaminate.leaks(docs(spark, rows), items.limit(0)).count() == 0
    assert decontaminate.clean(docs(spark, rows), items.limit(0)).count() == len(rows)


def brute_licences(text, least):
    out = set()
    g = decontaminate.grams(decontaminate.word_hashes(text), 2)
    for k, (_, t) in enumerate(licenses.TEMPLATES):
        own = decontaminate.grams(decontaminate.word_hashes(t), 2)
        width, own_set = min(len(own), len(g)), set(own.tolist())
        best = max((2 * len(set(g[i : i + width].tolist()) & own_set) / (len(set(g[i : i + width].tolist())) + len(own_set)) for i in range(len(g) - width + 1)), default=0)
        if best >= least:
            out.add((k, round(best, 9)))
    return out


def test_licence_scan(spark):
    full = licenses.TEMPLATES[2][1]
    rows = [*ODD, (30, "prose before. Released under the MIT License. prose after"), (31, "x " * 300 + full.replace("sublicense", "resell") + " y" * 50), (32, "licence of another kind"), (33, "Licensed under CC BY-NC 4.0. " + licenses.TEMPLATES[5][1])]
    got = collections.defaultdict(set)
    for r in licenses.scan(docs(spark, rows)).collect():
        got[r.doc_id].add((r.template, round(r.dice, 9)))
    assert set(got) == {30, 31, 33} and got[30] == {(0, 1.0)} and {t for t, _ in got[33]} == {5, 9}
    for i, t in rows:
        if t and len(t) < 5000:
            found, want = got.get(i, set()), brute_licences(t, 0.8)
            assert found <= want and bool(found) == bool(want) and max(found, key=lambda m: m[1], default=(0, 0))[1] == max(want, key=lambda m: m[1], default=(0, 0))[1]
    assert licenses.scan(docs(spark, [])).count() == 0


def brute_top(vectors, k):
    out = {}
    ids = np.array([i for i, _ in vectors])
    x = np.floor(256 * np.array([v for _, v in vectors], float)).astype(np.int64)
    for n, i in enumerate(ids):
        if i % 50 == 0:
            s = x @ x[n]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), int(s[j])) for j in order]
    return out


def answers(df):
    got = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(8)
    v = [(i, rng.normal(size=6).round(3).tolist()) for i in range(700)]
    v += [(1000 + i, [0.5] * 6) for i in range(260)]  # one vector many times
    schema = "vec_id long, embedding array<double>, id long, d int, score string"
    odd = [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2050, [float("nan")] * 6), (2100, [float("inf")] * 6), (2150, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, x, 1, 2, "s") for i, x in v + [(i, None if x is None else [None if y is None else float(y) for y in x]) for i, x in odd]], schema)
    assert answers(topk.top_k(df, F.col("vec_id") % 50 == 0, 5)) == brute_top(v, 5)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert answers(topk.top_k(few, F.col("vec_id") % 50 == 0, 5)) == {0: [(1, 256 * 512)]}
    assert topk.top_k(few.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_dual_tree_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 5)) * 4000
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 5)) * 30).astype(np.int64)
    q = x[::40] + 1
    best = Best.empty(len(q), 3)
    tree = Tree(np.arange(10_000, 10_000 + len(q)), q, 6)
    taken = search(tree, Tree(np.arange(len(x)), x), best)
    assert taken < q.shape[0] * x.shape[0] / 3
    for i, row in enumerate(tree.rows):
        s = x @ row
        order = np.lexsort((np.arange(len(x)), -s))[:3]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == s[order].tolist()


LANGS = {"aa": "the and of water stone river", "bb": "der und das schloss berg straße", "cc": "les et une été fenêtre jour"}


def test_language_id(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(LANGS[k].split()) for _ in range(30)), k) for i in range(240) for k in [rng.choice(list(LANGS))]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 ...", "aa"), (902, "", None), (903, "der " * 20_000, None)], "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 4 <> 2"), rows_of_language=60)
    got = {r.doc_id: (r.p.lang_pred, r.p.score) for r in df.select("doc_id", langid.predict(df, model).alias("p")).collect()}
    assert all(got[i][0] == k for i, _, k in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "bb"
    assert (model.weights == 0).mean() > 0.5
    empty = langid.fit(df.limit(0))
    assert df.limit(3).select(langid.predict(df, empty).alias("p")).collect()[0].p.lang_pred == "und"


def test_temperature_lowers_loss():
    rng = np.random.default_rng(3)
    z, y = rng.normal(size=(400, 3)) * 8, rng.integers(0, 3, 400)
    t = langid.temperature(z, y)
    loss = lambda s: float(-np.log(np.maximum(langid.softmax(z / s)[np.arange(400), y], 1e-300)).mean())
    assert loss(t) < loss(1.0) and t > 1


def test_licence_stretches_of_any_size():
    scan = licenses.Scanner.of(licenses.TEMPLATES, 0.8).scan
    mit, gpl3, gpl2 = (licenses.TEMPLATES[k][1] for k in (2, 6, 8))
    cut = mit.split()
    longer = " ".join(cut[:40] + [f"new{i}" for i in range(25)] + cut[40:])
    assert [(m[1], m[3], m[4]) for m in scan("a b c " + longer + " d e")] == [(2, 3, len(licenses.word_hashes(longer)) - 2)]  # "the Software" at the end stands in it before
    assert [m[1] for m in scan("before " + " ".join(cut[: len(cut) * 3 // 4]) + " after")] == [2]
    edited = gpl3.replace("published by", "made public by").replace("any later version", "later ones")
    assert [m[0] for m in scan(gpl2 + " and some prose between them " + edited)] == ["GPL-2.0", "GPL-3.0"]
    assert [(m[1], m[2]) for m in scan(" some prose ".join([mit] * 3))] == [(2, 1.0)] * 3


def test_licences_near_others_have_their_own_name():
    scan = licenses.Scanner.of(licenses.TEMPLATES, 0.8).scan
    for name, text in licenses.TEMPLATES:
        assert [(m[0], m[2]) for m in scan(f"before {text} after")] == [(name, 1.0)]
    gnu = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
    assert [m[0] for m in scan(gnu.format("This library", ";", "Lesser", ";", "2.1"))] == ["LGPL-2.1"]
    assert [m[0] for m in scan(gnu.format("This program", ":", "Affero", ",", "3"))] == ["AGPL-3.0"]
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause")
    tail = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert [m[0] for m in scan(bsd + tail)] == ["BSD-3-Clause"]


def test_licence_stretches_against_brute_force():
    rng = random.Random(8)
    templates = [("A", "a b c d e f g h"), ("B", "a b c x e f g y z"), ("C", "p q r s p q t")]
    for _ in range(150):
        parts = [rng.choice(templates)[1].split() if rng.random() < 0.5 else rng.choices("abcdefghxyzpqrst", k=5) for _ in range(4)]
        words = [w for part in parts for w in part if rng.random() > 0.05]
        g = decontaminate.grams(decontaminate.word_hashes(" ".join(words)), 2).tolist()
        every = []
        for k, (_, t) in enumerate(templates):
            own = set(decontaminate.grams(decontaminate.word_hashes(t), 2).tolist())
            for i in range(len(g)):
                for j in range(i + 1, len(g) + 1):
                    dice = 2 * len(set(g[i:j]) & own) / (len(set(g[i:j])) + len(own))
                    if dice >= 0.8:
                        every.append((-dice, -(len(t.split()) - 1), k, j - i, i))
        want = []
        for m in sorted(every):
            if all(m[4] + m[3] + 1 <= o[4] or o[4] + o[3] + 1 <= m[4] for o in want):
                want.append(m)
        got = licenses.Scanner.of(templates, 0.8).scan(" ".join(words))
        want.sort(key=lambda m: m[4])
        assert [(m[1], m[2]) for m in got] == [(m[2], -m[0]) for m in want]
        assert all(m[3] <= o[4] and o[4] + o[3] + 1 <= m[3] + m[4] and (-o[0], o[2], m[4] - 1, m[3]) in {(-e[0], *e[2:]) for e in every} for m, o in zip(got, want, strict=True))
        assert all(a[3] + a[4] <= b[3] for a, b in zip(got, got[1:]))


def test_toxicity_learns_terms_and_pairs(spark):
    rng = random.Random(9)
    plain = [f"plain{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        w = rng.sample(plain, 12)
        a, b, c = (rng.random() < p for p in (0.4, 0.4, 0.15))
        w += ["scoundrel"] * a + ["group"] * b + ["vilest"] * c
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(c or (a and b))))
    rows += [(2000, None), (2001, ""), (2002, "group " + "plain1 " * 30_000 + "scoundrel")]
    df = docs(spark, rows)
    machine = toxicity.fit(spark.createDataFrame(labels[:600] + labels[:5] + [(1, None), (None, 1)], "doc_id long, toxic int"), df)
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score(df, machine).alias("s")).collect()}
    wrong = sum((got[i] >= 0.5) != bool(y) for i, y in labels[600:])
    assert wrong <= 12 and all(0 <= s <= 1 for s in got.values()) and got[2000] == got[2001] < 0.5
    assert toxicity.fit(spark.createDataFrame([], "doc_id long, toxic int"), df) is None
    assert df.select(toxicity.score(df, None).alias("s")).first().s == 0.0


def test_toxicity_learns_terms_that_are_neutral_alone():
    rng = random.Random(4)

    def drawn(times):
        pairs = [(a, b) for a in range(30) for b in range(30)] * times  # each term meets as many of one label as of the other
        rng.shuffle(pairs)
        texts = [" ".join([f"i{a}", f"g{b}", *(f"plain{k}" for k in rng.sample(range(200), 10))]) for a, b in pairs]
        return [toxicity.terms(t) for t in texts], [(a + b) % 2 for a, b in pairs]

    rows, labels = drawn(8)
    machine = toxicity.learn(rows, labels)
    held_out, truth = drawn(1)
    scores = np.array([machine.margin(at) for at in held_out])
    truth = np.array(truth, bool)
    assert (scores[truth][:, None] > scores[~truth]).mean() > 0.9  # the area under the curve


def test_word_hashes_do_not_depend_on_the_process():
    assert neardup._words[b"abc"] == xxhash.xxh3_64_intdigest(b"abc")
