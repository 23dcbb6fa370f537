"""Decontamination, clustering and resampling against brute force, and at the edges."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmill.llm import clusters, decontaminate, resampling
from reelmill.llm import words as w
from reelmill.llm.suffix import SuffixAutomaton

DOCS = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "One", None), (3, "One", None), (None, "no id " * 9, "en"), (5, "a b c d e f " * 3000, "en"), (7, "\n\n \n", "en"), (8, "é世x" + "y" * 3000 + " z", "x")]
    clash = {c: F.lit("x") for c in ("item_id", "__at", "n_words", "weight", "score", "rank", "bucket", "block", "able", "place", "gain")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


def fuzz(seed, n=300):
    rng = np.random.default_rng(seed)
    parts = ["a", "B", "é", "世", " ", " ", "-", "\n", "9", "xyzw", "\x00", "q" * 300, ""]
    return ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(n)]


def test_words_of_a_batch_are_those_of_each_text(monkeypatch):
    texts = fuzz(1)
    for piece in (1 << 21, 7):
        monkeypatch.setattr(w, "PIECE", piece)
        found = w.words_of(pa.array(texts).slice(5))
        own = [[found.word(i).decode() for i in range(a, b)] for a, b in zip(found.first, found.first[1:])]
        assert own == [lowered(t) for t in texts[5:]]
    h = w.hashes(found)
    by_word = {}
    assert all(by_word.setdefault(found.word(i), h[i]) == h[i] for i in range(len(h))) and len(set(by_word.values())) == len(by_word)


def test_crcs_of_runs_are_those_of_joined_words():
    found = w.words_of(pa.array(fuzz(2)))
    seen = 0
    for lo in (0, 100):
        for k, (begin, crc) in enumerate(w.run_crcs(found, 3, lo, len(found.starts))):
            for b, c in zip(begin.tolist(), crc.tolist()):
                assert c == zlib.crc32(b" ".join(found.word(b + j) for j in range(k + 1)))
                seen += 1
    assert seen > 3000


def brute_hits(doc, items, window):
    """(hit words, items, longest run that an item has too)."""
    words, hit, held = lowered(doc), set(), set()
    for name, text in items:
        own = lowered(text)
        k = min(window, len(own))
        wins = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for p in range(len(words) - k + 1 if k else 0):
            if tuple(words[p : p + k]) in wins:
                hit |= set(range(p, p + k))
                held |= {name} - {None}
    return len(words), len(hit), sorted(held)


def planted(seed, docs=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(str(i), " ".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(25)]
    items += [("25", None), ("26", "..."), ("27", "Solo"), (None, "quiet words that have no name"), ("3", "another text of item three"), ("28", items[4][1])]
    made = []
    for i in range(docs):
        text = list(rng.choice(vocabulary, rng.integers(0, 60)))
        some = lowered(items[rng.integers(0, len(items))][1])
        if some:
            a = rng.integers(0, len(some))
            text[len(text) // 2 : len(text) // 2] = some[a : a + rng.integers(1, 30)]
        made.append((i, " ".join(text).title() + ("! Solo" if i % 17 == 0 else "")))
    return made, items


@pytest.mark.parametrize(("window", "block_words", "lane"), [(10, 1 << 17, 2048), (4, 120, 8), (1, 1 << 17, 2048)])
def test_hits_match_brute_force(spark, monkeypatch, window, block_words, lane):
    docs, items = planted(window)
    df, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    limits = decontaminate.Limits(window=window)
    found = decontaminate.matches(df, of, limits, block_words=block_words).select("doc_id", "__match.*").collect()
    assert len(found) == len(docs)
    texts = dict(docs)
    for r in found:
        n, hits, held = brute_hits(texts[r.doc_id], items, window)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hits, held), r
        assert sum(s.end - s.start for s in r.spans) == hits


def test_lanes_find_what_one_pass_does(monkeypatch):
    rng = np.random.default_rng(3)
    strings = [(rng.integers(1, 4, rng.integers(1, 30)).tolist(), i) for i in range(8)]
    tokens = rng.integers(0, 4, 5000)
    made = SuffixAutomaton(strings, 3, 10)
    subs = {tuple(s[a:b]) for s, _ in strings for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    results = []
    for lane in (2048, 1):
        monkeypatch.setattr("reelmill.llm.suffix.LANE", lane)
        places, states, lengths = made.matched(tokens, *made.runs(tokens, np.array([0, 777])))
        order = np.argsort(places)
        results.append((places[order].tolist(), states[order].tolist(), lengths[order].tolist()))
    assert results[0] == results[1]
    for p, n in list(zip(results[0][0], results[0][2]))[::37]:
        longest = max((k for k in range(1, 31) if p - k + 1 >= 0 and not (p - k + 1 < 777 <= p) and tuple(tokens[p - k + 1 : p + 1]) in subs), default=0)
        assert n == longest


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 16)
    words = [f"x{i}" for i in range(100)]
    of = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    segments = decontaminate.segments_of(of, 10).collect()
    assert {tuple(words[i : i + 10]) for i in range(91)} <= {tuple(r.words.decode().split()[i : i + 10]) for r in segments for i in range(r.n - 9)}
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 10])) for i in range(91)] + [(99, " ".join(words[:9]))], "doc_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, of).collect()} == {i: 10 for i in range(91)} | {99: 0}


def test_spans_are_cut_and_hit_texts_go(spark, edges):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    of = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "É before, Alpha; beta gamma delta epsilon zeta eta theta iota kappa! and after it all come more of the words 世."), (2, item), (3, "clean"), (4, None), (4, None)]
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id long, text string"), of).collect()}
    assert got == {1: "É before, ! and after it all come more of the words 世.", 3: "clean", 4: None}
    kept = decontaminate.decontaminated(edges, of)
    assert kept.columns == edges.columns and sorted(map(str, kept.collect())) == sorted(map(str, edges.collect()))


def test_decontamination_edges(spark, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(edges, none).collect()
    assert len(rows) == edges.count() and all(r.n_hit == 0 and r["items"] == [] for r in rows)
    of = spark.createDataFrame([(1, "one"), (1, "one"), (None, "a b c")], "item_id long, text string")
    by_id = {r.doc_id: r for r in decontaminate.contamination(edges, of).collect()}
    assert (by_id[3].n_hit, by_id[3]["items"], by_id[1].n_words) == (1, ["1"], 0)
    assert (by_id[5].n_hit, by_id[5]["items"], by_id[5].n_words) == (9000, [], 18000)
    assert decontaminate.contamination(edges.limit(0), of).count() == 0


def brute_clusters(rows, s):
    kept = [(i, [math.floor(s.scale * float(x)) if abs(x) < 1e300 else int(x) * s.scale for x in v]) for i, v in rows if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[: s.k]]
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(s.rounds):
        of = [k for _, k in assign()]
        for k in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of) if o == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    found, most = assign(), clusters.MOST
    inertia = {k: sum(min(d, most) for d, o in found if o == k) for k in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i is None, i or 0), k, min(d, most), min(inertia[k], most), min(sum(inertia.values()), most), digest[k]) for (i, _), (d, k) in zip(kept, found)
    )


def vectors(seed, n, dims, large=False):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dims) + 3 * (i % 5 == 0)]) for i in range(n)]
    rows += [(i, [float(i % 3 - 1)] * dims) for i in range(n, n + 6)] + [rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1])]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1)), (904, [math.inf] + [1.0] * (dims - 1)), (905, [math.nan] * dims), (906, [0.0] * dims)]
    return rows + ([(907, [1e300] * dims), (908, [-1e308] * dims), (909, [2.5e9] * dims), (910, [5e6] * dims)] if large else [])


@pytest.mark.parametrize(("dims", "large"), [(64, False), (10, False), (6, True)])
def test_clusters_match_brute_force(spark, dims, large):
    rows = vectors(dims, 120, dims, large)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("vec", "short", "cluster", "own", "all")})
    s = clusters.Clustering(dims=dims, rounds=4)
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clusters.clustered(df, s).collect())
    assert got == brute_clusters(rows, s)


def test_bounds_leave_out_far_centroids_only(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(8, 64)) * 4
    rows = [(i, (middles[i % 8] + rng.normal(size=64) / 4).tolist()) for i in range(400)]
    _, centroids, left_out = clusters.fitted_centroids(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(centroids) == 8 and left_out > 0.5


def test_cluster_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clusters.clustered(empty).count() == 0
    few = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance, r.inertia) for r in clusters.clustered(few).collect()} == {(0, 0, 0), (1, 0, 0), (2, 0, 0)}


def brute_resampled(docs, target, s):
    def buckets(text):
        own = [x.encode() for x in lowered(text)]
        return [zlib.crc32(b" ".join(own[i : i + k])) % s.buckets for k in range(1, s.run + 1) for i in range(len(own) - k + 1)]

    own, wanted = [0] * s.buckets, [0] * s.buckets
    for _, text in docs:
        for b in buckets(text):
            own[b] += 1
    for text in target:
        for b in buckets(text):
            wanted[b] += 1
    gain = [math.floor(s.scale * math.log((t + 1) * (sum(own) + s.buckets) / ((n + 1) * (sum(wanted) + s.buckets)))) for n, t in zip(own, wanted)]
    scored = []
    for i, text in docs:
        found = buckets(text)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        scored.append((i, len(found), weight, weight + math.floor(-s.scale * math.log(-math.log((h + 0.5) / 4294967296))), len(lowered(text))))
    able = sorted((r for r in scored if r[4] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    place = [(*r[:4], k + 1 if k < s.percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return sorted(map(str, place + [(*r[:4], None) for r in scored if r[4] < s.least_words]))


@pytest.mark.parametrize("s", [resampling.Resampling(), resampling.Resampling(run=3, buckets=97, least_words=5, percent=40, seed="7")])
def test_resampling_matches_brute_force(spark, edges, s):
    docs = list(enumerate(fuzz(4))) + [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    target = fuzz(5, 20) + [None, "no id é世x"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("weight", "rank", "__at", "able", "bucket")})
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), s).collect()
    assert sorted(map(str, map(tuple, got))) == brute_resampled(docs, target, s)


def test_resampling_of_many_ties_and_empty_tables(spark, edges):
    same = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("w " * 30).alias("text")).repartition(7)
    target = spark.createDataFrame([("w",)], "text string")
    assert sorted(r.rank for r in resampling.resampled(same, target).where("rank is not null").collect()) == list(range(1, 51))
    assert resampling.resampled(edges.limit(0), target).count() == 0
    assert {r.weight for r in resampling.resampled(edges.limit(0).unionByName(edges.where("doc_id = 1")), target.limit(0)).collect()} == {0}
    assert resampling.drawn(edges, target).columns == edges.columns
