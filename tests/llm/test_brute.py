"""Pseudonyms, shards and toxicity against plain Python."""

import datetime
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.llm import pii, queries, sharding, toxicity

KEY = "public-test-key"


def mixed(what, turn, half):
    return int(hashlib.sha256("\x1f".join((KEY, what, str(turn), str(half))).encode()).hexdigest()[:15], 16)


def feistel(a, b, high, low, what):
    for turn in range(8):
        if turn % 2 == 0:
            a = (a + mixed(what, turn, b) % high) % high
        else:
            b = (b + mixed(what, turn, a) % low) % low
    return a, b


def digits(s, what):
    left = len(s) // 2
    a, b = feistel(int(s[:left]), int(s[left:]), 10**left, 10 ** (len(s) - left), what)
    return f"{a:0{left}d}{b:0{len(s) - left}d}"


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s)))


def refilled(shape, new):
    left = iter(new)
    return "".join(next(left) if c.isascii() and c.isdigit() else c for c in shape)


def only(x):
    return re.sub("[^0-9]", "", x)


def card(x):
    d = only(x)
    if luhn(d) % 10:
        return None
    body = digits(d[:-1], "card")
    return refilled(x, body + str(-luhn(body + "0") % 10))


def phone(x):
    d, country = only(x), re.match(r"^\+(\d{1,3})[ .(-]", x)
    country = country[1] if country else ""
    return refilled(x, country + digits(d[len(country) :], "phone")) if 8 <= len(d) <= 15 else None


def address(x):
    p = [int(v) for v in x.split(".")]
    if max(p) > 255:
        return None
    a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "address")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def ssn(x):
    area, group, serial = map(int, x.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    a, b = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def date(x):
    form = "%Y-%m-%d" if "-" in x else "%m/%d/%Y" if "/" in x else "%d.%m.%Y"
    try:
        day = datetime.datetime.strptime(x, form).date()
    except ValueError:
        return None
    if not 100 <= day.year < 9700:
        return None
    start = datetime.date(1700, 1, 1)
    cycle, within = divmod((day - start).days, 146_097)
    a, b = feistel(within // 773, within % 773, 189, 773, "date")
    new = start + datetime.timedelta(days=cycle * 146_097 + a * 773 + b)
    return form.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def account(x):
    plain = x.replace(" ", "")
    d = only(plain[4:])
    if len(d) < 4 or len(plain) < 12 or mod97(plain) != 1:
        return None
    new = refilled(plain[4:], digits(d, "account"))
    return refilled(x, f"{98 - mod97(plain[:2] + '00' + new):02d}" + only(new))


def email(x):
    return f"user-{hashlib.sha256(chr(31).join((KEY, 'email', x.lower())).encode()).hexdigest()[:16]}@example.invalid"


MAKE = {"email": email, "account": account, "date": date, "ssn": ssn, "address": address, "phone": phone, "card": card}


def pseudonymised(text):
    """The text with pseudonyms, and the kinds replaced; a piece that isn't valid under its first shape stays."""
    found, out, at = [], [], 0
    shapes = [(k, re.compile(p.replace(r"\p{L}\p{N}_", r"\w").replace("++", "+"))) for k, p in pii.SHAPES]
    for m in re.finditer("|".join(f"({p.pattern})" for _, p in shapes), text):
        kind = next(k for k, p in shapes if p.fullmatch(m[0]))
        new = MAKE[kind](m[0])
        out += [text[at : m.start()], m[0] if new is None else new]
        found += [kind] * (new is not None)
        at = m.end()
    return "".join([*out, text[at:]]), found


def personal(rng):
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    kind = rng.integers(0, 9)
    if kind == 0:
        d = n(int(rng.integers(12, 19)))
        return d + str(-luhn(d + "0") % 10) if rng.random() < 0.8 else d + "0"
    if kind == 1:
        d = n(15)
        d += str(-luhn(d + "0") % 10)
        return rng.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == 2:
        body = n(18)
        return f"DE{98 - mod97('DE00' + body):02d}{body}"
    if kind == 3:
        return rng.choice([f"{rng.integers(1, 9999):04d}-{rng.integers(1, 14):02d}-{rng.integers(1, 32):02d}", f"{rng.integers(1, 14):02d}/{rng.integers(1, 32):02d}/{rng.integers(90, 9800):04d}", f"{rng.integers(1, 32):02d}.{rng.integers(1, 13):02d}.{rng.integers(1600, 2200):04d}"])
    if kind == 4:
        return f"{rng.choice([0, 1, 665, 666, 667, 899, 900])!s:0>3}-{rng.integers(0, 100):02d}-{rng.integers(0, 10000):04d}"
    if kind == 5:
        return ".".join(str(x) for x in rng.integers(0, 300 if rng.random() < 0.3 else 256, 4))
    if kind == 6:
        return f"+{rng.integers(1, 500)}{rng.choice([' ', '-', '.'])}{n(3)} {n(3)}-{n(4)}"
    if kind == 7:
        return f"{rng.choice(['a.b', 'Joe_7', 'x+y'])}@mail{rng.integers(0, 9)}.example.org"
    return rng.choice(["word", "12 345", "1.2.3", "2020-13", "é"])


def test_pseudonyms_match_plain_permutations(spark):
    rng = np.random.default_rng(11)
    texts = [" , ".join(personal(rng) for _ in range(rng.integers(0, 9))) for _ in range(250)]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    kinds = Counter()
    for i, text in enumerate(texts):
        want, found = pseudonymised(text)
        assert (got[i].text, list(got[i].found)) == (want, found), text
        kinds.update(found)
    assert set(kinds) == set(MAKE) and min(kinds.values()) > 10


def test_pseudonym_query_counts_kinds(spark, documents):
    rows = queries.op3_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        want, found = pseudonymised(texts[r.doc_id]) if texts[r.doc_id] else (texts[r.doc_id], [])
        assert r.text == want and [r[f"n_{k}"] for k in pii.KINDS] == [found.count(k) for k in pii.KINDS]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_shard_query_keeps_its_contract(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "é" * int(rng.integers(0, 300)) if i % 7 else None) for i in range(3000)] + [(None, "x"), (None, None), (5, "again"), (5, "again"), (9999, "y" * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    made = queries.op5_sharding(spark, str(tmp_path)).collect()
    raw = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in made) == sorted((str(i), len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in made} == {("bytes", None)} and {r.shard for r in made} == set(range(16))
    by_shard = {}
    for r in made:
        by_shard.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values())
    sizes = [sum(r["size"] for r in own) for own in by_shard.values()]
    assert max(sizes) - min(sizes) <= 2 * 5001  # the largest record
    # the map is the greedy one of slot sizes, and a slot is an id's for ever
    slots, of = Counter(), {}
    for r in made:
        slots[r.virtual_slot] += r["size"]
        assert of.setdefault(r.virtual_slot, r.shard) == r.shard
    load, want = [0] * 16, {}
    for v in sorted(range(sharding.SLOTS), key=lambda v: (-slots[v], v)):
        s = min(range(16), key=lambda s: (load[s], s))
        want[v] = s
        load[s] += slots[v]
    assert all(want[v] == s for v, s in of.items())


def plain_features(text, bits):
    words = re.findall(rb"[a-z\x80-\xff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode())
    h = [zlib.crc32(x) for x in words]
    mask, turn = (1 << 64) - 1, 0x9E3779B97F4A7C15
    every = h + [(a * 0x9E3779B1 + b * 0x85EBCA6B + 1) & mask for a, b in zip(h, h[1:])] + [(a * 0xC2B2AE35 + b * 0x27D4EB2F + 2) & mask for a, b in zip(h, h[2:])]
    return sorted({(x * turn & mask) >> (64 - bits) for x in every})


def plain_ftrl(rows, s):
    """FTRL-proximal a coordinate at a time, over dictionaries."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(zi, ni, l1):
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((s.beta + ni**0.5) / s.alpha + s.l2)

    def step(zi, ni, g, w):
        return zi + g - ((ni + g * g) ** 0.5 - ni**0.5) / s.alpha * w, ni + g * g

    for epoch in range(s.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, label = rows[k]
            w, b = {i: weight(z.get(i, 0.0), n.get(i, 0.0), s.l1) for i in at}, weight(*bias, 0.0)
            g = (1 / (1 + np.exp(-np.clip(b + sum(w.values()), -40, 40))) - label) * (s.lift if label else 1.0)
            for i in at:
                z[i], n[i] = step(z.get(i, 0.0), n.get(i, 0.0), g, w[i])
            bias = list(step(*bias, g, b))
    return weight(*bias, 0.0), {i: v for i in z if (v := weight(z[i], n[i], s.l1))}


def test_toxicity_matches_plain_ftrl(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(120)]
    texts = {i: " ".join([*rng.choice(words, 12), *(["Vile", "scum!"] if i % 4 == 0 else [])]) for i in range(240)} | {240: "", 241: None, 242: "é vile"}
    labels = [(i, 0, int(i % 4 == 0)) for i in range(0, 240, 1)] + [(999, 0, 1), (4, 1, 0), (None, 0, 1), (8, 0, None)]
    s = toxicity.ToxicitySettings(bits=12, epochs=3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = toxicity.toxicity(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), s).collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = {i: int(i % 4 == 0) for i in range(240) if not out(i)}
    order = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    rows = [(plain_features(texts[i], s.bits), known[i]) for i in sorted(known, key=order.get)]
    bias, weights = plain_ftrl(rows, s)
    assert len(weights) > 2
    for r in made:
        score = 1 / (1 + np.exp(-(bias + sum(weights.get(i, 0.0) for i in plain_features(texts[r.doc_id] or "", s.bits)))))
        assert r.score == pytest.approx(score, rel=1e-9) and r.held_out == out(r.doc_id) and r.predicted == int(score >= 0.7)
