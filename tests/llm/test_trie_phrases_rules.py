"""op11 to op13 against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortflow.llm import collocations, prefix_trie, quality_rules


# --- prefix trie -------------------------------------------------------------------

CONV_SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def turn_key(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16]


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), turn_key(role, text), (role or "", text or "")))
    own = {c: [t[2] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if rebuilt[c] == p)))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 300), n):
        first = rng.choice(["hello", "hello", "hi é"])
        for t in range(rng.choice([0, 1, 3, 9, 9, 14])):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", first if t == 0 else rng.choice(["a", "b", None]), "x", 1))
    rows += [(400 + k, t, "user", f"same {t}", "x", 1) for k in range(30) for t in range(12)]  # copies
    rows += [(7, None, None, None, "x", 1), (7, 3, "user", "z", "x", 1), (7, 3, "user", "z", "x", 1), (7, 3, "bot", "y", "x", 1), (None, 1, "user", "lost", "x", 1)]
    rows += [(1000, t, "user", str(t % 7), "x", 1) for t in range(500)] + [(1001, t, None, str(t % 7), "x", 1) for t in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batch, cut", [(65536, 4096), (50, 16)])
def test_trie_equals_brute_force(spark, monkeypatch, batch, cut):
    monkeypatch.setattr(prefix_trie, "BATCH_ROWS", batch)
    monkeypatch.setattr(prefix_trie, "CHAIN_SLICE", cut)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 4)
    rows = conversations(batch)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV_SCHEMA).repartition(5)).drop("node").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute_trie(rows)


def test_empty_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV_SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "x", 1)], CONV_SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), max_size=25))
def test_local_trie_finds_every_exit(paths):
    name = lambda p: repr(tuple(p)).encode()
    trie, seen = prefix_trie.ZFastTrie(name([])), {()}
    for c, p in enumerate(paths):
        full = [name(p[:d]) for d in range(len(p) + 1)]
        assert trie.exit_node(full)[1] == max(d for d in range(len(p) + 1) if tuple(p[:d]) in seen)
        if p:
            trie.insert(full, [0] * len(full), c, True)
            seen |= {tuple(p[:d]) for d in range(len(p) + 1)}
    nodes = list(trie.expand())
    assert sorted(n[0] for n in nodes) == sorted(name(p) for p in seen if p)
    for node, depth, parent, conv, n, _, ends in nodes:
        through = [c for c, p in enumerate(paths) if len(p) >= depth and name(p[:depth]) == node]
        assert (conv, n, ends) == (through[0], len(through), [c for c in through if len(paths[c]) == depth])


# --- collocations ------------------------------------------------------------------

def brute_collocations(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3, 4):
                counts[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrases(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "of", "é", "New", "york", "city", "hall", "a", "b c", "x-y", "ß"]
    rows = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 40)):
            t += rng.choice(words) if rng.random() < 0.7 else "New York City hall"
            t += rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"])
        rows.append((rng.choice(["en", "de", None, "und"]), t))
    return rows + [("en", None), ("en", ""), ("fr", " \t\n"), ("de", "rare words only here")]


@pytest.mark.parametrize("bits, block", [(26, 16 << 20), (16, 500)])
def test_collocations_equal_brute_force(spark, monkeypatch, bits, block):
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rows = phrases(bits)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("w1", F.lit("x")).repartition(4)
    for least, top in ((3, 2000), (8, 5)):
        assert sorted(map(tuple, collocations.collocations(docs, least, top).collect())) == brute_collocations(rows, least, top)


def test_a_full_bitmap_change_nothing(spark, monkeypatch):
    rows = phrases(3, 40)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "_bitmap", lambda keys: b"\xff" * 8192)
    assert sorted(map(tuple, collocations.collocations(docs, 4, 9).collect())) == brute_collocations(rows, 4, 9)


def test_collocations_of_awkward_rows(spark):
    found = collocations.collocations(awkward(spark), 2, 50).collect()
    rows = [(r.lang, r.text) for r in awkward(spark).collect()]
    assert sorted(map(tuple, found)) == brute_collocations(rows, 2, 50)
    assert collocations.collocations(empty(spark)).count() == 0


def test_score_passes_64_bits(spark):
    row = spark.createDataFrame([(2**62, 3, 4)], "a long, l long, r long")
    score = "(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"
    big = spark.createDataFrame([(2**62, 2**61, 2**61 + 5)], "a long, l long, r long")
    assert big.select(F.expr(score)).first()[0] == 2000000 * 2**62 // (2**62 + 5)
    assert row.count() == 1


# --- quality rules -----------------------------------------------------------------

def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é#<\n\t  \x1c\r", max_size=60), st.lists(st.sampled_from("abc"), max_size=40))
def test_statistics(text, words):
    assert quality_rules.text_statistics(text) == brute_statistics(text)
    assert quality_rules.text_statistics(" ".join(words)) == brute_statistics(" ".join(words))


def brute_estimate(x):
    """The same subset search in numpy on one group."""
    q, d = quality_rules, quality_rules.DIMS
    floor, prior = (np.diag(np.square(v)) for v in (q.FLOOR, q.PRIOR))
    widen = q.SHARE / q.chi_square(q.chi_square_quantile(q.SHARE, d), d + 2)

    def solve(y):
        scatter = ((y.T @ y) / len(y) - np.outer(y.mean(0), y.mean(0))) / q.GRID**2 * widen
        return y.mean(0) / q.GRID, (scatter * len(y) + prior * q.PRIOR_ROWS) / (len(y) + q.PRIOR_ROWS) + floor

    lower = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    middle = lower(x)
    scale = np.sqrt((1.4826 / q.GRID * lower(abs(x - middle))) ** 2 + np.square(q.FLOOR))
    unit = (x - middle) / q.GRID / scale
    size = np.sqrt((unit**2).sum(1))[:, None]
    ways = np.where(size > 0, np.round(unit / np.where(size > 0, size, 1) * scale * q.GRID), 0)

    def steps(centre, scatter, n):
        for _ in range(n):
            off = x / q.GRID - centre
            step = np.floor(np.log2(1 + np.einsum("ni,ij,nj->n", off, np.linalg.inv(scatter), off)) * q.GRID)
            edge = np.sort(step)[int(np.ceil(q.SHARE * len(x))) - 1]
            centre, scatter = solve(x[step <= edge].astype(float))
        return np.linalg.slogdet(scatter)[1], centre, scatter

    starts = [steps(middle / q.GRID, scatter, q.FIRST_STEPS) for scatter in (np.diag(scale**2), solve(ways)[1])]
    _, centre, scatter = min(starts, key=lambda r: r[0])
    return steps(centre, scatter, q.STEPS - q.FIRST_STEPS)


def test_estimate_equals_numpy_and_is_robust(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for k, n in enumerate((400, 60, 3)):
        x = rng.normal([5, 1.6, 0, 0, 0.02], [0.8, 0.1, 0.05, 0.2, 0.01], (n, 5))
        x[: n // 6] += [0, 0.5, 5, 1, 0]
        groups["en", f"s{k}"] = np.round(x * quality_rules.GRID).astype(np.int64)
    rows = [(lang, source, v.tolist()) for (lang, source), x in groups.items() for v in x]
    found = quality_rules.estimates(spark.createDataFrame(rows, "lang string, source string, x array<long>").repartition(4)).collect()
    assert len(found) == 3
    for r in found:
        _, centre, scatter = brute_estimate(groups[r.lang, r.source])
        assert np.allclose(r.centre, centre, atol=1e-9) and np.allclose(np.array(r.inverse).reshape(5, 5), np.linalg.inv(scatter), rtol=1e-6)
    centre = next(r.centre for r in found if r.source == "s0")
    assert abs(centre[2]) < 0.1 and abs(centre[0] - 5) < 0.2  # a sixth of the rows does not move it


def test_rules_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    rows = [(k, text(rng.randint(40, 300)), "en", "a", 5, "x") for k in range(150)]
    rows += [(200 + k, " ".join(w + "###" for w in text(80).split()), "en", "a", 5, "x") for k in range(20)]
    rows += [(300, "too short", "en", "a", 5, "x"), (301, text(6) * 12, "en", "a", 5, "x"), (302, None, None, None, 5, "x"), (303, "", "en", "a", 5, "x"),
             (304, text(50), None, None, 5, "x"), (None, rows[0][1], "en", "a", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, centre string").repartition(3)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        assert tuple(got[k])[1:6] == brute_statistics(t)
        n, *_, repeated = brute_statistics(t)
        assert got[k].base_failed == (n < 10 or 100 * repeated > 20 * n)
    assert all(got[k].kept for k in range(150)) and not any(got[200 + k].kept for k in range(20))
    assert [got[k].kept for k in (300, 301, 302, 303, 304, None)] == [False, False, False, False, True, True]
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    assert quality_rules.quality_rules(awkward(spark).withColumn("inverse", F.lit(1))).count() == awkward(spark).count()


def test_chi_square():
    assert abs(quality_rules.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality_rules.chi_square_quantile(0.75, 5) - 6.6257) < 1e-3
