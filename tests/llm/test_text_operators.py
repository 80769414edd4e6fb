import re
import zlib

import numpy as np
import pytest
import xxhash
from helpers import DOC_SCHEMA, awkward, empty, prose, row
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortflow.llm import components, decontaminate, language, licenses, packing, quality, sharding, simhash, token_counts
from cohortflow.llm.common import remainder


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- SimHash ---------------------------------------------------------------------

def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash_matches_brute_force(spark, monkeypatch):
    base = prose(50, 400)
    near = [base.replace(" ", "  ", k) + f" tail{k}" for k in range(6)]
    docs = spark.createDataFrame([row(100 + k, t) for k, t in enumerate(near)], DOC_SCHEMA).union(awkward(spark))
    monkeypatch.setattr(simhash, "NODE_ROWS", 3)  # node pairs are expanded over several levels
    got = rows_of(simhash.near_duplicates(docs))
    texts = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()}
    assert len(got) == docs.count()
    fps = sorted({int(r["fingerprint"], 16) for r in got})
    root = brute_components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    group = dict(zip(fps, root))
    least = {}
    for r in got:
        if r["doc_id"] is not None:
            k = group[int(r["fingerprint"], 16)]
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    for r in got:
        assert int(r["fingerprint"], 16) == brute_simhash(texts[r["doc_id"], r["text_hash"]])
        assert r["component_id"] == least.get(group[int(r["fingerprint"], 16)])
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5, 6)} == {4}  # no words: fingerprint zero


def test_chunked_words_give_the_same_fingerprint(monkeypatch):
    text = prose(9, 3000)
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 50)
    assert simhash.simhash(text) == brute_simhash(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(0, 4), st.lists(st.integers(0, 63), max_size=40))
def test_trie_finds_all_pairs(values, bits, flips):
    values = sorted({v ^ (1 << f) for v in values for f in flips} | set(values))[:400]
    fps = np.array(values, np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(fps, [(0, len(fps), 0, len(fps))], 0, bits) for a, b in zip(i, j)}
    assert got == {(a, b) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= bits}


def test_keep_one_row_of_each_group(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None)
    assert [i for i, _ in got].count(3) == 2 and (1, prose(1)) in got and 2 not in [i for i, _ in got]
    assert [i for i, _ in got if i in (4, 5, 6)] == [4]
    assert [r.text for r in kept.collect() if r.doc_id is None] == [prose(4)]
    assert simhash.keep_one(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(900, 901), (7, 7)], "u long, v long"))
    got = dict(components.connected_components(edges).collect())
    assert len({got[k] for k in range(201)}) == 1 and got[900] == got[901] != got[0] and len(got) == 203


# --- quality -----------------------------------------------------------------------

def test_quality_separates_junk_and_takes_awkward_rows(spark):
    rows = [row(k, prose(k) if k % 4 else prose(k).upper().replace(" ", "!! ")) for k in range(400)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).union(awkward(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame([(k, 1 if k % 4 else 0) for k in range(0, 400, 2)] + [(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    learn = remainder(F.col("doc_id"), 3) != 1, remainder(F.col("id"), 3) != 1
    got = {r["id"]: r["score"] for r in rows_of(quality.quality_scores(docs, labels, *learn))}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.5) == bool(k % 4) for k in held]) > 0.98
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 400 + 14
    kept = quality.keep_good(docs, labels, *learn)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= 0.5} | {None} & {r.doc_id for r in kept.collect()}


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in rows_of(quality.quality_scores(awkward(spark), labels, F.lit(True), F.lit(True)))} == {0.5}
    assert quality.quality_scores(empty(spark), labels, F.lit(True), F.lit(True)).count() == 0


def test_step_sums_are_the_derivatives_of_the_risk():
    rng = np.random.default_rng(0)
    x, p, u = rng.normal(size=(40, quality.FEATURES)), (rng.random(40) < 0.5) * 1.0, np.ones(40)
    mean, scale, w = np.zeros(quality.FEATURES), np.ones(quality.FEATURES), rng.normal(0, 0.1, quality.FEATURES + 1)
    d = len(w)
    risk = lambda w: (lambda t: 0.4 * (t[0] - t[2 : 2 + d] @ w) / p.sum() + t[1] / 40 - 0.4 * t[0] / p.sum())(quality._step_sums(mean, scale, w)(x, p, u))
    t = quality._step_sums(mean, scale, w)(x, p, u)
    grad = t[2 + 2 * d : 2 + 3 * d] / 40 - 0.4 * t[2 : 2 + d] / p.sum()
    for k in (0, 5, d - 1):
        e = np.zeros(d)
        e[k] = 1e-6
        assert abs((risk(w + e) - risk(w - e)) / 2e-6 - grad[k]) < 1e-5


# --- language ------------------------------------------------------------------------

def test_language(spark):
    rows = [row(k, prose(k, 30, kind), kind) for k in range(300) for kind in [("en", "de", "fr")[k % 3]]]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    model = language.train(docs, remainder(F.col("doc_id"), 5) != 0)
    got = {r["id"]: r for r in rows_of(language.predicted(docs.union(awkward(spark).withColumn("doc_id", F.col("doc_id") + 1000)), model))}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["lang_pred"] == ("en", "de", "fr")[k % 3] for k in held]) > 0.98
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1004, 1005, 1006, 1012))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language.keep_known(docs.union(awkward(spark).withColumn("doc_id", F.col("doc_id") + 1000)), F.col("doc_id") < 300)
    assert kept.columns == docs.columns and kept.where("doc_id in (1004, 1005, 1006, 1012)").count() == 0 and kept.where("doc_id < 300").count() > 290


def test_language_with_one_or_no_language(spark):
    one = language.train(spark.createDataFrame([row(1, "some text")], DOC_SCHEMA), F.lit(True))
    assert one.predict("more")[0] == "en" and one.predict("12")[0] == "und"
    none = language.train(empty(spark), F.lit(True))
    assert none.predict("more") == ("und", 0.0, True)
    assert language.predicted(empty(spark), none).count() == 0


@pytest.mark.parametrize("classes", [2, 3, 5, 6, 20])
def test_codewords_differ(classes):
    code = language.codewords(classes)
    assert len({tuple(r) for r in code}) == classes and (np.abs(code.sum(0)) < classes).all()


def test_gram_counts_do_not_depend_on_the_piece(monkeypatch):
    text = prose(3, 200, "fr")
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "PIECE", 17)
    assert (language.gram_counts(text) == whole).all()


# --- packing -------------------------------------------------------------------------

def check_packing(pieces, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    docs = awkward(spark)
    report = []
    got = rows_of(packing.pack_documents(docs, report=report.append))
    used = check_packing(got, 2048)
    assert used == report[0]["sequences"] and report[0]["lower_bound"] <= used <= report[0]["lower_bound"] + 2
    crc = sorted(zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())
                 for r in docs.collect() for ids in [whole.encode(r.text or "", add_special_tokens=False).ids + [0]] for k in range(0, len(ids), 2048))
    assert crc == sorted(r["ids_crc32"] for r in got)
    assert packing.pack_documents(empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), st.integers(0, 3))
def test_word_ids_equal_those_of_the_whole_text(text, repeat):
    coder = packing.word_ids(None)
    texts = [text + (" the thing's end!! " + text) * repeat]
    assert list(coder.encode(texts)) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), min_size=1, max_size=20))
def test_plan_holds_every_piece_once(hist):
    groups, bound = packing.plan(hist, 40, 60)
    used = {}
    for contents, m in groups:
        assert sum(k * a for k, a in contents) <= 40 and m > 0
        for k, a in contents:
            used[k] = used.get(k, 0) + a * m
    assert used == hist
    sequences = sum(m for _, m in groups)
    assert bound <= sequences + 1e-6
    table = packing.placements(groups)
    assert sorted(set(table["length"].tolist())) == sorted(hist)


def test_plan_beats_or_equals_plain_decreasing_order():
    rng = np.random.default_rng(1)
    hist = {}
    for x in np.minimum(2048, rng.lognormal(6, 1, 20000).astype(int) + 1):
        hist[int(x)] = hist.get(int(x), 0) + 1
    groups, bound = packing.plan(hist)
    n = sum(m for _, m in groups)
    assert n <= sum(m for _, m in packing.best_fit_decreasing(hist, 2048)) and n <= 1.01 * bound + 1


# --- sharding ------------------------------------------------------------------------

def test_sharding_law(spark):
    docs = awkward(spark)
    got = rows_of(sharding.feistel_shards(docs, 4))
    assert len(got) == docs.count()
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    sizes = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    expected = sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert expected == sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got)
    again = sharding.feistel_shards(docs.repartition(5), 4)
    assert sorted(map(str, rows_of(again))) == sorted(map(str, got))  # does not depend on the partitions
    assert sharding.feistel_shards(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation_and_inverse(spark, n):
    x = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 3).alias("p"))
    got = x.select("id", "p", sharding.permuted(F.col("p"), n, 3, inverse=True).alias("back")).collect()
    assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)


# --- decontamination -----------------------------------------------------------------

def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i) if i is not None else None)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[k : k + m])):
                    found |= ids
                    hit |= set(range(k, k + m))
        out.append((i if i is not None else -1, len(w), len(hit), tuple(sorted(found - {None}))))
    return sorted(out)


def test_contamination_matches_brute_force(spark):
    items = [(1, prose(70, 40)), (2, prose(71, 12)), (3, "one two three four five"), (4, "rare"), (5, None), (6, "--"), (None, prose(72, 15)),
             (7, prose(70, 40)), (8, " ".join(["same"] * 14))]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int")
    w = prose(70, 40).split()
    extra = [(50, prose(80) + " " + prose(70, 40).upper() + "; " + prose(81)), (51, " ".join(w[3:13])), (52, " ".join(w[3:12])),
             (53, "x one two three four five y rare"), (54, " ".join(["same"] * 30)), (55, prose(72, 15)), (56, "one two three four"),
             (57, " ".join(w[:20]) + " zz " + " ".join(w[10:])), (57, "no hit"), (58, " ".join(w[3:13])), (58, " ".join(w[3:13]))]
    docs = spark.createDataFrame([row(i, t) for i, t in extra], DOC_SCHEMA).union(awkward(spark))
    got = sorted((r["id"] if r["id"] is not None else -1, r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows_of(decontaminate.contamination(docs, benchmark)))
    assert got == brute_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(i for i, _, n, _ in got if not n)
    assert decontaminate.contamination(empty(spark), benchmark).count() == 0
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == docs.count()


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_hashed_words(data, piece):
    old = decontaminate.PIECE_BYTES
    decontaminate.PIECE_BYTES = piece
    try:
        start, stop, h = decontaminate.hashed_words(data)
    finally:
        decontaminate.PIECE_BYTES = old
    found = [data[a:b] for a, b in zip(start, stop)]
    assert found == re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    seen = {}
    for w, x in zip(found, h.tolist()):
        assert seen.setdefault(w.lower(), x) == x


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_bitmap", lambda items: b"\xff" * (decontaminate.BITMAP_BITS // 8))
    docs = spark.createDataFrame([row(1, prose(70, 40)), row(2, prose(71))], DOC_SCHEMA)
    benchmark = spark.createDataFrame([(1, prose(70, 40))], "item_id long, text string")
    assert {r["id"]: r["n_hit"] for r in rows_of(decontaminate.contamination(docs, benchmark))} == {1: 40, 2: 0}


# --- licences ----------------------------------------------------------------------

def test_licenses(spark):
    rows = [row(1, prose(1) + "\nReleased under the MIT License.\n" + prose(2)), row(2, "Licensed under CC BY-NC 4.0."), row(3, "All rights reserved."),
            row(4, "Driving licence lost near the harbour, please call."), row(5, "this work is LICENSED under the GNU General Public License, version 2"),
            row(6, "Licensed under the Apache License, Version 2.0.")]
    got = {(r["doc_id"], r["block"]): r for r in rows_of(licenses.license_blocks(spark.createDataFrame(rows, DOC_SCHEMA).union(awkward(spark))))}
    assert {k: r["license"] for k, r in got.items()} == {(1, 1): "MIT", (2, 0): "CC-BY-NC-4.0", (3, 0): "proprietary", (4, 0): None, (5, 0): "GPL-2.0", (6, 0): "Apache-2.0"}
    assert got[6, 0]["exact"]
    assert licenses.license_blocks(empty(spark)).count() == 0


def test_compression_ranks_the_own_template_first():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    names = list(licenses.TEMPLATES)
    for k, text in enumerate(licenses.TEMPLATES.values()):
        assert names[scanner.ranked(text)[0][1]] == names[k]


# --- token counts ------------------------------------------------------------------

def test_token_counts_match_whole_encoding(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    docs = awkward(spark).where("doc_id is not null and doc_id != 3")
    got = rows_of(token_counts.section_tokens(docs))
    for r in docs.collect():
        mine = sorted((x["section"], x["first"], x["end"], x["n_tokens"]) for x in got if x["doc_id"] == r.doc_id)
        text = r.text or ""
        assert sum(n for *_, n in mine) == len(whole.encode(text, add_special_tokens=False).ids)
        assert "".join(text[a:b] for _, a, b, _ in mine) == text
    assert token_counts.section_tokens(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é日\n  \U0001f600", max_size=40), st.sets(st.integers(0, 40), max_size=6))
def test_attribution_rule(text, cuts):
    bounds = np.array([0, *sorted(c for c in cuts if 0 < c < len(text)), len(text)])
    first, end = token_counts.token_spans(text)
    assert (first[1:] >= first[:-1]).all() and (not len(end) or end[-1] == len(text))
    expected = [0] * (len(bounds) - 1)
    for a, b in zip(first.tolist(), end.tolist()):
        share = [min(b, bounds[k + 1]) - max(a, bounds[k]) for k in range(len(expected))]
        expected[share.index(max(share))] += 1
    assert token_counts.attribute(first, end, bounds)[0].tolist() == expected


def test_long_texts_are_cut_between_tokens(monkeypatch):
    text = prose(5, 500) + "  \n x  " + prose(6, 100, "fr")
    whole = token_counts.token_spans(text)
    monkeypatch.setattr(token_counts, "PIECE", 40)
    assert all((a == b).all() for a, b in zip(whole, token_counts.token_spans(text)))
