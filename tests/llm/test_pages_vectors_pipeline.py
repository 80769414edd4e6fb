import os

import numpy as np
import pandas as pd
import pytest
from helpers import DOC_SCHEMA, prose, row
from pyspark.sql import functions as F

import corpus_pipeline
from cohortflow.llm import html_blocks, html_extract, mtree


def page(title, paragraphs, furniture="<nav><ul><li><a href='/a'>Home</a></ul></nav>", end="<footer>&copy; me</footer>"):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body>{furniture}"
            f"<!-- <p>hidden</p> --><article><h1>{title}</h1>{body}</article>{end}</body></html>")


def test_blocks():
    got = html_blocks.blocks("<body><nav><ul><li><a href=x>A&amp;B</a><li>two</ul></nav><div class='Main-Text'>one <b>t</b>wo<br>x &#233;&nbsp;y<p>p1<p>p2"
                             "</div>tail<script>no</script><select><option>no</select><!-- no --> end <b")
    assert [b.text for b in got] == ["A&B", "two", "one two x é y", "p1", "p2", "tail end"]
    assert got[0].path == ("body", "nav", "ul", "li") and got[0].linked == 3 and got[1].linked == 0
    assert got[2].path == ("body", "div", ".main", ".text") and got[4].path == ("body", "div", ".main", ".text", "p")
    assert html_blocks.blocks(None) == [] == html_blocks.blocks("") == html_blocks.blocks("<script>only") == html_blocks.blocks("<!--")


def test_gradients_are_those_of_the_loss():
    p, rng = html_extract.start(1), np.random.default_rng(0)
    x, mask = rng.normal(size=(5, 3, html_extract.DIMS)), np.ones((5, 3))
    mask[3:, 1] = 0
    y = (rng.random((5, 3)) > 0.5) * 1.0
    loss, grad = html_extract.gradients(p, x, mask, y)
    for k, v in p.items():
        at = np.unravel_index(rng.integers(v.size), v.shape)
        q = {a: b.copy() for a, b in p.items()}
        q[k][at] += 1e-6
        assert abs((html_extract.gradients(q, x, mask, y)[0] - loss) / 1e-6 - grad[k][at]) < 1e-4


def test_main_text(spark):
    rows = [(k, f"http://x/{k}", page(prose(k, 6), [prose(1000 + 10 * k + j, 30) for j in range(2 + k % 5)],
                                     furniture=f"<nav><ul><li><a href='/a'>{prose(k, 1)}</a></ul></nav><div class='ad'>{prose(k + 7, 8)}</div>")) for k in range(120)]
    held = [(1000, "u", "<html><body><header><a href=/>Site</a></header><div class='cookie-notice'>We use cookies. Accept</div>"
                        + "<main><h1>" + prose(1, 5) + "</h1><p>" + prose(2, 30) + "</p><p>" + prose(3, 30) + "</p></main>"
                        + "<section class='comments'><div class='comment'><p>" + prose(4, 12) + "</p></div></section><footer>All rights reserved.</footer></body></html>")]
    odd = [(None, None, None), (2000, "u", ""), (2001, "u", "<html><nav>"), (2002, "u", rows[0][2]), (2002, "u", rows[0][2]),
           (2003, "u", page("Long", [prose(k, 40) for k in range(3000)]))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows + held + odd], "page_id long, url string, html string, text string, n_chars int")
    got = [r.asDict() for r in html_extract.main_text(pages).collect()]
    assert len(got) == 127
    texts = {r["page_id"]: r["text"] for r in got}
    good = 0
    for k, _, h in rows:
        want = "\n".join(b.text for b in html_blocks.blocks(h) if "article" in b.path)
        good += texts[k] == want
    assert good >= 118
    assert prose(3, 30) in texts[1000] and prose(4, 12) not in texts[1000] and "cookies" not in texts[1000] and "rights" not in texts[1000]
    assert texts[None] == texts[2000] == texts[2001] == "" and texts[2002] == texts[0] and texts[2003].count("\n") > 2900
    assert html_extract.main_text(pages.limit(0)).count() == 0


def brute_top_k(rows, k):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean[i, tuple(np.floor(1024 * np.array(v, float)).astype(int).tolist())] = None
    out = []
    for i, v in clean:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in clean if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(mtree, "TREE_ROWS", (40, 60))
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[5][1]) for k in range(60)]  # copies and ties
    rows += [(2000, None), (2100, [None] * 8), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, rows[3][1]), (2400, [1.0, 2.0]), (2500, []), rows[100], rows[100]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top_k(rows, 10)


def test_top_k_of_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).count() == 0
    got = mtree.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.lit(True)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2 * 1024**2), (1, 1, 0, 2 * 1024**2)]


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 3
    x = np.floor(1024 * (centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 6)) * 0.05)).astype(np.int64)
    top = float((x * x).sum(1).max())
    tree = mtree.Tree(x, [[k] for k in range(len(x))], mtree.lifted(x[:1], top)[0], top)
    q = x[17]
    to = float(mtree.distances(np.append(q.astype(float), 0)[None], mtree.lifted(x[:1], top))[0, 0])
    best, computed = tree.search(17, q, 10, [], to)
    order = sorted((-int(x[k] @ q), k) for k in range(len(x)) if k != 17)[:10]
    assert [(-s, n) for s, n in order] == [(s, -n) for s, n in best] and computed < 1500


def write(folder, name, df):
    df.toPandas().to_parquet(os.path.join(folder, f"{name}.parquet")) if df.isEmpty() else df.write.parquet(os.path.join(folder, f"{name}.parquet"))


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = [row(k, prose(k, 80)) for k in range(120)] + [row(200 + k, prose(k, 40).upper().replace(" ", "!! ")) for k in range(30)]
    rows += [row(300, prose(5, 80)), row(301, prose(5, 80)), row(302, "x " + prose(6, 800)), row(303, "y " + prose(6, 800))]  # copies
    rows += [row(400, prose(401, 50) + " " + prose(500, 20) + " " + prose(402, 50)), row(None, None), row(500, ""), row(501, "12 34")]
    labels = [(k, 1) for k in range(100)] + [(200 + k, 0) for k in range(25)]
    write(tmp_path, "documents", spark.createDataFrame(rows, DOC_SCHEMA))
    write(tmp_path, "labels", spark.createDataFrame(labels, "doc_id long, quality int"))
    write(tmp_path, "benchmark", spark.createDataFrame([(1, prose(500, 20))], "item_id long, text string"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not kept["quality"] & set(range(200, 230)) and set(range(120)) <= kept["quality"]
    assert not kept["language"] & {None, 500, 501} and set(range(120)) <= kept["language"]
    assert {5, 302} <= kept["near_dedup"] and not kept["near_dedup"] & {300, 301, 303} and kept["language"] - kept["near_dedup"] <= {300, 301, 303}
    assert kept["near_dedup"] - kept["decontamination"] == {400}
    assert kept["packing"] == kept["decontamination"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == kept["packing"]


def test_pipeline_over_an_empty_table(spark, tmp_path):
    none = pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "text": pd.Series([], dtype="str"), "lang": pd.Series([], dtype="str"),
                         "source": pd.Series([], dtype="str"), "n_chars": pd.Series([], dtype="int64")})
    none.astype({"text": "string", "lang": "string", "source": "string"}).to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
