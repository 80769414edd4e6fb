"""Contract points of earlier operators: letters, long texts, large vectors, unclosed elements, whole training pages."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cohortflow.llm import html_extract, language, mtree, quality
from cohortflow.llm.html_blocks import Block, blocks


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the house", "en"), (2, "das Haus", "de"), (3, "½ ² ١٢", None), (4, "1 x", None), (5, "日本", None)],
                                 "doc_id long, text string, lang string")
    got = {r["id"]: r["lang_pred"] for r in language.predicted(docs, language.train(docs, F.lit(True))).collect()}
    assert got[3] == "und" and all(got[k] in ("en", "de") for k in (1, 2, 4, 5))


def test_features_of_a_long_text_keep_their_meaning():
    words = " ".join(f"w{k}" for k in range(300_000))
    once, twice = quality.text_features(words), quality.text_features(words + " " + words)
    at = int(np.flatnonzero(np.isclose(once, 1.0) & np.isclose(twice, 0.5))[0])  # the distinct share
    assert twice[at] == pytest.approx(0.5)
    short = quality.text_features("a b c d a b c d")
    assert short[at] == pytest.approx(0.5)


def test_too_large_vectors_are_an_error(spark):
    schema = "vec_id long, embedding array<double>"
    fine = spark.createDataFrame([(0, [1e5, 2.0]), (1, [3.0, -1e5])], schema)
    assert mtree.top_k(fine, F.col("vec_id") == 0, k=1).first()["score"] == 102400000 * 3072 + 2048 * -102400000
    with pytest.raises(PythonException, match="too large"):
        mtree.top_k(spark.createDataFrame([(0, [1e17]), (1, [1.0])], schema), F.col("vec_id") == 0, k=1).count()


@pytest.mark.parametrize("tag", ["video", "svg", "noscript", "select", "iframe", "math"])
def test_unclosed_elements_do_not_eat_the_page(tag):
    assert [b.text for b in blocks(f"<p>one</p><{tag}><p>two</p><p>three</p>")] == ["one", "two", "three"]


def test_hidden_elements():
    assert [b.text for b in blocks("<p>a <math><mi>x</mi></math> b <video>no film</video></p><script>var a = '<p>no</p>'")] == ["a x b"]


def test_training_reads_whole_pages():
    page = "<article>" + "".join(f"<p>sentence number {k} of the article</p>" for k in range(150)) + "</article><div class='footer'><p>end</p></div>"
    vectors, labels = html_extract.training_pages([page])[0]
    assert len(vectors) == len(labels) == 151 and labels[:150].all() and not labels[150]
    made = html_extract.training_pages(["<div><p>" + "long text of the page " * 6 + "</p></div><ul><li>Home</li></ul>"])
    assert made and made[0][1].tolist() == [1.0, 0.0]
    assert html_extract.long_text(Block("x" * 100, (), 0)) and not html_extract.long_text(Block("x" * 100, (), 80))
