"""Fitting samples stay bounded where one id holds a large share of the rows."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import bigru_langid, ftrl_toxicity, knn_quality
from millrace.llm.labelled import labelled_sample

MANY = 3_000


@pytest.fixture(scope="module")
def docs(spark):
    hot = [(7, f"text number {k}", "en") for k in range(MANY)]
    rest = [(i, None if i == 8 else f"some words {i}", "en" if i % 2 else "de") for i in range(100, 160)]
    return spark.createDataFrame([*hot, *rest, (8, None, "en"), (9, None, "en"), (9, "has one", "en")], "doc_id long, text string, lang string").repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in (7, 8, 9, *range(100, 160))], "doc_id long, quality int, toxic int")


def test_labelled_documents(docs, labels):
    rows = labelled_sample(docs, labels, "quality", F.lit(True), 100).collect()
    assert sorted(r.doc_id for r in rows) == [7, 8, 9, *range(100, 160)]
    assert {r.doc_id: r.text for r in rows}[9] == "has one" and {r.doc_id: r.text for r in rows}[8] is None
    again = labelled_sample(docs.repartition(2), labels, "quality", F.lit(True), 100).collect()
    assert {r.doc_id: r for r in rows} == {r.doc_id: r for r in again}


def test_models(docs, labels, monkeypatch):
    """What comes to the task that fits has a row per chosen id (and epoch)."""
    sizes = []
    for module, rows in ((knn_quality, lambda r: r), (ftrl_toxicity, lambda r: r.where("epoch = 1 AND part = 0"))):
        fitted = module.fitted
        monkeypatch.setattr(module, "fitted", lambda r, *rest, fitted=fitted, rows=rows: sizes.append(rows(r).count()) or fitted(r, *rest))
    knn_quality.fit(docs, labels, F.lit(True))
    ftrl_toxicity.fit(docs, labels, F.lit(True))
    assert sizes == [63, 63]


@pytest.mark.parametrize("most", [16, 400])
def test_languages(docs, monkeypatch, most):
    seen = []
    monkeypatch.setattr(bigru_langid, "DOCS_PER_LANGUAGE", most)
    monkeypatch.setattr(bigru_langid, "train", lambda windows, languages: seen.extend(languages))
    bigru_langid.fit(docs, F.lit(True))
    assert {lang: seen.count(lang) for lang in ("de", "en")} == {"de": min(most, 30), "en": min(most, 32)}
