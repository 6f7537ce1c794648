import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.plans import retrieval
from lamina.sources import versions
from tests.conftest import rows

FILES = {
    "procedure.md": "---\ndoc_id: PROC-1\ntitle: Rayures\ndoc_type: procedure\n---\n# Rayures en Z\n\nIsoler la tôle.\n\n## Actions immédiates\n\nArrêter la ligne, prévenir le poste.",
    "rapport.md": "---\ndoc_id: RPT-7\ntitle: Rapport\ndoc_type: report\n---\n# Arrêt\n\nLa ligne a été arrêtée pour rayures ; le défaut revient.",
    "plain.md": "Sans titre, sans en-tête : une consigne de sécurité.",
    "kpi.py": "import math\n\n\ndef reactive_ratio(rows):\n    return sum(rows)\n",
    "faults.sql": "-- name: fault_counts\nSELECT 1;\n\n-- name: monthly_trend\nSELECT readings FROM lectures",
    "broken.py": "def (:",
    "notes.txt": "not indexed",
}


def files(spark, **changed):
    return spark.createDataFrame([(p, t) for p, t in {**FILES, **changed}.items() if t is not None], "path string, text string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "chunks")
    report = rows(retrieval.refresh_index(spark, path, files(spark), buckets=4))
    return path, report


def test_files_become_chunks(spark, built):
    path, report = built
    assert report == [("code", 4, 0), ("doc", 4, 0)]
    found = versions.read_versioned(spark, path, 1)
    assert set(rows(found.where("source_type = 'doc'"), "source_id", "section", "heading")) == {
        ("PROC-1", "Rayures en Z", "Rayures Rayures en Z"), ("PROC-1", "Rayures en Z > Actions immédiates", "Rayures Rayures en Z > Actions immédiates"),
        ("RPT-7", "Arrêt", "Rapport Arrêt"), ("plain", None, "")}
    assert set(rows(found.where("source_type = 'code'"), "source_id", "section", "heading", "start_line")) == {
        ("faults.sql", "fault_counts", "faults.sql fault_counts", 1), ("faults.sql", "monthly_trend", "faults.sql monthly_trend", 4),
        ("kpi.py", "module", "kpi.py module", 1), ("kpi.py", "reactive_ratio", "kpi.py reactive_ratio", 4)}
    assert found.where("size(embedding) = 256").count() == 8


QUERIES = [(0, "actions immédiates : arrêter la ligne, prévenir le poste"), (1, '"défaut revient"'), (2, "lectures"), (3, "")]


def search(spark, path, source_type, **how):
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    found = retrieval.retrieve(queries, versions.read_versioned(spark, path), source_type, **how)
    return {q: [r["source_id"] + (" > " + r["section"].split(" > ")[-1] if r["section"] else "") for r in sorted(found.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])]
            for q in range(4)}


def test_one_call_searches_with_type_filters_mode_and_rerank(spark, built):
    path, _ = built
    docs = search(spark, path, "doc", k=2)
    assert docs[0][0] == "PROC-1 > Actions immédiates" and docs[1][0] == "RPT-7 > Arrêt" and len(docs[0]) == 2
    only = search(spark, path, "doc", filters={"doc_type": "report"})
    assert only[0] == ["RPT-7 > Arrêt"] and only[1] == only[0]
    code = search(spark, path, "code", k=1)
    assert code[2] == ["faults.sql > monthly_trend"]
    assert search(spark, path, "code", k=1, mode="dense")[2] == ["faults.sql > monthly_trend"]

    @F.pandas_udf("double")
    def short(query: pd.Series, passage: pd.Series) -> pd.Series:
        return -passage.str.len().astype(float)

    ranked = search(spark, path, "doc", k=1, rerank=True, score=short("text", "content"))
    assert ranked[0] == ["PROC-1 > Rayures en Z"]
    assert search(spark, path, "doc", filters={"doc_type": "none"})[0] == []
    with pytest.raises(ValueError):
        search(spark, path, "doc", mode="sparse")


def test_only_changed_files_are_encoded_again(spark, built):
    path, _ = built
    encoded = spark.sparkContext.accumulator(0)

    def encoder():
        from lamina.operators.embed import hashing_encoder

        plain = hashing_encoder()

        def encode(texts):
            encoded.add(len(texts))
            return plain(texts)

        return encode

    before = {r["chunk_id"]: r["content"] for r in versions.read_versioned(spark, path).collect()}
    edited = files(spark, **{"rapport.md": FILES["rapport.md"].replace("Arrêt\n", "Arrêt court\n"), "kpi.py": None})
    report = rows(retrieval.refresh_index(spark, path, edited, encoder=encoder))
    assert report == [("code", 4, 0), ("doc", 4, 0)] and encoded.value == 1
    after = {r["chunk_id"]: r["content"] for r in versions.read_versioned(spark, path).collect()}
    # The file that vanished stays; the section of the edited one has a new name.
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 1
    again = rows(retrieval.refresh_index(spark, path, edited, encoder=encoder))
    assert again == report and encoded.value == 1
