"""The registered corpus queries on whole tables: against SQL where there is one, else brute force or held-out labels; the pipeline stage by stage."""

import hashlib

import pytest

import corpus_pipeline
from stowage.llm import mixing, pii, queries
from tests.llm.test_small import brute_links, brute_pii, brute_removed, brute_secrets, brute_windows
from tests.oracle import connect, spark_rows, sql_rows

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, folder, name):
    names, rows = spark_rows(QUERIES[name](spark, folder))
    other, expected = sql_rows(connect(folder), ORACLES[name])
    assert names == other and rows == expected


def test_op7(spark, folder, docs):
    want = brute_removed([(i, t) for i, t in docs])
    for r in QUERIES["op7_substring_dedup"](spark, folder).collect():
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == want[r.doc_id]


@pytest.mark.parametrize("name,brute,kinds", [("op6_secret_scan", brute_secrets, ("assign", "access", "hex")), ("op8_pii", brute_pii, pii.KINDS[:4])])
def test_base_findings(spark, folder, docs, name, brute, kinds):
    texts = dict(docs)
    for r in QUERIES[name](spark, folder).collect():
        base = brute(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == k for x in base) for k in kinds]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_language_id"](spark, folder).join(lang, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op9_quality"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in got) >= 0.95 * len(got)


def test_op2(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op2_html_extraction"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert "\xa9" not in r.text and "track(" not in r.text and "<" not in r.text and r.n_chars == len(r.text) > 0


def test_pipeline_stage_by_stage(spark, folder, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
    good = {r.doc_id for r in QUERIES["op9_quality"](spark, folder).where("predicted = 1").collect()}
    assert set(kept["quality"]) == good
    links = brute_links([(i, r.text) for i, r in kept["quality"].items()])
    assert set(kept["near_duplicates"]) == {c for _, c in links.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = {i: brute_windows(r.text, items) for i, r in kept["near_duplicates"].items()}
    bad = {i for i, (n, hit, full, _) in held.items() if full or hit and 20 * len(hit) >= n}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - bad
    assert set(kept["pii"]) == set(kept["decontamination"])
    for i, r in kept["pii"].items():
        assert not brute_pii(r.text) and r.n_chars == len(r.text)
        if not brute_pii(kept["decontamination"][i].text):
            assert r.text == kept["decontamination"][i].text or "[" in r.text
    again = {(r.doc_id, r.taken) for r in mixing.mix(spark.read.parquet(str(tmp_path / "pii"))).collect()}
    assert {(i, r.taken) for i, r in kept["mixing"].items()} == again
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, folder).collect()} == again


def test_pipeline_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
