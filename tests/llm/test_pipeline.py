import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from finstrata.llm import langid
from finstrata.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORDS = {"en": "the of and to in that with from this have which been were their would about", "de": "der die und nicht auch über schön größe für müssen können während zwischen durch wäre"}


def test_every_operator_is_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in order]
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def _docs():
    rng = np.random.default_rng(0)
    prose = lambda k, n: " ".join(rng.choice(WORDS[k].split(), n)) + "."
    rows = [(i, prose("de" if i % 3 == 0 else "en", 60), "de" if i % 3 == 0 else "en", f"s{i % 12}") for i in range(240)]
    item = prose("en", 30)
    rows += [(300, "12 34 / 56", "en", "s1"), (301, None, "en", "s1"), (302, "", None, "s2")]  # no language
    rows += [(400 + i, rows[1][1], "en", f"s{i % 2}") for i in range(6)]  # copies of 1
    rows += [(450, rows[2][1] + " tail", "en", "s3")]  # nearly a copy of 2
    rows += [(500 + i, prose("en", 40) + "\nAll rights and terms of the site\n" + prose("en", 40), "en", f"s{i}") for i in range(12)]
    rows += [(600, prose("en", 40) + " " + item + " " + prose("en", 40), "en", "s4")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows], item


def test_stages_by_brute_force(spark, tmp_path):
    rows, item = _docs()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "source_mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    every = {r[0] for r in rows}
    assert set(kept["language_id"]) == every - {300, 301, 302}
    lines = kept["line_dedup"]
    assert set(lines) == set(kept["language_id"])
    assert [i for i in range(500, 512) if "All rights" in lines[i]["text"]] == [500] and lines[505]["n_chars"] == len(lines[505]["text"])
    assert all(lines[r[0]]["text"] == r[1] for r in rows if r[0] in lines and not 500 < r[0] < 512)
    near = set(kept["simhash_near_dedup"])
    assert near == set(lines) - {400, 401, 402, 403, 404, 405, 450}
    clean = set(kept["decontamination"])
    assert clean == near - {600}
    mix = kept["source_mixing"]
    assert set(mix) == clean and all(r["taken"] <= 2 * r["size"] for r in mix.values())
    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {k: r["taken"] for k, r in mix.items()}


def test_stages_over_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 9)], schema)
    assert corpus_pipeline.identify_language(spark, unlabelled, str(tmp_path)).count() == 1
    assert langid.UNDETERMINED == "und"
