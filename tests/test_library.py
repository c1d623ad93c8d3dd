"""Sources, relational operators, retrieval, quality, lifecycle, project, manifest and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardloom import cli, etl, manifest, profiles, standards
from wardloom.functions import text as TX
from wardloom.operators import columns as C
from wardloom.operators import lifecycle
from wardloom.operators import quality as Q
from wardloom.operators import relational as R
from wardloom.operators import retrieval as RT
from wardloom.operators import schema_map as SM
from wardloom.project import Project
from wardloom.sources import interchange, tabular
from wardloom.streaming import incremental


@pytest.mark.parametrize("kind", ["csv", "parquet", "json", "orc", "tsv"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    path = str(tmp_path / f"t.{kind}")
    if kind == "tsv":
        df.write.options(header="true", sep="\t").csv(path)
    else:
        tabular.write(df, path)
    got = tabular.read_source(spark, path)
    assert sorted(r["id"] if kind not in ("csv", "tsv") else int(r["id"]) for r in got.collect()) == [1, 2]
    with pytest.raises(ValueError):
        tabular.read_source(spark, path, "xlsx")


def test_records_catalog_and_database_arguments(spark, tmp_path):
    df = tabular.from_records(spark, [{"a": 1}, {"a": 2, "b": "x"}])
    assert tabular.to_records(df.orderBy("a")) == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    assert tabular.from_records(spark, [], "a int").count() == 0
    tabular.write_single_csv(df, str(tmp_path / "one"))
    assert tabular.read_csv(spark, str(tmp_path / "one")).count() == 2
    with pytest.raises(ValueError):
        tabular.read_database(spark, "jdbc:x", table="t", query="q")
    catalog = tabular.Catalog(spark)
    catalog.add("one", path=str(tmp_path / "one"))
    assert catalog.read("one").count() == 2
    with pytest.raises(ValueError):
        catalog.add("bad", path="a", url="b")


def test_transform_and_lookup(spark):
    df = spark.createDataFrame([("1", "x"), ("z", None)], "a string, b string")
    assert rows(R.transform(df, {"a": "b", "b": "a"}, {"b": "int"}, lenient=True), "a", "b") == sorted([("x", 1), (None, None)], key=str)
    for mapping in ({"1": 7}, {str(i): i * 7 for i in range(500)}):
        assert rows(R.map_column(df, "a", mapping, "t"), "a", "t") == [("1", 7), ("z", 0)]
    twice = spark.createDataFrame([("1", 5), ("1", 9), (None, 3)], "key string, value int")
    assert rows(R.map_column(df, "b", twice, "t", -1), "t") == [(-1,), (-1,)]
    assert R.map_column(df, "a", {}, "t").count() == 2


def test_profile_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a string, b double")
    got = {r["column_name"]: r for r in R.profile(df).collect()}
    assert got["a"]["null_pct"] == 100.0 and got["a"]["min_value"] is None and got["b"]["n_unique"] == 2
    assert R.profile(df.limit(0)).count() == 2
    assert R.column_stats(df.limit(0)).first()["mean_value"] is None
    assert R.companion_column(["dx_cd", "dx_desc"], "dx_cd") == "dx_desc" and R.companion_column(["dx_cd"], "dx_cd") is None


def test_samples(spark):
    df = spark.range(100).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    a = rows(R.uniform_sample(df, "id", 10))
    assert a == rows(R.uniform_sample(df.repartition(5), "id", 10)) and len(a) == 10
    assert R.uniform_sample(df, "id", 1000).count() == 100
    assert R.stratified_sample(df, "id", "g", 30).groupBy("g").count().count() == 2


def test_bm25_edges(spark):
    corpus = spark.createDataFrame([(1, "renal cyst"), (2, "cyst cyst"), (3, None), (4, "")], "concept_id long, concept_name string")
    queries = spark.createDataFrame([(1, "cyst of renal"), (2, "the of"), (3, None)], "query_id long, query string")
    got = RT.top_k(RT.bm25(corpus, queries), 5).collect()
    assert [(r["query_id"], r["doc"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (1, 2)]
    assert RT.bm25(corpus.limit(0), queries).count() == 0
    k1, k2 = (rows(RT.top_k(RT.bm25(corpus, queries), k), "query_id", "doc") for k in (1, 2))
    assert set(k1) <= set(k2)


def test_index_vectors_and_hook(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "renal cyst"), (2, None)], "concept_id long, concept_name string")
    RT.save_index(corpus, str(tmp_path))
    index, figures = RT.load_index(spark, str(tmp_path))
    assert index.count() == 2 and figures.first()["n_docs"] == 2
    got = {r["concept_id"]: r["vector"] for r in RT.hashed_vectors(corpus, "concept_name", 8).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[2] == [0.0] * 8
    kept = RT.verify(corpus, lambda batches: (b[b.concept_id == 1] for b in batches), "concept_id long, concept_name string")
    assert kept.count() == 1


def test_concept_names_and_runs(spark):
    df = spark.createDataFrame([("M",), ("x",)], "sex string")
    codes = spark.createDataFrame([("sex", "M", 8507)], "source_column string, key string, value int")
    names = spark.createDataFrame([(8507, "Male")], "concept_id int, concept_name string")
    assert rows(R.add_concepts(df, codes, {"sex": "g"}, names), "sex", "g_concept_id", "g_concept_name") == [("M", 8507, "Male"), ("x", 0, None)]
    runs = spark.createDataFrame([("omop", "fhir", "person", 3), ("omop", "fhir", "visit", 4)], "source string, target string, entity string, records int")
    from wardloom.operators import crossmap

    assert crossmap.run_summary(runs).first().asDict() == {"runs": 2, "records": 7, "pairs": 1}


def test_parse_resources(spark):
    lines = spark.createDataFrame([('{"active": true, "gender": "male"}',), ('{"active": "perhaps"',), (None,)], "value string")
    got = profiles.parse(lines, standards.load("fhir"), "Patient").collect()
    assert got[0]["gender"] == "male" and got[0]["malformed"] is None and got[1]["malformed"] is not None


def test_cosine_edges(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "k long, v array<double>")
    queries = spark.createDataFrame([(9, [3.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    got = RT.cosine(index, queries, 5, "k", "v")
    assert rows(got, "query_id", "doc", "score", "rank") == [(9, 1, 1.0, 0), (9, 2, 0.0, 1), (9, 3, 0.0, 2)]
    assert RT.cosine(index, queries.limit(0), 5, "k", "v").count() == 0


def test_fusion_and_routes(spark):
    lists = spark.createDataFrame([("a", 1, 10, 0, 0.9), ("b", 1, 10, 1, 0.8), ("b", 1, 11, 0, 0.95), ("a", 2, 5, 0, 0.4)], "list_id string, query_id long, doc long, rank int, score double")
    got = {(r["query_id"], r["doc"]): r["rrf_score"] for r in RT.rrf(lists).collect()}
    assert got[(1, 10)] == round(1 / 61 + 1 / 62, 6) and got[(2, 5)] == 0.4
    assert max(r["rrf_score"] for r in RT.rrf(lists, normalise=True).where("query_id = 1").collect()) <= 1
    best = spark.createDataFrame([(1, 7, 0.99), (2, 7, 0.85), (3, 7, 0.72), (4, 7, 0.4), (5, 7, 0.2), (6, None, None)], "query_id long, doc long, score double")
    routed = {r["query_id"]: (r["method"], r["target_concept_id"]) for r in RT.confidence_route(best, verify=0.8).collect()}
    assert routed == {1: ("auto", 7), 2: ("verified", 7), 3: ("review", 7), 4: ("manual", 7), 5: ("manual", None), 6: ("manual", None)}
    hybrid = RT.hybrid({n: lists.where(f"list_id = '{n}'").select("query_id", "doc", "score") for n in "ab"}, 5)
    assert {(r["query_id"], r["doc"]) for r in hybrid.collect()} == {(1, 10), (1, 11), (2, 5)}
    assert RT.backend("bm25") is RT.bm25
    with pytest.raises(ValueError):
        RT.backend("nothing")


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-02", "2024-01-01"), (None, "b1", "x", None), (9, None, "2024-01-01", "2024-01-01")], "n int, s string, d1 string, d2 string")
    rules = [
        Q.parse_rule({"id": "r", "type": "range", "column": "n", "min": 0, "max": 5}),
        Q.Rule("x", "regex", "s", pattern="[a-z]$"),
        Q.Rule("e", "enum", "s", values=("a",)),
        Q.Rule("t", "temporal_order", before="d1", after="d2"),
        Q.Rule("f", "fk_exists", "n", ref_table="ref", ref_column="id"),
        Q.Rule("m", "fk_exists", "n", ref_table="absent", ref_column="id"),
    ]
    got = {r["rule_id"]: (r["total_rows"], r["failed_count"], r["passed"]) for r in Q.evaluate(df, rules, {"ref": spark.createDataFrame([(1,), (None,)], "id int")}).collect()}
    assert got == {"r": (2, 1, False), "x": (2, 1, False), "e": (2, 1, False), "t": (2, 1, False), "f": (2, 1, False), "m": (0, 0, True)}
    assert all(r["passed"] for r in Q.evaluate(df.limit(0), rules).collect())
    assert "6" in Q.text_report(Q.evaluate(df, rules)).splitlines()[0]
    for bad in ({"id": "r", "type": "fuzzy"}, {"id": "r", "type": "range", "column": "n", "colour": 1}, {"id": "r", "type": "range", "severity": "loud"}):
        with pytest.raises(ValueError):
            Q.parse_rule(bad)
    good = Q.evaluate(df.limit(0), rules).withColumn("category", F.lit("plausibility"))
    assert Q.Gate().passed(good)
    assert not Q.Gate().passed(Q.evaluate(df, rules).withColumn("category", F.lit("plausibility")))
    assert Q.output_issues({"person": df}, {"person": ["n", "q"], "visit": ["id"]}) == [("person", "error", "column q is missing"), ("visit", "error", "table is missing")]


def test_plan_has_one_scan_and_no_python(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "a")], "n int, s string").write.parquet(path)
    df = spark.read.parquet(path)
    plan = Q.evaluate(df, [Q.Rule("r", "range", "n", low=0), Q.Rule("e", "enum", "s", values=("a",))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_schema_mapping_and_review(spark):
    text = spark.createDataFrame([("pt_id", "bigint", ["1", "2", "3", "4"])], "n string, t string, s array<string>")
    assert text.select(SM.source_text(F.col("n"), F.col("t"), F.col("s"))).first()[0] == "pt id number 1 2 3"
    assert [r[0] for r in spark.createDataFrame([(0.96,), (0.8,), (0.1,)], "c double").select(SM.status(F.col("c"))).collect()] == ["auto_accepted", "needs_review", "unmapped"]
    items = spark.createDataFrame([(1, "t", "needs_review"), (2, None, "needs_review")], "item_id int, target string, status string")
    assert rows(lifecycle.approve_all(items), "item_id", "status") == [(1, "approved"), (2, "needs_review")]
    assert not lifecycle.finalised(items)


def test_etl_run(spark, tmp_path):
    df = spark.createDataFrame([("1", "M", "x"), ("b", None, "y")], "pid string, sex string, other string")
    items = [
        {"source_column": "pid", "target_table": "person", "target_column": "person_id"},
        {"source_column": "sex", "target_table": "person", "target_column": "gender_source_value"},
        {"source_column": "sex", "target_table": "person", "target_column": "gender_source_value"},
    ]
    codes = spark.createDataFrame([("sex", "M", 8507)], "source_column string, key string, value int")
    result = etl.plan(df, items, codes, {"sex": "gender"}, standards.load("omop"))
    assert rows(result.tables["person"], "person_id", "gender_concept_id", "gender_source_value") == sorted([(1, 8507, "M"), (None, 0, None)], key=str)
    assert result.unmapped_columns == ["other"]
    assert etl.run(result, str(tmp_path), dry=True).written == {}
    assert spark.read.parquet(etl.run(result, str(tmp_path)).written["person"]).count() == 2


def test_interchange(spark, tmp_path):
    df = spark.createDataFrame([("A", "nan", "7.0", "V"), ("B", "text", "oops", None)], "source_code string, source_description string, target_concept_id string, vocabulary_id string")
    got = {r["source_code"]: r for r in interchange.import_mapping(df).collect()}
    assert got["A"]["target_concept_id"] == 7 and got["A"]["source_description"] is None and got["A"]["target_vocabulary_id"] == "V"
    assert got["B"]["target_concept_id"] is None
    with pytest.raises(ValueError):
        interchange.import_mapping(df.drop("source_code"))
    ranked = interchange.usagi_ranked(spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.9)], "sourceCode string, conceptId long, matchScore double"))
    assert rows(ranked, "conceptId", "rank") == [(1, 0), (2, 1)]
    res = spark.createDataFrame([("Patient", 1, None), ("Condition", 2, "x")], "resourceType string, id int, n string")
    interchange.write_ndjson(res, str(tmp_path / "n"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "n")).collect()]
    assert {"resourceType": "Patient", "id": 1} in lines
    bundle = json.loads(interchange.bundles(interchange.bundle_entries(res, F.col("id"))).first()["value"])
    assert bundle["type"] == "transaction" and len(bundle["entry"]) == 2
    with pytest.raises(ValueError):
        interchange.ndjson(res.drop("resourceType"))


def test_vocabulary_files(spark, tmp_path):
    head = "concept_id\tconcept_name\tdomain_id\tvocabulary_id\tconcept_class_id\tstandard_concept\tconcept_code"
    (tmp_path / "CONCEPT.csv").write_text(head + '\n1\tA "quoted"\tD\tV\tC\tS\t1\n2\tB\tD\tW\tC\t\t2\nx\tC\tD\tV\tC\tS\t3\n')
    assert rows(interchange.concept_scan(spark, str(tmp_path)), "concept_id", "concept_name") == [(1, 'A "quoted"')]
    assert interchange.concept_scan(spark, str(tmp_path), ("W",), standard_only=False).count() == 1


def test_profiles(spark):
    df = spark.createDataFrame([("Patient", "1", None, "M", ["a"]), ("Patient", "2", "N", None, None), ("Other", "3", None, None, None)], "resourceType string, id string, name string, gender string, tags array<string>")
    profile = {"type": "Patient", "required": ["name", "absent"], "invariants": {"i1": "tags.count() >= 1", "i2": "name.exists() and gender.exists()", "i3": "weird(x)"}}
    issues = profiles.validate(df, "id", profile)
    assert rows(issues, "id", "path") == sorted([("1", "name"), ("1", "absent"), ("2", "absent"), ("2", "i1"), ("1", "i2"), ("2", "i2"), (None, "i3")], key=str)
    assert {r["severity"] for r in issues.where("path = 'i3'").collect()} == {"information"}
    assert profiles.report(issues, df, "id").first()["passed"] is False
    assert profiles.validate(df, "id", {"type": "Patient", "url": "u", "required": ["name"]}).count() == 0


def test_columns(spark):
    prof = spark.createDataFrame([("dx_code", 100, 50), ("patient_id", 100, 100), ("zip_code", 100, 5), ("note", 100, 20)], "column_name string, row_count long, n_unique long")
    by = lambda v: {r["column_name"] for r in C.code_columns(prof, v).where("is_code").collect()}
    assert by("suffix") == {"dx_code"} and "patient_id" in by("names") and "patient_id" not in by("strict")
    assert {r["column_name"] for r in C.phi_columns(prof).where("is_phi").collect()} == {"patient_id", "zip_code"}
    kinds = [("stage_id", 100, 5, "bigint"), ("icd_version", 100, 2, "int"), ("note", 100, 20, "string"), ("amount", 100, 20, "double"), ("ref_id", 100, 31, "string"), (None, None, None, None)]
    typed = spark.createDataFrame(kinds, "column_name string, row_count long, n_unique long, data_type string")
    by = lambda v: {r["column_name"] for r in C.code_columns(typed, v).where("is_code").collect()}
    assert by("names") == {"stage_id", "icd_version", "note", "ref_id"} and by("strict") == {"note"}
    assert {r["column_name"] for r in C.phi_columns(typed, with_age=True).where("is_phi").collect()} == {"stage_id"}
    assert C.column_metadata(spark.createDataFrame([("x",)], "a string")) == [{"name": "a", "type": "string", "samples": ["x"]}]


def test_manifest_project_cli(spark, tmp_path, capsys):
    f = tmp_path / "in.csv"
    f.write_text("a,b\n1,x\n")
    rec = manifest.Recorder("run", {"k": 1})
    rec.input(str(f))
    rec.stage("load", rows=1)
    doc = rec.finalize(str(tmp_path / "m.json"))
    assert manifest.verify_inputs(doc) == {}
    assert manifest.replay(doc, {"load": lambda: {"rows": 1}})[0]["ok"] and not manifest.replay(doc, {"load": lambda: {"rows": 2}})[0]["ok"]
    f.write_text("changed")
    assert manifest.verify_inputs(doc) == {str(f): "changed"} and cli.main(["replay", str(tmp_path / "m.json")]) == 1
    assert cli.main(["models", "omop"]) == 0 and "person" in capsys.readouterr().out
    f.write_text("a,b\n1,x\n")
    project = Project(spark, str(tmp_path / "p"))
    assert project.add_source("in", path=str(f)).count() == 1
    assert Project(spark, str(tmp_path / "p")).catalog.read("in").count() == 1
    project.save_table("mappings", "m", spark.range(3))
    assert project.load_table("mappings", "m").count() == 3 and project.list("sources") == ["in"]
    with pytest.raises(ValueError):
        project.save("reports", "../x", {})
    project.delete("sources", "in")
    assert project.list("sources") == []


def test_text_functions(spark):
    df = spark.createDataFrame([("The Renal-cyst of x1", "jdbc://u:p@h/d")], "t string, u string")
    got = df.select(TX.tokens(F.col("t")).alias("t"), TX.redact(F.col("u")).alias("u")).first()
    assert got["t"] == ["renal", "cyst", "x1"] and got["u"] == "jdbc://***@h/d"
    assert TX.interpolate({"a": ["${X}-1"]}, {"X": "y"}) == {"a": ["y-1"]}


def test_stream_of_new_codes(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("A", at), ("A", at), (None, at), ("B", at)], "code string, at timestamp").write.parquet(src)
    stream = spark.readStream.schema("code string, at timestamp").parquet(src)
    mapped = incremental.mapped_stream(incremental.new_codes(stream, "code", "at"), "code", {"A": 1}, "id")
    incremental.append_to(mapped, out, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(out), "code", "id") == [("A", 1), ("B", 0)]


def test_union_above_literal_columns_groups_once(spark):
    from wardloom.session import guard
    from pyspark.sql import Window

    guard(spark)
    base = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    ranked = base.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    both = ranked.withColumn("l", F.lit("a")).unionByName(ranked.where("r < 5").withColumn("l", F.lit("b")))
    assert both.groupBy("k").count().count() == 50


def test_project_cross_map_and_sql(spark, tmp_path):
    project = Project(spark, str(tmp_path / "p"))
    people = spark.createDataFrame([(1, 8507, 1980)], "person_id long, gender_concept_id long, year_of_birth int")
    got = project.cross_map("omop_cdm_v5.4", "fhir_r4", "person", people)
    assert got.first()["resourceType"] == "Patient"
    assert project.cross_map("omop_cdm_v5.4", "fhir_r4", "no_such", people).columns == people.columns
    runs = [project.load("runs", n) for n in project.list("runs")]
    assert {(r["entity"], r["target_entity"]) for r in runs} == {("person", "Patient"), ("no_such", None)}
    assert tabular.run_sql(spark, "SELECT person_id + 1 AS n FROM {people} WHERE gender_concept_id = 8507", people=people).first()["n"] == 2
