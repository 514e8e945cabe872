import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import compare, discrepancy, fuzzy, insights, match, reports
from ledgerloom.plans.reconcile import reconcile
from ledgerloom.sources import readers
from ledgerloom.sources.spec import FULL, BaseSpec, FieldSpec, JobSpec, RefSpec
from ledgerloom.sources.tables import scratch, shared_dir, written

NOW = dt.datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()), key=str)


def test_exact_left_match(spark):
    base = spark.createDataFrame([("INV001", 100), ("INV002", 200), ("INV003", 300), ("INV004", 400)], "Invoice string, Amount long")
    bank = spark.createDataFrame([("INV001", "Paid"), ("INV002", "Pending")], "Ref_Inv string, Ref_State string")
    out = match.exact_join(base, [("Bank", bank, "Invoice", "Ref_Inv")])
    assert rows(out, "Invoice", "Bank_Ref_State") == [("INV001", "Paid"), ("INV002", "Pending"), ("INV003", None), ("INV004", None)]


def test_fuzzy_match(spark):
    base = spark.createDataFrame([("INV001",), ("INV002",), ("INV003",), ("INV004",), (None,)], "Invoice string")
    ledger = spark.createDataFrame([("inv-001", "Found 1"), ("INV-004", "Found 4")], "Ref_Inv string, Ref_Note string")
    out = {r["Invoice"]: r["Ledger_Ref_Note"] for r in fuzzy.fuzzy_join(base, "Invoice", ledger, "Ref_Inv", "Ledger").collect()}
    assert out["INV001"] == "Found 1" and out["INV004"] == "Found 4" and out[None] is None


def test_fuzzy_is_the_best_of_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: " ".join("".join(rng.choice("abcde1") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 3)))
    a, b = {word() for _ in range(250)}, {word() for _ in range(250)}
    a |= {"long " * 12 + "tail", "abcdefghi", "ltd acme holdings", "q" * 45, "INV#1"}
    b |= {"long " * 12 + "tai1", "abxdexghx", "holdings acme ltd", "q" * 41, "inv 1", "inv-1"}
    left, right = spark.createDataFrame([(x,) for x in sorted(a)], "a string"), spark.createDataFrame([(x,) for x in sorted(b)], "b string")
    sides = left.crossJoin(right).withColumn("x", fuzzy.fuzzy_text(F.col("a"))).withColumn("y", fuzzy.fuzzy_text(F.col("b")))
    in_order = lambda c: F.array_join(F.sort_array(F.split(c, " +")), " ")
    for reordered in (False, True):
        s = fuzzy.score(F.col("x"), F.col("y"))
        if reordered:
            s = F.greatest(s, F.bround(fuzzy.score(in_order(F.col("x")), in_order(F.col("y"))) * fuzzy.REORDERED, 4))
        pairs = sides.select("a", "b", s.alias("s")).where(F.col("s") >= fuzzy.CUTOFF)
        want = {r["a"]: (r["w"]["b"], -r["w"]["s"]) for r in pairs.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), "b")).alias("w")).collect()}
        got = {r["value"]: (r["ref_value"], r["score"]) for r in fuzzy.best_matches(left, "a", right, "b", reordered=reordered).collect()}
        assert got == want
    assert got["ltd acme holdings"] == ("holdings acme ltd", 95.0)


def test_statement_smoke(spark):
    base = spark.createDataFrame([("INV001", "2024-01-01", 100.0), ("INV002", "2024-01-02", 200.0), ("INV003", "2024-01-03", 300.0)], "Invoice string, Date string, Amount double")
    ref = spark.createDataFrame([("INV001", 100.0, "Paid"), ("INV002", 150.0, "Pending")], "`Invoice #` string, Total double, Status string")
    spec = JobSpec(BaseSpec("Invoice", "Date", "Amount"), (RefSpec("Ref1", "Invoice #", ("Status",)),))
    done = reconcile(spec, base, {"Ref1": ref}, NOW)
    assert rows(done.discrepancies, "Invoice #", "Status", "Delta") == [("INV002", "Underpaid (Short)", 50.0), ("INV003", "MISSING IN REF", 300.0)]
    assert done.detail.columns[:2] == ["Age Bucket", "Age (Days)"] and done.issues.isEmpty()


def test_two_references(spark):
    base = spark.createDataFrame([("INV-001", "2024-01-01", 1.0), ("INV-002", "2024-01-01", 2.0), ("INV-003", "2024-01-01", 3.0)], "`Invoice #` string, Date string, Amount double")
    one = spark.createDataFrame([("INV-001", "UPS", "ok")], "Ref_Invoice string, Carrier string, Status string")
    two = spark.createDataFrame([("INV-002", "2024-02-01", "77")], "Vendor_Inv string, Payment_Date string, Check_No string")
    spec = JobSpec(BaseSpec("Invoice #", "Date", "Amount"), (RefSpec("Ref1", "Ref_Invoice", ("Carrier", "Status")), RefSpec("Ref2", "Vendor_Inv", ("Payment_Date", "Check_No"))))
    view = reconcile(spec, base, {"Ref1": one, "Ref2": two}, NOW).detail
    assert {"Ref1_Carrier", "Ref1_Status", "Ref2_Payment_Date", "Ref2_Check_No"} <= set(view.columns)
    assert rows(view, "Invoice #", "Match Source", "Duplicate Summary") == [
        ("INV-001", "Ref1", "Ref1: 1x, Ref2: no entry"), ("INV-002", "Ref2", "Ref1: no entry, Ref2: 1x"), ("INV-003", "", "Ref1: no entry, Ref2: no entry"),
    ]


def test_fields_of_a_master_list(spark):
    base = spark.createDataFrame([(i, "2024-01-01", 1) for i in (1, 2, 3, 4)], "ID long, Date string, Amount long")
    one = spark.createDataFrame([(1, "ABC", 1), (2, "XYZ", 1), (4, "A", 1)], "ID long, Shipper string, Amount long")
    two = spark.createDataFrame([(1, "ABC", 1), (3, "DEF", 1), (4, "B", 1)], "Tracking long, `Shipper Name` string, Total long")
    spec = JobSpec(BaseSpec("ID"), (RefSpec("Ref1", "ID", ("Shipper",)), RefSpec("Ref2", "Tracking", ("Shipper Name",))), (FieldSpec("Shipper", {"Ref1": "Shipper", "Ref2": "Shipper Name"}),), FULL)
    done = reconcile(spec, base, {"Ref1": one, "Ref2": two}, NOW)
    assert rows(done.schema, "ID / Key", "Shipper Status") == [("1", "MATCH"), ("2", "MISSING DATA"), ("3", "MISSING DATA"), ("4", "MISMATCH")]
    assert done.discrepancies is None


@pytest.mark.parametrize(
    ("base", "a", "b", "status", "delta"),
    [
        (0.0, None, None, "NO DATA", 0.0), (5.0, None, None, "MISSING IN REF", 5.0), (0.0, 3.0, None, "MISSING IN SOA", -3.0), (5.0, 5.0, None, "PARTIAL (Some Refs Missing)", 0.0), (5.0, 5.0, 5.0, "MATCH", 0.0),
        (5.0, 4.0, None, "MISMATCH (Partial)", 1.0), (5.0, 4.0, 5.0, "Underpaid (Short)", 1.0), (5.0, 6.0, 5.0, "Overpaid (Excess)", -1.0), (5.0, 6.0, 4.0, "Overpaid (Excess)", -1.0), (5.0, 4.0, 6.0, "Underpaid (Short)", 1.0),
        (0.0, 0.0, 0.0, "MATCH", 0.0), (None, 2.0, 2.0, "MISSING IN SOA", -2.0),
    ],
)
def test_each_status(spark, base, a, b, status, delta):
    spec = JobSpec(BaseSpec("k", None, "x"), (RefSpec("A", "k"), RefSpec("B", "k")))
    per_key = spark.createDataFrame([("1", base, a, b)], "`Invoice #` string, `SOA Amount` double, `A Amount` double, `B Amount` double")
    assert rows(discrepancy.judged(spec, per_key, ["A", "B"]), "Status", "Delta") == [(status, delta)]


def test_full_join_counts_and_keys(spark):
    base = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    a = spark.createDataFrame([("2", "x"), ("3", "y"), ("3", "z")], "k string, v string")
    b = spark.createDataFrame([("3", "p"), ("4", "q")], "k string, v string")
    spec = JobSpec(BaseSpec("k"), (RefSpec("A", "k", ("v",)), RefSpec("B", "k", ("v",))), how=FULL)
    view = match.detail(spec, base, [(spec.refs[0], a), (spec.refs[1], b)], NOW)
    assert rows(view, "k", "A_v", "A_Match_Count", "B_v", "B_Match_Count") == sorted(
        [("1", None, 0, None, 0), ("2", "x", 1, None, 0), ("NAN", None, 0, None, 0), ("3", "y", 2, "p", 1), ("3", "z", 2, "p", 1), ("4", None, None, "q", 1)], key=str
    )


def test_null_keys_meet_or_not(spark):
    base = spark.createDataFrame([(None, 1.0), (None, 2.0)], "k string, Amount double")
    ref = spark.createDataFrame([(None, "x")], "k string, v string")
    spec = JobSpec(BaseSpec("k"), (RefSpec("A", "k", ("v",)),))
    assert match.detail(spec, base, [(spec.refs[0], ref)], NOW).where("A_v = 'x'").count() == 2
    assert match.detail(spec, base, [(spec.refs[0], ref)], NOW, null_key=None).where("A_v = 'x'").count() == 0


def test_no_row_is_lost_with_null_keys_apart(spark):
    base = spark.createDataFrame([(None, 1.0), (None, 2.0), ("1", 3.0), ("2", 4.0)], "k string, Amount double")
    a = spark.createDataFrame([(None, "x"), (None, "x"), ("1", "y")], "k string, v string")
    b = spark.createDataFrame([(None, "p"), ("3", "q")], "k string, v string")
    spec = JobSpec(BaseSpec("k"), (RefSpec("A", "k", ("v",)), RefSpec("B", "k", ("v",))), how=FULL)
    view = match.detail(spec, base, [(spec.refs[0], a), (spec.refs[1], b)], NOW, null_key=None)
    assert rows(view, "k", "Amount", "A_v", "A_Match_Count", "B_v", "B_Match_Count") == sorted([
        (None, 1.0, None, 0, None, 0), (None, 2.0, None, 0, None, 0), (None, None, "x", 1, None, 0), (None, None, "x", 1, None, 0), (None, None, None, None, "p", 1),
        ("1", 3.0, "y", 1, None, 0), ("2", 4.0, None, 0, None, 0), ("3", None, None, None, "q", 1),
    ], key=str)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_a_broken_reference_does_not_stop_the_others(spark):
    base = spark.createDataFrame([("1", 5.0)], "k string, Amount double")
    good, bad = spark.createDataFrame([("1", 5.0)], "k string, Total double"), spark.createDataFrame([("1",)], "z string")
    spec = JobSpec(BaseSpec("k", None, "Amount"), (RefSpec("Bad", "k", ("v",)), RefSpec("Good", "k", ("Total",)), RefSpec("None", "k", ("v",))))
    done = reconcile(spec, base, {"Bad": bad, "Good": good}, NOW)
    assert rows(done.issues, "source", "issue") == [("Bad", "missing column: k, v"), ("None", "no table")]
    assert done.detail.first()["Match Source"] == "Good" and done.discrepancies.isEmpty()


def _isolated(spark, refs, **how):
    base = spark.createDataFrame([("1", 5.0), ("2", 6.0), ("3", 7.0)], "k string, Amount double")
    spec = JobSpec(BaseSpec("k", None, "Amount"), tuple(RefSpec(n, "k", ("Total",)) for n in refs))
    return reconcile(spec, base, refs, NOW, **how)


def test_a_reference_that_fails_while_it_is_read_is_left_out(spark, tmp_path):
    good = spark.createDataFrame([("1", 5.0), ("2", 1.0)], "k string, Total double")
    failing = good.withColumn("Total", F.when(F.col("k") == "2", F.raise_error(F.lit("damaged"))).otherwise(F.col("Total")))
    damaged = tmp_path / "damaged.parquet"
    good.coalesce(1).write.parquet(str(damaged))
    part = next(damaged.glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:40])
    for crc in damaged.glob(".*.crc"):
        crc.unlink()
    unlike = good.withColumn("Total", F.array("Total")).withColumn("k", F.map_from_arrays(F.array("k"), F.array("k")))
    refs = {"Failing": failing, "Good": good, "Damaged": str(damaged), "Gone": str(tmp_path / "gone.csv"), "Sheet": str(tmp_path / "a.xlsx"), "Unlike": unlike}
    done = _isolated(spark, refs, isolate=True)
    issues = {r["source"]: r["issue"] for r in done.issues.collect()}
    assert {s: i.split(":")[0] for s, i in issues.items() if s != "Unlike"} == dict.fromkeys(["Failing", "Damaged", "Gone", "Sheet"], "cannot be read")
    assert "unsupported file format" in issues["Sheet"] and "gone.csv" in issues["Gone"]
    alone = _isolated(spark, {"Good": good})
    shown = ["k", "Amount", "Good_Total", "Good_Match_Count"]
    assert rows(done.detail, *shown) == rows(alone.detail, *shown)
    assert {s for r in done.detail.select("Match Source").collect() for s in r[0].split(", ")} <= {"", "Good", "Unlike"}


def test_short_and_long_rows_of_a_file_stay_and_are_counted(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text('k,note,Total\n1,"a, b",5\n2,short\n3,long,7,8\n')
    done = _isolated(spark, {"Bank": str(path)})
    assert rows(done.issues, "source", "issue") == [("Bank", "rows with too few or too many cells: 2")]
    assert rows(done.detail, "k", "Bank_Total", "Bank_Match_Count") == [("1", "5", 1), ("2", None, 1), ("3", "7", 1)]
    # a file without such rows is no issue, nor is an empty one
    path.write_text("k,note,Total\n1,a,5\n")
    assert _isolated(spark, {"Bank": str(path)}).issues.isEmpty()
    path.write_text("k,note,Total\n")
    assert _isolated(spark, {"Bank": str(path)}).issues.isEmpty()


def test_joins_read_the_staged_columns_only(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    spark.createDataFrame([("1", "x", 2.0, 5.0)], "k string, other string, `Due Amount` double, Total double").write.parquet(path)
    whole, isolated = (_isolated(spark, {"Bank": source}) for source in (spark.read.parquet(path), path))
    plan = isolated.detail._jdf.queryExecution().executedPlan().toString()
    assert "wide.parquet" not in plan and "other" not in plan
    # the amount column is the same one as in the whole table
    assert sorted(map(str, whole.discrepancies.collect())) == sorted(map(str, isolated.discrepancies.collect()))


def test_row_order_and_keys_do_not_matter(spark, small):
    from ledgerloom.plans import derived as D

    base, refs = D.base(spark, small), [(D.BANK, D.bank(spark, small)), (D.LEDGER, D.ledger(spark, small))]
    mixed = [(r, df.orderBy(F.rand(3))) for r, df in refs]
    every = discrepancy.discrepancies(D.spec(), base, refs, keep_matches=True)
    again = discrepancy.discrepancies(D.spec(), base.orderBy(F.rand(5)), mixed, keep_matches=True)
    assert every.exceptAll(again).isEmpty() and again.exceptAll(every).isEmpty()
    assert every.count() == match.keyed(base, "Invoice").select(match.KEY).distinct().count() == every.select("Invoice #").distinct().count()
    full = discrepancy.discrepancies(D.FULL_SPEC, base, refs, keep_matches=True)
    keys = [match.keyed(base, "Invoice").select(match.KEY), *[match.keyed(df, r.match).select(match.KEY) for r, df in refs]]
    assert full.count() == keys[0].union(keys[1]).union(keys[2]).distinct().count()
    assert match.detail(D.spec(), base, refs, NOW).count() >= base.count()


def test_one_shuffle_makes_the_report(spark, small):
    from ledgerloom.plans import derived as D

    refs = [(D.BANK, D.bank(spark, small)), (D.LEDGER, D.ledger(spark, small))]
    report = discrepancy.discrepancies(D.spec(), D.base(spark, small), refs, sources=["Bank", "Ledger"])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_fields_compared_row_by_row(spark):
    view = spark.createDataFrame([("1", "2024-01-02", "abc", "2/1/2024", "ab"), ("2", "2024-01-02", "abc", "3/1/2024", "x"), ("3", None, "abc", "nan", "ABC")], "k string, Date string, Note string, R_date string, R_Note string")
    spec = JobSpec(BaseSpec("k"), (RefSpec("R", "k", ("date", "Note")),))
    assert rows(compare.fields(spec, view, ["k", "Date", "Note"]), "k", "Field Comparison") == [("1", "Partial: Note"), ("2", "Mismatch: Date, Note"), ("3", "✓ All Match")]


def test_insights_of_nothing(spark):
    spec = JobSpec(BaseSpec("k", None, "Amount"), (RefSpec("A", "k", ("v",)),))
    view = match.detail(spec, spark.createDataFrame([], "k string, Amount double"), [(spec.refs[0], spark.createDataFrame([], "k string, v string"))], NOW)
    report = spark.createDataFrame([], "`Invoice #` string, `SOA Amount` double, Ref_Count long, Delta double, Status string")
    assert insights.executive_summary(spec, view, report).first()["health_score"] == 0.0
    assert insights.iqr_summary(report, "SOA Amount").isEmpty() and insights.risk_scores(spec, report).isEmpty() and insights.patterns(spec, report).isEmpty()


def test_orders_and_figures_of_a_job_without_discrepancies(spark):
    scores = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "k string, `Risk Score` int")
    assert [r["k"] for r in insights.by_risk(scores).collect()] == ["c", "a", "b"]
    outliers = spark.createDataFrame([("a", 5.0), ("b", -9.0), ("c", 7.0)], "k string, x double")
    assert [r["k"] for r in insights.by_size(outliers).collect()] == ["b", "c", "a"]
    base = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate([1, 2, 3, 4, 100])], "k string, Amount double")
    ref = base.withColumnRenamed("Amount", "Total")
    spec = JobSpec(BaseSpec("k", None, "Amount"), (RefSpec("A", "k", ("Total",)),))
    done = reconcile(spec, base, {"A": ref}, NOW)
    assert done.discrepancies.isEmpty()
    assert [tuple(r)[:2] for r in done.reports()["outliers"].collect()] == [("4", 100.0)]
    told = {r["Metric"]: r["Value"] for r in done.reports()["reconciliation_insights"].collect()}
    assert told["Outlier Count"] == "1" and told["Median Amount"] == "$3.00"
    every = discrepancy.discrepancies(spec, base, [(spec.refs[0], ref)], keep_matches=True)
    assert tuple(insights.header_stats(done.detail, every, summary=False).first()) == (5, 5, 0)


def test_age_points_are_opt_in(spark):
    spec = JobSpec(BaseSpec("k"), (RefSpec("A", "k"),))
    report = spark.createDataFrame([("1", 10.0, 1, "MISSING IN REF")], "`Invoice #` string, Delta double, Ref_Count long, Status string")
    age = spark.createDataFrame([("1", 240)], "k string, days int")
    assert insights.risk_scores(spec, report).first()["Risk Score"] == 60
    assert insights.risk_scores(spec, report, age).first()["Risk Score"] == 80


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_set_of_reports_is_committed_together(spark, tmp_path, kind):
    folder = str(tmp_path / "out")
    table = lambda *values: spark.createDataFrame([(v,) for v in values], "v int")
    shown = lambda run=None: {n: sorted(r[0] for r in df.collect()) for n, df in reports.committed(spark, folder, run).items()}
    assert shown() == {}
    assert reports.commit_reports({"a": table(1, 2), "b": table()}, folder, "one", kind) == ["a"]
    assert shown() == {"a": [1, 2], "b": []}
    # a run that stops between two reports shows nothing of itself
    stopped = {"a": table(3), "b": table(4).select(F.raise_error(F.lit("lost")).cast("int").alias("v"))}
    with pytest.raises(Exception, match="lost"):
        reports.commit_reports(stopped, folder, "two", kind)
    assert shown() == {"a": [1, 2], "b": []} and shown("two") == {}
    # done again it is whole; once whole it is not done again
    reports.commit_reports({"a": table(5), "b": table(6)}, folder, "two", kind)
    assert reports.commit_reports(stopped, folder, "two", kind) == ["a", "b"]
    assert shown() == {"a": [5], "b": [6]} and shown("one") == {"a": [1, 2], "b": []}
    assert reports.commit_reports({}, folder, "three", kind) == []


def test_the_first_age_of_a_key_in_file_order(spark, tmp_path):
    for part, lines in enumerate(["1,\n2,2023-12-02", "1,2023-12-22\n2,2023-01-01\n1,2020-01-01"]):
        (tmp_path / "base.csv").mkdir(exist_ok=True)
        (tmp_path / "base.csv" / f"part-{part}.csv").write_text(f"k,Date\n{lines}\n")
    ages = match.placed_ages(readers.read_table(spark, str(tmp_path / "base.csv")), "k", "Date", NOW)
    report = spark.createDataFrame([(k, 0.0, 1, "MATCH") for k in "123"], "`Invoice #` string, Delta double, Ref_Count long, Status string")
    spec = JobSpec(BaseSpec("k"), (RefSpec("A", "k"),))
    plain = {r[0]: r[1] for r in insights.risk_scores(spec, report).select("Invoice #", "Risk Score").collect()}
    scores = {r[0]: r[1] - plain[r[0]] for r in insights.risk_scores(spec, report, ages.repartition(7)).select("Invoice #", "Risk Score").collect()}
    # 10 and 30 days of 120 give 1.7 and 5 of 20 points
    assert scores == {"1": 2, "2": 5, "3": 0}


def test_reports_are_written(spark, tmp_path):
    base = spark.createDataFrame([("1", "2024-01-01", 5.0), ("2", "2023-01-01", 7.0)], "k string, Date string, Amount double")
    ref = spark.createDataFrame([("1", 4.0)], "k string, Total double")
    spec = JobSpec(BaseSpec("k", "Date", "Amount"), (RefSpec("A", "k", ("Total",)),), (FieldSpec("Amount", {"SOA": "Amount", "A": "Total"}, "Currency"),))
    done = reconcile(spec, base, {"A": ref}, NOW).write(str(tmp_path))
    assert set(done) == {"detailed_view", "discrepancy_report", "reconciliation_insights", "risk_analysis", "normalized_comparison", "aging"}
    stamp = spark.read.parquet(str(tmp_path / "reconciliation_insights")).where("Metric = 'Generated At'").first()["Value"]
    assert stamp == "2024-01-01 00:00:00"
    assert spark.read.parquet(str(tmp_path / "discrepancy_report")).count() == 2
    shown = reports.preview(base.union(spark.createDataFrame([(None, None, None)], base.schema)))
    assert shown.count() == 3 and shown.where("k = ''").count() == 1


@pytest.mark.parametrize("rows", [0, 3, 500])
def test_figures_collected_while_writing(spark, rows):
    ids = spark.range(rows).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("Amount"))
    ref = ids.where("k % 3 <> 0").select("k", (F.col("Amount") - F.when(F.col("k") % 2 == 0, 1.0).otherwise(0.0)).alias("Total"))
    spec = JobSpec(BaseSpec("k", None, "Amount"), (RefSpec("A", "k", ("Total",)),))
    done = reconcile(spec, ids, {"A": ref}, NOW)
    view, report, known = insights.with_figures(spec, done.detail, done.discrepancies)
    assert known.count() == 1
    for insight in (insights.executive_summary, insights.data_summary, insights.metric_table):
        assert insight(spec, view, report, known=known).collect() == insight(spec, view, report).collect()
    assert rows_of(insights.status_breakdown(view, report, known)) == rows_of(insights.status_breakdown(view, report))
    for summary in (True, False):
        assert insights.header_stats(view, report, summary, known).collect() == insights.header_stats(view, report, summary).collect()
    risk = insights.risk_scores(spec, report, known=known)
    assert rows_of(risk) == rows_of(insights.risk_scores(spec, report))
    assert plan_of(risk).count("Relation [") == 1 and "Relation [" not in plan_of(insights.executive_summary(spec, view, report, known))


@pytest.mark.parametrize("tasks", [1, 7])
def test_sums_are_right_to_the_cent(spark, tasks):
    """Doubles near 10^13 lie 0.002 apart, so cents added to them one by one do not come to 10.00."""
    base = spark.createDataFrame([("big", 1e13)], "k string, Amount double").union(spark.range(1000).selectExpr("'c' || id", "0.01")).repartition(tasks)
    ref = base.selectExpr("k", "Amount * 0 as Total")
    spec = JobSpec(BaseSpec("k", None, "Amount"), (RefSpec("A", "k", ("Total",)),))
    done = reconcile(spec, base, {"A": ref}, NOW)
    told = lambda table: {r["Metric"]: r["Value"] for r in table.collect()}
    read, (view, report, known) = insights.metric_table(spec, done.detail, done.discrepancies), insights.with_figures(spec, done.detail, done.discrepancies)
    for figures in (told(read), told(insights.metric_table(spec, view, report, known=known))):
        assert figures["[SOA (Master)] Value Sum"] == figures["Total Discrepancy Value"] == "$10,000,000,000,010.00"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().replace("LocalRelation [", "")


def test_tables_written_on_the_way_are_removed(spark, tmp_path):
    base = spark.createDataFrame([("1", 5.0)], "k string, Amount double")
    spec = JobSpec(BaseSpec("k", None, "Amount"), (RefSpec("A", "k", ("Total",)),))
    done = reconcile(spec, base, {"A": base.select("k", (F.col("Amount") + 1).alias("Total"))}, NOW)
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    done.write(str(tmp_path / "out"))
    assert set(shared.iterdir()) == before
    with pytest.raises(ZeroDivisionError), scratch(spark):
        written(base, "lost")
        1 / 0
    assert set(shared.iterdir()) == before


def hot_tables(spark):
    """Half the base rows and two reference rows have no key; other keys repeat and lack partners here and there."""
    base = spark.range(4000).select(F.when(F.col("id") % 2 == 0, (F.col("id") % 700).cast("string")).alias("Invoice"), F.lit("2024-01-01").alias("Date"), F.col("id").alias("Amount"))
    ref = spark.range(900).select(F.when(F.col("id") > 1, F.col("id").cast("string")).alias("No"), F.col("id").alias("Total"), F.concat(F.lit("c"), "id").alias("Carrier"))
    return base, [(RefSpec("One", "No", ("Carrier",)), ref), (RefSpec("Two", "No", ("Total",)), ref.where("No is null or cast(No as int) % 3 = 0"))]


@pytest.mark.parametrize("how", ["left", FULL])
@pytest.mark.parametrize("null_key", ["NAN", None])
def test_hot_key_in_pieces(spark, how, null_key):
    base, refs = hot_tables(spark)
    spec = JobSpec(BaseSpec("Invoice", "Date", "Amount"), tuple(r for r, _ in refs), how=how)
    want = None
    for heavy, buckets in ((None, None), (100, None), (None, 5), (100, 5)):
        view = match.detail(spec, base, refs, NOW, null_key, heavy_rows=heavy, buckets=buckets)
        got = rows(view, *view.columns)
        want = want or got
        assert got == want


def test_bucketed_tables_join_without_an_exchange(spark):
    base, refs = hot_tables(spark)
    spec = JobSpec(BaseSpec("Invoice", "Date", "Amount"), tuple(r for r, _ in refs))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = spark.catalog.listTables()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain, staged = (match.detail(spec, base, refs, NOW, buckets=n) for n in (None, 8))
        assert "Exchange hashpartitioning" in executed(plain) and "Exchange" not in executed(staged)
        # the source itself is read while staging only
        assert "Range" in executed(plain) and "Range (" not in executed(staged)
        assert executed(staged).count("Scan parquet") == 1 + 2 * len(refs)
        assert staged.count() == plain.count()
        # a hot key in pieces needs none either
        assert "Exchange hashpartitioning" not in executed(match.detail(spec, base, refs, NOW, heavy_rows=100, buckets=8))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.catalog.listTables() == names


def executed(df):
    """The plan before it is run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_spread_over_tasks(spark):
    base, refs = hot_tables(spark)
    spec = JobSpec(BaseSpec("Invoice", "Date", "Amount"), tuple(r for r, _ in refs))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = {}
        for heavy in (None, 10):
            view = match.detail(spec, base, refs, NOW, heavy_rows=heavy)
            parts = sorted(r["count"] for r in view.groupBy(F.spark_partition_id()).count().collect())
            sizes[heavy] = parts[-1] / parts[len(parts) // 2]
        assert sizes[10] < 2 < 10 < sizes[None]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
