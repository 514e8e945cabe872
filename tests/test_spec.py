import pytest

from ledgerloom.sources import spec as S


def test_amount_column_prefers_keywords_over_column_order():
    assert S.amount_column(["Total", "Open Amount"]) == "Open Amount"
    assert S.amount_column(["Net Balance", "Grand Total"]) == "Grand Total"
    assert S.amount_column(["unit cost", "list price"]) == "list price"
    assert S.amount_column(["a", "b"]) is None


def test_role_columns():
    assert S.role_column(["Dated", "Inv Date"], S.DATE_ROLE) == "Dated"
    assert S.role_column(["Amount Due", "Amount"], S.AMOUNT_ROLE) == "Amount"
    assert S.role_column(["Balance", "Amount"], S.AMOUNT_ROLE, "first_any") == "Balance"
    assert S.fallback_amount(["x", "Sub Total", "Amount"]) == "Sub Total"
    assert S.invoice_column(["x", "Invoice Num"]) == "Invoice Num"
    assert S.invoice_column(["x", "y"]) == "x"


def test_column_resolution():
    assert S.with_key(["a"], "k") == ["a", "k"] and S.with_key(None, "k") is None
    assert S.return_columns(["a"], ["k", "a", "b"], "k", needed=["b", "k"]) == ("a", "b")
    assert S.return_columns([], ["k", "a", "b"], "k") == ("a", "b")
    assert S.return_columns(["a"], ["k", "a", "b"], "k", loaded=["k", "a", "b"]) == ("a", "b")
    assert S.source_names(["Bank", None, " "]) == ["Bank", "Ref2", "Ref3"]
    assert S.base_key(None, {"b": "K"}, "b") == "K"
    with pytest.raises(ValueError):
        S.base_key(None, {}, "b")


def test_fields():
    rows = [{"name": "", "mappings": {"SOA": "Amt", "B": ""}}, {"name": "x", "mappings": {}}, {"name": " Y ", "type": "Date", "mappings": {"B": "d"}}]
    assert S.fields_of(rows) == (S.FieldSpec("Amt", {"SOA": "Amt"}), S.FieldSpec("Y", {"B": "d"}, "Date"))


def test_saved_spec_is_bound_to_what_there_is():
    spec = S.JobSpec(S.BaseSpec("k"), (S.RefSpec("A", "k", ("x", "y")), S.RefSpec("B", "k", ("x",)), S.RefSpec("C", "k", ("z",))), (S.FieldSpec("F", {"SOA": "x", "A": "x", "B": "x"}),))
    assert S.JobSpec.from_json(spec.to_json()) == spec
    bound = S.bind(spec, {"A": ["k", "y"], "B": ["x"], "C": ["k"]})
    assert bound.refs == (S.RefSpec("A", "k", ("y",)),)
    assert bound.fields == (S.FieldSpec("F", {"SOA": "x", "B": "x"}),)


def test_saved_spec_is_bound_by_file_name():
    refs = (S.RefSpec("A", "k", ("x", "y"), "bank.csv"), S.RefSpec("B", "k", ("x",), "gone.csv"), S.RefSpec("C", "k", ("x",), "ledger.csv"), S.RefSpec("D", "k", ("x",)))
    spec = S.JobSpec(S.BaseSpec("k", "Date", "Amount"), refs, (S.FieldSpec("F", {"SOA": "x", "A": "y", "B": "x"}),))
    assert S.JobSpec.from_json(spec.to_json()) == spec
    files = {"s3a://b/june/bank.csv": ["k", "y"], "/old/bank.csv": ["k", "x"], "C:\\new\\ledger.csv": ["other", "x"], "/new/D": ["k", "x"]}
    bound, paths = S.bind_files(spec, files, ["k", "Amount"])
    assert paths == {"A": "s3a://b/june/bank.csv"}
    assert bound.refs == (S.RefSpec("A", "k", ("y",), "bank.csv"),)
    assert bound.base == S.BaseSpec("k", None, "Amount")
    assert bound.fields == (S.FieldSpec("F", {"SOA": "x", "A": "y"}),)
    assert S.bind_files(spec, {})[1] == {} and S.bind_files(spec, {})[0].base == spec.base


def test_auto_spec_and_checks():
    auto = S.auto_spec(["Invoice", "Date", "Amount"], {"A": ["id", "x"], "B": ["only"]}, {"A": "x"})
    assert auto.base == S.BaseSpec("Invoice", "Date", "Amount")
    assert auto.refs == (S.RefSpec("A", "x", ("id",)), S.RefSpec("B", "only", ("only",)))
    with pytest.raises(ValueError):
        S.JobSpec(S.BaseSpec("k"), (S.RefSpec("A", "k"), S.RefSpec("A", "k")))
    with pytest.raises(ValueError):
        S.JobSpec(S.BaseSpec("k"), how="inner")
