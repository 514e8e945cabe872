"""Weighted fuzzy scores against all pairs."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import fuzzy


def sides(spark, n, seed=5):
    """Names of companies: shuffled, cut, misspelt and unrelated ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 8)))
    common = ["ltd", "holdings", "international", "co", "group"]
    words = [word() for _ in range(n // 2)]
    b = {" ".join([*r.sample(words, r.randint(1, 3)), *r.sample(common, r.randint(0, 2))]) for _ in range(n)} | {"LTD ACME Holdings International", "x", "holdings of the long road company"}
    a = {"Acme Ltd", "LTD", "", "x y", "company holdings of the", "the lonq road", "zz"}
    for text in r.sample(sorted(b), n // 2):
        parts = text.split()
        r.shuffle(parts)
        kept = " ".join(parts[: r.randint(1, len(parts))])
        lo = r.randint(0, len(text) // 2)
        cut = list(text[lo : lo + r.randint(3, 25)])
        cut[r.randrange(len(cut))] = r.choice("xyz")
        a |= {kept, "".join(cut), text.upper()}
    frame = lambda values, c: spark.createDataFrame([(v,) for v in sorted(values)], f"{c} string")
    return frame(a, "a"), frame(b, "b")


def best_of_all_pairs(left, right, score, cutoff=fuzzy.CUTOFF):
    pairs = left.crossJoin(right).withColumn("x", fuzzy.fuzzy_text(F.col("a"))).withColumn("y", fuzzy.fuzzy_text(F.col("b"))).select("a", "b", score(F.col("x"), F.col("y")).alias("s")).where(F.col("s") >= cutoff)
    return {r["a"]: (r["w"]["b"], -r["w"]["s"]) for r in pairs.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), "b")).alias("w")).collect()}


def in_order(c):
    return F.array_join(F.sort_array(F.split(c, r"\s+")), " ")


def weighted(x, y):
    return F.greatest(fuzzy.score(x, y), F.bround(fuzzy.score(in_order(x), in_order(y)) * fuzzy.REORDERED, 4), fuzzy.token_score(x, y), fuzzy.part_score(x, y))


def test_weighted_is_the_best_of_all_pairs(spark):
    left, right = sides(spark, 250)
    got = {r["value"]: (r["ref_value"], r["score"]) for r in fuzzy.best_matches(left, "a", right, "b", weighted=True).collect()}
    assert got == best_of_all_pairs(left, right, weighted)
    assert got["Acme Ltd"] == ("LTD ACME Holdings International", 85.5)
    assert got["the lonq road"][0] == "holdings of the long road company"


def test_scores(spark):
    row = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(fuzzy.token_score(F.col("a"), F.col("b")).alias("t"), fuzzy.part_score(F.col("a"), F.col("b")).alias("p")).first()
    assert tuple(row("acme ltd", "ltd acme holdings international")) == (57.0 * 1.5, 0.0)
    assert tuple(row("acme ltd", "acme ltd")) == (95.0, 0.0)
    assert tuple(row("abcde", "xxabXdexxx")) == (0.0, 72.0)
    assert tuple(row("", "abc")) == (0.0, 0.0)
    assert tuple(row("ab", "ab" + "c" * 20)) == (0.0, 60.0)


def tables_of(monkeypatch, *sides, **how):
    """Rows of the tables that a search writes, by name."""
    rows, plain = {}, fuzzy.written

    def counted(df, name):
        out = plain(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "written", counted)
    return fuzzy.best_matches(*sides, **how), rows


def test_texts_too_unlike_in_length_are_not_looked_for_by_edits(spark, monkeypatch):
    """Short names of long titles get a score by words that no number of edits could beat, so no round of deletions or bigrams is due."""
    titles = spark.range(300).selectExpr("concat_ws(' ', 'hot', elt(1 + id % 3, 'ring', 'bolt', 'plate'), 'brand 7 lot', id, 'standard') as b")
    names = spark.range(300).selectExpr("concat_ws(' ', id, elt(1 + id % 3, 'ring', 'bolt', 'plate'), 'lot') as a")
    found, rows = tables_of(monkeypatch, names, "a", titles, "b", weighted=True)
    assert found.count() == 300 and found.where("score = 85.5").count() > 250
    assert "fuzzy-grams" not in rows and "fuzzy-texts" not in rows
    assert sum(map(len, rows.values())) < 40


def test_reach_by_length():
    reach = lambda *given: (lambda most, theirs: ({n: round(m, 1) for n, m in most.items()}, theirs))(*fuzzy._reach(*given))
    of_b = [10, 20, 21]
    assert reach({5: 0.0, 13: 0.0}, of_b, 60.0) == ({13: 76.9}, {10, 20, 21})
    assert reach({13: 0.0}, of_b, 60.0, 3) == ({13: 76.9}, {10})
    assert reach({13: 77.0}, of_b, 60.0) == ({}, set())
    assert reach({20: 100.0}, of_b, 60.0) == ({20: 100.0}, {20})
    assert reach({}, of_b, 60.0) == reach({5: 0.0}, [], 60.0) == ({}, set())


def test_texts_that_many_fit_equally_well_have_one_row(spark, monkeypatch):
    """Of a thousand titles with the same piece the smallest is kept, whatever the round."""
    titles = spark.range(1000).selectExpr("concat('large hot ring brand ', id, ' lot ', id * 7) as b")
    pieces = spark.createDataFrame([("rge hot ring",), ("rge hXt ring",), ("ring large nn",)], "a string")
    found, rows = tables_of(monkeypatch, pieces, "a", titles, "b", weighted=True)
    assert {r["value"]: r["ref_value"] for r in found.collect()} == {p: "large hot ring brand 0 lot 0" for p in ("rge hot ring", "rge hXt ring", "ring large nn")}
    assert max(rows["fuzzy-found"]) <= 3


def test_common_grams_alone_bring_nothing_together(spark):
    """Numbers under one long common name: candidates of the gram rounds grow with the values, not with their square."""
    sizes = {}
    for n in (400, 1600):
        r = random.Random(2)
        texts = [f"customer account {r.randrange(10**9):09d}" for _ in range(n)]
        df = spark.createDataFrame([(t,) for t in texts], "b string").distinct()
        counts = df.select(F.explode(fuzzy._grams(F.col("b"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        keys = fuzzy._rare_first(df, "b", counts).select("b", F.explode(fuzzy._gram_keys(F.col("grams"), F.lit(2 * 2 + 1))).alias("key"))
        sizes[n] = keys.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert sizes[1600] <= 4 ** 1.3 * sizes[400], sizes
