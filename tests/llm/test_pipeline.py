import corpus_pipeline as P
from ledgerloom.llm import pieces
from ledgerloom.llm.shared import read, written


def test_stages(spark, tiny):
    docs = read(spark, tiny, "documents")
    columns, left = docs.columns, [docs.count()]
    assert len(P.STAGES) == 5
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, tiny), name.replace(" ", "-"))
        assert docs.columns == columns, name
        left.append(docs.count())
    assert left[0] > left[1] == left[2] > left[3] > left[4] > 0
    last = P.STAGES[-1][1](spark, docs, tiny)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in docs.collect())
    labels = {r["doc_id"]: r["quality"] for r in read(spark, tiny, "labels").collect()}
    kept = {r["doc_id"] for r in last.collect()}
    bad, good = [d for d, q in labels.items() if q == 0], [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in bad) <= 0.1 * len(bad) and sum(d in kept for d in good) >= 0.8 * len(good)


def test_run_gives_pieces_of_what_is_left(spark, tiny):
    rows = P.run(spark, tiny).limit(20).collect()
    v = pieces.load(pieces.default_model())
    assert rows and all(len(r["ids"]) == r["n_pieces"] and isinstance(v.decode(r["ids"]), str) for r in rows)


def test_empty_and_odd_documents(spark, tiny, docs):
    odd = [(1, None), (2, ""), (2, ""), (None, "text of a row"), (3, "clean words in a line. " * 30, "en", None), (3, "clean words in a line. " * 30, "en", None)]
    for rows in ([], odd):
        given = docs(rows)
        for name, stage in P.STAGES:
            out = written(stage(spark, given, tiny), "odd")
            if name != P.STAGES[-1][0]:
                assert out.columns == given.columns, name
                given = out


def test_a_passage_outlives_both_dedup_stages(spark, tiny, docs):
    """A long passage stands in two texts of a host, and the one that keeps it is a near copy of a text without it."""
    passage = " ".join(f"p{i}" for i in range(60))
    lines = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(40))
    given = docs([(1, lines, "en", "host"), (2, f"{lines}\n{passage}", "en", "host"), (3, f"{passage}\nquite another text of a few words", "en", "host")])
    for name, stage in P.STAGES[1:3]:
        given = written(stage(spark, given, tiny), "passage")
    left = {r["doc_id"]: r["text"] for r in given.collect()}
    assert sum(passage in t for t in left.values()) == 1 and sorted(left) == [2, 3]
