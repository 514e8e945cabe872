"""Fuzzy best-match join of two columns by edit distance.

Distinct values of both sides are compared after a light normalisation; the best
score wins and the smallest reference value among equals. Texts are also compared
with their words sorted, which counts a little less, so a change of word order
costs little. Candidates come from equi-joins, never from a product of both sides.

Rounds look for more and more edits, and go on only for values whose best score so
far a text of more edits could still beat.

* Up to two edits, texts of up to ``SHORT`` signs: two texts within ``d`` edits share a
  text made by deleting up to d signs from each.
* More edits, or longer texts: two texts within d edits share all but 2d of the bigrams
  of the longer one (with a mark at either end, L signs have L + 1). Of each text's
  bigrams, rarest first, the first 2d + 1 therefore hold a shared one: the join is on
  these alone, so common bigrams are left out as long as d is small. The last round
  takes as many edits as the cutoff allows. Every pair of score over 50 shares two bigrams,
  so for such cutoffs the result is that of comparing all pairs. A bigram of more than
  ``LIGHT`` texts is no key by itself: it is one with each further bigram of the text's
  first 2d + 2, which hold two shared ones; so texts don't meet on a common bigram alone.

``weighted`` adds two scores for names of unlike length:

* tokens: the share, by length, of the side with fewer signs in its distinct words that
  the other side has too. Each text is looked for by the words that are rarest on the
  other side, as many as a shared
  set that reaches the cutoff can't do without, among all words of the other side.
* parts: where one text is at least ``UNLIKE`` times as long, the shorter one is held
  against its best window in the longer (a window of its length), and counts if at least
  ``FITS`` percent of it need no edit. An edit breaks q runs of q signs, so of q * e + 1
  runs of the shorter text, the rarest, one stands in the longer as it is; q is as long as
  the text allows, up to ``RUN``, as long runs are rare. Rounds go from
  no edit to as many as ``FITS`` allows, each with twice as many.

Rounds leave out texts whose length alone keeps them from a pair that is no worse than the
best so far. Of each text only the best score and the smallest reference value that has it
are kept, so texts that many others fit equally well cost no more.

Both count ``TOKENS`` and 1 of their share, times 0.9 where the lengths are unlike and 0.6
where one is eight times the other or more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fuzzy_text, name
from ..sources.tables import written

NO_MATCH = "No Match"
CUTOFF = 60.0
#: What a score of texts with sorted words counts.
REORDERED = 0.95
#: Edits found by deletions, and signs of the longest texts for which they are: their number grows with the square.
NEAR, SHORT = 2, 40
Q = 2
#: Texts that one bigram may bring together.
LIGHT = 64
# What the scores of shared words and of parts count, by how unlike the lengths are.
TOKENS, UNLIKE, FAR = 0.95, 1.5, 8.0
UNLIKE_SCALE, FAR_SCALE = 0.9, 0.6
#: Percent of the shorter text that its best window must fit; longest runs that are looked up.
FITS, RUN = 80.0, 8
#: Rows of a table of keys that are sent to all tasks instead of bringing the other side's rows to them.
BROADCAST_ROWS = 20_000


def score(a: Column, b: Column) -> Column:
    """0 to 100: share of the longer text that needs no edit."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.bround((1 - F.levenshtein(a, b) / longest) * 100, 4))


def _grams(text: Column) -> Column:
    """Bigrams of a text with a mark at either end, each with its number among equal ones before it."""
    marked = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    plain = F.transform(F.sequence(F.lit(1), F.length(marked) - Q + 1), lambda i: F.substring(marked, i, F.lit(Q)))
    numbered = F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, 1, i), lambda x: x == g)).cast("string")))
    return numbered


def _rare_first(texts: DataFrame, text: str, frequency: DataFrame) -> DataFrame:
    """texts with the array ``grams``, rarest first."""
    each = texts.select("*", F.explode(_grams(F.col(text))).alias("gram")).join(frequency, "gram", "left")
    return each.groupBy(*texts.columns).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("grams"))


def _gram_keys(grams: Column, few: Column) -> Column:
    """Keys of a text by its grams (n, gram), rarest first: each of the first ``few``, or, of a common one, its pairs with what follows it in the first few + 1."""
    first, more = F.slice(grams, F.lit(1), few), F.slice(grams, F.lit(1), few + 1)
    pairs = lambda g, i: F.transform(F.slice(more, i + 2, F.size(more)), lambda h: F.concat(g["gram"], F.lit("\x04"), h["gram"]))
    return F.flatten(F.transform(first, lambda g, i: F.when(g["n"] <= LIGHT, F.array(g["gram"])).otherwise(pairs(g, i))))


def _without_one(texts: Column) -> Column:
    """All texts made by deleting one sign from any of an array's."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    return F.array_distinct(F.flatten(F.transform(texts, cut)))


def _keys(text: Column, edits: int) -> Column:
    rings = [F.array(text)]
    for _ in range(edits):
        rings.append(_without_one(rings[-1]))
    return F.array_distinct(F.flatten(F.array(*rings)))


def _best(scored: DataFrame) -> DataFrame:
    """(a, ref, score): of each text the best score and the smallest reference value that has it; one row, however many have."""
    w = F.col("w")
    return scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "ref")).alias("w")).select("a", w["ref"].alias("ref"), (-w["s"]).alias("score"))


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows, so the other side of a join stays where it is."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _reach(of_a: Mapping[int, float], of_b: Sequence[int], cutoff: float, d: int | None = None) -> tuple[dict[int, float], set[int]]:
    """Lengths of texts that can have a pair of d edits (or any number), scored no worse than the cutoff and the best so far.

    ``of_a`` gives the worst best score of each length, ``of_b`` the other side's lengths in
    order. Returns the highest score that each length of a can reach, and the lengths of b.
    """
    most, theirs = {}, set()
    for n, best in of_a.items():
        at = bisect_left(of_b, n)
        scores = [(1 - abs(n - m) / max(n, m, 1)) * 100 for m in of_b[max(at - 1, 0) : at + 1] if d is None or abs(n - m) <= d]
        need = max(cutoff, best) - 1e-3
        if scores and max(scores) >= need:
            most[n] = max(scores)
            lo, hi = (n * need / 100, n * 100 / need) if need > 0 else (0, float("inf"))
            if d is not None:
                lo, hi = max(lo, n - d), min(hi, n + d)
            theirs.update(of_b[bisect_left(of_b, lo - 1e-6) : bisect_right(of_b, hi + 1e-6)])
    return most, theirs


def _search(left: DataFrame, right: DataFrame, cutoff: float) -> list[DataFrame]:
    """(a, ref, score): for each text of left (a, best) the best one of right (b, ref), if it is no worse than best."""
    allowed, spark = 1 - cutoff / 100, left.sparkSession
    found: list[DataFrame] = []
    of_b = sorted(r[0] for r in right.select(F.length("b")).distinct().collect())
    lengths = lambda df: {r[0]: r[1] for r in df.groupBy(F.length("a")).agg(F.min("best")).collect()}

    def fitting(df: DataFrame, x: str, within: Mapping[int, float] | set[int]) -> DataFrame:
        """The texts of these lengths; of side a only those that still reach a score no worse than their best."""
        rows = [(n, float(within[n]) if x == "a" else 0.0) for n in within]
        kept = df.join(F.broadcast(spark.createDataFrame(rows, "__n int, __most double")), F.length(x) == F.col("__n"))
        return (kept.where(F.col("best") <= F.col("__most") + 1e-3) if x == "a" else kept).drop("__n", "__most")

    def settle(todo: DataFrame, met: DataFrame, d: int, longest: int | None = None) -> DataFrame:
        """Adds the best of the pairs met; returns the texts that more edits could still serve better."""
        edits = F.levenshtein("a", "b", d)
        share = F.bround((1 - edits / F.nullif(F.greatest(F.length("a"), F.length("b")), F.lit(0))) * 100, 4)
        scored = met.where(edits >= 0).select("a", "ref", F.coalesce(share, F.lit(0.0)).alias("score")).where(F.col("score") >= cutoff)
        found.append(written(_best(scored), "fuzzy-found"))
        # a text of more edits scores less than this
        open_to = F.bround((1 - (d + 1) / (F.length("a") + d + 1)) * 100, 4)
        done = found[-1].where((F.col("score") > open_to) & (F.length("a") <= longest if longest else F.lit(True))).select("a")
        rest = todo.where((F.col("best") <= open_to) | (F.length("a") > longest if longest else F.lit(False)))
        return written(rest.join(done, "a", "left_anti"), "fuzzy-todo")

    todo, of_a = left, lengths(left)
    near = lambda d: F.bround((1 - d / F.greatest(F.length("a") + d, F.lit(1))) * 100, 4)
    for d in range(1, NEAR + 1):
        if not _reach(of_a, of_b, cutoff)[0]:
            return found
        most, theirs = _reach(of_a, of_b, cutoff, d)
        if not most or min(most) > SHORT or min(theirs) > SHORT:
            continue
        keyed = lambda df, x: df.where(F.length(x) <= SHORT).select(x, *(["ref"] if x == "b" else []), F.explode(_keys(F.col(x), d)).alias("key"))  # noqa: B023, E731
        # equal texts, too, are found by this round
        mine = fitting(todo, "a", most).where(F.col("best") <= (100.0 if d == 1 else near(d)))
        # a longer text may lie as near to one that is left out here
        todo = settle(todo, keyed(mine, "a").join(keyed(fitting(right, "b", theirs), "b"), "key").select("a", "b", "ref").distinct(), d, SHORT - d)
        of_a = lengths(todo)
    most, theirs = _reach(of_a, of_b, cutoff)
    if not most:
        return found
    longest = max(*most, *theirs)
    todo, right = fitting(todo, "a", most), fitting(right, "b", theirs)
    frequency = written(right.select(F.explode(_grams(F.col("b"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "fuzzy-grams")
    todo, b = (written(_rare_first(df, x, frequency), "fuzzy-texts") for df, x in ((todo, "a"), (right, "b")))
    rounds = [NEAR]
    while rounds[-1] < allowed * longest:
        rounds.append(2 * rounds[-1] + 1)
    for d in rounds:
        of_a = lengths(todo)
        if not _reach(of_a, of_b, cutoff)[0]:
            break
        most, theirs = _reach(of_a, of_b, cutoff, d)
        if not most:
            continue
        # no more than the cutoff allows: at 60, a text of L signs shares 0.2 L + 1 bigrams of L + 1
        share = lambda x: F.least(F.lit(allowed), 1 - F.col("best") / 100 + 1e-9) if x == "a" else F.lit(allowed)
        few = lambda x: F.least(F.lit(2 * d + 1), F.ceil(F.length(x) * 2 * share(x)).cast("int") + 1)  # noqa: B023, E731
        keyed = lambda df, x: df.where(F.length(x) > (SHORT - NEAR if d == NEAR else -1)).select(x, *(["ref"] if x == "b" else []), F.explode(_gram_keys(F.col("grams"), few(x))).alias("gram"))  # noqa: B023, E731
        met = keyed(fitting(todo, "a", most), "a").join(keyed(fitting(b, "b", theirs), "b"), "gram").where(F.abs(F.length("a") - F.length("b")) <= d).select("a", "b", "ref").distinct()
        todo = settle(todo, met, d)
    return found


def _scale(a: Column, b: Column) -> Column:
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(long < UNLIKE * short, 1.0).when(long < FAR * short, UNLIKE_SCALE).otherwise(FAR_SCALE)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, r"\s+"), ""))


def _weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t))


def token_score(a: Column, b: Column) -> Column:
    """0 to 95: share of the lighter side's words, by length, that the other side has."""
    return _token_score(_tokens(a), _tokens(b), a, b)


def _token_score(x: Column, y: Column, a: Column, b: Column) -> Column:
    least = F.least(_weight(x), _weight(y))
    return F.when(least == 0, 0.0).otherwise(F.bround(_weight(F.array_intersect(x, y)) / F.nullif(least, F.lit(0)) * 100 * TOKENS * _scale(a, b), 4))


def _edits_of_part(a: Column, b: Column) -> Column:
    """Edits between the shorter text and its best window in the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    return F.array_min(F.transform(F.sequence(F.lit(1), F.length(long) - n + 1), lambda i: F.levenshtein(short, F.substring(long, i, n))))


def _fitting(pairs: DataFrame, short: str, long: str, e: int) -> DataFrame:
    """The pairs in which a window of the longer text is at most e edits from the shorter one (with its bigrams in ``grams``), with ``edits``."""
    if not e:
        return pairs.where(F.contains(long, short)).withColumn("edits", F.lit(0))
    # an edit breaks two bigrams; counting those that are lost costs less than the windows
    lost = F.size(F.filter("grams", lambda r: ~F.contains(F.col(long), r)))
    n = F.length(short)
    windows = F.transform(F.sequence(F.lit(1), F.length(long) - n + 1), lambda i: F.levenshtein(short, F.substring(long, i, n), e))
    # as rows, so that it is worked out once
    return pairs.where(lost <= 2 * e).select("*", F.explode(F.array_compact(F.array(F.array_min(F.filter(windows, lambda x: x >= 0))))).alias("edits"))


def part_score(a: Column, b: Column, edits: Column | None = None) -> Column:
    """0 to 90: share of the shorter text that fits the longer one's best window; 0 if the lengths are alike or too little of it fits."""
    n = F.least(F.length(a), F.length(b))
    share = (1 - (_edits_of_part(a, b) if edits is None else edits) / F.when(n > 0, n)) * 100
    return F.when((n > 0) & (_scale(a, b) < 1) & (share >= FITS), F.bround(share * _scale(a, b), 4)).otherwise(0.0)


def _token_search(left: DataFrame, right: DataFrame, cutoff: float) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(a, ref, score): for each text of left (a, best) the best one of right (b, ref) by shared words, if it is no worse than best.

    First those with all words of the lighter side, which are cheap to find, and a function that
    finds the others for texts (a, best), when more is known of what they have to be as good as.
    """
    sides = {"a": left, "b": right}
    words = {x: df.withColumn(f"w_{x}", _weight(_tokens(F.col(x)))).select("*", F.explode(_tokens(F.col(x))).alias("word")) for x, df in sides.items()}

    def placed(x: str, texts: DataFrame, others: DataFrame) -> DataFrame:
        """Words that the other side has too, in the order of their texts on that side: ``i`` is a word's place, ``rest`` the weight of the words from here to the most frequent one."""
        wanted = _small(written(texts.select("word").distinct(), "fuzzy-words"))
        counts = _small(written(others.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")), "fuzzy-words"))
        own = [c for c in texts.columns if c != "word"]
        each = texts.join(counts, "word", "left").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("words"))
        rest = lambda i: F.aggregate(F.slice("words", i + 1, F.size("words")), F.lit(0), lambda n, w: n + F.length(w["word"]))
        listed = F.transform("words", lambda w, i: F.struct(w["n"].alias("n"), w["word"].alias("word"), i.alias("i"), rest(i).alias("rest")))
        return written(each.select(*own, F.explode(listed).alias("w")).select(*own, "w.*").where("n > 0").drop("n"), "fuzzy-placed")

    a = placed("a", words["a"], words["b"])
    weights = {x: df.agg(F.min(F.col(f"w_{x}")), F.max(F.col(f"w_{x}"))).first() for x, df in words.items()}
    # of texts of b that are lighter than one of a, the shared words are looked for by theirs
    lighter = None
    if (weights["b"][0] or 0) < (weights["a"][1] or 0):
        below = lambda df: df.where(F.col("w_b") < weights["a"][1])
        lighter = placed("b", below(words["b"]), words["a"])
    # a shared set of so much of the weight can't begin later
    leads = lambda x, share: F.col("rest") >= share * F.col(f"w_{x}") - 1e-9

    def met(of_a: DataFrame, todo: DataFrame, of_b: Column) -> DataFrame:
        """Pairs that share a word of either list; a pair may come more than once."""
        pairs = _small(written(of_a.select("a", "word"), "fuzzy-keys")).join(words["b"], "word").select("a", "b", "ref")
        if lighter is None:
            return pairs
        return pairs.unionByName(todo.join(lighter.where(of_b).select("b", "ref", "w_b", "word"), "word").where("w_b < w_a").select("a", "b", "ref"))

    def scored(pairs: DataFrame) -> DataFrame:
        # as rows, so that a score is worked out once
        split = pairs.select("*", _tokens(F.col("a")).alias("x"), _tokens(F.col("b")).alias("y"))
        value = F.explode(F.array(_token_score(F.col("x"), F.col("y"), F.col("a"), F.col("b"))))
        return split.select("a", "ref", value.alias("score")).where(F.col("score") >= cutoff)

    def others(known: DataFrame) -> DataFrame:
        least = F.greatest(F.lit(cutoff), F.col("best")) / 100 / TOKENS
        # pairs that share the first word of one that is no heavier were among the first
        later = F.col("i") > 0
        of_a = a.drop("best").join(known, "a")
        return written(_best(scored(met(of_a.where(later & leads("a", least)), words["a"].drop("best").join(known, "a"), later & leads("b", F.lit(cutoff / 100 / TOKENS))))), "fuzzy-found")

    # texts whose words all stand in the other one need but the rarest word
    return written(_best(scored(met(a.where(leads("a", F.lit(1.0))), words["a"], leads("b", F.lit(1.0))))), "fuzzy-found"), others


def _runs(text: Column, q: Column | int) -> Column:
    """All runs of q signs; none of a shorter text."""
    n = F.length(text)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(text, i, F.lit(q) if isinstance(q, int) else q))).otherwise(F.array().cast("array<string>"))


def _part_search(left: DataFrame, right: DataFrame, cutoff: float) -> list[DataFrame]:
    """(a, ref, score): for each text of left (a, best) the best one of right (b, ref) of which one is part of the other, if it is no worse than best."""
    found: list[DataFrame] = []
    other = {"a": "b", "b": "a"}
    spread = {x: df.agg(F.min(F.length(x)), F.max(F.length(x))).first() for x, df in (("a", left), ("b", right))}
    least, lengths = ({x: r[i] or 0 for x, r in spread.items()} for i in (0, 1))

    def met(short: str, todo: DataFrame, e: int, before: int) -> DataFrame | None:
        """Pairs in which the text of side ``short`` is the shorter one and may fit with e edits, more than the ``before`` looked for: one of its rarest runs stands in the longer."""
        long, sides = other[short], {"a": todo, "b": right}
        if UNLIKE * max(least[short], 1) > lengths[long]:
            return None
        x, n = F.col(short), F.length(short)
        # no more edits than FITS allows
        own = F.least(F.lit(e), F.floor((100 - FITS) / 100 * n + 1e-9).cast("int"))
        if short == "a":  # nor more than could still give a better score
            own = F.least(own, F.floor((1 - F.col("best") / (100 * UNLIKE_SCALE)) * n + 1e-9).cast("int"))
        q = F.least(F.lit(RUN), F.floor(n / (own + 1)).cast("int"))
        kept = [short, *(["ref"] if short == "b" else [])]
        texts = sides[short].where((n > 0) & (UNLIKE * n <= lengths[long])).select(*kept, own.alias("own"), q.alias("q")).where(F.col("own") > before)
        sizes = sorted(r[0] for r in texts.select("q").distinct().collect())
        if not sizes:
            return None
        mine = texts.select(*kept, "own", "q", F.explode(F.transform(_runs(x, F.col("q")), lambda r, i: F.struct(i.alias("i"), r.alias("run")))).alias("r")).select(*kept, "own", "q", "r.*")
        theirs = sides[long].where(F.length(long) >= UNLIKE * max(least[short], 1)).select(long, *(["ref"] if long == "b" else []), F.explode(F.flatten(F.array(*[_runs(F.col(long), k) for k in sizes]))).alias("run"))
        wanted = _small(written(mine.select("run").distinct(), "fuzzy-runs"))
        counts = _small(written(theirs.join(wanted, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n")), "fuzzy-runs"))
        rare = mine.join(counts, "run", "left").groupBy(*kept, "own", "q").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "run"))).alias("runs"))
        # runs that no longer text has bring nothing
        chosen = rare.select(*kept, F.array_distinct(F.transform(F.filter(F.slice("runs", F.lit(1), F.col("q") * F.col("own") + 1), lambda r: r["n"] > 0), lambda r: r["run"])).alias("runs"))
        keys = _small(written(chosen.select("*", F.posexplode("runs").alias("i", "run")).select(*kept, "run", F.slice("runs", F.lit(1), F.col("i")).alias("earlier"), _runs(x, 2).alias("grams")), "fuzzy-keys"))
        pairs = keys.join(theirs, "run").where(F.length(long) >= UNLIKE * n)
        # each pair once, by the first of the runs
        return _fitting(pairs.where(~F.exists("earlier", lambda r: F.contains(F.col(long), r))), short, long, e).select("a", "b", "ref", "edits")

    todo, e, before = left, 0, -1
    shorter = max(min(lengths["a"], lengths["b"] / UNLIKE), min(lengths["b"], lengths["a"] / UNLIKE))
    most = int((100 - FITS) / 100 * shorter + 1e-9)
    while shorter and e <= most:
        pairs = [p for p in (met("a", todo, e, before), met("b", todo, e, before)) if p is not None]
        done = None
        if pairs:
            scored = reduce(DataFrame.unionByName, pairs).select("a", "ref", part_score(F.col("a"), F.col("b"), F.col("edits")).alias("score")).where(F.col("score") >= cutoff)
            found.append(written(_best(scored), "fuzzy-found"))
            done = found[-1]
        if e == most:
            break
        # what more edits could still reach, the shorter text being no longer than a
        still = F.bround((1 - (e + 1) / F.nullif(F.length("a"), F.lit(0))) * 100 * UNLIKE_SCALE, 4)
        rest = todo.where(F.col("best") <= still)
        rest = rest if done is None else rest.join(done.where(F.col("score") > still).select("a"), "a", "left_anti")
        todo, e, before = written(rest, "fuzzy-todo"), min(2 * e + 1, most), e
        if todo.isEmpty():
            break
    return found


def best_matches(base: DataFrame, on: str, ref: DataFrame, ref_on: str, cutoff: float = CUTOFF, reordered: bool = True, weighted: bool = False) -> DataFrame:
    """(value, ref_value, score): the best reference value of each base value that has one."""
    left = base.select(name(on).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct().withColumn("a", fuzzy_text(F.col("value")))
    right = ref.select(name(ref_on).cast("string").alias("ref")).where(F.col("ref").isNotNull()).withColumn("b", fuzzy_text(F.col("ref")))
    # of reference values that are one text the smallest stands for all
    # (in as many files as there are tasks, as each text of it costs far more than its bytes)
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    smallest = lambda df: written(df.repartition(parts, "b").groupBy("b").agg(F.min("ref").alias("ref")), "fuzzy-right")
    left, right = written(left, "fuzzy-left"), smallest(right)
    pairs: list[DataFrame] = []

    def open_to(most: float, texts: DataFrame) -> DataFrame:
        """(value, a, best) of the values whose best score so far is no better than most."""
        if not pairs:
            return texts.withColumn("best", F.lit(0.0))
        best = written(reduce(DataFrame.unionByName, pairs).groupBy("value").agg(F.max("score").alias("best")), "fuzzy-best")
        return texts.join(best, "value", "left").withColumn("best", F.coalesce("best", F.lit(0.0))).where(F.col("best") <= most)

    # of values that are one text the worst score decides how far is looked
    of_texts = lambda df: written(df.groupBy("a").agg(F.min("best").alias("best")), "fuzzy-todo")

    def look(search, most: float) -> None:
        pairs.extend(left.join(found, "a").select("value", F.col("ref").alias("ref_value"), "score") for found in search(of_texts(open_to(most, left)), right, cutoff))

    # what is found decides how many edits the later, dearer searches look for
    if weighted:
        others = []

        def first_tokens(*sides) -> list[DataFrame]:
            found, more = _token_search(*sides)
            others.append(more)
            return [found]

        look(first_tokens, 100 * TOKENS)
        look(_part_search, 100 * UNLIKE_SCALE)
        look(lambda texts, *_: [others[0](texts)], 100 * TOKENS)
    look(_search, 100.0)
    if reordered:
        in_order = lambda t: F.array_join(F.sort_array(F.split(t, r"\s+")), " ")
        left, right = written(open_to(100 * REORDERED, left).withColumn("a", in_order(F.col("a"))), "fuzzy-left"), smallest(right.withColumn("b", in_order(F.col("b"))))
        for found in _search(of_texts(left.withColumn("best", F.bround(F.col("best") / REORDERED - 5e-5, 4))), right, cutoff / REORDERED):
            pairs.append(left.join(found, "a").select("value", F.col("ref").alias("ref_value"), F.bround(F.col("score") * REORDERED, 4).alias("score")))
    if not pairs:
        return left.select("value", F.lit(None).cast("string").alias("ref_value"), F.lit(0.0).alias("score")).limit(0)
    first = F.struct(-F.col("score"), F.col("ref_value"))
    return reduce(DataFrame.unionByName, pairs).groupBy("value").agg(F.min_by("ref_value", first).alias("ref_value"), F.max("score").alias("score"))


def fuzzy_join(base: DataFrame, on: str, ref: DataFrame, ref_on: str, source: str, **how) -> DataFrame:
    """base with ``{source}_Match_Key`` (or ``No Match``) and the columns of the reference rows that have it."""
    match = f"{source}_Match_Key"
    found = _small(written(best_matches(base, on, ref, ref_on, **how).select("value", F.col("ref_value").alias("__ref_value")), "fuzzy-match"))
    keyed = base.join(found, name(on).cast("string") == F.col("value"), "left").drop("value").withColumn(match, F.coalesce("__ref_value", F.lit(NO_MATCH)))
    side = ref.select(*[name(c).alias(f"{source}_{c}") for c in ref.columns])
    of_ref = name(f"{source}_{ref_on}").cast("string")
    # few reference rows may be all that is matched
    matched = _small(written(side.join(_small(written(found.select("__ref_value").distinct(), "fuzzy-match")), of_ref == F.col("__ref_value"), "left_semi"), "fuzzy-side"))
    return keyed.join(matched, F.col("__ref_value") == of_ref, "left").drop("__ref_value")
