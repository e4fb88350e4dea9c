"""The cleaning funnel of raw learner pairs, one step a function, cheap steps first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.functions.hangul import letter_distance

BOTH = ("orig", "cor")


def on_both(pairs: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return pairs.withColumns({c: f(F.col(c)) for c in BOTH})


def where_both(pairs: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return pairs.filter(f(F.col("orig")) & f(F.col("cor")))


def token_ratio(o: Column, c: Column) -> Column:
    per = F.try_divide(F.size(X.tokens(c)), F.size(X.tokens(o)))
    return (per > 0.25) & (per < 4)


def char_ratio(o: Column, c: Column) -> Column:
    per = F.try_divide(F.length(c), F.length(o))
    return (per > 0.5) & (per < 1.25)


def enough_tokens(o: Column, c: Column, least: int = 5) -> Column:
    return F.least(F.size(X.tokens(c)), F.size(X.tokens(o))) > least


def balanced(o: Column, c: Column) -> Column:
    """Whether two sides are of like length, in tokens and in characters, and long enough."""
    return token_ratio(o, c) & char_ratio(o, c) & enough_tokens(o, c)


def ratios(pairs: DataFrame) -> DataFrame:
    return pairs.filter(balanced(F.col("orig"), F.col("cor")))


def free_of(c: Column, *words: str) -> Column:
    """Whether a text contains none of the words."""
    clear = F.lit(True)
    for w in words:
        clear = clear & ~c.contains(w)
    return clear


def blocked(pairs: DataFrame, *words: str) -> DataFrame:
    return pairs.filter(free_of(F.col("cor"), *words))


def sentence_pairs(orig: Column, cor: Column) -> Column:
    """The pairs of sentences (structs) of a pair: those that differ, if both sides have as many; a pair of
    one sentence as it is."""
    o, c = (F.split(x, r"\.", -1) for x in (orig, cor))
    several = F.size(o) > 2
    one = lambda z: F.struct(F.concat(z["o"], F.lit(" .")).alias("orig"), F.concat(z["c"], F.lit(" .")).alias("cor"))
    zipped = F.slice(F.arrays_zip(o.alias("o"), c.alias("c")), F.lit(1), F.greatest(F.size(o) - 1, F.lit(0)))
    parts = F.transform(F.filter(zipped, lambda z: (z["o"] != z["c"]) & (F.least(F.length(z["o"]), F.length(z["c"])) > 4)), one)
    none = F.filter(parts, lambda _: F.lit(False))
    return F.when(several & (F.size(o) == F.size(c)), parts).when(several, none).otherwise(F.array(F.struct(orig.alias("orig"), cor.alias("cor"))))


def split_sentences(pairs: DataFrame) -> DataFrame:
    """Pairs of several sentences become one row for each sentence that differs, if both sides have as many."""
    others = [x for x in pairs.columns if x not in BOTH]
    return pairs.select(*others, F.explode(sentence_pairs(F.col("orig"), F.col("cor"))).alias("p")).select(*others, "p.*")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(*BOTH).distinct()


def multiplicity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*BOTH).agg(F.count("*").alias("n"))


def far_apart(pairs: DataFrame, limit: float = 10, keep: str = "gt") -> DataFrame:
    """Pairs whose distance in letters is above the limit, or (``le``) is not."""
    scored = pairs.withColumn("distance", letter_distance("orig", "cor"))
    return scored.filter(F.col("distance") > limit if keep == "gt" else F.col("distance") <= limit).drop("distance")

@dataclass(frozen=True)
class Step:
    """A step that looks at one pair alone: a change of each side, then a condition on both."""

    name: str
    change: Callable[[Column], Column] | None = None
    keep: Callable[[Column, Column], Column] | None = None

    def __call__(self, pairs: DataFrame) -> DataFrame:
        changed = on_both(pairs, self.change) if self.change else pairs
        return changed.filter(self.keep(F.col("orig"), F.col("cor"))) if self.keep else changed


def _each(f: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda o, c: f(o) & f(c)


#: The funnel: steps on single pairs, copies, steps on what is left, sentences, steps on these, distance.
BEFORE = [
    Step("foreign", lambda c: X.strip(X.strip_foreign(c))),
    Step("short", keep=_each(lambda c: F.length(c) > 2)),
    Step("charset", keep=_each(lambda c: X.allowed(c) & X.has_hangul(c))),
    Step("ratios", keep=lambda o, c: balanced(o, c) & free_of(c, "or", "good") & (X.longest_token(o) <= 20) & (X.longest_token(c) <= 20)),
    Step("punctuation", X.pad_punctuation, _each(lambda c: ~c.contains("/"))),
]
BETWEEN = [Step("repeats", X.drop_repeats)]
AFTER = [Step("different", keep=lambda o, c: o != c), Step("final", keep=_each(lambda c: ~c.contains("\t") & (F.length(c) >= 2)))]
STEPS: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [
    *((s.name, s) for s in BEFORE), ("distinct", distinct_pairs), *((s.name, s) for s in BETWEEN), ("sentences", split_sentences), *((s.name, s) for s in AFTER), ("far_apart", far_apart),
]


def clean(pairs: DataFrame, upto: str = "final", limit: float = 10, keep: str = "gt") -> DataFrame:
    """``orig`` and ``cor`` after the steps up to the one named; null sides drop out at the first filter.

    The whole funnel is ``upto="far_apart"``, whose ``limit`` and ``keep`` are those of that step.
    """
    for name, step in STEPS:
        pairs = far_apart(pairs, limit, keep) if name == "far_apart" else step(pairs)
        if name == upto:
            break
    return pairs


def _marked(pairs: DataFrame, steps: list[Step], left: Column) -> DataFrame:
    """Add one mark for each step: whether the pair is left after it.  Steps only look at pairs still left."""
    pairs = pairs.withColumn("left", left)
    for step in steps:
        if step.change:
            pairs = pairs.withColumns({c: F.when(F.col("left"), step.change(F.col(c))) for c in BOTH})
        if step.keep:
            pairs = pairs.withColumn("left", F.col("left") & F.when(F.col("left"), step.keep(F.col("orig"), F.col("cor"))))
        pairs = pairs.withColumn(step.name, F.col("left"))
    return pairs


def funnel(pairs: DataFrame, limit: float = 10, keep: str = "gt") -> DataFrame:
    """How many pairs each step leaves.

    Two passes: one marks every pair with the steps it survives up to the copies, one does so for the
    distinct pairs and their sentences.
    """
    number = {name: i + 1 for i, (name, _) in enumerate(STEPS)}
    first = _marked(pairs.select(*BOTH), BEFORE, F.lit(True)).agg(F.count("*").alias("loaded"), *(F.count_if(s.name).alias(s.name) for s in BEFORE))
    single = clean(pairs, "distinct")
    for step in BETWEEN:
        single = step(single)
    parts = single.select(F.posexplode_outer(sentence_pairs(F.col("orig"), F.col("cor"))).alias("at", "p"))
    there = F.col("at").isNotNull()
    named = _marked(parts.select(F.coalesce(F.col("at") == 0, F.lit(True)).alias("whole"), there.alias("sentences"), "p.orig", "p.cor"), AFTER, F.col("sentences"))
    named = named.withColumn("distance", letter_distance(*(F.when(F.col("left"), F.col(c)) for c in BOTH)))
    second = named.agg(F.count_if("whole").alias("distinct"), *(F.count_if("whole").alias(s.name) for s in BETWEEN), F.count_if("sentences").alias("sentences"), *(F.count_if(s.name).alias(s.name) for s in AFTER), F.count_if(F.col("distance") > limit if keep == "gt" else F.col("distance") <= limit).alias("far_apart"))
    rows_of = lambda d: d.select(F.explode(F.array(*(F.struct(F.lit(number.get(c, 0)).alias("step_no"), F.lit(c).alias("step"), F.col(c).alias("n_pairs")) for c in d.columns))).alias("x")).select("x.*")
    return rows_of(first).union(rows_of(second))
