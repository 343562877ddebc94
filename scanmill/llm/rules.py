"""Quality rules by weak supervision, in DataFrame operations only.

Each rule looks at one property of a text and votes good (1), bad (0) or abstains (-1). Rules are noisy, so each has an
accuracy, unknown at first. Expectation-maximisation estimates the accuracies and the share of good texts from how the
rules agree over all documents; it needs only the number of documents for each pattern of votes, of which there are
at most 3 to the number of rules. The verdict is the posterior probability that a text is good.

Defined cases: a null or blank text has no words, every count 0, fails the base rules and is not kept; an empty table
gives an empty result; rows that are repeated are judged alike; only the text is read, other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.session import stored

_SPACE = r"[\\x20\\x09-\\x0D]+"

#: Rule name -> (SQL of bad, SQL of good); where neither holds, the rule abstains. Divisions are guarded by n_words > 0.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= 2 * n_words"),
    "word_length": ("word_chars > 12 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    "repeated_lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    "repeated_words": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "capitals": ("10 * n_upper > 4 * n_letters", "100 * n_upper <= 15 * n_letters"),
    "shouting": ("10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    "letters": ("10 * n_letters < 6 * word_chars", "100 * n_letters >= 80 * word_chars"),
    "sentences": ("n_words > 100 and n_stops = 0", "n_stops > 0 and n_words <= 60 * n_stops"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame) -> DataFrame:
    """Add the counts the rules look at; the words themselves stay inside the row."""
    text = docs.withColumn("_t", F.expr("coalesce(text, '')"))
    split = text.withColumns(
        {
            "_w": F.expr(f"filter(split(_t, '{_SPACE}'), x -> x <> '')"),
            "_l": F.expr("filter(split(_t, '\\n'), x -> rlike(x, '[^\\\\x20\\\\x09-\\\\x0D]'))"),
        }
    )
    # explode of one element: the arrays are made once, not again in every expression that reads them
    one = split.withColumn("_1", F.explode(F.array(F.struct("_w", "_l")))).withColumns({"_words": F.col("_1._w"), "_lines": F.col("_1._l")}).drop("_w", "_l", "_1")
    sizes = one.withColumn("_n", F.size("_words"))
    windows = "transform(sequence(0, _n - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))"
    hashed = sizes.withColumn("_h", F.explode(F.expr(f"array(case when _n < 3 then array() else {windows} end)")))
    # Windows in order of hash, then position: those next to an equal hash are the repeated ones. A text in which all windows differ skips this.
    pairs = hashed.withColumn(
        "_s",
        F.explode(
            F.expr("array(case when size(array_distinct(_h)) = size(_h) then array() else array_sort(transform(_h, (h, p) -> struct(h as h, p as p))) end)")
        ),
    )
    at = pairs.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, k) -> (k > 0 and _s[greatest(k - 1, 0)].h = x.h) or (k < size(_s) - 1 and _s[least(k + 1, size(_s) - 1)].h = x.h)), x -> x.p))"))
    covered = "aggregate(_p, struct(-3 as last, 0 as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"
    return at.withColumns(
        {
            "n_words": F.expr("cast(_n as long)"),
            "word_chars": F.expr(f"cast(length(regexp_replace(_t, '{_SPACE}', '')) as long)"),
            "n_symbols": F.expr("cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as long)"),
            "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)"),
            "n_repeat_words": F.expr(f"cast({covered} as long)"),
            "n_lines": F.expr("size(_lines)"),
            "n_letters": F.expr("length(regexp_replace(_t, '[^\\\\p{L}]+', ''))"),
            "n_upper": F.expr("length(regexp_replace(_t, '[^\\\\p{Lu}]+', ''))"),
            "n_shouts": F.expr("length(_t) - length(translate(_t, '!', ''))"),
            "n_stops": F.expr("length(_t) - length(translate(_t, '.?', ''))"),
        }
    ).drop("_t", "_words", "_lines", "_n", "_h", "_s", "_p")


def vote(name: str) -> Column:
    bad, good = RULES[name]
    return F.expr(f"case when n_words = 0 then -1 when {bad} then 0 when {good} then 1 else -1 end")


GOOD = "good"


@dataclass
class LabelModel:
    """Latent kinds of text: good, and for each rule a kind of fault that it sees first. bad[kind][rule]: probability that a vote is for bad."""

    share: dict[str, float]
    bad: dict[str, dict[str, float]]

    def _constant(self, kind: str) -> float:
        return math.log(self.share[kind] / self.share[GOOD])

    def _weights(self, kind: str, rule: str) -> tuple[float, float]:
        """What a vote for bad and one for good add to the log odds of the kind against good."""
        p, q = self.bad[kind][rule], self.bad[GOOD][rule]
        return math.log(p / q), math.log((1 - p) / (1 - q))

    def kinds(self, votes: dict[str, int]) -> dict[str, float]:
        """Posterior of each kind."""
        odds = {k: math.exp(self._constant(k) + sum(self._weights(k, r)[v] for r, v in votes.items() if v >= 0)) for k in self.share if k != GOOD}
        total = 1 + sum(odds.values())
        return {GOOD: 1 / total, **{k: v / total for k, v in odds.items()}}

    def posterior(self) -> Column:
        """The probability of good, over the vote columns."""
        total = F.lit(1.0)
        for k in RULES:
            odds = F.lit(self._constant(k))
            for r in RULES:
                bad, good = self._weights(k, r)
                odds = odds + F.when(F.col(f"vote_{r}") == 0, bad).when(F.col(f"vote_{r}") == 1, good).otherwise(0.0)
            total = total + F.exp(odds)
        return 1 / total


def fit(patterns: list[tuple[dict[str, int], int]], rounds: int = 100, alarm: tuple[float, float] = (0.002, 0.01)) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents).

    With one bad class, rules would be believed only where several fire at once; with a kind for each rule, a fault that one
    rule alone can see is found too, if it is more frequent than the rule's false alarms. `alarm` bounds the share of
    good texts that a rule calls bad: the upper bound fixes which kind is the good one, the lower one keeps a rule
    that hardly ever fires from deciding alone.
    """
    low, high = alarm
    kinds = [GOOD, *RULES]
    model = LabelModel(
        {k: 0.8 if k == GOOD else 0.2 / len(RULES) for k in kinds},
        {k: {r: (0.005 if k == GOOD else 0.9 if k == r else 0.1) for r in RULES} for k in kinds},
    )
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        mass = dict.fromkeys(kinds, 0.0)
        cast = {k: dict.fromkeys(RULES, 1e-9) for k in kinds}
        bad = {k: dict.fromkeys(RULES, 0.0) for k in kinds}
        for votes, n in patterns:
            for k, p in model.kinds(votes).items():
                mass[k] += n * p
                for r, v in votes.items():
                    if v >= 0:
                        cast[k][r] += n * p
                        bad[k][r] += n * p * (v == 0)
        bound = lambda k, r: (low, high) if k == GOOD else (0.5, 0.99) if k == r else (0.01, 0.99)
        model = LabelModel(
            {k: max(1e-4, mass[k] / total) for k in kinds},
            {k: {r: min(bound(k, r)[1], max(bound(k, r)[0], bad[k][r] / cast[k][r])) for r in RULES} for k in kinds},
        )
    return model


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every row of `docs` (without its text and any clashing column) with the counts, votes, quality_prob, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. The counts are written to the
    shared folder, so each text is read once.
    """
    added = {*COUNTS, "n_lines", "n_letters", "n_upper", "n_shouts", "n_stops", "quality_prob", "base_failed", "kept", *(f"vote_{r}" for r in RULES)}
    added |= {"_t", "_w", "_l", "_1", "_words", "_lines", "_n", "_h", "_s", "_p"}
    voted = stored(counted(docs.drop(*(added & set(docs.columns)))).drop("text")).withColumns({f"vote_{r}": vote(r) for r in RULES})
    seen = voted.groupBy(*(f"vote_{r}" for r in RULES)).count().collect()  # at most 3 to the number of rules
    model = fit([({r: row[f"vote_{r}"] for r in RULES}, row["count"]) for row in seen])
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    out = voted.withColumns({"quality_prob": model.posterior(), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= threshold))
