"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes for good (1) or bad (0) or abstains (NULL). Expectation-maximisation over the votes estimates the share of
good documents and how often each rule is right on either class; a document's verdict is its posterior probability of being
good. Documents enter the estimate as counts of vote patterns (3 to the power of the number of rules at most), so the
iterations read a table of bounded size, whatever the corpus. The features of a document are computed once, inside its own
row, and stored; no step shuffles texts or words.

Defined cases: a missing or blank text has no words; all its counts are 0 and the base rule fails. Lines are split at line
feeds. Repeated rows count each. Features depend on the text alone, so ties cannot arise; an empty table gives an empty
result.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import SPACE_CLASS, SPACES, WORD_CLASS, fresh, stored

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything in ASCII that is no letter, without the apostrophe and the backslash.
NO_LETTERS = SPACES + "0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}~\""
WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_exclaims",
            "n_pipes")


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the features: when it votes bad, and when it votes good if it doesn't vote bad."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "20 * n_symbols > word_chars", "100 * n_symbols <= word_chars"),
    Rule("letters", "10 * n_letters < 9 * word_chars", "20 * n_letters >= 19 * word_chars"),
    Rule("capitals", "2 * n_capitals > word_chars", "5 * n_capitals <= word_chars"),
    Rule("exclaims", "5 * n_exclaims > n_words", "50 * n_exclaims <= n_words"),
    Rule("separators", "10 * n_pipes > n_words", "n_pipes = 0"),
    Rule("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    Rule("lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
)
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class LabelModel:
    """Probability that a document is good; for each rule, that its vote is bad on a bad and on a good document."""

    good: float
    bad_if_bad: tuple[float, ...]
    bad_if_good: tuple[float, ...]


def _without(text: str, chars: str) -> str:
    return f"length(translate({text}, '{chars}', ''))"


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with FEATURES (long); the input's columns of these names are replaced. ``n_repeat_words``: words within
    windows of five words that occur twice or more in the text. Windows are told apart by their 64-bit hash."""
    docs = docs.drop(*[c for c in FEATURES if c != text])
    own = docs.columns
    t, w, g, e = fresh(docs, "t_", "w_", "g_", "e_")
    spaces = SPACES.replace("\\", "\\\\")
    at = ", ".join(f"{w}[i + {k}]" for k in range(WINDOW))
    step = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    step = step.withColumn(w, F.array_remove(F.split(F.col(t), SPACE_CLASS + "+"), ""))
    # The windows' hashes, by position.
    step = step.withColumn(g, F.expr(
        f"CASE WHEN size({w}) > {WINDOW} THEN transform(sequence(0, size({w}) - {WINDOW}), i -> xxhash64({at})) END"))
    # Only where some hash occurs again: (hash, position) in order of hash, then the positions whose neighbour has the same.
    step = step.withColumn(e, F.expr(
        f"CASE WHEN size(array_distinct({g})) < size({g}) THEN array_sort(transform({g}, (h, i) -> struct(h, i))) END"))
    lines = fresh(step, "l_")[0]
    step = step.withColumn(lines, F.expr(f"filter(split({t}, '\\n'), x -> x RLIKE '{WORD_CLASS}')"))
    step = step.select(
        *own, t, lines,
        F.size(w).cast("long").alias("n_words"),
        F.expr(f"""array_sort(transform(filter({e}, (s, j) -> (j > 0 AND {e}[greatest(j - 1, 0)].h = s.h)
            OR (j + 1 < size({e}) AND {e}[least(j + 1, size({e}) - 1)].h = s.h)), s -> s.i))""").alias(e))
    return step.select(
        *own, "n_words",
        F.expr(_without(t, spaces)).cast("long").alias("word_chars"),
        F.expr(f"length({t}) - {_without(t, SYMBOLS)}").cast("long").alias("n_symbols"),
        F.expr(f"size({lines}) - size(array_distinct({lines}))").cast("long").alias("n_dup_lines"),
        F.expr(f"""coalesce(aggregate(transform({e}, (p, j) -> CASE WHEN j + 1 < size({e})
            THEN least({WINDOW}, {e}[least(j + 1, size({e}) - 1)] - p) ELSE {WINDOW} END), 0L, (a, x) -> a + x), 0L)""")
        .alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.expr(f"length({t}) - {_without(t, CAPITALS)}").cast("long").alias("n_capitals"),
        F.expr(_without(t, NO_LETTERS)).cast("long").alias("n_letters"),
        F.expr(f"length({t}) - {_without(t, '!')}").cast("long").alias("n_exclaims"),
        F.expr(f"length({t}) - {_without(t, '|')}").cast("long").alias("n_pipes"))


def vote(rule: Rule) -> Column:
    return F.expr(f"CASE WHEN {rule.bad} THEN 0 WHEN {rule.good} THEN 1 END")


def posterior_sql(model: LabelModel, names: list[str]) -> str:
    """The probability of good given the votes, as SQL over vote columns; an abstention says nothing."""
    odds = [f"{math.log(model.good / (1 - model.good))!r}D"]
    for name, b, g in zip(names, model.bad_if_bad, model.bad_if_good):
        odds.append(f"CASE {name} WHEN 0 THEN {math.log(g / b)!r}D WHEN 1 THEN {math.log((1 - g) / (1 - b))!r}D ELSE 0D END")
    return f"1D / (1D + exp(-({' + '.join(odds)})))"


def fit_label_model(features: DataFrame, rules=RULES, rounds: int = 25) -> LabelModel:
    """Expectation-maximisation from votes. Starts from: half of the documents good, a rule votes bad on 40 % of the bad
    and 2 % of the good documents. Each round is an aggregate over the pattern table; the driver gets its few sums."""
    names = [f"v{i}" for i in range(len(rules))]
    patterns = stored(
        features.select(*[vote(r).alias(n) for r, n in zip(rules, names)]).groupBy(*names).agg(F.count("*").alias("n"))
        .coalesce(1).sortWithinPartitions(*names), "votes").coalesce(1)
    model = LabelModel(0.5, (0.4,) * len(rules), (0.02,) * len(rules))
    for _ in range(rounds):
        q = patterns.withColumn("q", F.expr(posterior_sql(model, names)))
        sums = [F.sum("n").alias("n"), F.expr("sum(n * q)").alias("good")]
        for n in names:
            sums += [F.expr(f"sum(CASE WHEN {n} = 0 THEN n * (1 - q) ELSE 0 END)").alias(f"{n}_bb"),
                     F.expr(f"sum(CASE WHEN {n} = 1 THEN n * (1 - q) ELSE 0 END)").alias(f"{n}_gb"),
                     F.expr(f"sum(CASE WHEN {n} = 0 THEN n * q ELSE 0 END)").alias(f"{n}_bg"),
                     F.expr(f"sum(CASE WHEN {n} = 1 THEN n * q ELSE 0 END)").alias(f"{n}_gg")]
        s = q.agg(*sums).first()
        if not s["n"]:
            break
        model = LabelModel(
            (s["good"] + 1) / (s["n"] + 2),
            tuple((s[f"{n}_bb"] + 1) / (s[f"{n}_bb"] + s[f"{n}_gb"] + 2) for n in names),
            tuple((s[f"{n}_bg"] + 1) / (s[f"{n}_bg"] + s[f"{n}_gg"] + 2) for n in names))
    return model


def with_verdict(features: DataFrame, model: LabelModel, rules=RULES, least: float = 0.5) -> DataFrame:
    """Adds the votes (``vote_<rule>``, with an underscore behind the name where the input has such a column), ``p_good``, ``base_failed`` and
    ``kept``; equally named columns of the input are replaced by the last three."""
    features = features.drop("p_good", "base_failed", "kept")
    names = fresh(features, *[f"vote_{r.name}" for r in rules])
    voted = features.select("*", *[vote(r).alias(n) for r, n in zip(rules, names)])
    return voted.withColumn("p_good", F.expr(posterior_sql(model, names))).withColumn(
        "base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.expr(f"NOT base_failed AND p_good >= {least}D"))
