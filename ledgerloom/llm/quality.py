"""Quality filtering by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation over the vote
patterns estimates how often every rule votes either way, or abstains, on good and on bad
documents, so how accurate it is; no labels are used. A document is kept if its posterior probability of being good reaches
``threshold``. The pattern table has at most 3 ** len(RULES) rows whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, without

ROUNDS = 12
#: Strength of the prior in documents, the prior share of good documents, and for each class the
#: prior rates of a vote for good and a vote for bad; the rest abstains.
PRIOR_DOCS, GOOD_SHARE = 20.0, 0.85
PRIOR = {"g": (0.6, 0.05), "b": (0.2, 0.3)}
THRESHOLD = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

#: name, SQL condition for a bad vote, SQL condition for a good vote. Both Spark and DuckDB read them.
RULES = [
    ("enough_words", "n_words < 50", "n_words >= 100"),
    ("word_length", "word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words", "FALSE"),
    ("symbols", "10 * n_symbols > n_words", "FALSE"),
    ("duplicate_lines", "10 * n_dup_lines > 5 * n_lines", "FALSE"),
    ("repeated_words", "10 * n_repeat_words > 3 * n_words", "FALSE"),
    ("capitals", "10 * n_upper > 3 * word_chars", "FALSE"),
    ("sentences", "100 * n_stops < n_words", "FALSE"),
    ("prose", "FALSE", "n_words > 0 AND 50 * n_symbols <= n_words AND 10 * n_upper <= word_chars AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_stops BETWEEN n_words / 50.0 AND n_words / 3.0"),
    ("variety", "FALSE", "n_words > 0 AND 10 * n_repeat_words <= n_words AND n_dup_lines = 0"),
]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text``, and the counts that the rules look at.

    Null text counts as empty: all counts are 0. The whole text is measured. Columns that have the
    name of a count, a vote or a verdict make way for it.
    """
    gaps = "\t\n\x0b\x0c\r "
    docs = without(docs, *BASE, "n_lines", "n_upper", "n_stops", *[f"v_{n}" for n, _, _ in RULES], "posterior", "base_failed", "kept")
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    spaced = F.trim(F.translate(text, gaps, " " * 6))
    step = docs.select(
        *rest,
        text.alias("__t"),
        F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +")).alias("__w"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, gaps, " " * 6)) != "").alias("__l"),
    )
    step = step.select(
        "*",
        F.transform(
            F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")),
        ).alias("__g"),
    )
    step = step.select("*", F.array_sort("__g").alias("__s"))
    again = F.filter(
        "__s",
        lambda x, k: (x.h == F.get("__s", k + 1).h).eqNullSafe(F.lit(True)) | (x.h == F.get("__s", k - 1).h).eqNullSafe(F.lit(True)),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x.i, x.i + 1, x.i + 2)))
    chars = F.length(_without(F.col("__t"), gaps))
    return step.select(
        *rest,
        F.size("__w").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.length("__t") - F.length(_without(F.col("__t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        (F.length("__t") - F.length(_without(F.col("__t"), ".!?"))).cast("long").alias("n_stops"),
    )


def _votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END").alias(f"v_{name}") for name, bad, good in RULES]


def _posterior(model: dict) -> Column:
    """Probability of a good document from its votes, by the log odds."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for name, _, _ in RULES:
        (g1, g0), (b1, b0) = model[f"g_{name}"], model[f"b_{name}"]
        vote = F.col(f"v_{name}")
        odds = odds + F.when(vote == 1, math.log(g1 / b1)).when(vote == 0, math.log(g0 / b0)).otherwise(
            math.log((1 - g1 - g0) / (1 - b1 - b0))
        )
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """The share of good documents, and how often each rule votes good and bad on either class.

    ``patterns`` has a row for each combination of votes, with ``n``. Each round is one small
    aggregation; only its sums, one row, come back. An empty table gives the prior.
    """
    model = {"share": GOOD_SHARE} | {f"{c}_{name}": PRIOR[c] for name, _, _ in RULES for c in "gb"}
    for _ in range(rounds):
        p = patterns.withColumn("p", _posterior(model))
        weight = {"g": F.col("n") * F.col("p"), "b": F.col("n") * (1 - F.col("p"))}
        sums = [F.sum(w).alias(c) for c, w in weight.items()]
        for name, _, _ in RULES:
            sums += [F.sum(F.when(F.col(f"v_{name}") == v, w).otherwise(0.0)).alias(f"{c}{v}_{name}") for c, w in weight.items() for v in (1, 0)]
        s = p.agg(*sums).first()
        if s["g"] is None:
            break
        model = {"share": (s["g"] + PRIOR_DOCS * GOOD_SHARE) / (s["g"] + s["b"] + PRIOR_DOCS)}
        for name, _, _ in RULES:
            for c in "gb":
                model[f"{c}_{name}"] = tuple(
                    (s[f"{c}{v}_{name}"] + PRIOR_DOCS * PRIOR[c][1 - v]) / (s[c] + PRIOR_DOCS) for v in (1, 0)
                )
    return model


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``measures``, the votes, ``posterior``, ``base_failed`` and ``kept``.

    A document that fails a base rule (under 50 words, or over half of its words in repeated
    windows) is never kept. Repeated rows are judged alike, each in its own row.
    """
    measured = materialize(measures(docs), "measures")
    voted = measured.select("*", *_votes())
    names = [f"v_{name}" for name, _, _ in RULES]
    patterns = materialize(voted.groupBy(*names).agg(F.count("*").alias("n")).repartition(1), "patterns")
    model = fit(patterns)
    return voted.select(
        "*", _posterior(model).alias("posterior"), F.expr(BASE_FAILED).alias("base_failed")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def oracle_sql(rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL: the counts from scratch, each round of the estimation a step."""
    gap, votes = "[\\x20\\x09-\\x0D]", [f"v_{n}" for n, _, _ in RULES]

    def odds(m: str) -> str:
        parts = [
            f"CASE WHEN v_{n} = 1 THEN ln({m}.g1_{n} / {m}.b1_{n}) WHEN v_{n} = 0 THEN ln({m}.g0_{n} / {m}.b0_{n})"
            f" ELSE ln((1 - {m}.g1_{n} - {m}.g0_{n}) / (1 - {m}.b1_{n} - {m}.b0_{n})) END"
            for n, _, _ in RULES
        ]
        return f"1 / (1 + exp(-(ln({m}.share / (1 - {m}.share)) + {' + '.join(parts)})))"

    first = [f"{GOOD_SHARE}::DOUBLE AS share"]
    first += [f"{PRIOR[c][1 - v]}::DOUBLE AS {c}{v}_{n}" for n, _, _ in RULES for c in "gb" for v in (1, 0)]
    steps = [f"m0 AS (SELECT {', '.join(first)})"]
    for k in range(1, rounds + 1):
        cols = [f"(sum(n * p) + {PRIOR_DOCS * GOOD_SHARE}) / (sum(n) + {PRIOR_DOCS}) AS share"]
        for n, _, _ in RULES:
            for c, w in (("g", "p"), ("b", "(1 - p)")):
                for v in (1, 0):
                    own = f"coalesce(sum(n * {w}) FILTER (WHERE v_{n} = {v}), 0)"
                    cols.append(f"({own} + {PRIOR_DOCS * PRIOR[c][1 - v]}) / (sum(n * {w}) + {PRIOR_DOCS}) AS {c}{v}_{n}")
        steps.append(f"m{k} AS MATERIALIZED (SELECT {', '.join(cols)} FROM (SELECT patterns.*, {odds(f'm{k - 1}')} AS p FROM patterns, m{k - 1}))")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{gap}+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^.!?]', '', 'g')) AS n_stops
      FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN l USING (r)),
v AS MATERIALIZED (SELECT *, {", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END AS v_{n}" for n, bad, good in RULES)} FROM f),
patterns AS MATERIALIZED (SELECT {", ".join(votes)}, count(*) AS n FROM v GROUP BY {", ".join(votes)}),
{", ".join(steps)}
SELECT doc_id, {", ".join(f"{c}::BIGINT AS {c}" for c in BASE)}, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND {odds(f"m{rounds}")} >= {threshold} AS kept
FROM v, m{rounds}"""
