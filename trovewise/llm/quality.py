"""Weak supervision of quality: rules vote or abstain, expectation maximisation weighs them.

Each rule looks at one property of the text and votes good (1), bad (0) or abstains (null). Votes are counted by
pattern, at most 3 to the number of rules, whatever the corpus. From the patterns, expectation maximisation estimates
every rule's rates of voting good and bad among good and among bad documents, and the share of good documents,
starting from the majority. A document's posterior probability of being good is a sum of its votes' log weights, as a
Spark expression over the votes, which one pass over the texts writes. Nothing but the patterns is shuffled.

Defined cases: a null text has the votes of the empty one; rules about words abstain without words. Repeated rows
count as often as they occur. No rows, no result. Other columns pass through or are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, written

ROUNDS, SMOOTH = 20, 1.0
WORD = r"[^ \t\r\n]+"
COMMON = ["the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "les", "et", "des", "que", "el", "los", "y", "en", "der", "die", "und", "das", "den", "von", "zu", "ist"]

# name: votes good if, votes bad if; in terms of the measures below, in SQL that Spark and DuckDB share.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words BETWEEN 50 AND 50000", "n_words < 15"),
    "word_length": ("n_words > 0 AND n_word_chars >= 3.0 * n_words AND n_word_chars <= 9.0 * n_words", "n_words > 0 AND (n_word_chars < 2.0 * n_words OR n_word_chars > 14.0 * n_words)"),
    "signs": ("n_words > 0 AND n_signs <= 0.05 * n_words", "n_words > 0 AND n_signs > 0.3 * n_words"),
    "capitals": ("n_words > 0 AND n_capitals <= 0.1 * n_chars", "n_words > 0 AND n_capitals > 0.3 * n_chars"),
    "digits": ("n_words > 0 AND n_digits <= 0.05 * n_chars", "n_words > 0 AND n_digits > 0.2 * n_chars"),
    "line_ends": ("n_lines > 1 AND n_ended >= 0.6 * n_lines", "n_lines > 1 AND n_ended < 0.2 * n_lines"),
    "lines_repeat": ("n_lines > 2 AND n_own_lines >= 0.9 * n_lines", "n_lines > 2 AND n_own_lines < 0.5 * n_lines"),
    "words_repeat": ("n_words > 30 AND n_own_words >= 0.3 * n_words", "n_words > 30 AND n_own_words < 0.15 * n_words"),
    "common_words": ("n_words > 20 AND n_common >= 0.08 * n_words", "n_words > 20 AND n_common < 0.01 * n_words"),
}


def _measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    size = lambda x: F.size(x).cast("bigint")
    chars = lambda x: F.char_length(x).cast("bigint")
    without = lambda signs: chars(text) - chars(F.translate(text, signs, ""))
    common = F.array(*[F.lit(x) for x in COMMON])
    return {
        "n_chars": chars(text),
        "n_words": size(words),
        "n_word_chars": chars(F.regexp_replace(text, "[ \t\r\n]+", "")),
        "n_signs": without("#$%&*|{}<>~^_="),
        "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": without("0123456789"),
        "n_lines": size(lines),
        "n_ended": size(F.filter(lines, lambda x: F.rtrim(x).rlike("[.!?\"']$"))),
        "n_own_lines": size(F.array_distinct(lines)),
        "n_own_words": size(F.array_distinct(words)),
        "n_common": size(F.filter(words, lambda x: F.array_contains(common, F.lower(x)))),
    }


def votes(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with a column of the vote of each rule; the measures are computed once, below a projection of their own."""
    measured = docs.withColumn(f"{prefix}m", F.struct(*[v.alias(k) for k, v in _measures(F.col("text")).items()]))
    inner = lambda sql: F.expr(_within(sql, f"{prefix}m"))
    return measured.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.when(inner(good), 1).when(inner(bad), 0).alias(f"{prefix}{k}") for k, (good, bad) in RULES.items()])


def _within(sql: str, struct: str) -> str:
    return " ".join(f"{struct}.{w}" if w.startswith("n_") else w for w in sql.replace("(", "( ").replace(")", " )").split())


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS, smooth: float = SMOOTH) -> tuple[float, list[dict[tuple[int, int], float]]]:
    """The log odds of good, and each rule's log weight of its votes, from (votes, number of documents)."""
    total = sum(n for _, n in patterns)
    post = [(0.5 + sum(v for v in p if v is not None)) / (1 + sum(v is not None for v in p)) for p, _ in patterns]
    prior, weights = 0.0, []
    for _ in range(rounds):
        good = sum(n * q for (_, n), q in zip(patterns, post))
        prior = math.log((good + smooth) / (total - good + smooth))
        weights = []
        for k in range(len(RULES)):
            own = {}
            cast_good, cast_bad = 2 * smooth, 2 * smooth
            for (p, n), q in zip(patterns, post):
                if p[k] is not None:
                    cast_good, cast_bad = cast_good + n * q, cast_bad + n * (1 - q)
            for vote in (0, 1):
                a = smooth + sum(n * q for (p, n), q in zip(patterns, post) if p[k] == vote)
                b = smooth + sum(n * (1 - q) for (p, n), q in zip(patterns, post) if p[k] == vote)
                own[vote] = math.log(a / cast_good) - math.log(b / cast_bad)
            weights.append(own)
        post = [1 / (1 + math.exp(-max(-700.0, min(700.0, prior + sum(w[v] for w, v in zip(weights, p) if v is not None))))) for p, _ in patterns]
    return prior, weights


def _weighed(voted: DataFrame, patterns: DataFrame, name: str, prefix: str) -> DataFrame:
    """voted, which has a column of each rule behind a prefix, with the posterior that patterns (of votes without it) give."""
    counts = [(tuple(r[:-1]), r[-1]) for r in patterns.groupBy(*RULES).count().collect()]
    if not counts:
        return voted.withColumn(name, F.lit(None).cast("double"))
    prior, weights = estimate(sorted(counts, key=str))
    odds = F.lit(prior)
    for k, w in zip(RULES, weights):
        odds = odds + F.when(F.col(f"{prefix}{k}") == 1, w[1]).when(F.col(f"{prefix}{k}") == 0, w[0]).otherwise(0.0)
    return voted.withColumn(name, 1 / (1 + F.exp(-odds)))


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, votes_good, votes_bad, posterior, keep) of every document; texts are read once, their votes are written."""
    cast = votes(docs.select("doc_id", "text")).select("doc_id", *[F.col(k).cast("tinyint").alias(k) for k in RULES])
    cast = written(cast.toDF("doc_id", *RULES), "votes")
    out = _weighed(cast, cast, "tw_posterior", "")
    count = lambda v: sum((F.coalesce((F.col(k) == v).cast("bigint"), F.lit(0)) for k in RULES), F.lit(0).cast("bigint"))
    return out.select("doc_id", count(1).alias("votes_good"), count(0).alias("votes_bad"), F.round("tw_posterior", 6).alias("posterior"), (F.col("tw_posterior") >= least).alias("keep"))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose posterior reaches least; texts are read twice, to count and to filter, and nothing but patterns moves."""
    (name,) = fresh(docs, "tw_posterior")
    prefix = "tw_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    out = _weighed(votes(docs, prefix), votes(docs.select("text")), name, prefix)
    return out.filter(F.col(name) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """The same in SQL, the rounds of estimation unrolled."""
    common = ", ".join(f"'{w}'" for w in COMMON)
    without = lambda signs: f"length(t) - length(translate(t, '{signs}', ''))"
    cases = ",\n  ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 END AS {k}" for k, (good, bad) in RULES.items())
    cast, ayes = " + ".join(f"({k} IS NOT NULL)::INT" for k in RULES), " + ".join(f"coalesce({k}, 0)" for k in RULES)
    odds = " + ".join(["prior", *[f"CASE {k} WHEN 1 THEN {k}_1 WHEN 0 THEN {k}_0 ELSE 0.0 END" for k in RULES]])
    weight = ",\n  ".join(
        f"ln(({SMOOTH} + coalesce(sum(n * q) FILTER ({k} = {v}), 0)) / ({2 * SMOOTH} + coalesce(sum(n * q) FILTER ({k} IS NOT NULL), 0))) - ln(({SMOOTH} + coalesce(sum(n * (1 - q)) FILTER ({k} = {v}), 0)) / ({2 * SMOOTH} + coalesce(sum(n * (1 - q)) FILTER ({k} IS NOT NULL), 0))) AS {k}_{v}"
        for k in RULES
        for v in (0, 1)
    )
    steps = [f"q0 AS MATERIALIZED (SELECT *, (0.5 + {ayes}) / (1.0 + {cast}) AS q FROM patterns)"]
    for i in range(1, ROUNDS + 1):
        steps.append(f"w{i} AS MATERIALIZED (SELECT ln((sum(n * q) + {SMOOTH}) / (sum(n) - sum(n * q) + {SMOOTH})) AS prior,\n  {weight} FROM q{i - 1})")
        steps.append(f"q{i} AS MATERIALIZED (SELECT patterns.*, 1 / (1 + exp(-({odds}))) AS q FROM patterns CROSS JOIN w{i})")
    names = ", ".join(RULES)
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS lines,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), m AS (
  SELECT doc_id, length(t) AS n_chars, len(words) AS n_words, length(regexp_replace(t, '[ \t\r\n]+', '', 'g')) AS n_word_chars,
    {without("#$%&*|{}<>~^_=")} AS n_signs, {without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS n_capitals, {without("0123456789")} AS n_digits,
    len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '[.!?"'']$'))) AS n_ended,
    len(list_distinct(lines)) AS n_own_lines, len(list_distinct(words)) AS n_own_words,
    len(list_filter(words, lambda x: lower(x) IN ({common}))) AS n_common FROM base
), v AS MATERIALIZED (SELECT doc_id,
  {cases} FROM m
), patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM v GROUP BY {names}
), {", ".join(steps)}
SELECT doc_id, ({ayes})::BIGINT AS votes_good, ({cast} - ({ayes}))::BIGINT AS votes_bad,
  round(1 / (1 + exp(-({odds}))), 6) AS posterior, 1 / (1 + exp(-({odds}))) >= 0.5 AS keep
FROM v CROSS JOIN w{ROUNDS}
"""
