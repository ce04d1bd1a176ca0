"""Keyword risk, votes and verdicts on single messages, and the admission of messages to scoring.

A null message hits no keyword and is refused on admission; keywords are found anywhere in the
lower-cased text, not only as whole words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paigham import lexicon
from paigham.functions.text import contains_any, strip

MAX_LENGTH = 2000


def risk_score(c: Column) -> Column:
    """20 for each category with a keyword in the text."""
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [F.when(contains_any(low, words), 20).otherwise(0) for words in lexicon.RISK_KEYWORDS.values()])


def risk_level(score: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, lexicon.RISK_LEVELS)), (F.least(F.floor(score / 25), F.lit(4)) + 1).cast("int"))


def keyword_hits(c: Column) -> Column:
    """Category -> keywords found; categories without any are left out."""
    low = F.lower(c)
    found = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.contains(low, w), F.lit(False)))
    entries = [F.struct(F.lit(name).alias("key"), found(words).alias("value")) for name, words in lexicon.RISK_KEYWORDS.items()]
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda _, v: F.size(v) > 0)


def expected_label(c: Column) -> Column:
    return F.when(contains_any(F.lower(c), lexicon.EXPECTED_SCAM_WORDS), "Scam").otherwise("Genuine")


def votes(*predictions: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(p == "Scam", 1).otherwise(0) for p in predictions])


def ensemble(df: DataFrame, *columns: str) -> DataFrame:
    """Votes for Scam, the majority's label and its percent; a null prediction is a vote for Genuine."""
    n = len(columns)
    v = votes(*map(F.col, columns))
    return df.withColumns({"scam_votes": v, "prediction": F.when(v * 2 > n, "Scam").otherwise("Genuine"), "confidence": F.greatest(v, n - v) / n * 100})


def verdict(prediction: Column, score: Column) -> Column:
    scam = F.coalesce(prediction == "Scam", F.lit(False))
    return F.when(scam & (score > 50), "confirmed scam").when(scam, "likely scam").when(score > 50, "suspicious").otherwise("genuine")


def batch(df: DataFrame, message: str, *predictions: str) -> DataFrame:
    """The input with a shortened message, votes, label, percent as text, and keyword risk."""
    score = risk_score(F.col(message))
    voted = ensemble(df, *predictions)
    return voted.withColumns({"sms": F.substring(message, 1, 50), "confidence_text": F.format_string("%.0f%%", F.col("confidence")), "risk_score": F.least(score, F.lit(100)), "risk_level": risk_level(score)})


def batch_totals(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row: messages of a batch, and those of each label."""
    n, scam = F.count("*"), F.count_if(F.col(prediction) == "Scam")
    return scored.agg(n.alias("total"), scam.alias("scam"), (n - scam).alias("genuine"))


def admission(message: Column, cleaned: Column, known_terms: Column | None = None, ready: bool = True, bytes_most: int = 32 * 1024, is_json: Column | None = None, prediction: Column | None = None) -> tuple[Column, Column]:
    """Status and error of a message, the first check that fails; 200 for one that can be scored.

    ``is_json`` tells whether a request was sent as JSON, ``prediction`` what the model said: anything but a label is a failure.
    """
    ladder = [
        (F.coalesce(F.octet_length(message) > bytes_most, F.lit(False)), 413, "request too large"),
        *([] if is_json is None else [(~F.coalesce(is_json, F.lit(False)), 415, "request is not JSON")]),
        (message.isNull(), 400, "message must be text"),
        (F.length(message) > MAX_LENGTH, 400, "message too long"),
        (strip(message) == "", 400, "message is blank"),
        (F.lit(not ready), 503, "model not ready"),
        (F.coalesce(cleaned, F.lit("")) == "", 400, "no usable text"),
    ]
    if known_terms is not None:
        ladder.append((F.coalesce(known_terms, F.lit(0)) == 0, 422, "no known words"))
    if prediction is not None:
        ladder.append((~F.coalesce(prediction.isin(*lexicon.LABELS), F.lit(False)), 500, "scoring failed"))
    status, error = F, F
    for condition, code, text in ladder:
        status, error = status.when(condition, code), error.when(condition, text)
    return status.otherwise(200), error


def parse_body(body: Column) -> Column:
    """The message of a JSON request body: an object with a string ``message``; null for anything else."""
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT<") & (F.schema_of_variant(F.try_variant_get(parsed, "$.message", "variant")) == "STRING"), F.try_variant_get(parsed, "$.message", "string"))


def vote_map(names: dict[str, str]) -> Column:
    """Model -> prediction, of the named columns."""
    return F.create_map(*[x for name, column in names.items() for x in (F.lit(name), F.col(column))])
