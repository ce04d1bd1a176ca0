"""Settings of the preparation pipeline, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, field

from paigham import lexicon


@dataclass(frozen=True)
class Settings:
    lowercase: bool = True
    urls: bool = True
    number_mode: str = "token"  # token, keep or remove
    phones: bool = True
    service_codes: bool = True
    short_codes: tuple[str, ...] = lexicon.SHORT_CODES
    punctuation: bool = True
    whitespace: bool = True
    spelling: bool = True
    spellings: dict[str, str] = field(default_factory=lambda: lexicon.SPELLINGS)
    drop_stopwords: bool = True
    stopwords: frozenset[str] = field(default_factory=lexicon.stopwords)
    min_token_length: int = 2
    conflicts: str = "drop"  # drop all copies of a text with two labels, or keep the first
    strict: bool = False  # also one row per cleaned text
    test_size: float = 0.2
    seed: int = 42
    ngrams: int = 2
    min_df: int = 1
    max_df: float = 1.0
    max_features: int | None = None
    sublinear_tf: bool = True
