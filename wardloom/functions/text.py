"""Tokens, hashes and small scalar functions."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that carry no meaning for retrieval.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
WORD = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, stopwords: bool = True) -> Column:
    """Lower-case words of two or more characters, in order, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS)) if stopwords else found


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def redact(url: Column) -> Column:
    """Credentials of a connection string hidden: ``scheme://user:secret@host`` to ``scheme://***@host``."""
    return F.regexp_replace(url, r"(://)([^/]*)(@)", "$1***$3")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def interpolate(value, env=None):
    """``${NAME}`` in texts of nested configuration replaced from the environment; unknown names raise KeyError."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: env[m[1]], value) if isinstance(value, str) else value
