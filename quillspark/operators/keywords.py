"""Categories by any number of keywords: one pass over each text with an automaton of them all.

The rules' own few keywords are a chain of `contains` (categorize.keyword_category); its cost grows with their number, and this one's doesn't."""

from __future__ import annotations

import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .categorize import unique_accounts

#: Every task holds the automaton, some hundred bytes for each byte of keywords; longer lists are an error.
MOST_BYTES = 8 * 1024 * 1024

_automata: dict[str, ahocorasick.Automaton] = {}  # of this worker process: a list is turned into an automaton once and not in each batch


def deciding(words: list[str]) -> list[int]:
    """Places of the words that can decide, if the first that occurs does: one that holds an earlier word never comes first."""
    every = _built(words, range(len(words)))
    return [i for i, w in enumerate(words) if min(at for _, at in every.iter(w)) == i]


def _built(words: list[str], places) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i in places:
        out.add_word(words[i], i)
    out.make_automaton()
    return out


def _automaton(name: str, words: list[str]) -> ahocorasick.Automaton:
    if name not in _automata:
        _automata.clear()
        _automata[name] = _built(words, deciding(words))
    return _automata[name]


def listed(keywords: DataFrame, accounts: DataFrame) -> DataFrame:
    """keywords(prio, keyword, account) whose account exists, as (prio, keyword, category), lower-cased and each once: of equal keywords the least prio
    counts, then the least account id.  Null and empty keywords and null prios are left out."""
    named = unique_accounts(accounts).select(F.col("name").alias("account"), F.col("id").alias("category"))
    known = keywords.filter("prio is not null and keyword <> ''").join(named, "account").select("prio", F.lower("keyword").alias("keyword"), "category")
    return known.groupBy("keyword").agg(F.min(F.struct("prio", "category")).alias("k")).select("k.prio", "keyword", "k.category")


def with_keyword(df: DataFrame, haystack: Column, keywords: DataFrame, accounts: DataFrame, out: str = "found") -> DataFrame:
    """df with a struct column (keyword, category): of the keywords(prio, keyword, account) whose account exists and that occur in the
    haystack, whatever its case, the one with the least prio, then the least keyword; nulls if none occurs or the haystack is null.

    No shuffle of df.  The list goes to the tasks as one broadcast below MOST_BYTES; a longer one is a ValueError."""
    kept = listed(keywords, accounts)
    size = kept.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)).alias("n")).first()["n"]
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of keywords are more than {MOST_BYTES}")
    rows = sorted((r["prio"], r["keyword"], r["category"]) for r in kept.collect())  # bounded above
    shared = df.sparkSession.sparkContext.broadcast(([k for _, k, _ in rows], [c for _, _, c in rows]))
    name = uuid.uuid4().hex

    @F.pandas_udf("keyword string, category int")
    def found(texts: pd.Series) -> pd.DataFrame:
        words, categories = shared.value
        if not words:
            return pd.DataFrame({"keyword": pd.Series([None] * len(texts), dtype=object), "category": pd.Series([None] * len(texts), dtype="Int32")})
        automaton = _automaton(name, words)
        best = [None if t is None else min((at for _, at in automaton.iter(t)), default=None) for t in texts]
        return pd.DataFrame({"keyword": pd.Series([None if i is None else words[i] for i in best], dtype=object), "category": pd.Series([None if i is None else categories[i] for i in best], dtype="Int32")})

    return df.withColumn(out, found(F.lower(haystack)))
