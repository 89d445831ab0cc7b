"""Stems of the words of a corpus, worked out once for every word and stored.

Stemming needs Python, searching does not: the map is extended by the words of new texts, and a search
reads from it how the stems it looks for are spelt in the corpus. Texts stay in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import porter, words
from larder.sources.store import Conflict, Store

#: Words of another shape are their own stems and are not stored.
_SHAPE = r"^[a-z]{3,}\z"


@F.pandas_udf(T.StringType())
def _stem(found: pd.Series) -> pd.Series:
    return found.map(porter.stem)


class StemMap:
    """A stored table (word, stem), hashed by the stem, so that a search reads the buckets of its stems."""

    def __init__(self, store: Store, name: str = "stems", buckets: int = 64) -> None:
        self.store = store
        self.name = name
        self.buckets = buckets

    def learn(self, df: DataFrame, content: Column, retries: int = 3) -> StemMap:
        """Add the words of these texts that the map does not hold. Null and empty texts have none; texts
        that were learnt before change nothing, so a repeated batch does no harm."""
        shaped = F.filter(words.words(content), lambda w: w.rlike(_SHAPE))
        found = df.select(F.explode(F.array_distinct(shaped)).alias("word")).distinct()
        for attempt in range(retries + 1):
            base = self.store.version()
            known = self.store.read(self.name, base)
            new = found if known is None else found.join(known.select("word"), "word", "left_anti")
            rows = new.withColumn("stem", _stem("word"))
            table = self.store.table(base, self.name, rows, "word", self.buckets, ["stem"])
            grown = self.store.appended(self.name, table, rows)
            if known is not None and grown.folders == table.folders:
                return self
            try:
                self.store.commit(base, {self.name: grown})
                return self
            except Conflict:
                if attempt == retries:
                    raise
        raise AssertionError

    def spellings(self, stems: list[str], most: int = 2000) -> dict[str, list[str]] | None:
        """The words that have each stem; None if these are more than `most`, too many for a list in a plan."""
        version = self.store.version()
        if self.name not in version.tables:
            raise LookupError("no word has been learnt")
        wanted = self.store.spark.createDataFrame([(t,) for t in stems], "stem string")
        stored = self.store.matching(self.name, wanted, version)
        found = stored.filter(F.col("stem").isin(stems)).orderBy("word").limit(most + 1).collect()
        if len(found) > most:
            return None
        own = {t: [] if re.fullmatch("[a-z]{3,}", t) else [t] for t in stems}
        return {t: own[t] + [r["word"] for r in found if r["stem"] == t] for t in stems}
