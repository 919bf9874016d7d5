"""Which of many strings a text contains, in one pass over the text."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# what runs in workers goes along by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Strings of an automaton; more of them are searched for in several passes.
MOST = 200_000


def automaton(held: dict):
    """The Aho-Corasick automaton of the strings, made once where a worker keeps the broadcast."""
    if "machine" not in held:
        import ahocorasick

        made = ahocorasick.Automaton()
        for k, head in enumerate(held["words"]):
            made.add_word(head, k)
        made.make_automaton()
        held["machine"] = made
    return held["machine"]


def finder(sought: Broadcast):
    """A function of a text: the strings that it contains."""

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        words = sought.value["words"]
        if not words:
            return texts.map(lambda t: [])
        machine = automaton(sought.value)
        return texts.map(lambda t: [words[k] for k in {k for _, k in machine.iter(t)}] if t else [])

    return find


def containing(df: DataFrame, text: str, heads: DataFrame, head: str, most: int = MOST) -> DataFrame:
    """(rows of ``df``, head) for every row whose ``text`` contains a distinct non-empty ``head``.

    The strings are sent to the tasks, ``most`` at a time, and every text is
    led through their automaton once for each lot; no text meets a string in a
    join.  Counting and fetching the strings are actions.
    """
    session = df.sparkSession
    distinct = heads.select(head).filter(F.col(head) != "").distinct()
    lots = max(1, -(-distinct.count() // most))
    lot = F.pmod(F.xxhash64(head), F.lit(lots))
    out = None
    for k in range(lots):
        strings = sorted(r[0] for r in distinct.filter(lot == k).collect())
        find = finder(session.sparkContext.broadcast({"words": strings}))
        found = df.withColumn(head, F.explode(find(F.col(text))))
        out = found if out is None else out.union(found)
    return out
