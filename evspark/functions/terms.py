"""Which terms of a question's list occur in a text, by one automaton for all of them.

For a few terms, looking each one up in the text (``instr``) is fastest. With thousands, a text would be read thousands of
times. Here the lists meet the rows of their key in the same partitions, each list makes one Aho-Corasick automaton, and every
text is read once. Keys may have most of the rows: rows are dealt over ``salts`` shares of their key, each with its own copy
of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


class TermAutomaton:
    """The terms of one list; equal terms keep all their places, an empty term occurs in every text."""

    def __init__(self, terms: list[str | None]):
        import ahocorasick

        places: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            if t is not None:
                places.setdefault(t, []).append(i)
        self.always = places.pop("", [])
        self.automaton = ahocorasick.Automaton() if places else None
        for t, own in places.items():
            self.automaton.add_word(t, own)
        if places:
            self.automaton.make_automaton()

    def places(self, text: str) -> list[int]:
        """Places, from 0, of the terms that occur in the text."""
        found = set(self.always)
        if self.automaton is not None:
            for _, own in self.automaton.iter(text):
                found.update(own)
        return sorted(found)


def term_places(rows: DataFrame, key: str, text: Column, terms: DataFrame, name: str, *, salts: int = 16) -> DataFrame:
    """rows with ``name``, the places (from 0) in the key's list of the terms that occur in ``text``, as an array.

    ``terms`` has key and terms (array of strings), one row for each key. Rows whose key is null or has no list, and null
    texts, have none; rows keep all their columns, a column of that name is replaced; two underscores are reserved.
    """
    kept = rows.drop(name)
    schema = StructType([StructField("__row", kept.schema), StructField(name, ArrayType(IntegerType()))])
    salt = F.pmod(F.xxhash64("__text"), F.lit(salts)).cast("int")
    mine = kept.select(F.col(key).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("__row"), text.alias("__text"))
    mine = mine.select("__key", salt.alias("__salt"), F.lit(None).cast("array<string>").alias("__terms"), "__text", "__row")
    lists = terms.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), F.col("terms").alias("__terms"))
    both = mine.unionByName(lists, allowMissingColumns=True)
    met = both.repartition("__key", "__salt").sortWithinPartitions("__key", "__salt", F.col("__row").isNotNull())

    def run(batches):
        import pyarrow as pa

        known, automaton = None, None
        for batch in batches:
            keys, lists, texts = (batch.column(i) for i in (0, 2, 3))
            is_row = batch.column(4).is_valid()
            out = []
            for k, row, terms_, text_ in zip(keys.to_pylist(), is_row.to_pylist(), lists, texts, strict=True):
                if not row:
                    known, automaton = k, TermAutomaton(terms_.as_py() or [])
                else:
                    found = automaton.places(text_.as_py()) if automaton is not None and k is not None and k == known and text_.is_valid else []
                    out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(4).filter(is_row), pa.array(out, pa.list_(pa.int32()))], ["__row", name])

    return met.mapInArrow(run, schema).select("__row.*", name)
