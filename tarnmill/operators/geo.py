"""Places in texts: the vocabulary as a table, and all of its terms found in one pass over a text."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tarnmill.functions import pins
from tarnmill.functions.places import ASIA_PACIFIC, MIDDLE_EAST, RESTRICTED
from tarnmill.operators.law import US_POSTAL, US_STATES

#: Classes of the default vocabulary; a term can be in several.
CLASSES = {
    "us_state": US_STATES, "us_postal": tuple(US_POSTAL), "us_metro": pins.METROS, "asia_pacific": ASIA_PACIFIC, "middle_east": MIDDLE_EAST,
    "restricted": RESTRICTED, "marker": pins.MARKERS, "contract": pins.CONTRACTS,
}
#: Terms of a vocabulary, at most: they travel with the tasks. A larger one is joined by its terms' words instead.
MOST_TERMS = 100_000

_FOUND = ArrayType(StructType([StructField("term", StringType()), StructField("class", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_ARROW = pa.list_(pa.struct([("term", pa.string()), ("class", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_MACHINES: dict[tuple, ahocorasick.Automaton] = {}


def vocabulary(spark: SparkSession) -> DataFrame:
    """``geo_vocab(term, class)``: the default terms, each once in a class."""
    return spark.createDataFrame([(term, name) for name, terms in CLASSES.items() for term in dict.fromkeys(terms)], "term string, class string")


def _machine(terms: tuple[tuple[str, tuple[str, ...]], ...]) -> ahocorasick.Automaton:
    if terms not in _MACHINES:
        _MACHINES.clear()
        machine = ahocorasick.Automaton()
        for term, classes in terms:
            machine.add_word(term, (term, classes))
        machine.make_automaton()
        _MACHINES[terms] = machine
    return _MACHINES[terms]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def find(machine: ahocorasick.Automaton, text: str) -> list[tuple[str, str, int, int]]:
    """All terms that stand as whole words in a lower-case text, by their ends; a term within another one too."""
    out = []
    for last, (term, classes) in machine.iter(text):
        start, end = last + 1 - len(term), last + 1
        # Where a term begins or ends with a mark, the mark itself is its border.
        if start and _word(text[start - 1]) and _word(term[0]) or end < len(text) and _word(text[end]) and _word(term[-1]):
            continue
        out += [(term, c, start, end) for c in classes]
    return out


def with_places(rows: DataFrame, text: str, vocab: DataFrame | None = None, column: str = "places") -> DataFrame:
    """Adds ``column``, an array of ``struct<term, class, start, end>``: the vocabulary's terms in the lower-case text, by place.

    ``vocab(term, class)`` is the default one if not given; its terms are lower-cased, and null and empty
    ones are left out. Every text is read once, whatever the number of terms. A null text has none. The
    automaton is built in each worker from the terms, which are collected: more than ``MOST_TERMS`` end
    with an error.
    """
    vocab = vocabulary(rows.sparkSession) if vocab is None else vocab
    listed = vocab.select(F.lower("term").alias("term"), "class").where(F.col("term") != "").groupBy("term").agg(F.sort_array(F.collect_set("class")).alias("classes")).orderBy("term").limit(MOST_TERMS + 1).collect()
    if len(listed) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS} terms")
    terms = tuple((r.term, tuple(r.classes)) for r in listed)

    def search(batches):
        machine = _machine(terms) if terms else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [[dict(zip(("term", "class", "start", "end"), x)) for x in find(machine, t)] if t and machine else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW)], names=[*batch.schema.names[:-1], column])

    schema = StructType([*rows.schema.fields, StructField(column, _FOUND)])
    return rows.withColumn(column, F.lower(F.col(text))).mapInArrow(search, schema)


def names_one(places: Column, *classes: str) -> Column:
    """Whether a term of one of the classes is among the places."""
    return F.exists(places, lambda p: p["class"].isin(*classes))
