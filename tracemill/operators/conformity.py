"""Whether the containers of an answer are those of its template, by descent level by level."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.dealt import dealt
from ..sources.shared import written

# Keys of a template that stand for any key, besides those in angle brackets.
PLACEHOLDERS = ["str", "int", "float", "number", "bool", "null", "none", "any", "object", "key"]
#: Answers whose JSON one task takes apart.
ANSWERS_A_TASK = 20_000
_NODE = {"node": T.LongType(), "parent": T.LongType(), "step": T.StringType(), "path": T.StringType(), "kind": T.StringType(), "size": T.LongType()}


def _nodes(doc: str | None) -> Iterator[tuple]:
    """The values of a JSON text, parents first: number, parent's number, key (null in lists), path, kind, children."""
    try:
        todo = [(None, None, "$", json.loads(doc))] if doc is not None else []
    except ValueError:
        return
    n = 0
    while todo:
        parent, step, path, value = todo.pop()
        if isinstance(value, dict):
            kind, below = "object", [(n, k, f"{path}.{k}", v) for k, v in value.items()]
        elif isinstance(value, list):
            kind, below = "array", [(n, None, f"{path}[{i}]", v) for i, v in enumerate(value)]
        else:
            kind, below = "scalar", []
        yield n, parent, step, path, kind, len(below)
        todo += reversed(below)
        n += 1


def json_nodes(docs: DataFrame, key: str = "answer_id", doc: str = "doc") -> DataFrame:
    """key, node, parent, step, path, kind (object, array, scalar), size of every value of a JSON text, numbered in order of the text.

    The root has no parent, elements of lists have no step. A text that is not JSON, or null, has no rows.
    """
    own = docs.select(F.col(key).alias("key"), F.col(doc).alias("doc"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, t) for n, t in _NODE.items()]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = list(_nodes(text))
                at += [i] * len(found)
                rows += found
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=schema.names)

    return own.mapInArrow(of, schema)


def _placeholder(step: str) -> Column:
    key = F.trim(F.col(step))
    return (key.startswith("<") & key.endswith(">")) | F.lower(key).isin(PLACEHOLDERS)


def _merged(side: DataFrame) -> DataFrame:
    """A side of a join by merging: it grows with the answers, and packed files look small enough to be sent to all tasks."""
    return side.hint("merge")


def conformity(answers: DataFrame, key: str = "answer_id", template: str = "template", doc: str = "doc") -> DataFrame:
    """key, conforms, errors, first_error of every row of (key, template, doc).

    An object of the template asks for an object, and goes on with the keys that both
    have; one with a single placeholder key is a map, whose value all values of the
    answer are held against. A list asks for a list, whose elements are held against the
    template's first. A scalar of the template takes anything. Template and answer go
    down together, one join a level, until the template ends; a level holds each value of
    an answer once. A text that is not JSON does not conform, and has no error. Keys should be distinct.
    """
    answers = dealt(answers, each=ANSWERS_A_TASK)
    wide = written(json_nodes(answers, key, template), "template-nodes")
    above = wide.select(key, F.col("node").alias("parent"), F.col("kind").alias("above"), F.col("size").alias("siblings"))
    first = F.col("node") == F.col("parent") + 1  # the first child follows its parent
    edges = wide.join(_merged(above), [key, "parent"]).select(
        key, F.col("parent").alias("t"), F.col("node").alias("t_node"), F.col("kind").alias("t_kind"),
        F.when((F.col("above") == "object") & ~((F.col("siblings") == 1) & _placeholder("step")), F.col("step")).alias("step"), (F.col("above") == "array").alias("listed"), first.alias("first"))
    edges = written(edges.where("first or not listed").drop("listed", "first"), "template-edges")
    values = written(json_nodes(answers, key, doc), "answer-nodes")
    below = values.where("parent is not null").select(key, F.col("parent").alias("a"), F.col("node").alias("a_node"), F.col("kind").alias("a_kind"), "path", F.col("step").alias("a_step"))
    roots = wide.where("parent is null").select(key, F.col("node").alias("t_node"), F.col("kind").alias("t_kind")).join(
        _merged(values.where("parent is null").select(key, F.col("node").alias("a_node"), F.col("kind").alias("a_kind"), "path")), key)
    level, levels = written(roots, "level"), []
    while not level.isEmpty():
        levels.append(level)
        on = level.where("t_kind <> 'scalar' and t_kind = a_kind").select(key, F.col("t_node").alias("t"), F.col("a_node").alias("a"))
        steps = on.join(_merged(edges), [key, "t"])
        named = steps.where("step is not null").join(_merged(below.withColumnRenamed("a_step", "step")), [key, "a", "step"])
        every = steps.where("step is null").join(_merged(below), [key, "a"])
        level = written(named.select(*level.columns).unionByName(every.select(*level.columns)), "level")
    met = level
    for one in levels:
        met = met.unionByName(one)
    wrong = (F.col("t_kind") != "scalar") & (F.col("t_kind") != F.col("a_kind"))
    told = F.concat("path", F.lit(": expected "), F.when(F.col("t_kind") == "array", "list").otherwise(F.col("t_kind")))
    found = met.groupBy(key).agg(F.count_if(wrong).alias("errors"), F.min_by(told, F.when(wrong, F.col("a_node"))).alias("first_error"))
    return answers.select(key).join(_merged(found), key, "left").select(
        key, F.coalesce(F.col("errors") == 0, F.lit(False)).alias("conforms"), F.coalesce("errors", F.lit(0)).alias("errors"), "first_error")
