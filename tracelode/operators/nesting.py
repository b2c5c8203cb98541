"""Nested records to flat node tables with interval labels.

A depth-first walk numbers every node of a record when it enters it (pre) and gives it the
highest number below it (post).  A node lies inside another exactly when
``outer.pre < inner.pre <= outer.post``, so tables of different node types are linked without
keys of their own.  Only nodes of the asked types are emitted, but the numbers count all nodes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.frames import frames

NODE_SCHEMA = "row_id string, node_type string, pre int, post int, depth int, name string, place int, scalar string"


def _opened(value: object) -> object:
    """Text that holds an object or a list stands for it, however often it is wrapped."""
    for _ in range(8):
        if not isinstance(value, str):
            return value
        text = value.strip().lstrip("﻿").strip()
        if text[:1] not in '{["':
            return value
        try:
            inner = json.loads(text, strict=False)
        except ValueError:
            return value
        if text[:1] == '"' and not (isinstance(inner, str) and inner.strip().lstrip("﻿")[:1] in ('{', '[', '"')):
            return value
        value = inner
    return value


def label_nodes(text: str | None, types: list[tuple[str, re.Pattern]], lists: re.Pattern | None = None) -> Iterator[tuple]:
    """(type, pre, post, depth, name, place, scalar) of each node whose path fits a type.

    A path is /key/key/#: keys of objects, # for an element of a list.  lists names paths at
    which a lone object stands for a list of one.  A record that cannot be read has no nodes.
    The walk keeps its own stack, so depth is not bounded by the interpreter.
    """
    root = _opened(text) if text is not None else None
    if root is None or isinstance(root, str):
        return
    count = 0
    stack: list[list] = [["", "", 0, 0, root, None, None]]  # path, name, place, depth, value, children, label
    while stack:
        top = stack[-1]
        path, name, place, depth, value, children, label = top
        if children is None:
            value = _opened(value)
            if lists is not None and isinstance(value, dict) and lists.search(path):
                value = [value]
            count += 1
            top[6] = count
            if isinstance(value, dict):
                below = [(f"{path}/{k}", k, i) for i, k in enumerate(value, 1)]
                top[5] = iter([(p, k, i, v) for (p, k, i), v in zip(below, value.values())])
            elif isinstance(value, list):
                top[5] = iter([(f"{path}/#", "#", i, v) for i, v in enumerate(value, 1)])
            else:
                top[5] = iter(())
            top[4] = value
            children = top[5]
            label = count
        following = next(children, None)
        if following is not None:
            stack.append([following[0], following[1], following[2], depth + 1, following[3], None, None])
            continue
        stack.pop()
        if value is None:
            kind = "null"
        for node_type, pattern in types:
            if pattern.search(path):
                scalar = None if value is None or isinstance(value, (dict, list)) else value if isinstance(value, str) else json.dumps(value)
                if value is None and node_type.endswith("*"):
                    continue
                yield node_type.rstrip("*"), label, count, depth, name, place, scalar


def node_table(df: DataFrame, row_id: str, record: Column, types: dict[str, str], lists: str | None = None) -> DataFrame:
    """One row for each node of record whose path fits one of types (type -> pattern).

    record is JSON text or a struct (turned to JSON with its nulls, so that null elements keep
    their place).  A type whose name ends in * leaves out nodes that are null.  Null, empty and
    unreadable records have no rows; df may have any other columns.
    """
    given = [(name, re.compile(pattern)) for name, pattern in types.items()]
    lone = re.compile(lists) if lists else None

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row_id", "node_type", "pre", "post", "depth", "name", "place", "scalar"]
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch["row_id"], batch["record"]):
                for node in label_nodes(text, given, lone):
                    out.append((key, *node))
                if len(out) >= 20_000:
                    yield from frames(out, names)
                    out = []
            yield from frames(out, names)

    return df.select(F.col(row_id).cast("string").alias("row_id"), record.alias("record")).where(F.col("record").isNotNull()).mapInPandas(walk, NODE_SCHEMA)


def contained(nodes: DataFrame, keys: list[str], outer: str, name: str) -> DataFrame:
    """nodes with the column name: the innermost node of type outer that contains each, or null.

    Within a record the last outer node before a node contains it exactly when its post is not
    smaller; outer nodes must not lie in one another.  One sort per record; the rows of a
    record are bounded by the record itself.  Repeated rows of a node do no harm.
    """
    before = Window.partitionBy(*keys).orderBy("pre").rangeBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("node_type") == outer, F.struct("pre", "post", "name", "place"))
    return nodes.withColumn(name, F.last(own, ignorenulls=True).over(before)).withColumn(
        name, F.when(F.col(f"{name}.post") >= F.col("pre"), F.col(name))
    )
