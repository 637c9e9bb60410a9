"""Folds over the rows of a stream in order.

``fold_in_order`` is for rules whose steps do not compose: a stream's rows meet in one partition, sorted, and the fold
goes through them batch by batch with the state of one stream, so that nothing of a stream is collected.

``fold_in_segments`` is for rules whose steps do: what a run of rows does to a state fits a short list of numbers. A
stream is cut into segments that are summarised side by side; one short row per segment is folded in order, which
gives the state before each; and the segments are filled in side by side. A stream of any length is split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import idiv

Step = Callable[[Any, tuple], tuple[Any, tuple]]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _types(made: str) -> dict[str, pa.DataType]:
    return {part.split()[0]: _ARROW[part.split()[1]] for part in made.split(",")}


def fold_in_order(rows: DataFrame, by: str, order: str, start: Any, step: Step, made: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``by, order``, the columns ``carry`` and those of ``made`` (``name type, ...``).

    ``rows`` has ``by``, ``order``, and behind them the values that ``step`` reads: from the state and a
    row's values it makes the next state and the row's new columns. ``start`` is a stream's first state.
    """
    names = [part.split()[0] for part in made.split(",")]
    values = [c for c in rows.columns if c not in (by, order)]
    kept = [f"`{c}` {t}" for c, t in rows.dtypes if c in (by, order, *carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, first = None, start, True
        for b in batches:
            out = []
            for key, *row in zip(b.column(by).to_pylist(), *(b.column(c).to_pylist() for c in values), strict=True):
                if first or key != stream:
                    stream, state, first = key, start, False
                state, new = step(state, tuple(row))
                out.append(new)
            same = [c for c in b.schema.names if c in (by, order, *carry)]
            cols = [b.column(c) for c in same] + [pa.array([r[k] for r in out], types[n]) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=[*same, *names])

    types = _types(made)
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, ", ".join([*kept, made]))


#: Rows of a segment, where ``order`` counts rows.
SEGMENT = 1 << 16
Columns = dict[str, np.ndarray]


@dataclass(frozen=True)
class Composable:
    """A fold whose steps compose. States and effects are lists of ``number`` (long or double)."""

    #: a stream's first state
    start: list
    #: the effect of a segment's rows, in order
    effect: Callable[[Columns], list]
    #: the state behind a segment, from the one before it and its effect
    advance: Callable[[list, list], list]
    #: the new columns of a segment's rows, from the state before it
    fill: Callable[[list, Columns], list]
    number: str = "long"


def fold_in_segments(rows: DataFrame, by: str, order: str, fold: Composable, made: str, carry: tuple[str, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """As ``fold_in_order`` does, by a fold whose steps compose; ``rows`` has no nulls in the values it reads."""
    values = [c for c in rows.columns if c not in (by, order)]
    kinds, same = dict(rows.dtypes), [c for c in rows.columns if c in (by, order, *carry)]
    cut = rows.withColumn("__seg", idiv(F.col(order), segment).cast("long"))
    types = _types(made)

    def sorted_columns(group: pa.Table) -> tuple[pa.Table, Columns]:
        group = group.take(np.argsort(group[order].to_numpy(), kind="stable"))
        return group, {c: group[c].to_numpy() for c in values}

    def summarise(group: pa.Table) -> pa.Table:
        _, columns = sorted_columns(group)
        return pa.table({by: group[by][:1], "__seg": group["__seg"][:1], "effect": pa.array([fold.effect(columns)], _ARROW[f"array<{fold.number}>"])})

    def fill(group: pa.Table, states: pa.Table) -> pa.Table:
        group, columns = sorted_columns(group)
        new = fold.fill(states["state"][0].as_py(), columns)
        return pa.table({**{c: group[c] for c in same}, **{n: pa.array(x, t) for (n, t), x in zip(types.items(), new, strict=True)}})

    key = [by, "__seg"]
    effects = cut.groupBy(*key).applyInArrow(summarise, f"`{by}` {kinds[by]}, __seg long, effect array<{fold.number}>")
    states = fold_in_order(effects, by, "__seg", fold.start, lambda state, row: (fold.advance(state, row[0]), (state,)), f"state array<{fold.number}>")
    return cut.groupBy(*key).cogroup(states.groupBy(*key)).applyInArrow(fill, ", ".join([*(f"`{c}` {kinds[c]}" for c in same), made]))
