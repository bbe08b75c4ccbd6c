"""User-defined relations: table to table functions, with Arrow kernels for what the built-ins can't express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeframe.plans.relations import Relation, UserDefined


def relation(function: Callable[..., DataFrame], *inputs: Relation, names: tuple = ()) -> UserDefined:
    return UserDefined(tuple(inputs), function, names)


def optional_transform(kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A filter or map over batches; None drops a batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = kernel(b)
            if out is not None and out.num_rows:
                yield out

    return lambda df: df.mapInArrow(run, schema)


def fold(start: Callable[[], object], accumulate: Callable, partial: Callable[[object], pa.RecordBatch], schema: str, finalize: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Accumulates a state for each partition and emits it once; ``finalize`` combines the partial rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        state = start()
        for b in batches:
            state = accumulate(state, b)
        yield partial(state)

    return lambda df: finalize(df.mapInArrow(run, schema))


def iterate(start: Callable[[pa.RecordBatch], object], advance: Callable[[object], tuple[pa.RecordBatch, object] | None], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A source that unfolds: ``start`` makes a state of each input batch (a split), and ``advance`` gives the next
    batch with the state after it, or None at the end. Splits unfold in parallel, and one batch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            state = start(b)
            while (step := advance(state)) is not None:
                out, state = step
                if out.num_rows:
                    yield out

    return lambda df: df.mapInArrow(run, schema)


def stateful_transform(start: Callable[[], object], advance: Callable[[object, pa.RecordBatch], tuple[pa.RecordBatch | None, object]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A stream to a stream with a state that goes from batch to batch of a partition; None emits nothing. The
    input's own partitioning and order decide what a partition's batches are."""

    def run(batches: Iterator[pa.RecordBatch]):
        state = start()
        for b in batches:
            out, state = advance(state, b)
            if out is not None and out.num_rows:
                yield out

    return lambda df: df.mapInArrow(run, schema)
