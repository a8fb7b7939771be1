"""Python work over grouped rows as one plan: a block per item, and folds of the user's own.

Both run inside tasks on Arrow tables and see an item's rows in bounded pieces, so neither
the number of items nor the size of one limits them.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.shipping import ship

#: Rows that a block gets at a time at most.
PIECE_ROWS = 50_000
#: Rows of results that are sent on together, if not more.
OUT_ROWS = 5_000
#: Items whose states a task of a fold holds at most before it hands them on.
HELD_STATES = 10_000
#: Each item's partial states are merged in so many groups first.
FAN = 64


def _changes(table: pa.Table, keys: Sequence[str]) -> list[int]:
    """Where rows begin whose keys differ from the row before; nulls are equal."""
    n = table.num_rows
    if n < 2 or not keys:
        return [0] if n else []
    changed = None
    for k in keys:
        a, b = table[k].slice(0, n - 1).combine_chunks(), table[k].slice(1).combine_chunks()
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        changed = differ if changed is None else pc.or_(changed, differ)
    return [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist())]


def _pieces(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(item, some of its rows) in the rows' order."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        starts = _changes(table, keys)
        items = zip(*(table[k].take(pa.array(starts, pa.int64())).to_pylist() for k in keys)) if keys else [()] * len(starts)
        for item, a, b in zip(items, starts, [*starts[1:], table.num_rows]):
            yield item, table.slice(a, b - a)


def _batches(results: Iterable[Any], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What blocks give (tables, pandas frames, rows as dicts, or several), as declared, in
    batches of OUT_ROWS and more, however little one block gives."""
    rows: list[dict[str, Any]] = []
    tables: list[pa.Table] = []

    def whole() -> Iterator[pa.RecordBatch]:
        if rows:
            tables.append(pa.Table.from_pylist(rows, schema))
        if tables:
            yield from pa.concat_tables(tables).combine_chunks().to_batches(max_chunksize=10 * OUT_ROWS)
        rows.clear()
        tables.clear()

    for made in _flat(results):
        if isinstance(made, dict):
            rows.append(made)
        else:
            table = pa.Table.from_pandas(made, schema, preserve_index=False) if hasattr(made, "iloc") else pa.Table.from_batches([made]) if isinstance(made, pa.RecordBatch) else made
            if rows:  # in the order they came
                tables.append(pa.Table.from_pylist(rows, schema))
                rows.clear()
            tables.append(table.select(schema.names).cast(schema))
        if len(rows) + sum(t.num_rows for t in tables) >= OUT_ROWS:
            yield from whole()
    yield from whole()


def _flat(made: Any) -> Iterator[Any]:
    """Tables, frames and rows, of lists and iterators of such; None is none."""
    if made is None:
        return
    if isinstance(made, (dict, pa.Table, pa.RecordBatch)) or hasattr(made, "iloc"):
        yield made
        return
    for part in made:
        yield from _flat(part)


@dataclass(frozen=True)
class TableBlock:
    """``for_each`` over the items of a table, or over the files of a pattern, as one plan: see
    ``each_item``. Without ``by`` the items are the pattern's wildcards."""

    by: tuple[str, ...]
    block: Callable[[dict[str, Any], Any], Any]
    schema: str
    whole: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        return each_item(df, self.by, self.block, self.schema, self.whole)


def each_item(df: DataFrame, by: str | Sequence[str], block: Callable[[dict[str, Any], Any], Any], schema: str, whole: bool = False) -> DataFrame:
    """``block(item, rows)`` for each distinct value of ``by``: one scan and one shuffle,
    however many items there are.

    rows is an Arrow table of up to PIECE_ROWS of the item's rows; an item with more is given
    in pieces, over several tasks if adaptive execution finds its partition large, so that
    the results must not depend on the cut (row-wise work, or partial results that are
    summed after). With ``whole`` an item's rows all come to one call, as an iterator of such
    tables. A block gives an Arrow table, a pandas frame, a list of dicts, None, or an
    iterator of these, with the columns of ``schema`` (DDL). Null is an item like any other.
    """
    ship(df.sparkSession)
    keys = [by] if isinstance(by, str) else list(by)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    dealt = df.repartition(*keys) if whole else df.hint("rebalance", *keys)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
        for item, pieces in itertools.groupby(_pieces(batches, keys), key=lambda p: p[0]):
            named, tables = dict(zip(keys, item)), (t for _, t in pieces)
            if whole:
                yield block(named, tables)
                continue
            held: list[pa.Table] = []
            for t in tables:
                while t.num_rows:
                    room = PIECE_ROWS - sum(h.num_rows for h in held)
                    held.append(t.slice(0, room))
                    t = t.slice(room)
                    if sum(h.num_rows for h in held) == PIECE_ROWS:
                        yield block(named, pa.concat_tables(held))
                        held = []
            if held:
                yield block(named, pa.concat_tables(held))

    return dealt.sortWithinPartitions(*keys).mapInArrow(lambda batches: _batches(results(batches), arrow), schema)


@dataclass(frozen=True)
class Fold:
    """A fold of the user's own over all rows, or over each item's; see ``fold``.

    Called with a list of tables (as ``Reduce`` does) it folds their union.
    """

    add: Callable[[Any, pa.Table], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[dict[str, Any], Any], Any]
    schema: str
    by: tuple[str, ...] = ()

    def __call__(self, tables: Sequence[DataFrame]) -> DataFrame:
        return fold(reduce(DataFrame.unionByName, tables), self.add, self.merge, self.finish, self.schema, self.by)


def fold(df: DataFrame, add: Callable[[Any, pa.Table], Any], merge: Callable[[Any, Any], Any], finish: Callable[[dict[str, Any], Any], Any], schema: str, by: str | Sequence[str] = ()) -> DataFrame:
    """A distributed aggregate: ``add(state or None, rows)`` within tasks, ``merge(a, b)`` of
    states as a tree, ``finish(item, state)`` once per item (as a block of ``each_item``).

    Rows aren't shuffled, only states: one per item and task (more if a task sees over
    HELD_STATES items). An item's states meet in FAN groups first, then as one, so a hot item
    costs no task more than its share. merge must be associative and commutative, and a state
    small (it is pickled). Without rows and without ``by`` there is no result.
    """
    ship(df.sparkSession)
    keys = [by] if isinstance(by, str) else list(by)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    fields = [df.schema[k] for k in keys]
    states = T.StructType([*fields, T.StructField("__group", T.IntegerType()), T.StructField("__state", T.BinaryType())])
    states_arrow = to_arrow_schema(states)

    def rows(held: Mapping[tuple, Any], group: int) -> Iterator[pa.RecordBatch]:
        columns = [[k[i] for k in held] for i in range(len(keys))]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, states_arrow)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([group] * len(held), pa.int32()), pa.array([pickle.dumps(s, pickle.HIGHEST_PROTOCOL) for s in held.values()], pa.binary())], schema=states_arrow)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = TaskContext.get().partitionId() % FAN, {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if keys and table.num_rows:
                table = table.sort_by([(k, "ascending") for k in keys])
            for item, piece in _pieces(table.combine_chunks().to_batches(), keys):
                held[item] = add(held.get(item), piece)
            if len(held) > HELD_STATES:
                yield from rows(held, group)
                held = {}
        if held:
            yield from rows(held, group)

    def merged(batches: Iterator[pa.RecordBatch], on: Sequence[str]) -> Iterator[tuple[tuple, Any]]:
        for item, pieces in itertools.groupby(_pieces(batches, on), key=lambda p: p[0]):
            raw = (s for _, t in pieces for s in t["__state"].to_pylist())
            yield item, reduce(merge, map(pickle.loads, raw))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = {}, None
        for item, state in merged(batches, [*keys, "__group"]):
            if held and (group != item[-1] or len(held) >= OUT_ROWS):
                yield from rows(held, group)
                held = {}
            held[item[:-1]], group = state, item[-1]
        if held:
            yield from rows(held, group)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((finish(dict(zip(keys, item)), state) for item, state in merged(batches, keys)), arrow)

    grouped = ["__group", *keys]
    parts = df.mapInArrow(partial, states).repartition(*grouped).sortWithinPartitions(*grouped).mapInArrow(first, states)
    together = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1, F.lit(0))
    return together.mapInArrow(last, schema)
