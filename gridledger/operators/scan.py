"""Ordered machines over files of any size, as prefix scans over blocks of rows.

A file's rows are cut into blocks. One pass reads each block by itself and tells how it changes the state of the
machine, whatever state it begins in; a second goes over these short tellings, a row a block, and gives every block
its true state; a third runs the machine over each block from there. So a file is never one task's work: its rows
are shuffled by (file, block), and only the tellings of its blocks meet by file. Files of no more rows than a block has
need none of this: `sheet_scan` takes each through both machines at once."""

from __future__ import annotations

import pickle
from itertools import accumulate, chain, groupby, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from gridledger.sources.kept import kept

#: Row numbers of a block.
BLOCK = 4096
#: Kinds of rows: a data row, a lone cell that may continue it, a lone cell that is a title, a row above the header.
DATA, SOFT, HARD, ABOVE = 0, 1, 2, 3


class Titles:
    """Which lone cells are titles. Rows: (row_no, kind, value, opening); out come (file, row_no, section, is_title).

    A soft cell continues the last data row if that row's section has the name of the current one, else it is a
    title. The state is (name of the section, name of the last data row's section or None); None before all rows.

    What a block does to a state it does not know: before its first data row, section names follow each other as its
    lone cells say (`head`). From that row on the last row's section is the current one, X, and after names
    h, b, ..., c it is X where X is one of them but the last, else c: so sections that are named keep apart
    (`apart`: X to what it has become), while all others have become one (`rest`, or None: each still itself)."""

    @staticmethod
    def name_after(section, last, names, hard):
        """The section after lone cells of these names; `hard`: the first is a title whatever stands before."""
        for k, name in enumerate(names):
            if (k or not hard) and last == section:
                break  # it continues the last row, and so do the others
            section = name
        return section

    @classmethod
    def tell(cls, rows):
        opening, hard, head, seen, apart, rest, tail = None, False, [], False, {}, None, None
        for _, kind, value, opening in rows:
            if kind == DATA and not seen:
                seen = True
            elif kind == DATA and tail is not None:
                named, last = set(tail[:-1]), tail[-1]
                if rest is None:
                    apart, rest = {x: x for x in named if x != last}, last
                else:
                    rest = rest if rest in named else last
                    apart = {x: to for x, at in apart.items() if (to := at if at in named else last) != rest}
                tail = None
            elif kind == HARD and seen:
                tail = [value]
            elif kind == HARD:
                hard, head = True, [value]
            elif kind == SOFT and not seen:
                head.append(value)
            elif kind == SOFT and tail is not None:
                tail.append(value)
        return opening, hard, head, seen, apart, rest, tail

    @classmethod
    def after(cls, state, telling):
        opening, hard, head, seen, apart, rest, tail = telling
        section, last = state or (opening, None)
        section = cls.name_after(section, last, head, hard)
        if seen:
            section = last = apart.get(section, section if rest is None else rest)
            section = cls.name_after(section, last, tail or [], True)
        return (section, last), None, seen

    @staticmethod
    def run(file, state, notes, rows):
        section, last = state or (None, None)
        for row_no, kind, value, opening in rows:
            if section is None:
                section = opening
            title = kind == HARD or (kind == SOFT and last != section)
            if title:
                section = value
            elif kind == DATA:
                last = section
            yield file, row_no, section, title


class Values:
    """Data rows with what they inherit and what continues them. Rows: (row_no, section, kind, texts, numbers); out
    come (file, row_no, section, texts, numbers).

    Leading blanks take what the row above has there, since the last title; a lone cell is appended to the last
    data row, and inherited with it if no title stands between. The state is (cells of the row above or None after a
    title); what continues a row of an earlier block goes to that block as a note."""

    @staticmethod
    def joined(cell, more):
        return more if cell is None else (f"{cell[0]}\n{more[0]}", None)

    @staticmethod
    def cells_of(texts, numbers):
        return [None if s is None else (s, n) for s, n in zip(texts, numbers)]

    @staticmethod
    def own_from(cells):
        """Where a row's own cells begin; before, it inherits."""
        if cells and cells[0] is not None:
            return 0
        return next((i for i, c in enumerate(cells) if c is not None), len(cells))

    @classmethod
    def tell(cls, rows):
        # lead: lone cells before the first data row; above: (whether the row above has a cell of its own there, it, what continues an inherited one)
        lead, titled, seen, above = [], False, False, None
        for _, _, kind, texts, numbers in rows:
            if kind == HARD:
                titled, above = titled or not seen, None
                continue
            cells = cls.cells_of(texts, numbers)
            own = cls.own_from(cells)
            if kind == SOFT and not seen:
                lead.append((own, cells[own], titled))
            elif kind == SOFT and above is not None:
                has, cell, more = above[own]
                if has:
                    above[own] = (True, cls.joined(cell, cells[own]), more)
                else:
                    more.append(cells[own])
            elif kind == DATA:
                # after a title within the block there is nothing to inherit
                above = [(above[i] if above is not None else (seen, None, [])) if i < own else (True, cells[i], []) for i in range(len(cells))]
                seen = True
        return lead, titled, seen, above

    @classmethod
    def after(cls, state, telling):
        lead, titled, seen, above = telling
        row = None if state is None else list(state)
        for at, cell, late in lead:
            if row is not None and not late:
                row[at] = cls.joined(row[at], cell)
        if titled:
            row = None
        if seen and above is None:
            row = None
        elif seen:
            before, row = row, []
            for i, (has, cell, more) in enumerate(above):
                cell = cell if has or before is None else before[i]
                for x in more:
                    cell = cls.joined(cell, x)
                row.append(cell)
        return row, [(at, cell) for at, cell, _ in lead] or None, seen

    @classmethod
    def run(cls, file, state, notes, rows):
        above, held = None if state is None else list(state), None
        for row_no, section, kind, texts, numbers in rows:
            if kind == HARD:
                above = None
                continue
            cells = cls.cells_of(texts, numbers)
            own = cls.own_from(cells)
            if kind == SOFT:
                for row in (above, held and held[1]):
                    if row is not None:
                        row[own] = cls.joined(row[own], cells[own])
                continue
            if held:
                yield cls.written(file, *held)
            cells[:own] = above[:own] if above is not None else [None] * own
            above, held = list(cells), ((row_no, section), cells)
        if held:
            for note in notes:
                for at, cell in note:
                    held[1][at] = cls.joined(held[1][at], cell)
            yield cls.written(file, *held)

    @staticmethod
    def written(file, place, cells):
        return file, *place, [c and c[0] for c in cells], [c and c[1] for c in cells]


class Cells(Values):
    """Values, with the cells of a row as one list of pairs."""

    @staticmethod
    def cells_of(texts, numbers):
        return list(texts)

    @staticmethod
    def written(file, place, cells):
        return file, *place, cells


def sheet_scan(rows: DataFrame, opening: str, schema: str) -> DataFrame:
    """The data rows of whole files, each of few rows: Titles, then Values, in one go.

    rows: file, row_no, kind, value, vals (null above the header); `opening`: the section where no row is above."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.select("file", "row_no", "kind", "value", "vals").repartition(n, "file").sortWithinPartitions("file", "row_no")
    return in_order.mapInArrow(_sheets(opening, _arrow(schema)), schema)


def sheet(file, rows: list, opening: str):
    """(file, row_no, section, cells) of a file's data rows; rows: (row_no, kind, value, cells)."""
    above = [value for _, kind, value, _ in rows if kind == ABOVE]
    rows, opening = [r for r in rows if r[1] != ABOVE], above[-1] if above else opening
    titles = Titles.run(file, None, [], ((row_no, kind, value, opening) for row_no, kind, value, _ in rows))
    told = ((row_no, section, HARD if title else kind, cells, None) for (row_no, kind, _, cells), (_, _, section, title) in zip(rows, titles))
    return Cells.run(file, None, [], told)


def _sheets(opening, schema):
    def in_order(batches):
        for batch in batches:
            file, row_no, kind, value, vals = batch.columns
            yield from zip(_objects(file), _objects(row_no), _objects(kind), _objects(value), _cells(vals))

    def out(batches):
        for file, rows in groupby(in_order(batches), lambda r: r[0]):
            yield from sheet(file, [r[1:] for r in rows], opening)

    def emitted(batches):
        import pyarrow as pa

        rows = out(batches)
        while held := list(islice(rows, 4096)):
            *plain, vals = zip(*held)
            arrays = [pa.array(c, type=f.type) for c, f in zip(plain, schema)]
            yield pa.RecordBatch.from_arrays([*arrays, _cell_array(vals, schema.field("vals").type)], schema=schema)

    return emitted


def _objects(column) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _cells(column) -> list:
    """Lists of (text, number) pairs, None for an empty cell; what is no number is nan, as no cell is."""
    import numpy as np

    texts, numbers = column.values.flatten()
    cells = list(zip(_objects(texts), _objects(numbers)))
    for i in np.flatnonzero(texts.is_null().to_numpy(zero_copy_only=False)).tolist():
        cells[i] = None
    ends = column.offsets.to_pylist()
    return [cells[i:j] for i, j in zip(ends, ends[1:])]


def _cell_array(rows, kind):
    import pyarrow as pa

    cells = list(chain.from_iterable(rows))
    texts = pa.array([c and c[0] for c in cells], type=pa.string())
    numbers = pa.array([c and c[1] for c in cells], type=pa.float64(), from_pandas=True)
    values = pa.StructArray.from_arrays([texts, numbers], fields=list(kind.value_type), mask=pa.array([c is None for c in cells], type=pa.bool_()))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], type=pa.int32()), values, type=kind)


def block_scan(rows: DataFrame, machine, schema: str, block: int = BLOCK) -> DataFrame:
    """Rows of each file through a machine, by row_no. `rows` has file, row_no and what else the machine reads, in its order.

    The machine tells a block's rows; `after(state, telling)` gives the state after the block, a note to the block
    of the last data row before it, and whether it has data rows; `run(file, state, notes, rows)` gives what comes out.
    The state before a file's first row is None. Files of one block have nothing to tell and are only run."""
    names, spark = rows.columns, rows.sparkSession
    kind = dict(rows.dtypes)["file"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col("row_no") / block).cast("long").alias("_block")
    blocks = rows.select("file", place, F.lit(None).cast("binary").alias("_note"), *[c for c in names if c != "file"])
    note = f"file {kind}, _block long, _note binary"
    spans = rows.groupBy("file").agg(F.min("row_no").alias("_low"), F.max("row_no").alias("_high"))
    # kept, so that a few long files are broadcast and their rows not dealt by file
    long = kept(spans.filter(F.floor(F.col("_low") / block) < F.floor(F.col("_high") / block)).select("file"))
    in_order = blocks.join(long, "file", "left_semi").repartition(n, "file", "_block").sortWithinPartitions("file", "_block", "row_no")
    tellings = in_order.mapInArrow(_telling(machine, _arrow(note)), note)
    states = tellings.repartition(n, "file").sortWithinPartitions("file", "_block").mapInArrow(_states(machine, _arrow(note)), note)
    # a block's state and notes come before its rows
    both = blocks.unionByName(states, allowMissingColumns=True)
    both = both.repartition(n, "file", "_block").sortWithinPartitions("file", "_block", F.col("_note").isNull(), "row_no")
    return both.mapInArrow(_running(machine, _arrow(schema)), schema)


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema))


def _rows(batches):
    """((file, block), note, the rest of a row) of each row."""
    for batch in batches:
        file, block, note, *rest = [c.to_pylist() for c in batch.columns]
        yield from zip(zip(file, block), note, zip(*rest))


def _emitted(schema, rows, most: int = 1024):
    import pyarrow as pa

    rows = iter(rows)
    while held := [r for _, r in zip(range(most), rows)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _telling(machine, schema):
    def told(batches):
        for (file, block), rows in groupby(_rows(batches), lambda x: x[0]):
            yield file, block, pickle.dumps(machine.tell(row for _, _, row in rows))

    return lambda batches: _emitted(schema, told(batches))


def _states(machine, schema):
    """Notes are pairs: the block that gives it, or -1 for the state, and what it says."""

    def notes(batches):
        every = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for file, blocks in groupby(every, lambda x: x[0]):
            state, last = None, None
            for _, block, telling in blocks:
                yield file, block, pickle.dumps((-1, state))
                state, note, seen = machine.after(state, pickle.loads(telling))
                if note is not None and last is not None:
                    yield file, last, pickle.dumps((block, note))
                last = block if seen else last

    return lambda batches: _emitted(schema, notes(batches))


def _running(machine, schema):
    def out(batches):
        for (file, _), block in groupby(_rows(batches), lambda x: x[0]):
            notes, first = [], None
            for _, note, row in block:
                if note is None:
                    first = row
                    break
                notes.append(pickle.loads(note))
            (_, state), *notes = sorted(notes, key=lambda x: x[0]) or [(-1, None)]
            yield from machine.run(file, state, [said for _, said in notes], chain([first], (row for _, _, row in block)))

    return lambda batches: _emitted(schema, out(batches))
