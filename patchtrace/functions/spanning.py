"""Which mark ends which: function ends from the marks of a file (numpy on Arrow batches, inside tasks).

A file is a row of small numbers for its braces or lines and a few words for its headers; its text stays
in the JVM. Rows that have the same path are one file to the inventory, their marks taken in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from patchtrace.functions.vectors import list_offsets

SPAN = ("struct<start_pos:bigint,end_pos:bigint,start_line:bigint,end_line:bigint,"
        "name:string,signature:string,_from:int,_n:int>")


def _flat(col):
    """(lengths, values as int64) of a list column."""
    lens, flat = list_offsets(col)
    return lens, flat.astype(np.int64)


def _within(row, values):
    """Running sums of ``values`` that begin anew with each row (``row`` ascends)."""
    total = np.cumsum(values)
    first = np.searchsorted(row, row, side="left")
    return total - (total - values)[first] if len(row) else total


def _numbers(lens):
    """0, 1, ... within each of the stretches that have these lengths."""
    return np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)


#: Braces or lines that a step of the matching holds arrays for.
STEP_MARKS = 1 << 18


def _in_steps(step, marks, cols):
    """``step`` over slices of about STEP_MARKS entries of the list column ``marks`` (or one row), put together."""
    ends = np.cumsum(list_offsets(marks)[0])
    found, at = [], 0
    while at < len(marks):
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + STEP_MARKS, side="right")) - at)
        found.append(step(*[c.slice(at, n) for c in cols]))
        at += n
    return pa.concat_arrays(found) if found else step(*cols)


def _spans(n_rows, row, numbers, words, at):
    """The list column: a row's spans by start, end and lines; ``at`` has each one's place in ``words``."""
    start, end, first, last, begin, size = numbers
    order = np.lexsort((last, first, end, start, row))
    idx = pa.array(at[order])
    cols = [pa.array(x[order]) for x in (start, end, first, last)] + [w.take(idx) for w in words]
    cols += [pa.array(x[order].astype(np.int32)) for x in (begin, size)]
    names = ["start_pos", "end_pos", "start_line", "end_line", "name", "signature", "_from", "_n"]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cols, names=names))


def brace_spans():
    """Arrow UDF: a file's pieces and braces -> its functions, each up to the brace that closes it.

    ``pieces``: pieces of each of the file's rows; for each piece: ``count`` of its braces, ``name`` (null: no header),
    ``signature``, and of its header ``length``, ``breaks`` and ``inner`` braces; for each brace: ``n`` characters and
    ``nl`` line breaks since the one before, ``opens``."""
    def step(pieces, count, name, signature, length, breaks, inner, n, nl, opens):
        n_rows = len(pieces)
        _, per_copy = _flat(pieces)
        per_row, counts = _flat(count)
        names, signatures = name.flatten(), signature.flatten()
        size, lines, held = (_flat(x)[1] for x in (length, breaks, inner))
        piece = np.repeat(np.arange(len(counts)), counts)
        row = np.repeat(np.arange(n_rows), per_row)[piece]
        j = _numbers(counts)
        n, nl, opens = (_flat(x)[1] for x in (n, nl, opens))
        if len(per_copy) > n_rows:
            order = np.lexsort((j, _numbers(per_copy)[piece], row))
            piece, row, j, n, nl, opens = (x[order] for x in (piece, row, j, n, nl, opens))
        header = (j == counts[piece] - 1) & names.is_valid().to_numpy(zero_copy_only=False)[piece]
        e, cnl, depth = _within(row, n), _within(row, nl), _within(row, 2 * opens - 1)
        i = _within(row, np.ones_like(n)) - 1
        level = depth + (1 - opens)
        # the braces of a level in text order: an opening one is closed by the next
        by_level = np.lexsort((level, row))
        a, c = by_level[:-1], by_level[1:]
        kept = (row[a] == row[c]) & (level[a] == level[c]) & (opens[a] == 1) & (opens[c] == 0) & header[a]
        a, c = a[kept], c[kept]
        p = piece[a]
        # a header starts in the piece before its own inner braces, if it holds any
        numbers = (e[a] - size[p], e[c], cnl[a] - lines[p] + 1, cnl[c] + 1, i[a] - held[p], i[c] - i[a] + held[p] + 1)
        return _spans(n_rows, row[a], numbers, (names, signatures), p)

    def match(pieces: pa.Array, count: pa.Array, name: pa.Array, signature: pa.Array, length: pa.Array,
              breaks: pa.Array, inner: pa.Array, n: pa.Array, nl: pa.Array, opens: pa.Array) -> pa.Array:
        return _in_steps(step, n, (pieces, count, name, signature, length, breaks, inner, n, nl, opens))

    return F.arrow_udf(match, f"array<{SPAN}>").asNondeterministic()


def line_spans():
    """Arrow UDF: a file's lines -> its Python functions, each up to the next significant line that is indented
    at most as far; one inside an earlier one is left out.

    ``chars``, ``lines``: characters and lines of each of the file's rows; for each line: ``n`` characters, ``indent``,
    ``sig`` (significant); for each def: ``line`` number, ``name``, ``signature``, and ``defs``, their count in each row."""
    def step(chars, lines, n, indent, sig, defs, line, name, signature):
        n_rows = len(chars)
        copies, n_chars = _flat(chars)
        n_lines, n_defs = _flat(lines)[1], _flat(defs)[1]
        names, signatures = name.flatten(), signature.flatten()
        n, indent, sig = (_flat(x)[1] for x in (n, indent, sig))
        copy = np.repeat(np.arange(len(n_lines)), n_lines)
        row = np.repeat(np.arange(n_rows), copies)[copy]
        ln = _numbers(n_lines)
        which = np.full(len(ln), -1, dtype=np.int64)  # a line's def
        which[np.repeat(np.cumsum(n_lines) - n_lines, n_defs) + _flat(line)[1]] = np.arange(len(names))
        if len(n_lines) > n_rows:
            order = np.lexsort((ln, row))
            copy, row, ln, n, indent, sig, which = (x[order] for x in (copy, row, ln, n, indent, sig, which))
        off = _within(row, n + 1) - n - 1
        at = np.nonzero(which >= 0)[0]
        after = np.full(len(at), -1, dtype=np.int64)
        for bound in np.unique(indent[at]):
            mine = np.nonzero(indent[at] == bound)[0]
            bounds = np.nonzero((sig == 1) & (indent <= bound))[0]
            k = np.searchsorted(bounds, at[mine], side="right")
            to = np.append(bounds, -1)[k]
            after[mine] = np.where((k < len(bounds)) & (row[to] == row[at[mine]]), to, -1)
        end = np.where(after >= 0, ln[after], n_lines[copy[at]])
        stop = np.where(after >= 0, off[after] - 1, n_chars[copy[at]])
        # kept if no earlier def of the file reaches past it
        step = int(end.max(initial=0)) + 1
        reach = np.concatenate([[-1], np.maximum.accumulate(end + row[at] * step)[:-1]]) if len(at) else end
        kept = reach - row[at] * step <= ln[at]
        at, end, stop = at[kept], end[kept], stop[kept]
        numbers = (off[at], np.minimum(stop, n_chars[copy[at]]), ln[at] + 1, end, ln[at], end - ln[at])
        return _spans(n_rows, row[at], numbers, (names, signatures), which[at])

    def match(chars: pa.Array, lines: pa.Array, n: pa.Array, indent: pa.Array, sig: pa.Array,
              defs: pa.Array, line: pa.Array, name: pa.Array, signature: pa.Array) -> pa.Array:
        return _in_steps(step, n, (chars, lines, n, indent, sig, defs, line, name, signature))

    return F.arrow_udf(match, f"array<{SPAN}>").asNondeterministic()
