"""Rows that fail to parse, with the reason, beside the rows that load (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.nquads import BULK, Statement, diagnose

#: Lines of the largest block that is bisected.
BLOCK = 4096
TERMS = ["s", "p", "o", "g"]
Parsed = tuple[str | None, Statement | None]


def bulk_terms(lines: pa.Array) -> tuple[np.ndarray, pa.Table]:
    """(failed, terms) of a column of lines, matched by one compiled pattern over the whole column; terms of the good lines only."""
    found = pc.extract_regex(lines, BULK)
    good = found.is_valid()
    terms = pa.Table.from_arrays(found.filter(good).flatten(), TERMS)
    graph = terms["g"]
    return ~good.to_numpy(zero_copy_only=False), terms.set_column(3, "g", pc.if_else(pc.equal(graph, ""), pa.scalar(None, pa.string()), graph))


def isolated(failed: np.ndarray) -> list[int]:
    """Places of the bad lines: blocks that hold any are halved until the lines stand alone. One sum tells of any block
    whether it failed, so no line is matched again."""
    before = np.concatenate([[0], np.cumsum(failed)])
    todo = [(k, min(len(failed), k + BLOCK)) for k in range(0, len(failed), BLOCK)][::-1]
    out: list[int] = []
    while todo:
        a, z = todo.pop()
        if before[a] == before[z]:
            continue
        if z - a == 1:
            out.append(a)
        else:
            todo += [((a + z) // 2, z), (a, (a + z) // 2)]
    return out


def parse_block(lines: list[str]) -> list[Parsed]:
    """(reason, statement) of each line: the good ones by the bulk pattern, the others diagnosed strictly."""
    failed, terms = bulk_terms(pa.array(lines, pa.string()))
    good = zip(*(terms[t].to_pylist() for t in TERMS))
    return [diagnose(line) if bad else (None, next(good)) for line, bad in zip(lines, failed)]


def parse_lines(df: DataFrame, key: str = "line_no", line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """key, reason, s, p, o, g (and the columns of ``keep``) of each line that is neither null, blank nor a comment.

    reason is null for a valid statement, whose terms are given as written (g null in a
    triple); else quoting, terms or value, with null terms. One pass, no shuffle. Batches stay columns but for
    the lines that the bulk pattern refuses.
    """
    keep = [c for c in keep or [] if c not in (key, line)]
    kinds = ", ".join(f"`__{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate([key, *keep]))
    names = [f"__{i}" for i in range(1 + len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0)
            full = pc.and_(pc.not_equal(pc.utf8_trim_whitespace(lines), ""), pc.invert(pc.starts_with(lines, "#")))
            batch = batch.filter(full)  # null lines too are left out
            lines = batch.column(0)
            failed, terms = bulk_terms(lines)
            good = batch.filter(pa.array(~failed))
            yield from pa.Table.from_arrays([*good.columns[1:], pa.nulls(good.num_rows, pa.string()), *terms.columns], [*names, "reason", *TERMS]).combine_chunks().to_batches()
            if places := isolated(failed):
                bad = batch.take(pa.array(places))
                judged = [diagnose(x) for x in bad.column(0).to_pylist()]
                cells = list(zip(*(x or (None, None, None, None) for _, x in judged)))
                yield pa.RecordBatch.from_arrays([*bad.columns[1:], pa.array([r for r, _ in judged], pa.string()), *(pa.array(c, pa.string()) for c in cells)], [*names, "reason", *TERMS])

    return df.select(line, key, *keep).mapInArrow(run, f"{kinds}, reason string, s string, p string, o string, g string").withColumnsRenamed(dict(zip(names, [key, *keep])))


def rejected(df: DataFrame) -> DataFrame:
    """line_no and reason of the broken lines."""
    return parse_lines(df).where("reason is not null").select("line_no", "reason")


def loaded(df: DataFrame) -> DataFrame:
    """line_no and terms of the valid statements."""
    return parse_lines(df).where("reason is null").drop("reason")
