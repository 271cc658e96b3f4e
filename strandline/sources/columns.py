"""Column lineage of one parsed PySpark source: each column that is used, followed up through its frames.

It runs where the source is parsed, file by file, so that no graph has to be walked for it later.
"""

from __future__ import annotations

from collections import defaultdict

Row = tuple[str, dict]


def column_rows(rows: list[Row], frame_columns: dict[int, list[str]]) -> list[Row]:
    """column_edge, column_table and column_write rows out of a source's frames, derivations, reads and writes.

    column_edge: a frame's column comes from a parent frame's; column_table: from a table that the frame reads;
    column_write: a column that the frame writes to a table. A column that a frame does not derive comes from the
    parents that are known to have it, and from all of them where none is.
    """
    parents: dict[int, list[int]] = defaultdict(list)
    derived: dict[int, dict[str, list[str]]] = defaultdict(dict)
    reads: dict[int, list[str]] = defaultdict(list)
    writes: dict[int, list[str]] = defaultdict(list)
    for kind, x in rows:
        if kind == "edge":
            parents[x["dst"]].append(x["src"])
        elif kind == "derivation":
            derived[x["frame"]][x["column"]] = x["sources"]
        elif kind in ("read", "write") and x["target"]:
            (reads if kind == "read" else writes)[x["frame"]].append(x["target"])
    out: dict[tuple, Row] = {}
    seen: set[tuple[int, str]] = set()

    def put(kind: str, **x: object) -> None:
        out.setdefault((kind, *x.values()), (kind, x))

    def from_parents(frame: int, column: str, source: str) -> None:
        ups = parents[frame]
        having = [p for p in ups if source in frame_columns.get(p, ())] or ups
        for p in dict.fromkeys(having):
            put("column_edge", frame=frame, column=column, src_frame=p, src_column=source)
            todo.append((p, source))

    todo: list[tuple[int, str]] = []
    for frame, columns in derived.items():
        todo += [(frame, c) for c in columns]
    for frame, targets in writes.items():
        for column in frame_columns.get(frame, ()):
            for target in targets:
                put("column_write", frame=frame, column=column, table=target)
            todo.append((frame, column))
    while todo:
        frame, column = todo.pop()
        if (frame, column) in seen:
            continue
        seen.add((frame, column))
        if column in derived[frame]:
            for source in derived[frame][column]:
                from_parents(frame, column, source.split(".")[-1])
            if parents[frame]:
                continue
        for table in reads[frame]:
            put("column_table", frame=frame, column=column, table=table)
        if column not in derived[frame]:
            from_parents(frame, column, column)
    return list(out.values())
