"""An interactive shell: python -m marlstone.repl [ROOT]."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import islice

from .errors import EngineError
from .session import Result, Session, _text, connect

PAGE = 1000
HELP = "Statements end with ;   .tables  list tables   .clear  drop what was typed   .help   .exit, .quit"


def bordered(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A table with borders; NULL is shown as such."""
    cells = [["NULL" if v is None else _text(v) for v in row] for row in rows]
    widths = [max(map(len, [c, *(r[i] for r in cells)])) for i, c in enumerate(columns)]
    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths)
    line = lambda row: "|" + "".join(f" {v:<{w}} |" for v, w in zip(row, widths, strict=True))
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule])


def pages(result: Result) -> Iterator[str]:
    """What the shell shows for a result, PAGE rows at a time."""
    if not result.columns:
        yield f"Query OK ({result.elapsed:.3f} sec)"
        return
    rows, n = iter(result), 0
    while page := list(islice(rows, PAGE)):
        n += len(page)
        yield bordered(result.columns, page)
    yield f"{n} row{'s' * (n != 1)} in set ({result.elapsed:.3f} sec)" if n else f"Empty set ({result.elapsed:.3f} sec)"


def run(session: Session, lines, write=print) -> None:
    """Reads statements over several lines until `;`."""
    typed = ""
    for line in lines:
        word = line.strip()
        if word in (".exit", ".quit"):
            return
        if word == ".help":
            write(HELP)
        elif word == ".clear":
            typed = ""
        elif word == ".tables":
            write("\n".join(pages(session.execute("SHOW TABLES"))))
        else:
            typed += line + "\n"
            if word.endswith(";"):
                try:
                    for page in pages(session.execute(typed)):
                        write(page)
                except EngineError as e:
                    write(f"ERROR: {e}")
                typed = ""


if __name__ == "__main__":
    run(connect(sys.argv[1] if len(sys.argv) > 1 else None), sys.stdin)
