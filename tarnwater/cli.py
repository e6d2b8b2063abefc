"""python -m tarnwater.cli --table NAME=PATH ... query "SELECT ..." | shell | status | workers

Exit codes: 0 done, 1 the query is wrong or failed, 2 wrong use or no session.
"""

from __future__ import annotations

import argparse
import atexit
import json
import os
import shutil
import sys
from collections.abc import Iterable, Iterator

from tarnwater.engine import Engine, QueryError, QueryResult, Unavailable
from tarnwater.session import build

WIDTH, LEAST = 40, 6


def as_table(result: QueryResult, width: int = WIDTH, screen: int | None = None) -> str:
    """A table of cells of at most ``width`` characters, less where it would not fit the screen."""
    cell = lambda v: "NULL" if v is None else " ".join(str(v).splitlines())
    rows = [[cell(v) for v in r] for r in result.rows]
    sizes = [min(width, max(map(len, column))) for column in zip(result.columns, *rows, strict=True)]
    while screen and sum(sizes) + 3 * (len(sizes) - 1) > screen and max(sizes) > LEAST:
        sizes[sizes.index(max(sizes))] -= 1
    cut = lambda v, n: v if len(v) <= n else v[: max(n - 3, 0)] + "..."[:n]
    line = lambda r: " | ".join(cut(v, n).ljust(n) for v, n in zip(r, sizes, strict=True)).rstrip()
    head = [line(result.columns), "-+-".join("-" * s for s in sizes)]
    foot = f"({len(rows)} row{'s' * (len(rows) != 1)} in {result.stats.get('durationMs', 0):.0f} ms)"
    return "\n".join([*head, *map(line, rows), foot])


def show(engine: Engine, sql: str, kind: str, verbose: bool = False, validate: bool = True) -> int:
    try:
        if validate:
            engine.validate(sql)
        result = engine.query(sql)
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, Unavailable) else 1
    screen = shutil.get_terminal_size().columns if sys.stdout.isatty() else None
    print(json.dumps(result.to_dict(), default=str) if kind == "json" else as_table(result, screen=screen))
    if verbose:
        print(json.dumps(result.stats), file=sys.stderr)
    return 0


def _say(engine: Engine, word: str) -> None:
    if word == "\\tables":
        print(", ".join(sorted(engine.tables)) or "(no tables)")
    elif word == "\\status":
        print(json.dumps(engine.status()))
    elif word == "\\workers":
        print(json.dumps(engine.workers()))
    elif word == "\\help":
        print(shell.__doc__)
    else:
        print(f"unknown command {word}; \\help lists them", file=sys.stderr)


def shell(engine: Engine, kind: str, lines: Iterable[str], verbose: bool = False, validate: bool = True) -> int:
    """A statement ends with a semicolon, or with its line if that is a whole one; \\tables, \\status, \\workers, \\help and \\q are commands."""
    pending = ""
    for line in lines:
        word = line.strip()
        if not pending and (word.startswith("\\") or word.lower() in ("quit", "exit")):
            if word.lower() in ("\\q", "\\quit", "\\exit", "quit", "exit"):
                break
            _say(engine, word.split()[0].lower())
            continue
        whole = word.endswith(";") or bool(word) and not pending and engine.complete(word)
        pending = f"{pending}\n{line}" if pending else line if word else ""
        if whole:
            show(engine, pending, kind, verbose, validate)
            pending = ""
    return show(engine, pending, kind, verbose, validate) if pending.strip() else 0


def typed(history: str | None = None) -> Iterator[str]:
    """Lines from standard input; on a terminal with prompt and history (TARNWATER_HISTORY, or a file in the home folder)."""
    if not sys.stdin.isatty():
        yield from sys.stdin
        return
    import readline

    path = history or os.environ.get("TARNWATER_HISTORY") or os.path.expanduser("~/.tarnwater_history")
    if os.path.exists(path):
        readline.read_history_file(path)
    readline.set_history_length(1000)
    atexit.register(readline.write_history_file, path)
    while True:
        try:
            yield input("tarnwater> ") + "\n"
        except EOFError:
            return
        except KeyboardInterrupt:
            print()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnwater", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    parser.add_argument("--format", choices=("table", "json"), default="table" if sys.stdout.isatty() else "json")
    parser.add_argument("--master")
    parser.add_argument("-v", action="store_true", dest="verbose")
    parser.add_argument("--skip-validate", action="store_true", help="do not look for unknown tables and columns before a query is submitted")
    sub = parser.add_subparsers(dest="command")
    query = sub.add_parser("query")
    query.add_argument("sql", nargs="?")
    query.add_argument("-f", "--file")
    for name in ("shell", "status", "workers"):
        sub.add_parser(name)
    a = parser.parse_args(args)
    if a.command is None and not sys.stdin.isatty():
        parser.print_help()
        return 2
    if wrong := [t for t in a.table if "=" not in t]:
        print(f"error: --table {wrong[0]}: NAME=PATH expected", file=sys.stderr)
        return 2
    sql = None
    if a.command == "query":
        if a.file and not os.path.isfile(a.file):
            print(f"error: no file {a.file}", file=sys.stderr)
            return 2
        sql = a.sql or (open(a.file, encoding="utf-8").read() if a.file else "" if sys.stdin.isatty() else sys.stdin.read())
        if not sql.strip():
            print("error: no SQL given", file=sys.stderr)
            return 2
    engine = Engine(build(a.master))
    for t in a.table:
        engine.register(*t.split("=", 1))
    if a.command == "status":
        print(json.dumps(status := engine.status()))
        return int(status["status"] != "UP")
    if a.command == "workers":
        print(json.dumps(engine.workers()))
        return 0
    if a.command == "query":
        return show(engine, sql, a.format, a.verbose, not a.skip_validate)
    return shell(engine, a.format, typed(), a.verbose, not a.skip_validate)


if __name__ == "__main__":
    sys.exit(main())
