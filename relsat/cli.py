"""Command line: run a program, scan a folder, or read commands interactively.

    python -m relsat.cli                    interactive
    python -m relsat.cli program.rsat       run a file
    python -m relsat.cli folder --main m    scan a folder, run module m
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from relsat.engine import Engine
from relsat.errors import RelsatError
from relsat.sources import parser as p
from relsat.sources.modules import Modules


#: Where the lines of interactive sessions are kept.
HISTORY = Path.home() / ".relsat_history"


def warn(engine: Engine) -> None:
    for w in engine.warnings:
        print(f"warning: {w}", file=sys.stderr)
    engine.warnings.clear()


@contextmanager
def history(path: Path, most: int = 1000) -> Iterator[None]:
    """Lines that ``input`` reads can be called up again, those of earlier sessions too."""
    try:
        import readline
    except ImportError:  # some systems have none
        yield
        return
    readline.set_history_length(most)
    if path.is_file():
        readline.read_history_file(path)
    try:
        yield
    finally:
        readline.write_history_file(path)


def interact(modules: Modules, read: Callable[[str], str] = input, out: Callable[[str], object] = print, folder: Path = Path(".")) -> None:
    """Read commands until ``exit``, ``quit`` or the end; unfinished ones go on in the next line."""
    engine, held = modules.engine, ""
    engine.sink = out  # rows are printed as they arrive
    while True:
        try:
            line = read("... " if held else "> ")
        except (EOFError, KeyboardInterrupt):
            return
        if not held and line.strip() in ("exit", "quit"):
            return
        try:
            if not held and line.strip().startswith(":load"):
                modules.loaded.clear()  # always read again
                modules.run(folder / line.split(None, 1)[1].strip().strip('"'))
            else:
                held = f"{held}\n{line}" if held else line
                if not held.strip():
                    held = ""
                    continue
                if p.incomplete(held):
                    continue
                text, held = held, ""
                modules.run_text(text, folder)
            warn(engine)
        except (RelsatError, OSError, IndexError) as e:
            held = ""
            out(f"error: {e}")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="relsat")
    ap.add_argument("path", nargs="?")
    ap.add_argument("--main")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("relsat").getOrCreate()
    modules = Modules(Engine(spark))
    modules.engine.sink = print
    path = Path(a.path) if a.path else None
    try:
        if path is not None and path.is_dir():
            modules.scan(path)
            if a.main:
                if a.main not in modules.known:
                    raise RelsatError(f"no module {a.main}")
                modules.run(modules.known[a.main])
                warn(modules.engine)
            else:
                with history(HISTORY):
                    interact(modules, folder=path)
        elif path is not None:
            if a.main:
                raise RelsatError("--main needs a folder")
            modules.run(path)
            warn(modules.engine)
        else:
            with history(HISTORY):
                interact(modules)
    except (RelsatError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
