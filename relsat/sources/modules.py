"""Program files: loading declarations of other files, and scanning folders for modules."""

from __future__ import annotations

from pathlib import Path

from relsat.engine import Engine
from relsat.errors import ModuleError
from relsat.sources import parser as p

SUFFIX = ".rsat"


class Modules:
    """``suffix`` is that of program files; a bare name is looked up in the scanned folder first,
    then beside the loading file; a name with ``.`` or ``/`` is a path."""

    def __init__(self, engine: Engine, suffix: str = SUFFIX) -> None:
        self.engine, self.suffix = engine, suffix
        self.known: dict[str, Path] = {}
        self.loaded: set[Path] = set()

    def scan(self, folder: Path) -> None:
        for f in sorted(folder.rglob(f"*{self.suffix}")):
            if f.stem in self.known:
                raise ModuleError(f"two modules {f.stem}: {self.known[f.stem]} and {f}")
            self.known[f.stem] = f

    def resolve(self, name: str, beside: Path) -> Path:
        if "." in name or "/" in name:
            path = beside / name
        else:
            path = self.known.get(name, beside / f"{name}{self.suffix}")
        if not path.is_file():
            raise ModuleError(f"no module {name}: {path}")
        return path.resolve()

    def _declarations(self, path: Path) -> list[object]:
        """The declarations of a module and of what it loads, each file once; cycles end there."""
        if path in self.loaded:
            return []
        self.loaded.add(path)
        out: list[object] = []
        for c in p.parse(path.read_text()):
            if isinstance(c, p.Load):
                out += self._declarations(self.resolve(c.name, path.parent))
            elif isinstance(c, (p.Data, p.Relation, p.Function, p.Rule, p.Cost)):
                out.append(c)
            else:
                raise ModuleError(f"{path}: {type(c).__name__.lower()} in a loaded module")
        return out

    def run(self, path: Path) -> None:
        self.run_text(path.read_text(), path.parent)

    def run_text(self, text: str, folder: Path) -> None:
        commands: list[object] = []
        rest: list[object] = []
        for c in p.parse(text):
            if isinstance(c, p.Load):
                commands += self._declarations(self.resolve(c.name, folder))
            else:
                rest.append(c)
        # modules may load each other: their tables come before their rules
        commands.sort(key=lambda c: isinstance(c, (p.Rule, p.Cost)))
        self.engine.execute(commands + rest)
