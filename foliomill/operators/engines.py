"""Extraction engines: what turns a file row into a candidate text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from foliomill.schemas import ENGINE_LABELS, MSG_EMPTY_RESULT, MSG_OCR_MISSING, MSG_OCR_UNSUPPORTED, OCR_ENGINE
from foliomill.session import BATCH_ROWS, small_batches

TEXT, OCR = "text", "ocr"
#: Child processes of a task of a guarded engine; seconds that a row is waited for, and looked at, before others go on beside it.
MOST_CELLS, PATIENCE, LOOK = 4, 0.25, 0.05


@dataclass(frozen=True)
class _Engine:
    name: str
    priority: int
    kind: str = TEXT

    def __post_init__(self) -> None:
        if self.kind not in (TEXT, OCR):
            raise ValueError(f"kind must be {TEXT!r} or {OCR!r}")

    @property
    def label(self) -> str:
        return ENGINE_LABELS.get(self.name, self.name)

    def runs(self) -> str:
        return "use_text" if self.kind == TEXT else "use_ocr"


@dataclass(frozen=True)
class ColumnEngine(_Engine):
    """An engine that is a SQL expression over the columns of the file table. Stays inside the scan's stage."""

    text: str = None
    error: str | None = None  # why there is no text, where there is none; a SQL expression too


@dataclass(frozen=True)
class FrameEngine(_Engine):
    """An engine that maps the files it should run on to `path, text, error`, for example with `mapInPandas`."""

    run: Callable[[DataFrame], DataFrame] = None
    by_path: bool = False  # reads nothing of the files but their paths


Engine = ColumnEngine | FrameEngine

_REGISTRY: dict[str, Engine] = {}


def register_engine(engine: Engine) -> Engine:
    """Make an engine known by name; the same name replaces the earlier one."""
    _REGISTRY[engine.name] = engine
    return engine


def registered_engines(*names: str) -> list[Engine]:
    """The named engines, or all of them, best priority first."""
    chosen = [_REGISTRY[n] for n in names] if names else list(_REGISTRY.values())
    return by_priority(chosen)


def named_engines(engines: list[Engine | str]) -> list[Engine]:
    """The engines as they are, names replaced by the engines registered under them."""
    unknown = [e for e in engines if isinstance(e, str) and e not in _REGISTRY]
    if unknown:
        raise KeyError(f"no engine is registered as {', '.join(unknown)}")
    return [_REGISTRY[e] if isinstance(e, str) else e for e in engines]


def by_priority(engines: list[Engine]) -> list[Engine]:
    return sorted(engines, key=lambda e: (e.priority, e.name))


def is_usable(text: str) -> str:
    """Present and not empty. Whitespace alone is usable and scores zero."""
    return f"coalesce({text} <> '', false)"


def ocr_fault(available: bool) -> str:
    """Why an OCR engine gives no text at all, before it even looks at the file."""
    return f"CASE WHEN NOT ocr_supported THEN '{MSG_OCR_UNSUPPORTED}' END" if available else f"'{MSG_OCR_MISSING}'"


def table_engine(name: str, priority: int, candidates: DataFrame, kind: str = TEXT) -> FrameEngine:
    """An engine whose texts another system has already put in a `path, text, error` table.

    Rows of files that it does not run on are left out before they are scored; of a table with `seconds` all rows stay, as all their seconds count.
    """

    def run(files: DataFrame) -> DataFrame:
        return candidates if "seconds" in candidates.columns else candidates.join(files.select("path"), "path", "left_semi")

    return FrameEngine(name, priority, kind, run=run, by_path=True)


def missing_ocr(name: str = OCR_ENGINE, priority: int = 1) -> FrameEngine:
    """The OCR engine where none is set up: it never runs, but its error shows where it was wanted."""
    return FrameEngine(name, priority, OCR)


def is_available(engine: Engine) -> bool:
    return (engine.text if isinstance(engine, ColumnEngine) else engine.run) is not None


def isolated_engine(
    name: str,
    priority: int,
    convert: Callable[..., str | None],
    columns: list[str],
    setup: Callable[[], Any] | None = None,
    kind: str = TEXT,
) -> FrameEngine:
    """An engine from a Python function of one file, with faults kept to their row.

    `convert(resource, *values)` gets the values of `columns`, and `resource` from `setup()`, which runs once per
    partition. An exception becomes `TypeName: message` in `error` and the other rows go on. `error` also tells an
    empty text of a text engine. Batches pass through Arrow, and the seconds spent on each row are kept.
    """

    def run(files: DataFrame) -> DataFrame:
        def convert_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            resource = setup() if setup else None
            for batch in batches:
                texts, errors, seconds = [], [], []
                for values in batch[columns].itertuples(index=False, name=None):
                    start = time.perf_counter()
                    try:
                        text, error = convert(resource, *values), None
                        if kind == TEXT and not text:
                            text, error = None, MSG_EMPTY_RESULT
                    except Exception as fault:  # any fault of an outside engine belongs to its row
                        text, error = None, f"{type(fault).__name__}: {fault}"
                    texts.append(text)
                    errors.append(error)
                    seconds.append(time.perf_counter() - start)
                yield pd.DataFrame({"path": batch["path"], "text": texts, "error": errors, "seconds": seconds})

        wanted = list(dict.fromkeys(["path", *columns]))
        small_batches(files.sparkSession)
        return files.select(*wanted).mapInPandas(
            convert_batches, "path string, text string, error string, seconds double"
        )

    return FrameEngine(name, priority, kind, run=run)


class _Cell:
    """A child process that converts rows one by one; it may die or stall without taking the worker with it."""

    def __init__(self, convert: Callable[..., str | None], setup: Callable[[], Any] | None) -> None:
        import multiprocessing

        context, self.convert, self.setup = multiprocessing.get_context("fork"), convert, setup
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=self._serve, args=(theirs,), daemon=True)
        self.process.start()
        theirs.close()

    def _serve(self, pipe) -> None:
        resource = self.setup() if self.setup else None
        while True:
            try:
                values = pipe.recv()
            except EOFError:
                return
            try:
                pipe.send((self.convert(resource, *values), None))
            except Exception as fault:  # any fault of an outside engine belongs to its row
                pipe.send((None, f"{type(fault).__name__}: {fault}"))

    def close(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()


class _Cells:
    """Child processes of one task. A row is given out when the one before has its text, or while that one waits without using its core."""

    def __init__(self, convert: Callable[..., str | None], setup: Callable[[], Any] | None, seconds: float) -> None:
        self.convert, self.setup, self.seconds = convert, setup, seconds
        self.idle: list[_Cell] = []
        self.busy: list[tuple[_Cell, str, float]] = []  # the path of the row and when it was given out

    def run(self, rows: Iterator[tuple[str, tuple]]) -> Iterator[tuple[str, str | None, str | None, float]]:
        """`path, text, error, seconds` of rows (path, values), in the order in which they end."""
        import time

        for path, values in rows:
            cell = self.idle.pop() if self.idle else _Cell(self.convert, self.setup)
            start = time.perf_counter()
            self.busy.append((cell, path, start))
            try:
                cell.pipe.send(values)
            except OSError:  # it has died; reading will tell
                pass
            while any(given is cell for given, _, _ in self.busy):
                yield from self._ended()
                if len(self.busy) < MOST_CELLS and time.perf_counter() - start >= PATIENCE and self._all_wait():
                    break
        while self.busy:
            yield from self._ended()

    def _ended(self) -> list[tuple[str, str | None, str | None, float]]:
        """The rows that end by the next deadline, within PATIENCE at most; their children are idle again or gone."""
        import time
        from multiprocessing.connection import wait

        left = min(start for _, _, start in self.busy) + self.seconds - time.perf_counter()
        ready = set(wait([cell.pipe for cell, _, _ in self.busy], max(0.0, min(PATIENCE, left))))
        found, still = [], []
        for cell, path, start in self.busy:
            took = time.perf_counter() - start
            if cell.pipe in ready:
                try:
                    text, fault = cell.pipe.recv()
                    self.idle.append(cell)
                except (EOFError, OSError):
                    cell.process.join(self.seconds)
                    text, fault = None, f"WorkerDied: exit code {cell.process.exitcode}"
                    cell.close()
            elif took >= self.seconds:
                text, fault = None, f"TimeLimit: no text within {self.seconds:g} s"
                cell.close()
            else:
                still.append((cell, path, start))
                continue
            found.append((path, text, fault, took))
        self.busy = still
        return found

    def _all_wait(self) -> bool:
        """Whether no child, nor a process that it started, has used its core for a moment."""
        import time

        before = [_cpu_ticks(cell.process.pid) for cell, _, _ in self.busy]
        if None in before:
            return False
        time.sleep(LOOK)
        return before == [_cpu_ticks(cell.process.pid) for cell, _, _ in self.busy]

    def close(self) -> None:
        for cell in [*self.idle, *(cell for cell, _, _ in self.busy)]:
            cell.close()


def _cpu_ticks(pid: int) -> int | None:
    """Processor time of a process and those it started, or None where the system does not tell."""
    try:
        with open(f"/proc/{pid}/stat") as file:
            ticks = sum(int(t) for t in file.read().rsplit(")", 1)[1].split()[11:15])
        with open(f"/proc/{pid}/task/{pid}/children") as file:
            started = [_cpu_ticks(int(p)) for p in file.read().split()]
    except OSError:
        return None
    return None if None in started else ticks + sum(started)


def guarded_engine(
    name: str, priority: int, convert: Callable[..., str | None], columns: list[str], setup: Callable[[], Any] | None = None,
    seconds: float = 60.0, kind: str = TEXT,
) -> FrameEngine:
    """As `isolated_engine`, for functions that can kill or stall their process.

    Rows are converted in a child process of each task, one at a time. A row in whose course the child dies (a crash in native code, a
    lack of memory) or that takes longer than `seconds` is a failed row, `WorkerDied: ...` or `TimeLimit: ...`; a new child goes on with the next, and `setup` runs
    again in it. While a row only waits and uses no processor time, the rows after it go on in other children, of which a task has `MOST_CELLS` at
    most; so stalled rows wait together, and beside a row that computes none is begun. The price is one exchange over a pipe for each row.
    """

    def run(files: DataFrame) -> DataFrame:
        def convert_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from itertools import islice

            cells = _Cells(convert, setup, seconds)
            rows = (
                (path, values)
                for batch in batches
                for path, values in zip(batch["path"], batch[columns].itertuples(index=False, name=None), strict=True)
            )
            try:
                ended = cells.run(rows)
                while some := list(islice(ended, BATCH_ROWS)):
                    paths, texts, errors, took = zip(*some, strict=True)
                    if kind == TEXT:
                        errors = [error if text else error or MSG_EMPTY_RESULT for text, error in zip(texts, errors, strict=True)]
                        texts = [text or None for text in texts]
                    yield pd.DataFrame({"path": paths, "text": texts, "error": errors, "seconds": took})
            finally:
                cells.close()

        wanted = list(dict.fromkeys(["path", *columns]))
        small_batches(files.sparkSession)
        return files.select(*wanted).mapInPandas(convert_batches, "path string, text string, error string, seconds double")

    return FrameEngine(name, priority, kind, run=run)
