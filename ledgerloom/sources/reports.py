"""Folders of extracts, and the files that a run leaves: tables for print, a report, a manifest, and a record of its steps.

Only tables of a report's size are written here, and their bound is checked; what grows is written by Spark.
"""

from __future__ import annotations

import glob
import json
import os
import re
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .extracts import DataValidationError, contained, inventory

#: Rows of a table that a report may hold.
MOST_ROWS = 10_000


def windows(root: str) -> dict[str, str]:
    """Analysis windows below a folder by their name: every folder that ends in a number of months, as in revised-24m, and holds an extract."""
    found = {}
    for path in sorted(Path(root).iterdir()):
        if (m := re.search(r"(\d+m)$", path.name)) and path.is_dir() and any(path.glob("*.csv")):
            if m[1] in found:
                raise DataValidationError(f"{path} and {found[m[1]]} are both {m[1]}")
            found[m[1]] = str(path)
    return found


def window_of(path: str) -> str | None:
    """The window that a path speaks of, from the nearest folder that names one."""
    return next((m[1] for part in reversed(Path(path).parts) if (m := re.search(r"(\d+m)$", part))), None)


def only_file(folder: str, *patterns: str) -> str:
    """The one file that the first fitting pattern finds; an error if it finds several, or none does."""
    for pattern in patterns:
        found = sorted(glob.glob(os.path.join(folder, pattern)))
        if len(found) > 1:
            raise DataValidationError(f"{pattern} is ambiguous: {found}")
        if found:
            return found[0]
    raise DataValidationError(f"{folder} has none of {patterns}")


def staged(source: str, root: str, name: str) -> str:
    """A copy of a file below root, whole or not at all."""
    target = contained(root, name)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    replaced(target, lambda path: shutil.copyfile(source, path))
    return target


def replaced(path: str, write: Callable[[str], object]) -> None:
    """Writes a file beside its place and moves it there."""
    beside = f"{path}.part"
    write(beside)
    os.replace(beside, path)


def rows_of(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise DataValidationError(f"a report's table has at most {MOST_ROWS} rows")
    return rows


def written(value: object, places: int = 2) -> str:
    """A value as tables print it: whole numbers with separators, others with so many places, nothing as dashes."""
    if value is None or value != value:
        return "---"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:,.{places}f}" if isinstance(value, float) else str(value)


def latex_table(df: DataFrame, path: str, caption: str, label: str, places: int = 2) -> None:
    """A table for print and, beside it, the same as CSV."""
    special = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})
    rows = rows_of(df)
    line = lambda cells: " & ".join(str(c).translate(special) for c in cells) + r" \\\\"
    body = [line(df.columns), r"\midrule", *[line(written(v, places) for v in r) for r in rows]]
    head = [r"\begin{table}", rf"\caption{{{caption.translate(special)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule"]
    text = "\n".join([*head, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])
    replaced(path, lambda p: Path(p).write_text(text, encoding="utf-8"))
    quoted = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"'
    lines = [",".join(map(quoted, df.columns)), *[",".join(map(quoted, r)) for r in rows]]
    replaced(os.path.splitext(path)[0] + ".csv", lambda p: Path(p).write_text("\n".join(lines) + "\n", encoding="utf-8"))


def markdown_report(path: str, template: str, tables: dict[str, DataFrame], values: dict[str, object], places: int = 2) -> None:
    """A template with {{name}} for values and tables; a name that nothing is given for is an error."""
    def table(df: DataFrame) -> str:
        cells = [df.columns, ["---"] * len(df.columns), *[[written(v, places).replace("|", "\\|") for v in r] for r in rows_of(df)]]
        return "\n".join("| " + " | ".join(c) + " |" for c in cells)

    def filled(m: re.Match) -> str:
        name = m[1].strip()
        if name not in tables and name not in values:
            raise DataValidationError(f"nothing is given for {name}")
        return table(tables[name]) if name in tables else written(values[name], places)

    text = re.sub(r"\{\{([^}]*)\}\}", filled, template)
    replaced(path, lambda p: Path(p).write_text(text, encoding="utf-8"))


def manifest(spark: SparkSession, folder: str, path: str, pattern: str = "*.csv", **facts: object) -> dict:
    """Digests, sizes and roles of a folder's files and the given facts, as a JSON file."""
    files = [r.asDict() for r in rows_of(inventory(spark, folder, pattern).orderBy("path"))]
    whole = {"files": files, "n_files": len(files), **facts}
    replaced(path, lambda p: Path(p).write_text(json.dumps(whole, indent=2, sort_keys=True, default=str), encoding="utf-8"))
    return whole


def run_steps(steps: list[tuple[str, Callable[[], object], tuple[str, ...]]]) -> list[dict]:
    """Runs (name, step, names of steps it needs) in order. A step that fails is recorded and those that don't need it go on; those that do are
    skipped. Faults of the data and of the program are told apart."""
    record: list[dict] = []
    state: dict[str, str] = {}
    for name, step, needs in steps:
        if any(state.get(n) != "done" for n in needs):
            status, error = "skipped", None
        else:
            try:
                step()
                status, error = "done", None
            except DataValidationError as e:
                status, error = "invalid data", str(e)
            except Exception as e:  # recorded, so that the other steps still run
                status, error = "failed", f"{type(e).__name__}: {e}"
        state[name] = status
        record.append({"step": name, "status": status, "error": error})
    return record


def accepted(checks: list[tuple[str, bool]], files: list[str], phrases: dict[str, list[str]] | None = None) -> list[dict]:
    """Every named check, every file that must be there and not empty, and every phrase that a file must hold, with its verdict."""
    rows = [{"check": name, "status": "PASS" if ok else "FAIL"} for name, ok in checks]
    rows += [{"check": f"file {f}", "status": "PASS" if os.path.isfile(f) and os.path.getsize(f) else "FAIL"} for f in files]
    for f, wanted in (phrases or {}).items():
        text = Path(f).read_text(encoding="utf-8") if os.path.isfile(f) else ""
        rows += [{"check": f"{f} says {w!r}", "status": "PASS" if w in text else "FAIL"} for w in wanted]
    return rows
