"""Checks of a request before it is run, and small values that are logged about it."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import EXTENSIONS, language_of
from lodestone.functions.scalars import extension

#: Fixed value: milliseconds above which a run doesn't count.
SLOWEST = 30_000
# Commands that write a file from their input, and flags that read a body from it.
WRITERS = ("tee", "dd", "install", "cp", "mv")
STDIN_FLAGS = ("--data", "--data-binary", "--data-raw", "--data-urlencode", "--body-file", "-d", "-F")
_HEREDOC = re.compile(r"<<(-?)\s*(\\?)(['\"]?)([A-Za-z_][A-Za-z0-9_]*)\3")


def file_ext(path: Column) -> Column:
    """a known extension in lower case, ``other``, or null without one."""
    e = extension(path)
    return F.when(e.isNull(), None).when(e.isin(*EXTENSIONS), e).otherwise("other")


def file_language(path: Column) -> Column:
    """the language by extension, null if unknown."""
    return language_of(path)


def counted(runs: DataFrame, most: int = SLOWEST) -> DataFrame:
    """Runs without those that took over ``most`` milliseconds; a run of unknown time stays."""
    return runs.filter(F.col("latency_ms").isNull() | (F.col("latency_ms") <= most))


def check_impl_only(entries: DataFrame) -> None:
    """Callers through traits need a Rust file among the entries."""
    if entries.filter(F.endswith(F.lower("path"), F.lit(".rs"))).isEmpty():
        raise ValueError("impl_only needs at least one .rs file")


def check_modes(summary: bool | None = None, cursor: str | None = None, import_lookup: bool = False, def_use: bool = False, symbol: str | None = None) -> None:
    """Modes that exclude each other."""
    if summary and cursor:
        raise ValueError("summary=true is incompatible with a pagination cursor; use one or the other")
    if import_lookup and def_use:
        raise ValueError("import_lookup and def_use exclude each other")
    if import_lookup and not symbol:
        raise ValueError("import_lookup needs a symbol")


def inside_root(path: str, root: str, must_exist: bool = True) -> str:
    """The real path, if it lies in ``root``; links are followed before that is judged."""
    top = os.path.realpath(root)
    real = os.path.realpath(os.path.join(top, path))
    if real != top and not real.startswith(top.rstrip("/") + "/"):
        raise PermissionError(f"{path} is outside of {root}")
    if must_exist and not os.path.exists(real):
        raise FileNotFoundError(path)
    return real


def overwrite(path: str, content: str, root: str = ".") -> int:
    """D3, K6: the file holds ``content`` afterwards or what it held before; folders are made. Returns the bytes written."""
    real = Path(inside_root(path, root, must_exist=False))
    if real.is_dir():
        raise IsADirectoryError(path)
    real.parent.mkdir(parents=True, exist_ok=True)
    data, beside = content.encode(), real.with_name(f".{real.name}.{os.getpid()}")
    try:
        beside.write_bytes(data)
        os.replace(beside, real)
    finally:
        beside.unlink(missing_ok=True)
    return len(data)


def _plain(command: str, escapes: bool) -> str:
    """The command with quoted and escaped characters blanked out, places kept."""
    out, quote, k = [], "", 0
    while k < len(command):
        c = command[k]
        if escapes and c == "\\" and quote != "'":
            out.append("  "[: len(command[k : k + 2])])
            k += 2
            continue
        if quote:
            quote = "" if c == quote else quote
            out.append(c if c == "\n" else " ")
        elif c in "'\"":
            quote = c
            out.append(" ")
        else:
            out.append(c)
        k += 1
    return "".join(out)


def _writes(before: str) -> bool:
    """Whether what stands before a heredoc sends it to a file: a redirect, or a command that writes to its last argument."""
    part = re.split(r"[|;&\n(](?![^()]*\))", before)[-1] if "(" not in before else re.split(r"[|;&\n]", before)[-1].lstrip("( ")
    part = re.sub(r"[<>$]?\([^()]*\)", "x", part)
    if re.search(r"(?:^|[^0-9&>])>>?\s*[^\s>&|]+\s*$", part):
        return True
    words = part.split()
    return len(words) > 1 and words[0].rsplit("/", 1)[-1] in WRITERS and not words[-1].startswith("-")


def heredoc_error(command: str, has_stdin: bool = False) -> str | None:
    """P25: why a command with heredocs is rejected: it writes a file (``file_write``), passes a body to a flag that reads its input
    (``stdin_flag``), has an input of its own (``stdin_conflict``), or doesn't close one (``unclosed``); None if it may run.
    """
    plain = _plain(command, True)
    for m in re.finditer(r"<<(?!<)", re.sub(r"<<<", "   ", plain)):
        before = plain[: m.start()].rstrip()
        if _writes(before):
            return "file_write"
        if re.search(rf"(?:^|\s)(?:{'|'.join(STDIN_FLAGS)})[=\s]\s*@?-$|(?:^|\s)--stdin$|(?:^|[\s|;&])cat\s+-$", before):
            return "stdin_flag"
        if has_stdin:
            return "stdin_conflict"
    at = 0
    quoted = _plain(command, False)
    while m := _HEREDOC.search(command, at):
        at = m.end()
        if quoted[m.start() : m.start() + 2] != "<<" or "<" in (command[m.start() - 1 : m.start()], command[m.end() - len(m[0]) + 2 : m.end() - len(m[0]) + 3]):
            continue
        rest = command[at:].split("\n")[1:]
        closed = next((k for k, x in enumerate(rest) if (x.lstrip("\t") if m[1] else x) == m[4]), None)
        if closed is None:
            return "unclosed"
        at = len(command) - len("\n".join(rest[closed:]))
    return None
