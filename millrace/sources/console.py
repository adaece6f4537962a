"""Statements from text streams: the interactive console and script files."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import TextIO

from ..plans.parser import split_statements


def statements(lines: TextIO) -> Iterator[str]:
    """Statements as soon as their semicolon has come; the last one may lack it."""
    held = ""
    for line in lines:
        held += line
        if ";" in line:
            *done, rest = split_statements(held + "\x00") or [""]
            if rest != "\x00" and not rest.endswith("\x00"):
                done, rest = [*done, rest], "\x00"
            yield from done
            held = rest[:-1]
    if held.strip():
        yield from split_statements(held)


def run_console(engine, lines: TextIO = sys.stdin, out: TextIO = sys.stdout, *, rows: int = 20) -> None:
    """Execute statements until the text or the database ends; print messages, rows (up to ``rows``) and counts."""
    for text in statements(lines):
        result = engine.execute(text)
        print(format_result(result, rows), file=out)
        if engine.closed:
            return


def format_result(result, rows: int = 20) -> str:
    """Rows without an order of their own come in the order of their keys."""
    if result.df is None:
        return result.message
    shown = result.df.orderBy(*[f"`{k}`" for k in result.keys]) if result.keys else result.df
    shown = shown.limit(rows).collect() if rows else []
    body = ["\t".join(map(str, r)) for r in shown]
    return "\n".join(["\t".join(result.df.columns), *body, f"output size = {result.df.count()}"])
