"""An interactive shell: python -m larkspan.shell. Queries end with `;`, `exit;` or `quit;` ends the shell."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from .engine import Engine

MOST_ROWS = 1000
HISTORY = Path.home() / ".larkspan_history"


def format_duration(seconds: float) -> str:
    """As ms, s, min or h, with two decimals in the smallest unit shown."""
    if seconds < 1:
        return f"{seconds * 1000:.2f} ms"
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(int(minutes), 60)
    lead = f"{hours} h {minutes} min " if hours else f"{minutes} min " if minutes else ""
    return f"{lead}{rest:.2f} s"


def read_statement(ask: Callable[[str], str]) -> str:
    lines = [ask("larkspan> ")]
    while not lines[-1].rstrip().endswith(";"):
        lines.append(ask("     ...> "))
    return "\n".join(lines).strip()


def run_statement(engine: Engine, text: str) -> None:
    """Prints the plans, rows and time, or what is wrong with the text."""
    try:
        frame = engine.sql(text)
    except (ValueError, TypeError) as e:
        print(f"{type(e).__name__}: {e}")
        return
    frame.explain(full=True)
    began = time.perf_counter()
    n = frame.show(MOST_ROWS)
    print(f"{n} rows in {format_duration(time.perf_counter() - began)}")


def main(ask: Callable[[str], str] = input) -> None:
    try:
        import readline

        if HISTORY.exists():
            readline.read_history_file(HISTORY)
    except ImportError:
        readline = None
    with Engine() as engine:
        while True:
            try:
                text = read_statement(ask)
            except KeyboardInterrupt:
                print()
                continue
            except EOFError:
                break
            if text.lower().rstrip(" ;") in ("exit", "quit"):
                break
            run_statement(engine, text)
    if readline:
        readline.write_history_file(HISTORY)


if __name__ == "__main__":
    main()
