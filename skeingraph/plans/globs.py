"""Globs as Java regular expressions.

Runs between stars become atomic groups that take the earliest match, which is always
enough, so matching never backtracks over several stars.
"""

from __future__ import annotations

import re

#: Ends a component, and parts its name from its arity, in encoded paths.
END, ARITY = "\x01", "\x02"


def quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text) if text else ""


def component(pattern: str, ignore_case: bool = False) -> str:
    """Anchored: `*` is any run, `**` the same; nothing else is special."""
    parts = re.split(r"\*+", pattern)
    flags = "(?isu)" if ignore_case else "(?s)"
    if len(parts) == 1:
        return rf"{flags}\A{quoted(pattern)}\z"
    middle = "".join(f"(?>.*?{quoted(p)})" for p in parts[1:-1] if p)
    # Greedy, from the end: the last run has to stand there.
    last = f"(?>.*{quoted(parts[-1])})" if parts[-1] else ".*"
    return rf"{flags}\A{quoted(parts[0])}{middle}{last}\z"


def source(pattern: str, ignore_case: bool = False) -> str:
    """Unanchored, `*` spans lines."""
    parts = [p for p in re.split(r"\*+", pattern) if p]
    flags = "(?isu)" if ignore_case else "(?s)"
    return flags + (quoted(parts[0]) + "".join(f"(?>.*?{quoted(p)})" for p in parts[1:]) if parts else "")


def _within(name: str, any_char: str) -> str:
    return f"{any_char}*".join(quoted(p) for p in re.split(r"\*+", name))


def file(pattern: str, ignore_case: bool = False) -> str:
    """Anchored, by path parts: `*` within a part, a part `**` for none or several parts; backslashes of the pattern count as slashes."""
    parts = pattern.replace("\\", "/").split("/")
    out = ""
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            # Every repeated group ends in a slash, so none can match the same text in two ways.
            out += r"(?:[^/]*(?:/[^/]*)*)?" if last and i == 0 else r"[^/]*(?:/[^/]*)*" if last else r"(?:[^/]*/)*"
        else:
            out += _within(p, "[^/]") + ("" if last else "/")
    if len(parts) > 1 and parts[-1] == "**":
        head = out.removesuffix(r"[^/]*(?:/[^/]*)*").removesuffix("/")
        out = rf"{head}(?:/[^/]*)*"
    return rf"{'(?iu)' if ignore_case else ''}\A{out}\z"


def exclude(pattern: str) -> str:
    """Input excludes: `**/` any folders, `**` anything, `*` within a part, `?` one character; always without regard to case. Leading slashes of pattern and path don't count."""
    names = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = "".join(names.get(p, quoted(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", pattern.replace("\\", "/").lstrip("/")))
    return f"(?i)^/*{out}$"


def hierarchy(parts: list[tuple[str, int | None]], any_owner: bool = False, literal: bool = False, ignore_case: bool = False) -> str:
    """Over an encoded path: one (name pattern, arity) for each component; `*` one component, `**` none or several.

    No arity: 0, or any if the name has a star. any_owner: further components may stand before. literal: stars are plain characters."""
    out = rf"(?:[^{END}]*{END})*" if any_owner else ""
    for name, arity in parts:
        if name == "**" and not literal:
            out += rf"(?:[^{END}]*{END})*"
        else:
            n = str(arity) if arity is not None else "[0-9]+" if "*" in name and not literal else "0"
            out += (quoted(name) if literal else _within(name, f"[^{END}{ARITY}]")) + ARITY + n + END
    return rf"{'(?isu)' if ignore_case else '(?s)'}\A{out}\z"


def encode(components: list[tuple[str, int]]) -> str:
    return "".join(f"{name}{ARITY}{arity}{END}" for name, arity in components)
