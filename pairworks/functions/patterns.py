"""What a text must contain for a regular expression to be found in it."""

from __future__ import annotations

LEAST_LITERAL = 3
# Escapes that stand for a class, a boundary or a control character.
_NO_LITERAL = set("dDwWsSbBAZzGRXhHvVtnrfae")
_GROUPS = (":", "=", "!", "<", ">")


def _class_end(pattern: str, at: int) -> int | None:
    """Behind the character class that opens at `at`; None if it is not a plain one."""
    at += 1
    if pattern[at:at + 1] == "^":
        at += 1
    if pattern[at:at + 1] == "]":
        return None
    while at < len(pattern):
        if pattern[at] == "\\":
            if pattern[at + 1:at + 2] == "Q":
                return None
            at += 2
        elif pattern[at] == "[":
            end = _class_end(pattern, at)
            if end is None:
                return None
            at = end
        elif pattern[at] == "]":
            return at + 1
        else:
            at += 1
    return None


def _group_end(pattern: str, at: int) -> int | None:
    """Behind the group that opens at `at`; None if it cannot be told."""
    depth = 0
    while at < len(pattern):
        if pattern[at] == "\\":
            if pattern[at + 1:at + 2] == "Q":
                return None
            at += 2
            continue
        if pattern[at] == "[":
            end = _class_end(pattern, at)
            if end is None:
                return None
            at = end
            continue
        if pattern[at] == "(" and pattern[at + 1:at + 2] == "?" and pattern[at + 2:at + 3] not in _GROUPS:
            return None
        depth += {"(": 1, ")": -1}.get(pattern[at], 0)
        at += 1
        if depth == 0:
            return at
    return None


def required_literals(pattern: str, case_insensitive: bool = False, least: int = LEAST_LITERAL) -> list[str] | None:
    """Literals of which any text that matches a Java pattern contains at least one; None if none can be told.

    There is one per branch of the pattern, its longest run of characters that no group, class or
    quantifier makes optional. Where case does not matter it has ASCII only, in lower case. What is
    not surely understood gives None.
    """
    branches: list[list[str]] = [[]]
    run, at = "", 0

    def close() -> str:
        branches[-1].append(run)
        return ""

    while at < len(pattern):
        char, width = pattern[at], 1
        if char in "[(":
            if char == "(" and pattern[at + 1:at + 2] == "?" and pattern[at + 2:at + 3] not in _GROUPS:
                return None
            end = _class_end(pattern, at) if char == "[" else _group_end(pattern, at)
            if end is None:
                return None
            run, at = close(), end
            continue
        if char == ")":
            return None
        if char in "|.^$":
            run = close()
            if char == "|":
                branches.append([])
            at += 1
            continue
        if char in "*+?{":
            run = run if char == "+" else run[:-1]
            run = close()
            at = pattern.find("}", at) + 1 if char == "{" else at + 1
            if at == 0:
                return None
            continue
        if char == "\\":
            char, width = pattern[at + 1:at + 2], 2
            if not char or char.isalnum() and char not in _NO_LITERAL:
                return None
            if char in _NO_LITERAL:
                run = close()
                at += 2
                continue
        if case_insensitive and not char.isascii():
            run = close()
        else:
            run += char.lower() if case_insensitive else char
        at += width
    run = close()
    longest = [max(runs, key=len) for runs in branches]
    return longest if all(len(literal) >= least for literal in longest) else None
