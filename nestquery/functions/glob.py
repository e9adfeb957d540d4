"""Glob patterns as Java regular expressions."""

from __future__ import annotations


class BadPattern(ValueError):
    pass


def _class(p: str, i: int) -> tuple[str, int]:
    """The regex of the bracket expression that opens at p[i], and where it ends."""
    j, out = i + 1, ""
    negated = j < len(p) and p[j] in "!^"
    j += negated
    first = True
    while True:
        if j >= len(p):
            raise BadPattern(p)
        if p[j] == "]" and not first:
            break
        c = p[j]
        if c == "\\":
            j += 1
            if j >= len(p):
                raise BadPattern(p)
            c = p[j]
        elif c == "-" and not first and j + 1 < len(p) and p[j + 1] != "]":
            out += "-"
            j += 1
            continue
        out += c if c.isalnum() else "\\" + c if ord(c) < 128 else c
        first = False
        j += 1
    return (f"(?!/)[^{out}]" if negated else f"(?!/)[{out}]"), j + 1


def glob_to_regex(pattern: str) -> str:
    """An anchored regex: * and ? within a component, ** as a whole component for any number
    of them, [...] classes, {a,b} alternatives, backslash escapes; case matters."""

    def part(p: str, i: int, depth: int) -> tuple[str, int]:
        out = ""
        while i < len(p):
            c = p[i]
            if p.startswith("**", i) and (i == 0 or p[i - 1] in "/{,") and (i + 2 == len(p) or p[i + 2] in "/},"):
                if p.startswith("**/", i):
                    out, i = out + "(?:[^/]+/)*", i + 3
                elif out.endswith("/"):
                    out, i = out[:-1] + "(?:/.*)?", i + 2
                else:
                    out, i = out + ".*", i + 2
            elif c == "*":
                while i < len(p) and p[i] == "*":
                    i += 1
                out += "[^/]*"
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[":
                regex, i = _class(p, i)
                out += regex
            elif c == "{":
                choices, i = [], i + 1
                while True:
                    regex, i = part(p, i, depth + 1)
                    choices.append(regex)
                    if i >= len(p):
                        raise BadPattern(p)
                    i += 1
                    if p[i - 1] == "}":
                        break
                out += "(?:" + "|".join(choices) + ")"
            elif depth and c in ",}":
                return out, i
            elif c == "\\":
                if i + 1 >= len(p):
                    raise BadPattern(p)
                out, i = out + _quote(p[i + 1]), i + 2
            else:
                out, i = out + _quote(c), i + 1
        return out, i

    return "^(?s:" + part(pattern, 0, 0)[0] + ")$"


def _quote(c: str) -> str:
    return c if c.isalnum() or c in "/_ " or ord(c) > 127 else "\\" + c
