"""Regular expressions of records' schemas, translated for the JVM when a schema is read."""

from __future__ import annotations

import re


class PatternError(ValueError):
    """A pattern that the schema language does not allow."""


def to_jvm(pattern: str) -> str:
    """Translate a linear-time pattern: ``$`` is the end of the text, named groups lose their P; look-around and back-references are refused."""
    out, i, in_class, named = [], 0, False, set()
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            if i + 1 == len(pattern):
                raise PatternError(f"trailing backslash in {pattern!r}")
            if not in_class and pattern[i + 1].isdigit() and pattern[i + 1] != "0":
                raise PatternError(f"back-reference in {pattern!r}")
            out.append(r"\z" if two == r"\z" else two)
            i += 2
            continue
        if in_class:
            if two == "[:":
                end = pattern.find(":]", i)
                if end < 0:
                    raise PatternError(f"unclosed class in {pattern!r}")
                out.append(posix(pattern[i + 2 : end]))
                i = end + 2
                continue
            in_class = c != "]" or out[-1] in ("[", "[^")
            out.append("\\" + c if c in "[&" else c)  # the JVM nests classes and intersects them at &&
        elif c == "[":
            in_class = True
            out.append("[^" if pattern[i + 1 : i + 2] == "^" else "[")
            i += 2 if out[-1] == "[^" else 1
            continue
        elif c == "$":
            out.append(r"\z")
        elif pattern.startswith("(?P<", i):
            name = pattern[i + 4 : pattern.find(">", i)]
            if not re.fullmatch("[A-Za-z][A-Za-z0-9]*", name) or name in named:
                raise PatternError(f"bad group name in {pattern!r}")
            named.add(name)
            out.append("(?<")
            i += 4
            continue
        elif re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
            raise PatternError(f"look-around in {pattern!r}")
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise PatternError(f"possessive quantifier in {pattern!r}")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError(f"unclosed class in {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as error:
        raise PatternError(f"{pattern!r}: {error}") from error
    return "".join(out)


def posix(name: str) -> str:
    negated = name.startswith("^")
    known = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}
    if name.lstrip("^") not in known:
        raise PatternError(f"unknown class [:{name}:]")
    return (r"\P{" if negated else r"\p{") + known[name.lstrip("^")] + "}"
