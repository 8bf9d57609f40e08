"""Column functions that screen query text (injection, shell, script validation, write class)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.functions import packs

_WORD = "0-9A-Za-z_"
_BLANKS = " \t\n\r\f\x0b"


def ascii_boundary(pattern: str) -> str:
    r"""Turn ``\b`` into look-arounds over ASCII word characters (Java's own ``\b`` is Unicode)."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            follow = pattern[i + 2 : i + 3]
            before = pattern[i - 1] if i else ""
            closes = before != "" and (before.isalnum() or before in ")_")
            if follow and (follow.isalnum() or follow == "(") and not closes:
                out.append(f"(?<![{_WORD}])")
            elif closes:
                out.append(f"(?![{_WORD}])")
            else:
                out.append(f"(?<=[{_WORD}])")
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "(?d)" + "".join(out)


def literal_runs(pattern: str) -> list[str]:
    """Plain text that every hit of an alternation-free pattern must contain."""
    if "|" in pattern.replace(r"\|", ""):
        return []
    text = re.sub(r"\\b|\\[sd][*+]?|\[[^\]]*\][*+?]?|\.\*\??|\(\\r\?\\n\|\$\)", "\0", pattern)
    return [run for run in re.sub(r"\\(.)", r"\1", text).split("\0") if run]


def found(text: Column, pattern: str, *, ascii_words: bool = True) -> Column:
    """``rlike`` behind cheap ``contains`` tests, so the regex runs only on texts that may hit."""
    runs = literal_runs(pattern)
    tests = [text.contains(run) for run in runs]
    if runs != [re.sub(r"\\(.)", r"\1", pattern)] or r"\b" in pattern:
        regex = ascii_boundary(pattern) if ascii_words else "(?d)" + pattern
        tests.append(text.rlike(regex))
    return reduce(lambda a, b: a & b, tests)


def words_regex(patterns: list[str]) -> str:
    """One regex for patterns that all start with a word edge and a letter, keyed by first letter.

    A text position that starts no word fails at once; one that does only tries the alternatives
    of its letter. Much cheaper than one scan per pattern, and small in generated code.
    """
    by_letter: dict[str, list[str]] = {}
    for p in dict.fromkeys(patterns):
        by_letter.setdefault(p[2], []).append(p[3:])
    heads = []
    for letter, rests in sorted(by_letter.items()):
        bodies = [ascii_boundary("x" + rest)[len("(?d)x") :] for rest in rests]
        heads.append(f"{letter}(?:{'|'.join(bodies)})")
    return f"(?d)(?<![{_WORD}])(?:{'|'.join(heads)})"


def any_group(text: Column, groups: list[list[str]]) -> Column:
    """Whether any pattern of any group is found."""
    patterns = list(dict.fromkeys(p for group in groups for p in group))
    words = [p for p in patterns if re.match(r"\\b[a-z]", p) and ".*" not in p]
    tests = [found(text, p) for p in patterns if p not in words]
    if words:
        tests.insert(0, text.rlike(words_regex(words)))
    return reduce(lambda a, b: a | b, tests)


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.floor(
        (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)
    ).cast("int")


def _heuristics(low: Column) -> list[tuple[str, Column]]:
    return [
        ("excessive single quotes", count_of(low, "'") > 4),
        ("excessive double quotes", count_of(low, '"') > 4),
        ("always-true condition", low.contains("1=1") | low.contains("1 = 1")),
        ("quote-based bypass attempt", low.contains("' or '") | low.contains('" or "')),
    ]


def _heuristic_hits(low: Column) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for _, c in _heuristics(low)])


def injection_found(low: Column) -> Column:
    """Injection flag of an already lower-cased query."""
    return any_group(low, packs.INJECTION_GROUPS) | (_heuristic_hits(low) >= 2)


def is_sql_injection(query: Column) -> Column:
    return injection_found(F.lower(query))


def is_shell_command(query: Column) -> Column:
    return any_group(F.lower(query), packs.SHELL_GROUPS)


def query_kind(low: Column) -> Column:
    """Attack class of an already lower-cased query: shell, then injection, then heuristics."""
    return (
        F.when(any_group(low, packs.SHELL_GROUPS), F.lit("shell_command"))
        .when(any_group(low, packs.INJECTION_GROUPS), F.lit("sql_injection"))
        .when(_heuristic_hits(low) >= 2, F.lit("heuristic"))
        .otherwise(F.lit(""))
    )


def kind_detail(kind: Column, low: Column) -> Column:
    reasons = F.array(*[F.when(c, F.lit(name)) for name, c in _heuristics(low)])
    return (
        F.when(kind == "shell_command", F.lit("Shell command execution detected"))
        .when(kind == "sql_injection", F.lit("SQL injection pattern detected"))
        .when(
            kind == "heuristic",
            F.concat(
                F.lit("Multiple suspicious patterns: "), F.concat_ws(", ", F.array_compact(reasons))
            ),
        )
        .otherwise(F.lit(""))
    )


def is_write_query(query: Column) -> Column:
    return F.upper(F.btrim(query, F.lit(_BLANKS))).rlike("^(" + "|".join(packs.WRITE_KEYWORDS) + ")")


def _script_found(low: Column, pattern: str) -> Column:
    if pattern.startswith("--"):  # the one pattern anchored at line ends
        return low.contains("--") & low.rlike("(?dm)" + pattern)
    return found(low, pattern, ascii_words=False)


def script_messages(low: Column, pack: list[tuple[str, str]], template: str) -> Column:
    """Messages of a pack's patterns found in an already lower-cased script."""
    return F.array_compact(
        F.array(
            *[
                F.when(_script_found(low, p), F.lit(template.format(text=text, pattern=p)))
                for p, text in pack
            ]
        )
    )


def script_any(low: Column, pack: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [_script_found(low, p) for p, _ in pack])


def statement_heads(script: Column) -> Column:
    """Distinct upper-cased first words of the ``;``-separated statements, in order."""
    parts = F.transform(F.split(script, ";"), lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1))
    return F.array_distinct(F.transform(F.filter(parts, lambda s: s != ""), F.upper))


def long_line_messages(script: Column) -> Column:
    return F.array_compact(
        F.transform(
            F.split(script, "\n"),
            lambda line, i: F.when(
                F.length(line) > 1000,
                F.format_string(
                    "Extremely long line detected (line %d): %d characters", i + 1, F.length(line)
                ),
            ),
        )
    )
