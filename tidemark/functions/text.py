"""String and date expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of an article's id.
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
BLANK = r"(?U)\s+"
SNIPPET_CHARS = 280
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def squeeze(x: Column | str) -> Column:
    return F.regexp_replace(strip(x), BLANK, " ")


def day(x: Column | str) -> Column:
    """The YYYY-MM-DD prefix."""
    return F.substring(_c(x), 1, 10)


def valid_day(x: Column | str) -> Column:
    return day(x).rlike(ISO_DAY)


def strict_date(x: Column | str) -> Column:
    """A date if the prefix is a well-formed ISO day, else null."""
    return F.when(valid_day(x), F.try_to_date(day(x), "yyyy-MM-dd"))


def lenient_date(x: Column | str) -> Column:
    """A date from a leading Y-M-D with ``-`` or ``/`` and one- or two-digit parts, else null."""
    part = lambda i: F.regexp_extract(_c(x), r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})", i)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(iso.rlike(ISO_DAY), F.try_to_date(iso, "yyyy-MM-dd"))


def canonical_id(x: Column | str) -> Column:
    """One key for all renderings of an article id."""
    s = strip(F.coalesce(_c(x), F.lit("")))
    s = strip(F.regexp_replace(F.regexp_replace(s, '^"+|"+$', ""), "^'+|'+$", ""))
    s = strip(F.regexp_replace(s, "^id=", ""))
    s = F.regexp_replace(strip(F.regexp_replace(s, "^[<>]+|[<>]+$", "")), "[,.;]+$", "")
    s = F.lower(F.regexp_replace(s, "^urn:uuid:", ""))
    found = F.regexp_extract(s, UUID, 0)
    return F.when(found != "", found).otherwise(s)


def display_id(canonical: Column | str) -> Column:
    c = _c(canonical)
    return F.when(c.rlike(f"^{UUID}$"), F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))).otherwise(c)


def snippet(summary: Column | str, body: Column | str, limit: int = SNIPPET_CHARS) -> Column:
    """The squeezed summary, else the lede, cut at a sentence end in its latter half if there is one."""
    s, b = squeeze(F.coalesce(_c(summary), F.lit(""))), squeeze(F.coalesce(_c(body), F.lit("")))
    dots = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?U)\s+$", ""), F.lit("…"))
    lede = F.substring(b, 1, limit)
    cut = dots(b)
    for mark in ("? ", "! ", ". "):  # the last written is tried first
        at = F.lit(limit) - F.instr(F.reverse(F.rpad(lede, limit, " ")), mark[::-1]) - 1
        found = F.instr(lede, mark) > 0
        cut = F.when(found & (at >= limit // 2), F.substring(lede, F.lit(1), at + 1)).otherwise(cut)
    from_summary = F.when(F.length(s) > limit, dots(s)).otherwise(s)
    from_body = F.when(F.length(b) <= limit, b).otherwise(cut)
    return F.when(s != "", from_summary).otherwise(from_body)


def fixed(x: Column | str, digits: int) -> Column:
    """A number with ``digits`` decimals, rounded as it is stored, as C and Python do.

    ``%.4f`` of Java rounds the shortest decimal form half up: 0.35445 lies below its form and would become 0.3545.
    """
    return F.call_function("format_number", _c(x), F.lit("0." + "0" * digits))


def last_tag(x: Column | str, tag: str) -> Column:
    """Inner text of the last complete tag without a nested opener, stripped; null if none."""
    found = F.regexp_extract_all(_c(x), F.lit(f"(?s)<{tag}>((?:(?!<{tag}>).)*?)</{tag}>"), 1)
    return strip(F.try_element_at(found, F.lit(-1)))


def strip_think(x: Column | str) -> Column:
    """What follows the last ``</think>``, left-stripped; null if nothing is left."""
    return F.nullif(F.regexp_replace(_c(x), r"(?sU)^.*</think>\s*", ""), F.lit(""))


def safe_key(x: Column | str) -> Column:
    """A metric key: runs of unsafe characters become ``_``, ends trimmed, empty is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9_.\-]+", "_"), "^_+|_+$", ""), F.lit(""))


def truncate_tokens(x: Column | str, budget: int, encode: Callable[[str], list] | None = None, decode: Callable[[list], str] | None = None) -> Column:
    """Text cut to ``budget`` tokens and ``...``; tokens are words unless a tokenizer is given."""
    if encode is None or decode is None:
        words = F.split(strip(x), BLANK)
        return F.when(F.size(words) > budget, F.concat(F.array_join(F.slice(words, 1, budget), " "), F.lit("..."))).otherwise(_c(x))

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            tokens = encode(t)
            return t if len(tokens) <= budget else decode(tokens[:budget]) + "..."

        return texts.map(one, na_action="ignore")

    return cut(_c(x))


#: Where an error's class name puts the end of an episode, first match wins.
ERROR_NAMES = (
    ("MaxTokensReachedException", "max_tokens_reached"),
    ("ContextWindowOverflowException", "context_window_overflow"),
    ("MaxToolIterationsReachedError", "max_tool_iterations_reached"),
    ("MaxToolCallsReachedError", "max_tool_calls_reached"),
    ("RecursionError", "recursion_depth_exceeded"),
)


def termination(chain: Column | str) -> Column:
    """Why an episode ended, from the class names of an error and its causes, outermost first (null: none)."""
    names = _c(chain)
    inner = F.filter(names, lambda n: n != "EventLoopException")
    cause = F.coalesce(F.try_element_at(inner, F.lit(1)), F.try_element_at(names, F.lit(-1)))
    tail = F.when(F.size(inner) > 0, F.slice(names, F.array_position(names, cause).cast("int"), F.size(names))).otherwise(names)
    out = F.when(names.isNull() | (F.size(names) == 0), F.lit("task_complete"))
    for name, reason in ERROR_NAMES:
        out = out.when(cause == name, F.lit(reason))
    out = out.when(F.exists(tail, lambda n: F.lower(n).contains("timeout")), F.lit("timeout"))
    gone = lambda n: F.lower(n).contains("connection") | F.lower(n).contains("disconnected")
    return out.when(F.exists(tail, gone), F.lit("connection_error")).otherwise(F.lit("unclassified_error"))


def prompt_file(mode: Column | str, tools: Column | str) -> Column:
    return F.concat(_c(mode), F.when(_c(tools), F.lit("-tools")).otherwise(F.lit("")), F.lit(".md"))
