"""Violation-tag parsing and record severity as Catalyst expressions.

``violation_type`` holds a stringified list such as
``["WRONG PARKING","NO PARKING"]``. The rules (applied per row, JVM-side):

* NULL or blank text                  -> empty array
* a list ``[...]`` or tuple ``(...)`` of quoted strings / numbers
                                      -> its elements, whitespace-stripped
* one quoted string ``"..."``/``'...'`` -> a one-element array of its content
* anything else (bare text, a list followed by junk, a list holding
  ``null``, an unterminated list)     -> a one-element array of the stripped
  raw text

Two paths give the same array. The common shape (a double-quoted list
whose items need no stripping) is split with compiled string functions
(``startswith``, ``translate``, ``split``); every other list/tuple form is
read with ``from_json`` (single quotes allowed, tabs allowed inside quotes,
a trailing comma before ``]`` tolerated) and stripped item by item. No
regular expression is matched per row. Known residue, which falls back to
the raw text or differs from a full Python-literal reader: backslash escapes
beyond JSON's, nested lists, dicts, adjacent string literals,
``True``/``None``/``true`` items and numbers written in non-canonical form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbscope.schema import PARKING_SEVERITY_WEIGHTS

# --- fixed values: characters Python's str.strip() removes -----------------
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace of every kind (not only spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def _inner(s: Column) -> Column:
    """Text between the first and the last character."""
    return s.substr(F.lit(2), F.length(s) - 2)


def list_body(s: Column) -> Column:
    """JSON list text for list/tuple forms of stripped text ``s``, else NULL."""
    is_list = s.startswith("[") & s.endswith("]") & ~s.contains("][")
    is_tuple = s.startswith("(") & s.endswith(")") & ~s.contains(")(")
    items = strip_ws(_inner(s))
    items = F.when(items.endswith(","), items.substr(F.lit(1), F.length(items) - 1)) \
        .otherwise(items)
    return F.when(is_list | is_tuple, F.concat(F.lit("["), items, F.lit("]")))


# The common shape, a double-quoted list such as ["WRONG PARKING","NO PARKING"],
# is split with compiled string functions; every other shape takes the
# general JSON path. The fast path only accepts text whose split is
# provably the same array:
# * it starts with '["' and ends with '"]' and holds no backslash;
# * it holds exactly two quotes per item, so items contain no quote and
#   the separators are exactly '","';
# * it holds no line break: a quoted item ends at one;
# * no quote touches whitespace, so no item needs stripping (whitespace is
#   first mapped to a marker character with ``translate``).
_MARK = "\x01"


def fast_list(s: Column) -> Column:
    """Items of the common list shape via ``split`` (codegen), else NULL."""
    inner = s.substr(F.lit(3), F.length(s) - 4)
    items = F.split(inner, '","')
    quotes = F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))
    marked = F.translate(s, WHITESPACE, _MARK * len(WHITESPACE))
    ok = (s.startswith('["') & s.endswith('"]') & (F.length(s) >= 4) & ~s.contains("\\")
          & (quotes == F.size(items) * 2) & ~s.rlike("[\\n\\r]")
          & ~marked.contains('"' + _MARK) & ~marked.contains(_MARK + '"'))
    return F.when(ok, items).when(s == "[]", F.array().cast("array<string>"))


def parse_json_list(s: Column) -> Column:
    return F.from_json(list_body(s), "array<string>", {"allowUnquotedControlChars": "true"})


def clean_list(parsed: Column) -> Column:
    """Whitespace-stripped elements, or NULL when an element is NULL."""
    return F.when(F.exists(parsed, lambda x: x.isNull()), F.lit(None).cast("array<string>")) \
        .otherwise(F.transform(parsed, strip_ws))


def parse_list(s: Column) -> Column:
    """Elements of a list/tuple form of stripped text ``s``, each stripped;
    NULL when ``s`` is not a well-formed list of non-null items."""
    return F.coalesce(fast_list(s), clean_list(one_line(s, parse_json_list(s))))


def one_line(s: Column, parsed: Column) -> Column:
    """``parsed``, or NULL where a quoted item of ``s`` holds a raw line
    break (an escaped one is fine): such text is no list."""
    broken = F.exists(parsed, lambda x: x.rlike("[\\n\\r]")) & ~s.contains("\\")
    return F.when(broken, F.lit(None).cast("array<string>")).otherwise(parsed)


def tags_from_parts(s: Column, stripped_list: Column) -> Column:
    """Final tag array from stripped text ``s`` and its ``parse_list``.
    Uses no lambda functions, so it compiles with whole-stage codegen."""
    quoted = (F.length(s) >= 2) & (
        (s.startswith('"') & s.endswith('"') & ~_inner(s).contains('"'))
        | (s.startswith("'") & s.endswith("'") & ~_inner(s).contains("'")))
    return (
        F.when(s.isNull() | (s == ""), F.array().cast("array<string>"))
        .when(stripped_list.isNotNull(), stripped_list)
        .when(quoted, F.array(strip_ws(_inner(s))))
        .otherwise(F.array(s))
    )


def parse_tags(raw: Column) -> Column:
    """Single-expression form (convenient, but Catalyst may evaluate the
    stripped text and the JSON parse more than once per row; ``with_tags``
    is the staged form for large tables)."""
    s = strip_ws(raw)
    return tags_from_parts(s, parse_list(s))


def with_tags(df: DataFrame, src: str = "violation_type", out: str = "tags",
              extra: dict[str, Column] | None = None) -> DataFrame:
    """Add the parsed tag array (and any ``extra`` columns) with each
    expensive step evaluated once per row.

    The stripped text and the JSON parse are separate projected columns
    (Catalyst does not inline a non-trivial expression that is referenced
    several times), and the outputs come out of a one-row ``inline``
    generator: a later filter on anything derived from them cannot be
    pushed below a generator (nor below an earlier repartition), so the
    parse is neither re-run inside the filter nor moved before the shuffle
    that spreads the rows.
    """
    keep = df.columns
    text = strip_ws(F.col(src))
    staged = df.select("*", text.alias("_tag_text"))
    staged = staged.select("*", fast_list(F.col("_tag_text")).alias("_tag_fast"))
    # ``from_json`` and the lambda functions have no generated code in
    # Spark; they are confined to this one projection and skipped (CASE
    # short-circuits) for rows the compiled fast path already split.
    general = clean_list(one_line(F.col("_tag_text"), parse_json_list(F.col("_tag_text"))))
    staged = staged.select(*keep, "_tag_text", F.when(F.col("_tag_fast").isNotNull(),
                                                      F.col("_tag_fast"))
                           .otherwise(general).alias("_tag_list"))
    fields = [tags_from_parts(F.col("_tag_text"), F.col("_tag_list")).alias(out)]
    fields += [c.alias(name) for name, c in (extra or {}).items()]
    return staged.select(*keep, F.inline(F.array(F.struct(*fields))))


def record_severity(tags: Column) -> Column:
    """Worst (max) weight among known parking tags, else 0.0.

    Tested weight group by weight group, highest first, with
    ``arrays_overlap`` (no lambda, so it compiles with whole-stage codegen).
    """
    groups: dict[float, list[str]] = {}
    for tag, w in PARKING_SEVERITY_WEIGHTS.items():
        groups.setdefault(float(w), []).append(tag)
    expr = None
    for w in sorted(groups, reverse=True):
        hit = F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in groups[w]])),
                         F.lit(False))
        expr = F.when(hit, F.lit(w)) if expr is None else expr.when(hit, F.lit(w))
    return expr.otherwise(F.lit(0.0))
