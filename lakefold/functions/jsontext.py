"""JSON held in a text column."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .arrays import let, prefix_sums, tree_links

# One JSON string literal; possessive, so long strings do not deepen the stack.
STRING_LITERAL = '"(?:[^"\\\\]|\\\\.)*+"'
TOKEN = STRING_LITERAL + "|[{}\\[\\]:,]|[^\\s{}\\[\\]:,\"]++"

# A text nested more deeply than the readers allow holds this many opening brackets; a longer one may hold a longer string.
_OPEN, _LONG = 900, 20_000_000
_DEEP = f"(?s)^(?:[^{{\\[]*+[{{\\[]){{{_OPEN}}}"

_SCALAR = re.compile(r'-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null', re.ASCII)
_QUOTED = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_BLANK = re.compile(r"[ \t\r\n]*+")


def _first_error(text: str) -> int | None:
    """Where a text stops being one JSON value, None if it is one; open brackets are kept in a list, so any depth goes."""
    open_brackets: list[str] = []
    at, wanted = 0, "value"
    while True:
        at = _BLANK.match(text, at).end()
        if wanted == "end" and not open_brackets:
            return None if at == len(text) else at
        mark = text[at : at + 1]
        if wanted in ("value", "first") and mark in ("{", "["):
            open_brackets.append(mark)
            at, wanted = at + 1, "first key" if mark == "{" else "first"
        elif open_brackets and mark == ("}" if open_brackets[-1] == "{" else "]") and wanted in ("end", "first", "first key"):
            open_brackets.pop()
            at, wanted = at + 1, "end"
        elif wanted == "end":
            if mark != ",":
                return at
            at, wanted = at + 1, "key" if open_brackets[-1] == "{" else "value"
        elif wanted in ("key", "first key"):
            found = _QUOTED.match(text, at)
            if not found:
                return at
            at = _BLANK.match(text, found.end()).end()
            if text[at : at + 1] != ":":
                return at
            at, wanted = at + 1, "value"
        else:
            found = _QUOTED.match(text, at) or _SCALAR.match(text, at)
            if not found:
                return at
            at, wanted = found.end(), "end"


_STRICT = '("(?:[^"\\\\\\x00-\\x1f]|\\\\(?:["\\\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|[{}\\[\\]:,]|-?(?:0|[1-9][0-9]*+)(?:\\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null)'


def _valid_beyond(text: Column) -> Column:
    """Whether a text of any depth and length is one JSON value, by its tokens.

    Nothing but tokens and blanks may be there; a token's container is its parent in the tree of depths; and each token
    must be one that may follow the token before it in its container.
    """
    tokens = F.regexp_extract_all(text, F.lit(_STRICT), F.lit(1))
    step = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)

    def follows(toks: Column, t: Column, i: Column, parent: Column) -> Column:
        before, earlier = F.get(toks, i - 1), F.get(toks, i - 2)
        box = F.get(toks, parent)
        ended = ~before.isin("{", "[", ":", ",")
        word = ended & ~before.isin("}", "]")
        in_list = F.when(t == "]", ended | (before == "[")).when(t == ",", ended).when(t.isin(":", "}"), False).otherwise(before.isin(",", "["))
        told = ended & (~word | (earlier == ":"))  # a member is a key and its value
        in_object = (
            F.when(t == "}", told | (before == "{")).when(t == ",", told).when(t == ":", before.startswith('"') & earlier.isin("{", ",")).when(t == "]", False)
            .when(t.startswith('"'), before.isin(":", ",", "{")).otherwise(before == ":")
        )
        return F.when(parent.isNull(), (i == 0) & ~t.isin("}", "]", ":", ",")).when(box == "[", in_list).otherwise(in_object)

    def check(toks: Column) -> Column:
        links = tree_links(prefix_sums(F.transform(toks, step)))
        fits = let(links, lambda ls: F.forall(F.transform(toks, lambda t, i: F.coalesce(follows(toks, t, i, F.get(ls, i)["parent"]), F.lit(False))), lambda ok: ok))
        return (F.size(toks) > 0) & (F.aggregate(toks, F.lit(0), lambda n, t: n + step(t)) == 0) & fits

    return (F.regexp_replace(text, _STRICT + "|[ \\t\\r\\n]++", "") == "") & let(tokens, check)


def is_valid_json(text: Column) -> Column:
    """Whether the text is exactly one JSON value.

    The JSON readers stop after the first value and so accept trailing text.  A text that parses
    both as an object member and as an array element can only be one complete value.  They also refuse
    texts nested deeper than 1,000 levels or with strings over 20 million characters; texts that could
    have either are checked token by token, so depth and length have no limit.
    """
    beyond = text.rlike(_DEEP) | (F.length(text) >= _LONG)
    return F.coalesce(F.when(beyond, _valid_beyond(text)).otherwise(_read(text)), F.lit(False))


def _read(text: Column) -> Column:
    """Whether the JSON reader takes the text as one value."""
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad"}
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v STRING, _bad STRING", options)
    element = F.from_json(F.concat(F.lit('{"v":['), text, F.lit("]}")), "v ARRAY<STRING>, _bad STRING", options)
    return text.isNotNull() & member["_bad"].isNull() & element["_bad"].isNull()


def json_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def json_profile(text: Column) -> Column:
    """valid, data_type, keys, arrays, objects, max_depth; the root is level 1 and scalars count.

    Counted over structural characters after string literals are blanked out, in one linear fold.
    """
    invalid = F.struct(
        F.lit(False).alias("valid"),
        F.lit(None).cast("string").alias("data_type"),
        *[F.lit(None).cast("bigint").alias(n) for n in ("keys", "arrays", "objects", "max_depth")],
    )
    return F.when(is_valid_json(text), let(F.regexp_replace(text, STRING_LITERAL, "s"), _count)).otherwise(invalid)


def _count(bare: Column) -> Column:
    marks = F.regexp_extract_all(bare, F.lit("([{}\\[\\]]|[^\\s{}\\[\\]:,]++)"), F.lit(1))
    walked = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest")),
        lambda acc, m: F.struct(
            (acc["depth"] + F.when(m.isin("{", "["), 1).when(m.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            F.greatest(
                acc["deepest"],
                acc["depth"] + F.when(m.isin("}", "]"), 0).otherwise(1),
            ).alias("deepest"),
        ),
    )
    # a key is followed by a colon and is not a level of its own, but its value always is
    kind = F.substring(F.ltrim(bare), 1, 1)
    return F.struct(
        F.lit(True).alias("valid"),
        F.when(kind == "[", "array")
        .when(kind.isin("{", "n"), "object")
        .when(kind == "s", "string")
        .when(kind.isin("t", "f"), "boolean")
        .otherwise("number")
        .alias("data_type"),
        F.regexp_count(bare, F.lit(":")).cast("bigint").alias("keys"),
        F.regexp_count(bare, F.lit("\\[")).cast("bigint").alias("arrays"),
        F.regexp_count(bare, F.lit("\\{")).cast("bigint").alias("objects"),
        walked["deepest"].cast("bigint").alias("max_depth"),
    )


def _canonical_scalar(token: Column) -> Column:
    """Numbers in shortest decimal form, strings with only the necessary escapes."""
    number = F.regexp_replace(
        token.try_cast("double").cast("string").try_cast("decimal(38,15)").cast("string"), "\\.?0+$", ""
    )
    rewritten = F.to_json(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"))
    return (
        F.when(token.startswith('"') & F.contains(token, F.lit("\\")),
               F.substring(rewritten, F.lit(2), F.length(rewritten) - 2))
        .when(token.rlike("^-?\\d+[.eE]"), F.coalesce(number, token))
        .otherwise(token)
    )


def json_pretty(text: Column) -> Column:
    """Two-space indented rendering of a valid document, null for an invalid one.

    The VARIANT and struct writers have no matching layout, so the token list is re-joined.
    """
    return F.when(is_valid_json(text), let(json_tokens(text), _lay_out))


def _lay_out(toks: Column) -> Column:
    steps = F.transform(toks, lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0))

    def line_break(level: Column) -> Column:
        return F.concat(F.lit("\n"), F.repeat(F.lit("  "), level))

    def render(t: Column, i: Column, depth: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        empty_after = F.coalesce(F.get(toks, i + 1).isin("}", "]"), F.lit(False))
        empty_before = F.coalesce(F.get(toks, i - 1).isin("{", "["), F.lit(False))
        return (
            F.when(opens & ~empty_after, F.concat(t, line_break(depth + 1)))
            .when(closes & ~empty_before, F.concat(line_break(depth - 1), t))
            .when(t == ",", F.concat(t, line_break(depth)))
            .when(t == ":", F.lit(": "))
            .otherwise(_canonical_scalar(t))
        )

    placed = F.zip_with(toks, prefix_sums(steps), lambda t, d: F.struct(t.alias("t"), d.alias("d")))
    laid_out = F.transform(placed, lambda p, i: render(p["t"], i, p["d"]))
    return F.array_join(laid_out, "")


@F.pandas_udf(IntegerType())
def _error_position(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> int | None:
        if t is None:
            return None
        try:
            json.loads(t)
        except json.JSONDecodeError as err:
            return err.pos
        except RecursionError:
            return _first_error(t)
        return None

    return text.map(one).astype("Int32")


def json_error_context(text: Column, reach: int = 20) -> Column:
    """Position of the first error and the text around it, null for valid documents.

    Only rows that the JSON reader refuses carry their text into the Python worker.
    """
    position = _error_position(F.when(~_read(text), text))
    start = F.greatest(position - reach, F.lit(0))
    return F.when(
        position.isNotNull(),
        F.struct(
            position.alias("position"),
            F.substring(text, start + 1, position - start).alias("before"),
            F.substring(text, position + 1, F.lit(reach)).alias("after"),
        ),
    )
