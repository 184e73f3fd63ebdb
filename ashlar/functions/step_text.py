"""Lexical functions for STEP (ISO 10303-21) text: splitting, classifying and decoding fields."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_ESCAPE = re.compile(r"''|\\\\|\\S\\(.)|\\X\\([0-9A-Fa-f]{2})|\\X2\\((?:[0-9A-Fa-f]{4})*)\\X0\\|\\X4\\((?:[0-9A-Fa-f]{8})*)\\X0\\|\\P[A-I]\\", re.S)
# A list without lists or strings is one token, so long ones are not taken apart.
_TOKEN = re.compile(r"'(?:[^']|'')*'|/\*.*?\*/|\([^()'/]*\)|[(),]|[^'(),/]+|/", re.S)
_QUOTED = r"'(?:[^']|'')*'|/\*[\s\S]*?\*/"


def _unescape(m: re.Match) -> str:
    whole = m[0]
    if whole == "''":
        return "'"
    if whole == "\\\\":
        return "\\"
    if m[1] is not None:
        return chr(ord(m[1]) + 128) if ord(m[1]) < 128 else m[1]
    if m[2] is not None:
        return chr(int(m[2], 16))
    if m[3] is not None:
        return bytes.fromhex(m[3]).decode("utf-16-be", "replace")
    if m[4] is not None:
        return bytes.fromhex(m[4]).decode("utf-32-be", "replace")
    return ""


def decode_text(body: str) -> str:
    """The text of a string literal's inside: doubled quotes, \\S\\, \\X\\, \\X2\\ and \\X4\\ escapes."""
    return _ESCAPE.sub(_unescape, body)


def decode_bytes(raw: bytes) -> str:
    """UTF-8 if the bytes are that, else Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def split_args(body: str) -> list[str]:
    """The fields between top-level commas; quotes, parentheses and comments are respected."""
    if "(" not in body and "'" not in body and "/" not in body:
        return [x.strip() for x in body.split(",")] if body.strip() else []
    out, depth, current = [], 0, []
    for token in _TOKEN.findall(body):
        if token == "," and depth == 0:
            out.append("".join(current).strip())
            current = []
            continue
        if token.startswith("/*"):
            continue
        depth += (token == "(") - (token == ")")
        current.append(token)
    last = "".join(current).strip()
    if last or out:
        out.append(last)
    return out


@F.pandas_udf(ArrayType(StringType()))
def split_fields(body: pd.Series) -> pd.Series:
    """split_args for a column, in Arrow batches; null stays null."""
    return body.map(lambda b: None if b is None else split_args(b))


_PIECE = r"(''|\\\\|\\S\\.|\\X\\[0-9A-Fa-f]{2}|\\X2\\(?:[0-9A-Fa-f]{4})*+\\X0\\|\\X4\\(?:[0-9A-Fa-f]{8})*+\\X0\\|\\P[A-I]\\|[^'\\]++|['\\])"


def _units(hexes: Column) -> Column:
    """Text of UTF-16 units in hex; units that are half a character become U+FFFD."""
    spaced = F.regexp_replace(F.upper(hexes), "(.{4})", "$1 ")
    high, low = "D[89AB][0-9A-F]{2} ", "D[C-F][0-9A-F]{2} "
    whole = F.regexp_replace(F.regexp_replace(spaced, f"{high}(?!{low})", "FFFD "), f"(?<!{high}){low}", "FFFD ")
    return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")


def _points(hexes: Column) -> Column:
    """Text of code points in eight hex digits each; values that are no character become U+FFFD."""
    hex4 = lambda n: F.lpad(F.hex(n), 4, "0")

    def one(h: Column) -> Column:
        n = F.conv(h, 16, 10).cast("bigint")
        above = n - 0x10000
        pair = F.concat(hex4(F.lit(0xD800) + F.shiftright(above, 10)), hex4(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        return F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "FFFD").when(n >= 0x10000, pair).otherwise(hex4(n))

    return F.decode(F.unhex(F.array_join(F.transform(F.regexp_extract_all(hexes, F.lit("(.{8})"), F.lit(1)), one), "")), "UTF-16BE")


def _piece(p: Column) -> Column:
    """What one piece of a string literal stands for."""
    inner = lambda n: F.substr(p, F.lit(n), F.greatest(F.char_length(p) - n - 3, F.lit(0)))
    last = F.substr(p, F.lit(4), F.lit(1))
    return (
        F.when(p == "''", "'").when(~p.startswith("\\") | (F.char_length(p) == 1), p).when(p == "\\\\", "\\").when(p.startswith("\\S\\"), F.when(F.ascii(last) < 128, F.char(F.ascii(last) + 128)).otherwise(last))
        .when(p.startswith("\\X\\"), F.char(F.conv(F.substr(p, F.lit(4), F.lit(2)), 16, 10).cast("int"))).when(p.startswith("\\X2\\"), _units(inner(5))).when(p.startswith("\\X4\\"), _points(inner(5))).otherwise("")
    )


def decode_string(body: Column) -> Column:
    """decode_text for a column, in the JVM; texts without a backslash need no taking apart."""
    slow = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_PIECE), F.lit(1)), _piece), "")
    return F.when(~F.contains(body, F.lit("\\")), F.replace(body, F.lit("''"), F.lit("'"))).otherwise(slow)


def kind(field: Column) -> Column:
    """null, star, string, ref, enum, list, number or other."""
    return (
        F.when(field == "$", "null").when(field == "*", "star").when(field.startswith("'"), "string").when(field.rlike(r"^#\d+$"), "ref")
        .when(field.rlike(r"^\.[A-Za-z0-9_]+\.$"), "enum").when(field.startswith("("), "list").when(number(field).isNotNull(), "number").otherwise("other")
    )


def number(field: Column) -> Column:
    """A field's number, null for anything else."""
    return F.when(field.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), field.try_cast("double"))


def enum(field: Column) -> Column:
    return F.nullif(F.regexp_extract(field, r"^\.([A-Za-z0-9_]+)\.$", 1), F.lit(""))


def string(field: Column) -> Column:
    """A string literal's decoded text, null for anything else."""
    quoted = field.startswith("'") & field.endswith("'") & (F.char_length(field) >= 2)
    return F.when(quoted, decode_string(F.substr(field, F.lit(2), F.char_length(field) - 2)))


def ref(field: Column) -> Column:
    return F.regexp_extract(field, r"^#(\d+)$", 1).try_cast("bigint")


def refs(field: Column) -> Column:
    """The step ids of a list, or of a single reference."""
    return F.transform(F.regexp_extract_all(field, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def all_refs(args: Column) -> Column:
    """The step ids anywhere in a record outside strings and comments."""
    return refs(F.regexp_replace(args, _QUOTED, ""))


def typed(field: Column) -> tuple[Column, Column]:
    """(value, type) of a wrapped value such as IFCLABEL('x'); booleans as True, False and UNKNOWN."""
    name = F.regexp_extract(field, r"(?s)^\s*([A-Z][A-Z0-9_]*)\s*\((.*)\)\s*$", 1)
    inner = F.when(name != "", F.trim(F.regexp_extract(field, r"(?s)^\s*([A-Z][A-Z0-9_]*)\s*\((.*)\)\s*$", 2))).otherwise(field)
    flag = F.element_at(F.create_map(F.lit(".T."), F.lit("True"), F.lit(".F."), F.lit("False")), inner)
    unknown = F.when((inner == ".U.") & (name == "IFCLOGICAL"), "UNKNOWN")
    value = F.when(inner.isin("$", "*", ""), None).otherwise(F.coalesce(flag, unknown, string(inner), enum(inner), inner))
    return value, F.nullif(name, F.lit(""))


def last_enum(fields: Column) -> Column:
    """The right-most enumeration before which only nulls and stars stand."""
    kept = F.filter(fields, lambda f: ~f.isin("$", "*"))
    return enum(F.element_at(kept, -1))


def last_number(fields: Column) -> Column:
    """The right-most number before which only nulls, stars and enumerations stand."""
    kept = F.filter(fields, lambda f: ~f.isin("$", "*") & ~f.rlike(r"^\.[A-Za-z0-9_]+\.$"))
    return number(F.element_at(kept, -1))


def real(x: Column) -> Column:
    """A number as STEP text, always with a decimal point."""
    text = x.cast("string")
    return F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))
