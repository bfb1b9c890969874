"""Symbol strings: ``scheme manager package version descriptors``, names quoted by backticks."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schema as S

_FIELD = re.compile(r"((?:`[^`]*(?:`|$)|[^` ])*)(?: |$)")
#: A descriptor: its name (perhaps quoted) and its suffix.
_LAST = re.compile(r"(?P<name>`[^`]*`|[^`/#.()\[\]!:]*)(?P<suffix>\([^()]*\)\.|[/#.!]|:)$|\((?P<parameter>`[^`]*`|[^()`]*)\)$|\[(?P<type>`[^`]*`|[^\[\]`]*)\]$")
_KINDS = {"/": S.NAMESPACE, "#": S.TYPE, ".": S.TERM, "!": S.META}


class Parsed(NamedTuple):
    scheme: str
    package: str
    name: str
    kind: int
    container: str | None
    module: str


def parse(symbol: str) -> Parsed | None:
    """Fields of a symbol string, None if it has fewer than four before the descriptors."""
    if symbol.startswith("local "):
        return Parsed("local", "", symbol[6:], S.LOCAL, None, "")
    fields, at = [], 0
    for _ in range(4):
        if at >= len(symbol):
            return None
        m = _FIELD.match(symbol, at)
        fields.append(m[1])
        at = m.end()
    text = symbol[at:]
    module = text.split("/", 1)[0].strip("`") if "/" in text else ""
    m = _LAST.search(text)
    if not m:
        return Parsed(fields[0], fields[2], text, S.UNKNOWN, None, module)
    if m["parameter"] is not None or m["type"] is not None:
        kind, name = (S.PARAMETER, m["parameter"]) if m["parameter"] is not None else (S.TYPE_PARAMETER, m["type"])
    else:
        kind, name = (S.METHOD if m["suffix"].endswith(").") else _KINDS.get(m["suffix"], S.UNKNOWN)), m["name"]
    return Parsed(fields[0], fields[2], name.strip("`"), kind, text[: m.start()] or None, module)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType() if n == "kind" else T.StringType()) for n in Parsed._fields]))
def parse_symbol(symbols: pd.Series) -> pd.DataFrame:
    rows = [parse(s) if s else None for s in symbols]
    return pd.DataFrame([r or (None,) * 6 for r in rows], columns=list(Parsed._fields))
