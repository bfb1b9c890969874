"""Source trees: files, lines, literals, generated headers and the language survey."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import rules

HEAD_BYTES, MOST_BYTES, LITERAL_BYTES = 2048, 2 << 20, 200


def tree(spark: SparkSession, root: str, glob: str = "*", pack: dict = rules.DEFAULT) -> DataFrame:
    """(path, text, content_hash, bytes) of the text files of at most MOST_BYTES under *root*, skipped folders left out.

    ``too_large`` counts those that are longer.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.split("://")[-1].rstrip("/")
    path = F.regexp_replace("path", rf"^(?:\w+:/*)?/?{re.escape(base.lstrip('/'))}/", "")
    rows = read.where(F.col("length") <= MOST_BYTES).select(path.alias("path"), "content", F.col("length").alias("bytes"))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, pack["on_demand"]["skip_dirs"])))
    text = F.col("content").cast("string")
    return rows.where(~skipped & F.is_valid_utf8(text)).select("path", text.alias("text"), F.substring(F.sha2("content", 256), 1, 32).alias("content_hash"), "bytes")


def too_large(spark: SparkSession, root: str) -> int:
    """Files under *root* that *tree* leaves out for their size."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return read.where(F.col("length") > MOST_BYTES).count()


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines counted from 0."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))


_PYTHON = re.compile(
    r"(?P<comment>#[^\n]*)|(?P<triple>\"\"\"|''')(?P<prose>(?:\\.|(?!(?P=triple)).)*)(?:(?P=triple)|\Z)"
    r"|(?P<quote>[\"'])(?P<text>(?:\\.|(?!(?P=quote))[^\n])*)(?:(?P=quote)|\n|\Z)|`(?P<raw>(?:\\.|[^`])*)(?:`|\Z)",
    re.DOTALL,
)
_BRACED = re.compile(_PYTHON.pattern.replace("#[^\\n]*", r"//[^\n]*|/\*.*?(?:\*/|\Z)"), re.DOTALL)


def string_literals(text: str, path: str) -> list[tuple[int, str]]:
    """(line from 0, first line of the content) of quoted runs outside comments, up to LITERAL_BYTES bytes."""
    pattern = _BRACED if path.endswith((".go", ".ts", ".js")) else _PYTHON
    out, line, at = [], 0, 0
    for m in pattern.finditer(text):
        if m["comment"] is not None:
            continue
        line += text.count("\n", at, m.start())
        at = m.start()
        inner = next(x for x in (m["prose"], m["text"], m["raw"]) if x is not None)
        first = inner.split("\n", 1)[0].rstrip("\r")
        if first and len(first.encode()) <= LITERAL_BYTES:
            out.append((line, first))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("text", T.StringType())])))
def _literals(texts: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([[{"line": n, "text": s} for n, s in string_literals(t or "", p or "")] for t, p in zip(texts, paths, strict=True)])


def literals(files: DataFrame) -> DataFrame:
    """(path, line, text) of all literals in *files* (path, text)."""
    return files.select("path", F.explode(_literals("text", "path")).alias("l")).select("path", "l.line", "l.text")


_COMMENT = ("#", "//", "/*", "*", "--", "<!--")


def header(text: str) -> list[str]:
    """Lines of the leading comments and docstring, before the first line of code."""
    out, quoted = [], False
    for raw in text.splitlines():
        line = raw.strip()
        marks = line.count('"""') + line.count("'''")
        opens = line.startswith(('"""', "'''"))
        if quoted:
            quoted = marks == 0
        elif not line:
            continue
        elif opens and marks == 1:
            quoted = True
        elif not (line.startswith(_COMMENT) or (opens and marks > 1)):
            break
        out.append(line)
    return out


def is_generated(path: str, text: str | None, pack: dict = rules.DEFAULT) -> tuple[bool, int]:
    """Whether a file is generated, and how that is known: 0 not, 1 header, 3 path of an unreadable file."""
    if text is not None:
        head = text.encode()[:HEAD_BYTES].decode("utf-8", "ignore").lower()
        found = any(m in line for line in header(head) for m in pack["generated"]["markers"])
        return found, int(found)
    hinted = any(s in path for s in pack["generated"]["path_suffixes"])
    return hinted, 3 * hinted


@F.pandas_udf(T.StructType([T.StructField("generated", T.BooleanType()), T.StructField("gen_via", T.IntegerType())]))
def _generated(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([is_generated(p, t) for p, t in zip(paths, texts, strict=True)], columns=["generated", "gen_via"])


def generated(files: DataFrame) -> DataFrame:
    """(path, generated, gen_via) of *files* (path, text; null where unreadable); only heads reach Python."""
    return files.select("path", _generated("path", F.substring("text", 1, HEAD_BYTES)).alias("g")).select("path", "g.generated", "g.gen_via")


def extensions(files: DataFrame) -> DataFrame:
    """(ext) of each file that has one."""
    return files.select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext")).where("ext <> ''")


def excerpt(spans: DataFrame, source: DataFrame, most: int = 120) -> DataFrame:
    """(id, path, line, text): the first *most* lines of each span (id, path, start, end; from 0)."""
    cut = spans.withColumn("last", F.least("end", F.col("start") + most - 1)).alias("s")
    at = source.alias("l")
    return cut.join(at, (F.col("s.path") == F.col("l.path")) & F.col("l.line").between(F.col("s.start"), F.col("s.last"))).select("s.id", "l.path", "l.line", "l.text")
