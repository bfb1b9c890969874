"""Reading code indexes in the public SCIP protobuf form.

The wire format is decoded in Python, document by document, inside ``mapInArrow``: one index
file is a row, its documents are the output, and everything after is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import scalar as X
from factloom.functions.symbols import parse_symbol

# Field numbers of the public schema.
INDEX = {"metadata": 1, "documents": 2}
METADATA = {"project_root": 3}
DOCUMENT = {"relative_path": 1, "occurrences": 2, "symbols": 3, "language": 4}
OCCURRENCE = {"range": 1, "symbol": 2, "symbol_roles": 3, "enclosing_range": 7, "single": 8, "multi": 9, "enclosing_single": 10, "enclosing_multi": 11}
INFORMATION = {"symbol": 1, "documentation": 3, "relationships": 4}
RELATIONSHIP = {"symbol": 1, "is_implementation": 3}


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message; values are integers or slices."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value = data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value = data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind} is not in use")
        yield tag >> 3, value


def numbers(value: int | memoryview) -> list[int]:
    """A repeated integer field's values, packed or one."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = varint(value, at)
        out.append(n)
    return out


def _text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _small(value: memoryview, names: tuple[str, ...]) -> dict[str, int]:
    got = dict(fields(value))
    return {n: int(got.get(i + 1, 0)) for i, n in enumerate(names)}


_SINGLE = ("line", "start_character", "end_character")
_MULTI = ("start_line", "start_character", "end_line", "end_character")


def occurrence(data: memoryview) -> dict:
    out: dict = {"symbol": "", "role": 0, "packed": [], "enclosing": [], "single": None, "multi": None, "enclosing_end": None}
    for n, v in fields(data):
        if n == OCCURRENCE["range"]:
            out["packed"] += numbers(v)
        elif n == OCCURRENCE["symbol"]:
            out["symbol"] = _text(v)
        elif n == OCCURRENCE["symbol_roles"]:
            out["role"] = v
        elif n == OCCURRENCE["enclosing_range"]:
            out["enclosing"] += numbers(v)
        elif n == OCCURRENCE["single"]:
            out["single"] = _small(v, _SINGLE)
        elif n == OCCURRENCE["multi"]:
            out["multi"] = _small(v, _MULTI)
        elif n == OCCURRENCE["enclosing_single"]:
            out["enclosing_end"] = _small(v, _SINGLE)["line"]
        elif n == OCCURRENCE["enclosing_multi"]:
            out["enclosing_end"] = _small(v, _MULTI)["end_line"]
    if out["enclosing_end"] is None and len(out["enclosing"]) in (3, 4):
        out["enclosing_end"] = out["enclosing"][0 if len(out["enclosing"]) == 3 else 2]
    del out["enclosing"]
    return out


def information(data: memoryview) -> dict:
    out: dict = {"symbol": "", "documentation": [], "implements": []}
    for n, v in fields(data):
        if n == INFORMATION["symbol"]:
            out["symbol"] = _text(v)
        elif n == INFORMATION["documentation"]:
            out["documentation"].append(_text(v))
        elif n == INFORMATION["relationships"]:
            got = dict(fields(v))
            if got.get(RELATIONSHIP["is_implementation"]) and len(got.get(RELATIONSHIP["symbol"], b"")):
                out["implements"].append(_text(got[RELATIONSHIP["symbol"]]))
    return out


def documents(data: bytes) -> Iterator[dict]:
    """Documents of an index, each with the project root."""
    view, root = memoryview(data), ""
    for n, v in fields(view):
        if n == INDEX["metadata"]:
            root = next((_text(x) for k, x in fields(v) if k == METADATA["project_root"]), "")
    for n, v in fields(view):
        if n != INDEX["documents"]:
            continue
        doc: dict = {"root": root, "path": "", "language": "", "occurrences": [], "symbols": []}
        for k, x in fields(v):
            if k == DOCUMENT["relative_path"]:
                doc["path"] = _text(x)
            elif k == DOCUMENT["language"]:
                doc["language"] = _text(x)
            elif k == DOCUMENT["occurrences"]:
                doc["occurrences"].append(occurrence(x))
            elif k == DOCUMENT["symbols"]:
                doc["symbols"].append(information(x))
        yield doc


_INT = pa.int32()
_DOCUMENT = pa.schema(
    [
        ("root", pa.string()),
        ("path", pa.string()),
        ("language", pa.string()),
        (
            "occurrences",
            pa.list_(
                pa.struct(
                    [
                        ("symbol", pa.string()),
                        ("role", _INT),
                        ("packed", pa.list_(_INT)),
                        ("single", pa.struct([(n, _INT) for n in _SINGLE])),
                        ("multi", pa.struct([(n, _INT) for n in _MULTI])),
                        ("enclosing_end", _INT),
                    ]
                )
            ),
        ),
        ("symbols", pa.list_(pa.struct([("symbol", pa.string()), ("documentation", pa.list_(pa.string())), ("implements", pa.list_(pa.string()))]))),
    ]
)
_DDL = (
    "root string, path string, language string, occurrences array<struct<symbol:string,role:int,packed:array<int>,"
    "single:struct<line:int,start_character:int,end_character:int>,multi:struct<start_line:int,start_character:int,end_line:int,end_character:int>,enclosing_end:int>>, "
    "symbols array<struct<symbol:string,documentation:array<string>,implements:array<string>>>"
)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0).to_pylist():
            rows: list[dict] = []
            for doc in documents(data):
                rows.append(doc)
                if len(rows) == 100:
                    yield pa.RecordBatch.from_pylist(rows, _DOCUMENT)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _DOCUMENT)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all index files under *path*."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode, _DDL)


def resolve_prefix(docs: DataFrame, tree: DataFrame, sample: int = 24) -> str:
    """The folder under which most of the first documents exist in *tree* (path); of equals the first: none, suffixes of the root, top folders."""
    first = [r["path"] for r in docs.where("path <> ''").select("path").limit(sample).collect()]
    root = docs.select("root").limit(1).collect()
    parts = [p for p in (root[0]["root"].removeprefix("file://") if root else "").split("/") if p]
    tops = sorted(r[0] for r in tree.where("path like '%/%'").select(F.substring_index("path", "/", 1)).distinct().limit(1000).collect())
    named = ["", *("/".join(parts[i:]) for i in range(len(parts) - 1, -1, -1)), *(t for t in tops if not t.startswith("."))]
    spark = docs.sparkSession
    tried = spark.createDataFrame([(i, c, f"{c}/{p}" if c else p) for i, c in enumerate(dict.fromkeys(named)) for p in first], "rank int, prefix string, path string")
    best = tried.join(tree.select("path").distinct(), "path", "left_semi").groupBy("rank", "prefix").count().orderBy(F.desc("count"), "rank").first()
    return best["prefix"] if best else ""


def ingest(docs: DataFrame, prefix: str = "", generated: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fact tables files, symbols, occurrences and implements edges of decoded documents.

    Locals are dropped, paths that leave the repository as well; ids come from the texts of
    symbols and paths, so two builds agree and no step orders all rows.  *generated* holds (path, generated).
    """
    path = X.normalise_path(F.concat(F.lit(prefix + "/" if prefix else ""), F.col("path")))
    docs = docs.withColumn("path", path).where("path is not null")
    lang = X.detect_lang(F.col("language"), F.col("path"))
    files = docs.groupBy("path").agg(F.max(lang).alias("lang"))
    if generated is not None:
        files = files.join(generated.select("path", "generated"), "path", "left")
        files = files.withColumn("generated", F.coalesce("generated", F.lit(False)))
    else:
        files = files.withColumn("generated", F.lit(False))
    files = files.withColumns({"is_test": X.is_test_path(F.col("path")), "id": X.stable_id(F.col("path"))})

    occ = docs.select("path", F.explode("occurrences").alias("o")).where("o.symbol <> '' and not startswith(o.symbol, 'local ')")
    at = X.occurrence_range(F.col("o.single"), F.col("o.multi"), F.col("o.packed"))
    occ = occ.select("path", F.col("o.symbol").alias("symbol"), at.alias("at"), F.col("o.role").alias("role"), F.col("o.enclosing_end").cast("bigint").alias("enc_end"))
    info = docs.select(F.explode("symbols").alias("s"), lang.alias("lang")).select("s.symbol", "s.documentation", "s.implements", "lang")
    named = occ.select("symbol").unionAll(info.select("symbol")).unionAll(info.select(F.explode("implements"))).distinct()
    doc = info.where(F.size("documentation") > 0).groupBy("symbol").agg(F.max(X.clean_doc(F.col("documentation"))).alias("doc"))
    langs = docs.select(lang.alias("lang"), F.explode("occurrences.symbol").alias("symbol")).groupBy("symbol").agg(F.min("lang").alias("lang"))
    symbols = named.join(doc, "symbol", "left").join(langs, "symbol", "left").withColumn("p", parse_symbol("symbol"))
    symbols = symbols.withColumn("hash", X.symbol_hash(F.col("symbol")))
    symbols = symbols.select(
        X.stable_id(F.col("symbol")).alias("id"), "symbol", "hash", "p.name", "p.module", "p.container", X.container_leaf(F.col("p.container")).alias("container_leaf"),
        F.col("p.package").alias("pkg"), "p.kind", F.coalesce("lang", F.lit(0)).alias("lang"), "doc",
    )
    ids = symbols.select("symbol", F.col("id").alias("symbol_id"))
    occ = occ.join(ids, "symbol").join(files.select("path", F.col("id").alias("file_id")), "path")
    occ = occ.select("file_id", "symbol_id", "at.line", "at.col_start", "at.col_end", "role", "enc_end")
    pair = info.select("symbol", F.explode("implements").alias("to")).distinct()
    implements = pair.join(ids.withColumnRenamed("symbol_id", "src"), "symbol").join(ids.select(F.col("symbol").alias("to"), F.col("symbol_id").alias("dst")), "to")
    implements = implements.select("src", "dst", F.lit(S.IMPLEMENTS).alias("kind"), F.lit(S.EXACT).alias("source"), F.lit(1.0).alias("confidence"))
    return {"files": files, "symbols": symbols, "occurrences": occ, "implements": implements}
