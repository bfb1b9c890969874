"""Column expressions over names, paths and commands."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import rules

#: Handle alphabet. Fixed value.
ALPHABET = "abcdefghijkmnpqrstuvwxyz23456789"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def symbol_hash(symbol: Column) -> Column:
    """128 bits of a symbol's text as hex."""
    return F.substring(F.sha2(symbol, 256), 1, 32)


def stable_id(text: Column) -> Column:
    """60 bits of a text's hash: an id that needs no ordering of all rows and is the same in every build."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def handle_text(hash_hex: Column, length: int = 12) -> Column:
    """The first *length* base-32 characters of a hash: five bits each, from the left."""

    def char(i: int) -> Column:
        bit = 5 * i
        window = F.conv(F.substring(hash_hex, bit // 4 + 1, 3), 16, 10).cast("int")
        value = F.shiftright(window, 12 - 5 - bit % 4).bitwiseAND(31)
        return F.substr(F.lit(ALPHABET), value + 1, F.lit(1))

    return F.concat(*[char(i) for i in range(length)])


def same_rpc(a: Column) -> Column:
    """Key under which two spellings of an RPC's name meet: case and underscores do not count."""
    return F.replace(F.lower(a), F.lit("_"), F.lit(""))


def container_leaf(container: Column) -> Column:
    """Last path segment without the marks that end a descriptor."""
    return F.regexp_replace(F.substring_index(container, "/", -1), r"[#.()]+$", "")


def qualified(name: Column, container: Column) -> Column:
    """``Type.name`` for members of a type, else the name."""
    leaf = F.regexp_extract(container, r"([^/#.]*)#$", 1)
    return F.when(container.endswith("#") & (leaf != ""), F.concat(leaf, F.lit("."), name)).otherwise(name)


def location(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit(":"), (line + 1).cast("string"))


def is_under_resolved_attribute(kind: Column, container: Column) -> Column:
    return F.coalesce((kind == 2) & container.endswith("#"), F.lit(False))


def is_distinctive(name: Column) -> Column:
    """Names that do not occur as text by chance: long, with an underscore, or with an inner capital."""
    return (F.octet_length(name) >= 12) | name.contains("_") | F.substr(name, F.lit(2)).rlike(r"\p{Lu}")


def is_admitted_literal(text: Column) -> Column:
    return (F.octet_length(text) >= 4) & (F.trim(text) != "") & ~text.rlike(r"^[0-9.]+$")


def looks_like_text(subject: Column) -> Column:
    """Subjects to search as text rather than as a name."""
    return subject.rlike(r"[ /\-]") | ((F.length(subject) > 3) & subject.rlike(r"^[A-Z0-9_]+$") & subject.rlike("[A-Z]"))


def is_test_path(path: Column, pack: dict = rules.DEFAULT) -> Column:
    tests, name = pack["tests"], F.substring_index(path, "/", -1)
    return any_of(
        [name.endswith(s) for s in tests["file_suffixes"]]
        + [name.startswith("test_") & name.endswith(".py")]
        + [path.contains(s) for s in tests["path_contains"]]
        + [path.startswith(s) for s in tests["path_prefixes"]]
    )


def is_build_variant(path: Column, pack: dict = rules.DEFAULT) -> Column:
    return any_of([path.contains(s) for s in pack["build_selected"]["path_contains"]])


def detect_lang(language: Column, path: Column) -> Column:
    said, ext = F.lower(language), F.regexp_extract(path, r"\.([^./]+)$", 1)
    by_name = F.when(said == "python", 1).when(said == "go", 2).when(said.isin("typescript", "javascript", "tsx"), 3)
    by_path = F.when(ext.isin("py", "pyi"), 1).when(ext == "go", 2).when(ext.isin("ts", "tsx", "js", "jsx"), 3).otherwise(0)
    return F.coalesce(by_name, by_path)


def normalise_lang(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(n.isin("python", "py", "pyi"), "py").when(n.isin("go", "golang"), "go").when(n.isin("typescript", "javascript", "ts", "tsx", "js", "jsx"), "ts").otherwise(n)


def normalise_path(path: Column) -> Column:
    """A path without ``.`` and ``..``; null if it leaves the root or nothing is left."""
    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def occurrence_range(single: Column, multi: Column, packed: Column) -> Column:
    """struct(line, col_start, col_end): the typed range if there is one, else the packed one."""
    def at(line: Column, start: Column, end: Column) -> Column:
        return F.struct(line.cast("bigint").alias("line"), start.cast("int").alias("col_start"), end.cast("int").alias("col_end"))

    item = lambda i: F.get(packed, F.lit(i))
    return (
        F.when(single.isNotNull(), at(single["line"], single["start_character"], single["end_character"]))
        .when(multi.isNotNull(), at(multi["start_line"], multi["start_character"], multi["end_character"]))
        .when(F.size(packed) == 3, at(item(0), item(1), item(2)))
        .when(F.size(packed) == 4, at(item(0), item(1), item(3)))
        .otherwise(at(F.lit(0), F.lit(0), F.lit(0)))
    )


def clean_doc(parts: Column, most: int = 1200) -> Column:
    """Documentation without leading code fences, parts joined by a blank, cut at *most* characters."""
    bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^(?:\s*```(?:(?!```)[\s\S])*(?:```|$))+", ""), r"^\s+|\s+$", ""))
    return F.substring(F.array_join(F.filter(bare, lambda p: p != ""), " "), 1, most)


def package_of(path: Column) -> Column:
    """Name of a file's folder, null if it holds a dot or there is none."""
    parts = F.split(path, "/")
    name = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) != ""), F.try_element_at(parts, F.lit(-2)))
    return F.when((name != "") & ~name.contains("."), name)


def classify(name: Column, pack: dict = rules.DEFAULT) -> Column:
    """struct(service, role) of a generated symbol's name, null for any other name."""
    proto = pack["proto"]
    strip = "|".join(re.escape(p) for p in proto["strip_prefixes"])

    def service(stem: Column) -> Column:
        stem = F.regexp_replace(stem, f"^(?:{strip})", "")
        stem = F.substring_index(stem, "_", 1)
        named = F.concat(F.upper(F.substring(stem, 1, 1)), F.substr(stem, F.lit(2)))
        return F.when(stem.contains(proto["service_marker"]), named)

    tried = []
    for rule in proto["bindings"]:
        before, after = rule.get("prefix", ""), rule.get("suffix", "")
        fits = name.startswith(before) & name.endswith(after) & (F.length(name) >= len(before) + len(after))
        found = service(F.substr(name, F.lit(len(before) + 1), F.length(name) - len(before) - len(after)))
        role = 0 if rule["role"] == "serves" else 1
        tried.append(F.when(fits & found.isNotNull(), F.struct(found.alias("service"), F.lit(role).alias("role"))))
    return F.coalesce(*tried)


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case letters, digits and dots; runs of anything else become one dash."""
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9.]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, most)
