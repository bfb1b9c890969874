"""The questions from a shell: ``python -m factloom --base DIR COMMAND ...``.

Exit codes: 0 found, 1 nothing found, 2 a bad question, 3 a fact base that is missing or a layer that is empty.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom import schema as S
from factloom import sinks
from factloom.build import build
from factloom.engine import Ambiguous, Engine
from factloom.envelope import Envelope
from factloom.sources import code, worktree

#: command: positional arguments, those that may be left out with a question mark.
COMMANDS = {
    "symbol": ["needle"], "refs": ["subject"], "usage": ["subject"], "graph": ["subject"], "callees": ["subject"], "tests": ["subject"], "path": ["source", "target"],
    "weaklinks": ["subject"], "unreached": ["prefix?"], "outline": ["prefix?"], "topology": [], "entrypoints": ["reaching?"], "runs": ["subject"], "reaches": ["subject"],
    "calls-over": ["subject"], "callers-of-type": ["subject"], "affects": ["subject"], "literal": ["needle"], "docs": ["query?"], "line": ["file", "number"], "context": ["query"], "status": [],
    "expand": ["subject"], "find": ["needle"], "change": ["subject"], "understand": ["subject"], "unlinked": ["subject"], "coverage": [], "checks": ["head?"],
    "verdict": ["check", "area", "holds", "note?", "commit?"], "concept": ["name", "note?"], "concepts": ["namespace?"], "about": ["name", "subject"], "drop": ["namespace"],
    "link": ["source", "target", "note?"], "links": ["subject"], "structure": ["prefix"], "layers": [], "candidates": [],
}
#: Commands that read the source tree, which --repository names.
READ_TREE = {"expand", "find", "change", "unlinked", "coverage"}


def answer(engine: Engine, command: str, given: list[str], repository: str | None = None):  # noqa: ANN201
    """An envelope, a dictionary of them, or None for a command that writes."""
    files = code.tree(engine.spark, repository) if repository else None
    if files is None and command in READ_TREE:
        raise ValueError("name the source tree by --repository")
    if command in ("expand", "unlinked", "find", "change"):
        ask = {"expand": engine.expand, "unlinked": engine.unlinked_calls, "find": engine.for_find, "change": engine.for_change}[command]
        return ask(given[0], code.lines(files))
    if command == "coverage":
        return engine.coverage(code.extensions(files).groupBy(F.col("ext").alias("lang")).agg(F.count("*").alias("files")))
    if command == "layers":
        return engine.layers(None if files is None else worktree.indexable(engine.spark, repository))
    if command == "checks":
        return engine.standings(given[0] if given else worktree.head_commit(engine.spark, repository) if repository else None)
    if command == "docs":
        return engine.docs(*given, lines=None if files is None else code.lines(files).withColumn("line", F.col("line") + 1))
    if command in WRITES:
        return WRITES[command](engine, given)
    if command == "line":
        return engine.line(given[0], int(given[1]))
    if command == "callees":
        return engine.graph(*given, outward=True)
    if command == "calls-over":
        return engine.reaches(*given, outgoing=True)
    if command == "concepts":
        return Envelope(engine.authored.concepts(*given))
    if command == "links":
        return Envelope(engine.authored.asserted(engine.t["symbols"], engine.subject(given[0])))
    return getattr(engine, {"status": "verify", "callers-of-type": "callers_of_type", "understand": "for_understand"}.get(command, command))(*given)


def _hash(engine: Engine, given: str) -> str:
    return engine.t["symbols"].where(F.col("id") == engine.subject(given)).first()["hash"]


def _about(engine: Engine, given: list[str]) -> None:
    files = engine.t["files"].select(F.col("id").alias("def_file_id"), "path", "content_hash")
    engine.authored.link_concept(given[0], engine.t["symbols"].where(F.col("id") == engine.subject(given[1])).join(files, "def_file_id", "left"))


def _verdict(engine: Engine, given: list[str]) -> None:
    if given[2] not in ("yes", "no"):
        raise ValueError("a verdict is yes or no")
    engine.authored.record_verdict(given[0], given[1], given[2] == "yes", *given[3:])


WRITES = {
    "concept": lambda engine, given: engine.authored.add_concept(*given),
    "about": _about,
    "drop": lambda engine, given: engine.authored.drop_namespace(given[0]),
    "link": lambda engine, given: engine.authored.assert_link(_hash(engine, given[0]), _hash(engine, given[1]), note=given[2] if len(given) > 2 else ""),
    "verdict": _verdict,
}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom", description=__doc__)
    p.add_argument("--base", required=True, help="folder of the fact base")
    p.add_argument("--limit", type=int, default=40)
    p.add_argument("--budget", type=int, help="tokens of output")
    p.add_argument("--log", help="folder of the session log")
    p.add_argument("--repository", help="the source tree, for commands that read it")
    p.add_argument("--changed", action="append", help="a path that changed since the build (repeat it; an empty one says that none did)")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
    c = sub.add_parser("index")
    c.add_argument("index")
    c.add_argument("tree")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return S.BAD_QUERY if e.code else S.FOUND
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    began, exit_code, rows = time.monotonic(), S.FOUND, 0
    try:
        if a.command == "index":
            print(sinks.write_build(spark, a.base, build(spark, a.index, a.tree), {"symbols": ["id"], "deploy_reach": ["symbol_id"]}))
        else:
            given = [getattr(a, x.rstrip("?")) for x in COMMANDS[a.command]]
            engine = Engine(spark, a.base, None if a.changed is None else {x for x in a.changed if x})
            if a.changed is None and a.repository:
                engine.dirty = worktree.dirty(spark, a.repository, engine.t["files"])
            found = answer(engine, a.command, [g for g in given if g is not None], a.repository)
            parts = found if isinstance(found, dict) else {"": found} if found is not None else {}
            text = "\n".join(f"{name}:\n{e.render(a.limit, a.budget)}" if name else e.render(a.limit, a.budget) for name, e in parts.items())
            exits = {e.exit for e in parts.values()}
            exit_code = next((x for x in (S.DEGRADED, S.FOUND, S.NOT_FOUND) if x in exits), S.FOUND)
            rows = text.count("\n")
            print(text or "done")
    except Ambiguous as e:
        candidates = e.args[0]
        print("\n".join(f"{r['name']}  {r['module']}" for r in candidates) or "no symbol of this name", file=sys.stderr)
        exit_code = S.BAD_QUERY if candidates else S.NOT_FOUND
    except ValueError as e:
        print(e, file=sys.stderr)
        exit_code = S.BAD_QUERY
    except sinks.Degraded as e:
        print(e, file=sys.stderr)
        exit_code = S.DEGRADED
    if a.log:
        sinks.log_session(spark, a.log, " ".join(argv), exit_code, rows, time.monotonic() - began)
    return exit_code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
