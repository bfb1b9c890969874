"""Readers of code, prose and deployment files; a fact base from files to answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom import sinks
from factloom.build import build
from factloom.engine import Ambiguous, Engine
from factloom.envelope import Budget, Envelope, lines_around
from factloom.sources import code, deployment, markdown, scip, worktree


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(n, v):
    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


def occurrence(symbol, at, role=0, end=None):
    out = field(1, b"".join(map(varint, at))) + field(2, symbol.encode()) + (field(3, role) if role else b"")
    return out + (field(11, field(1, at[0]) + field(3, end)) if end is not None else b"")


def document(path, language, occurrences, info=()):
    return field(2, field(1, path.encode()) + field(4, language.encode()) + b"".join(field(2, o) for o in occurrences) + b"".join(field(3, i) for i in info))


P = "scip-python python shop 1 "
MAIN, PRICE, TOTAL, ORDER = P + "main/run().", P + "price/compute().", P + "price/Order#total().", P + "price/Order#"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "app/tests").mkdir(parents=True)
    (root / "index").mkdir()
    (root / "app/main.py").write_text('def run():\n    name = "compute_total_price"\n    compute()\n\nif True:\n    run()\n')
    (root / "app/price.py").write_text("class Order:\n    def total(self):\n        return compute()\n\ndef compute():\n    return 1\n")
    (root / "app/tests/test_price.py").write_text("def test_it():\n    compute()\n")
    (root / "README.md").write_text("---\nx: 1\n---\n# Shop\nwords here\n```\n# not a heading\n```\n### Deep\nmore words here\n## Next\n")
    (root / "compose.yaml").write_text("services:\n  shop:\n    build: {context: ./app}\n    command: [python3, -m, main]\n    ports: ['80:80']\n  hold:\n    command: sleep infinity\n")
    (root / "cron.sh").write_text("WORKER=shop\n# comment\n30 3 * * * docker exec $(docker ps -q -f name=${WORKER}) sh /x/nightly.sh\n")
    (root / "nightly.sh").write_text('#!/bin/sh\nexec python -m price "$@"\n')
    docs = [
        document("main.py", "python", [occurrence(MAIN, [0, 4, 7], 1, 2), occurrence(PRICE, [2, 4, 11]), occurrence(MAIN, [5, 4, 7]), occurrence("local 1", [1, 4, 8], 1)]),
        document("price.py", "python", [occurrence(ORDER, [0, 6, 11], 1, 2), occurrence(TOTAL, [1, 8, 13], 1, 2), occurrence(PRICE, [2, 15, 22]), occurrence(PRICE, [4, 4, 11], 1, 5)], [field(1, PRICE.encode()) + field(3, b"```py\ndef\n```\nComputes.")]),
        document("tests/test_price.py", "python", [occurrence(P + "test/test_it().", [0, 4, 11], 1, 1), occurrence(PRICE, [1, 4, 11])]),
    ]
    (root / "index/a.scip").write_bytes(field(1, field(3, b"file:///work/app")) + b"".join(docs))
    return root


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('facts')}"
    sinks.write_build(spark, at, build(spark, f"file://{repo}/index", f"file://{repo}"), {"symbols": ["id"]})
    return Engine(spark, at)


def names(envelope, *columns):
    return [tuple(r[c] for c in columns) for r in envelope.collect(50)]


def test_paths_get_their_prefix(engine):
    got = {r["path"]: r["is_test"] for r in engine.t["files"].collect()}
    assert got == {"app/main.py": False, "app/price.py": False, "app/tests/test_price.py": True}


def test_answers(engine):
    assert names(engine.graph("compute", depth=1), "name", "depth") == [("compute", 0), ("run", 1), ("Order.total", 1), ("test_it", 1)] or len(names(engine.graph("compute", depth=1), "name")) == 4
    assert {n for (n,) in names(engine.tests("compute"), "name")} == {"test_it"}
    assert names(engine.path("run", "compute"), "name") == [("run",), ("compute",)]
    assert sorted(names(engine.refs("compute"), "path", "enclosing")) == [("app/main.py", "run"), ("app/price.py", "total"), ("app/tests/test_price.py", "test_it")]
    assert ("compute", "direct") in [("compute", v) for _, v in names(engine.runs("compute"), "service", "via")]
    assert {s for (s,) in names(engine.entrypoints(), "service")} == {"shop", "hold", "shop (30 3 * * *)"}
    assert names(engine.docs("deep"), "trail") == [("Shop > (unnamed) > Deep",)]
    assert names(engine.line("app/price.py", 3), "what", "name")[0] == ("symbol", "total")
    assert {n for (n,) in names(engine.unreached("app"), "name")} == {"Order", "run", "Order.total"} or "Order.total" in {n for (n,) in names(engine.unreached("app"), "name")}
    assert engine.t["symbols"].where("name = 'compute'").first()["doc"] == "Computes."
    assert engine.affects("compute").exit == S.FOUND


def test_subjects_and_degraded_states(engine, spark, tmp_path):
    handle = engine.t["handles"].join(engine.t["symbols"].where("name = 'compute'").select("id"), engine.t["handles"]["symbol_id"] == engine.t["symbols"]["id"]).first()["handle"]
    assert engine.subject(handle) == engine.subject("compute")
    with pytest.raises(Ambiguous):
        engine.subject("nothing_of_this_name")
    with pytest.raises(ValueError, match="empty"):
        engine.subject(" ")
    with pytest.raises(sinks.Degraded):
        Engine(spark, f"file://{tmp_path}/none")
    (tmp_path / "_CURRENT").write_text(json.dumps({"build": "v=1", "schema": S.SCHEMA_VERSION + 1}))
    with pytest.raises(sinks.Degraded):
        Engine(spark, f"file://{tmp_path}")


def test_second_build_agrees(spark, repo, engine):
    again = build(spark, f"file://{repo}/index", f"file://{repo}")
    for t in ("symbols", "handles", "edges"):
        assert again[t].count() == engine.t[t].count()
    assert sorted(map(tuple, again["handles"].collect())) == sorted(map(tuple, engine.t["handles"].collect()))


def test_envelope(spark):
    e = Envelope(spark.range(5)).check_layer(0, "the weak layer", "build it").mark_stale({"a"}, {"a", "b"})
    said = e.render(2)
    assert e.exit == S.DEGRADED and "UNCHECKED" in said and "limit of 2" in said and "since the build: a" in said
    b = Budget(2)
    assert b.admit("x" * 50) and not b.admit("y")


def test_literal_scanner():
    text = 'a = "one"  # "not"\nb = \'\'\'first\nsecond\'\'\'\nc = "open\nd = \'two\' + "es\\"c"\n'
    assert code.string_literals(text, "x.py") == [(0, "one"), (1, "first"), (3, "open"), (4, "two"), (4, 'es\\"c')]
    assert code.string_literals('x := "a" // "b"\n/* "c"\n*/ y := `raw\nmore`\n', "x.go") == [(0, "a"), (2, "raw")]


def test_generated_headers():
    assert code.is_generated("a.py", "# Code generated by x. DO NOT EDIT.\nimport y\n") == (True, 1)
    assert code.is_generated("a.py", "import y\n# auto-generated steps\n") == (False, 0)
    assert code.is_generated("a.pb.go", None) == (True, 3)
    assert code.is_generated("a.pb.go", "package a\n") == (False, 0)


def test_markdown_spans():
    title, lines, got = markdown.sections("# A\nx y\n## B\nz\n# C\n")
    assert (title, lines) == ("A", 5)
    assert [(s["heading"], s["start_line"], s["end_line"], s["words"]) for s in got] == [("A", 1, 4, 5), ("B", 3, 4, 1), ("C", 5, 5, 0)]


def test_compose_overlay_and_commands():
    got = deployment.services(["services: {a: {image: x, ports: ['1'], build: ./p}}", "services: {a: {ports: ['2']}, b: {command: /bin/srv}}"])
    assert [(s["name"], s["image"], s["ports"], s["build_context"]) for s in got] == [("a", "x", ["2"], "./p"), ("b", None, [], None)]
    r = deployment.resolve_command
    assert r("python3 -m a.b --x") == ("module", "a.b") and r("gunicorn -w 2 app.wsgi:app") == ("module", "app.wsgi")
    assert r("tail -f /dev/null") == ("idle", None) and r("./manage.py migrate") == ("django", "migrate") and r("celery -A proj worker") == ("celery", "proj")
    assert r("/bin/grpcserver --p") == ("binary", "grpcserver") and r("echo hi") is None
    docker = "FROM x AS builder\nRUN xx-go build -o /out/srv ./cmd/srv/main.go\nCOPY --from=builder /out/srv /bin/srv\n"
    assert deployment.built_from(docker, "srv") == "cmd/srv/main.go"


def test_wire_format_skips_unknown_fields():
    data = field(1, field(3, b"file:///r")) + field(99, 7) + document("a.go", "go", [field(50, b"zz") + occurrence("s", [1, 2, 3])])
    (doc,) = scip.documents(data)
    assert (doc["root"], doc["path"], doc["occurrences"][0]["packed"]) == ("file:///r", "a.go", [1, 2, 3])


def test_commands_and_exit_codes(spark, engine, tmp_path, capsys):
    from factloom.__main__ import main

    base = ["--base", engine.root]
    assert main([*base, "--log", f"file://{tmp_path}/log", "symbol", "comp"], spark) == S.FOUND and "compute" in capsys.readouterr().out
    assert main([*base, "symbol", "zzz_nothing"], spark) == S.NOT_FOUND
    assert main([*base, "refs", " "], spark) == S.BAD_QUERY
    assert main([*base, "nonsense"], spark) == S.BAD_QUERY
    assert main(["--base", f"file://{tmp_path}/none", "topology"], spark) == S.DEGRADED
    assert main([*base, "line", "app/price.py", "3"], spark) == S.FOUND
    assert spark.read.json(f"file://{tmp_path}/log").first()["exit"] == S.FOUND


def test_authored_knowledge_outlives_builds(spark, engine, tmp_path):
    from factloom.authored import Authored

    own = Authored(spark, f"file://{tmp_path}")
    symbol = engine.t["symbols"].where("name = 'compute'").join(engine.t["files"].selectExpr("id AS def_file_id", "path", "content_hash"), "def_file_id")
    own.add_concept("pricing", "first")
    own.add_concept("pricing", "how prices are made")
    own.add_concept("other", ns="mine")
    own.link_concept("pricing", symbol)
    assert [tuple(r) for r in own.concepts().collect()] == [("agent", "pricing", "how prices are made", 1), ("mine", "other", "", 0)]
    link = own.concept_links(engine.t["symbols"], engine.t["files"]).first()
    assert link["symbol_id"] == symbol.first()["id"] and link["needs_review"] is False
    own.drop_namespace("mine")
    assert own.concepts("mine").count() == 0
    with pytest.raises(ValueError, match="default"):
        own.drop_namespace("agent")
    h = symbol.first()["hash"]
    own.assert_link(h, "gone")
    assert own.asserted(engine.t["symbols"], symbol.first()["id"]).first()["dst"] is None
    own.record_verdict("service-1", "cross-api", True, commit="c1")
    assert own.verdicts().first()["commit_sha"] == "c1"


def test_pointers_are_never_overwritten(spark, tmp_path):
    root = f"file://{tmp_path}/base"
    one = spark.range(1).withColumn("kind", F.lit(0))
    builds = [sinks.write_build(spark, root, {"files": one}) for _ in range(5)]
    held = sorted(p.name for p in (tmp_path / "base").glob("_CURRENT.*"))
    assert len(held) == sinks.KEEP and held[-1].endswith("5") and json.loads((tmp_path / "base" / held[-1]).read_text())["build"] == builds[-1]
    (tmp_path / "base" / "_writing-dead").write_text("half a pointer")  # a crash before the rename
    assert sinks.open_build(spark, root)["files"].count() == 1
    path = f"{root}/authored/t"
    for n in range(4):
        sinks.upsert_table(spark, path, spark.createDataFrame([(1, n)], "k int, at int"), ["k"], "at")
        (tmp_path / "base/authored/t/_writing-dead").mkdir(exist_ok=True)
        assert [tuple(r) for r in sinks.read_table(spark, path).collect()] == [(1, n)]
    with pytest.raises(RuntimeError), sinks.BuildLock(spark, path):
        sinks.upsert_table(spark, path, one, ["id"], "kind")


def test_docs_by_body(spark, engine, repo):
    lines = code.lines(code.tree(spark, f"file://{repo}")).withColumn("line", F.col("line") + 1)
    assert names(engine.docs("more words", lines), "trail", "hits", "in_heading") == [("Shop > (unnamed) > Deep", 1, False)]
    assert [t for (t,) in names(engine.docs("words", lines), "trail")] == ["Shop > (unnamed) > Deep", "Shop"]
    assert engine.docs("more words").unknown and not engine.docs("deep", lines).unknown


def test_stale_paths_are_named(spark, engine):
    assert "not tracked" in engine.refs("compute").render(9)
    now = Engine(spark, engine.root, {"app/main.py", "elsewhere.py"})
    assert "stale: changed since the build: app/main.py" in now.refs("compute").render(9)
    assert "stale: none" in Engine(spark, engine.root, set()).outline("app").render(9)


def test_outline_is_in_order(engine):
    got = names(engine.outline("app"), "path", "at", "name")
    assert got == sorted(got) and got[0][:2] == ("app/main.py", "app/main.py:1")


def test_commands_over_the_tree_and_authored_knowledge(spark, engine, repo, capsys):
    from factloom.__main__ import main

    base = ["--base", engine.root, "--repository", f"file://{repo}"]
    said = lambda *a: (main([*base, *a], spark), capsys.readouterr().out)
    assert said("find", "nightly")[0] == S.FOUND
    assert "def compute" in said("expand", "compute")[1]
    code_, text = said("change", "compute")
    assert code_ == S.FOUND and "residue:" in text and "affects:" in text
    assert said("understand", "run")[0] == S.FOUND
    assert main(["--base", engine.root, "find", "x"], spark) == S.BAD_QUERY
    assert said("docs", "more words")[0] == S.FOUND
    assert said("coverage")[0] == S.FOUND
    assert said("concept", "pricing", "how prices are made")[0] == S.FOUND and said("about", "pricing", "compute")[0] == S.FOUND
    assert "pricing" in said("concepts")[1] and "compute" in said("context", "pricing")[1]
    assert said("link", "run", "compute", "by hand")[0] == S.FOUND and "by hand" in said("links", "run")[1]
    check = next(x for x in said("checks")[1].splitlines() if x.startswith("entrypoints")).split("  ")[1]
    assert said("verdict", check, "entrypoints", "no")[0] == S.FOUND and "entrypoints: Failing" in said("checks")[1]
    assert said("verdict", check, "entrypoints", "maybe")[0] == S.BAD_QUERY
    assert said("affects", "compute")[0] in (S.FOUND, S.DEGRADED) and said("callers-of-type", "Order")[0] == S.NOT_FOUND
    assert said("unlinked", "run")[0] in (S.FOUND, S.NOT_FOUND)
    assert said("drop", "agent")[0] == S.BAD_QUERY


def test_checked_out_commit_and_changes(spark, engine, repo, tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    at = f"file://{tmp_path}"
    assert worktree.head_commit(spark, f"{at}/none") is None
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack-refs\nabc123 refs/heads/main\n")
    assert worktree.head_commit(spark, at) == "abc123"
    (git / "refs/heads/main").write_text("def456\n")
    assert worktree.head_commit(spark, at) == "def456"
    (git / "HEAD").write_text("789\n")
    assert worktree.head_commit(spark, at) == "789"
    assert worktree.dirty(spark, f"file://{repo}", engine.t["files"]) == set()
    kept = (repo / "app/main.py").read_text()
    (repo / "app/main.py").write_text(kept + "# more\n")
    try:
        assert worktree.dirty(spark, f"file://{repo}", engine.t["files"]) == {"app/main.py"}
    finally:
        (repo / "app/main.py").write_text(kept)
    assert {r["path"] for r in worktree.indexable(spark, f"file://{repo}").collect()} >= {"app/main.py", "app/price.py"}


def test_lines_around_a_site():
    assert [lines_around(t, n) for t, n in ((None, 3), (100, 0), (100, 5), (100, 2), (1000, 10), (100_000, 1))] == [0, 0, None, 0, 2, 6]


def test_long_documents_are_parsed_one_at_a_time(spark):
    import time

    import pyarrow as pa

    text = "".join(f"{'#' * (1 + 7 * i % 4)} h{i}\na b\n" for i in range(60_000))
    began = time.time()
    title, n, cols = markdown.columns(text)
    assert time.time() - began < 5  # no copy of the headings left for each heading
    assert (title, n, cols["trail"][1], cols["end_line"][:5], cols["words"][:2]) == ("h0", 120_000, "h0 > (unnamed) > (unnamed) > h1", [8, 4, 6, 8, 16], [14, 2])
    docs = [("a", "# A\nx y\n## B\nz\n# C\n"), ("b", None)]
    batch = pa.RecordBatch.from_pydict({"path": [p for p, _ in docs], "text": [t for _, t in docs]})
    assert [b.num_rows for b in markdown._parse(iter([batch]))] == [1, 1]
    table = spark.createDataFrame(docs, "path string, text string")
    got = markdown.flat(markdown.parse(table)).select("level", "trail", "start_line", "end_line", "words")
    assert sorted(map(tuple, got.collect())) == [(1, "A", 1, 4, 5), (1, "C", 5, 5, 0), (2, "A > B", 3, 4, 1)]


def test_hits_are_not_paired_with_sections(spark):
    from factloom.operators import text

    rnd = random.Random(5)
    body = "".join(rnd.choice(["# a", "## b", "### c", "#### click d", "click", "plain words", "click click"]) + "\n" for _ in range(400))
    lines = spark.createDataFrame([("1", i, x) for i, x in enumerate(body.splitlines(), 1)], "doc_id string, line int, text string")
    _, _, found = markdown.sections(body)
    held = [max((s["level"], s["start_line"]) for s in found if s["start_line"] <= i <= s["end_line"]) for i, x in enumerate(body.splitlines(), 1) if "click" in x and i >= found[0]["start_line"]]
    sections = spark.createDataFrame([("1", *s.values()) for s in found], "doc_id string, level int, heading string, trail string, start_line int, end_line int, words int")
    hits = text.section_hits(lines, sections, "Click")
    assert sorted(map(tuple, hits.select("start_line", "hits").collect())) == sorted((start, held.count((level, start))) for level, start in set(held))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # counts with their sections, no lines with sections
