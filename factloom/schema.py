"""Tables of the fact base and their closed enums."""

from __future__ import annotations

SCHEMA_VERSION = 1

TABLES = {
    "files": "id bigint, path string, lang int, generated boolean, gen_via int, is_test boolean, content_hash string",
    "symbols": "id bigint, hash string, name string, module string, container string, container_leaf string, pkg string, kind int, lang int, "
    "ref_count bigint, def_file_id bigint, def_line bigint, def_col_start int, def_col_end int, def_generated boolean, def_end_line bigint, doc string",
    "occurrences": "file_id bigint, symbol_id bigint, line bigint, col_start int, col_end int, role int, enc_end bigint",
    "edges": "src bigint, dst bigint, kind int, source int, confidence double, file_id bigint, line bigint, note string, needs_review boolean",
    "proto_services": "id bigint, pkg string, name string",
    "service_links": "service_id bigint, symbol_id bigint, role int, via_symbol bigint",
    "deploy_services": "name string, command string, build_context string, image string, ports array<string>, aliases array<string>, entry_file bigint",
    "deploy_on_demand": "service string, schedule string, script string, command string, entry_file bigint",
    "deploy_reach": "service string, symbol_id bigint",
    "literals": "text string, file_id bigint, line bigint, enclosing bigint",
    "doc_files": "id bigint, path string, title string, lines int",
    "doc_sections": "doc_id bigint, level int, heading string, trail string, start_line int, end_line int, words int",
    "handles": "symbol_id bigint, handle string",
    "concepts": "id bigint, ns string, name string, note string, author int",
    "concept_links": "concept_id bigint, symbol_hash string, rel string, note string, anchor_path string, anchor_line int, anchor_hash string, needs_review boolean",
    "verifications": "check_id string, area string, holds boolean, note string, commit_sha string, recorded_at timestamp",
    "meta": "key string, value string",
}

LANGS = {0: "??", 1: "py", 2: "go", 3: "ts"}
NAMESPACE, TYPE, TERM, METHOD, TYPE_PARAMETER, PARAMETER, META, LOCAL, UNKNOWN = range(9)
CALLS, IMPLEMENTS, WEAK_REF, ASSERTED, MEMBER = range(5)
EXACT, WEAK, AGENT, HUMAN = range(4)
SERVES, CALLS_SERVICE = 0, 1

FOUND, NOT_FOUND, BAD_QUERY, DEGRADED = range(4)
