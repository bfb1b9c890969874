"""The rule pack: naming conventions as data.

The values below are fixed values: the conventions that test runners, generators and build
tools follow.  A YAML file with the same keys replaces them section by section.
"""

from __future__ import annotations

import copy

# Fixed values.
DEFAULT = {
    "generated": {
        "markers": [
            "code generated by",
            "do not edit",
            "@generated",
            "auto-generated",
            "autogenerated",
            "automatically generated",
            "generated by the protocol buffer compiler",
            "this file is generated",
            "generated file",
        ],
        "path_suffixes": [".pb.go", "_pb2.py", "_pb2_grpc.py", "_pb2.pyi"],
    },
    "tests": {
        "path_contains": ["/tests/", "/testdata/", "/__tests__/", "/__mocks__/"],
        "path_prefixes": ["tests/"],
        "file_suffixes": ["_test.go", "_test.py", ".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.js"],
    },
    "build_selected": {"path_contains": [".web.", ".ios.", ".android.", ".native."]},
    "commands": [
        {"argv0_starts_with": ["python"], "target": {"kind": "module_after_flag", "flag": "-m"}},
        {"argv0_ends_with": ["uvicorn", "gunicorn", "hypercorn", "daphne"], "target": {"kind": "module_before_colon"}},
        {"command_starts_with": ["tail -f", "sleep infinity", "sleep inf"], "target": {"kind": "idle"}},
        {"word_ends_with": "manage.py", "target": {"kind": "subcommand_after_match"}},
        {"argv0_ends_with": ["celery"], "target": {"kind": "app_after_flag", "flag": "-A"}},
        {"target": {"kind": "binary"}},
    ],
    "proto": {
        "bindings": [
            {"prefix": "Register", "suffix": "Server", "role": "serves"},
            {"suffix": "Base", "role": "serves"},
            {"suffix": "Server", "role": "serves"},
            {"suffix": "Stub", "role": "calls"},
            {"suffix": "Client", "role": "calls"},
        ],
        "strip_prefixes": ["New", "mustEmbedUnimplemented", "MustEmbedUnimplemented", "Unimplemented", "Unsafe"],
        "service_marker": "Service",
    },
    "on_demand": {
        "service_marker": "name=",
        "runner_suffixes": [".sh"],
        "skip_dirs": [".git", "node_modules", ".venv", "venv", "__pycache__", "target", "dist", "build", ".mypy_cache", ".ruff_cache", ".pytest_cache"],
    },
}


def load(text: str | None = None) -> dict:
    """The default pack, with the sections that the YAML *text* holds in their place."""
    pack = copy.deepcopy(DEFAULT)
    if text:
        import yaml

        pack |= yaml.safe_load(text) or {}
    return pack
