"""Rule packs: read, validated and turned into a table of patterns on the driver (they are configuration)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sourceloom.functions.text import glob_regex
from sourceloom.operators.effects import RULE_SCHEMA

# Fixed values.
VERSION = "1.0"
EFFECT_KINDS = ("http.route", "db.sql", "db.orm", "graphql", "rpc", "messaging", "io.file", "io.blob", "subprocess", "cache", "feature_flag", "auth", "scheduler", "meta.core")
PATTERN_KINDS = ("call", "decorator", "class", "function")
PACK_LANGUAGES = ("python", "javascript", "typescript", "any")
FIELD_SOURCES = ("arg", "kw", "literal", "decorator", "filename")
DEFAULT_CONFIDENCE = 0.95

BUILT_IN = Path(__file__).resolve().parent / "packs"


def read_pack(path: str | Path) -> dict:
    """A pack from YAML or JSON, by its extension, with defaults filled in."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yaml", ".yml"):
        import yaml

        pack = yaml.safe_load(text)
    else:
        pack = json.loads(text)
    pack = {"version": VERSION, "language": "any", "requires": [], "telemetry_tag": None, "rules": []} | (pack or {})
    pack["rules"] = [{"family": "", "confidence": DEFAULT_CONFIDENCE, "patterns": [], "fields": []} | rule for rule in pack["rules"]]
    return pack


def errors_of(pack: dict) -> list[str]:
    """What is wrong with a pack; nothing if it is valid."""
    found = []
    if str(pack["version"]) != VERSION:
        found.append(f"version {pack['version']} is not {VERSION}")
    if pack["language"] not in PACK_LANGUAGES:
        found.append(f"unknown language {pack['language']}")
    if not pack["rules"]:
        found.append("no rules")
    ids = [rule.get("id") for rule in pack["rules"]]
    found += [f"duplicate rule {i}" for i in sorted({i for i in ids if ids.count(i) > 1}, key=str)]
    for rule in pack["rules"]:
        name = rule.get("id")
        if not name:
            found.append("a rule without an id")
        if not isinstance(rule["confidence"], (int, float)) or not 0 < rule["confidence"] <= 1:
            found.append(f"{name}: confidence {rule['confidence']}")
        if rule.get("effect_kind") not in EFFECT_KINDS:
            found.append(f"{name}: unknown effect kind {rule.get('effect_kind')}")
        if not rule["patterns"]:
            found.append(f"{name}: no patterns")
        found += [f"{name}: unknown pattern kind {p.get('kind')}" for p in rule["patterns"] if p.get("kind") not in PATTERN_KINDS]
        found += [f"{name}: unknown pattern language {p.get('language')}" for p in rule["patterns"] if p.get("language", "any") not in PACK_LANGUAGES]
        found += [f"{name}: unknown field source {f.get('source')}" for f in rule["fields"] if f.get("source") not in FIELD_SOURCES]
    return found


class Registry:
    """Loaded packs by name; a file is read again when it is newer."""

    def __init__(self) -> None:
        self.packs: dict[str, dict] = {}
        self._times: dict[str, float] = {}
        self._files: dict[str, float] = {}

    def load(self, path: str | Path) -> list[str]:
        """Register a valid pack; the errors of an invalid one."""
        pack = read_pack(path)
        wrong = errors_of(pack)
        if not wrong:
            self.packs[pack["name"]] = pack
            self._times[pack["name"]] = Path(path).stat().st_mtime
        return wrong

    def load_folder(self, folder: str | Path = BUILT_IN) -> dict[str, list[str]]:
        return {p.name: self.load(p) for p in sorted(Path(folder).iterdir()) if p.suffix in (".yaml", ".yml", ".json")}

    def reload_if_newer(self, name: str, path: str | Path) -> bool:
        if Path(path).stat().st_mtime <= self._times.get(name, float("-inf")):
            return False
        return not self.load(path)

    def refresh(self, folder: str | Path = BUILT_IN) -> list[str]:
        """Load the packs of a folder that are new or newer than what is held; their files' names."""
        found = []
        for path in sorted(Path(folder).iterdir()):
            if path.suffix in (".yaml", ".yml", ".json") and path.stat().st_mtime > self._files.get(str(path), float("-inf")):
                self._files[str(path)] = path.stat().st_mtime
                if not self.load(path):
                    found.append(path.name)
        return found

    def table(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """One row per pattern of the named packs, or of all."""
        rows = []
        for name, pack in self.packs.items():
            if names is not None and name not in names:
                continue
            for rule in pack["rules"]:
                fields = [(f["name"], f["source"], f.get("index"), f.get("key"), f.get("value_expr")) for f in rule["fields"]]
                for p in rule["patterns"]:
                    rows.append((name, pack["telemetry_tag"], rule["id"], pack["language"], p.get("language", "any"), rule["effect_kind"], rule["provider"], rule["family"], float(rule["confidence"]), p["kind"], p.get("callee"), p.get("object_method"), p.get("arg_count_min"), p.get("arg_count_max"), fields, glob_regex(p["filename_glob"]) if p.get("filename_glob") else None))
        return spark.createDataFrame(rows, RULE_SCHEMA)
