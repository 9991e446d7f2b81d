"""Which lines are noise: substrings, with a properties file to change them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Substrings of lines that are dropped by default.
DEFAULT_IGNORED = (
    '"c":"NETWORK"', '"c":"ACCESS"', '"c":"CONNPOOL"',
    '"hello":1', '"isMaster":1', '"ping":1', '"serverStatus":1', '"buildInfo"', '"getParameter":', '"getCmdLineOpts":1', '"getDefaultRWConcern":1', '"listDatabases":1',
    '"endSessions":', '"startSession"', '"saslContinue":1',
    '"replSetHeartbeat":"', "replSetUpdatePosition", '"replSetGetStatus":1',
    '"$db":"local"', '"$db":"config"', '"ns":"local.oplog.rs"', '"ns":"local.clustermanager"', '"ns":"config.system.sessions"', '"ns":"config.mongos"',
    '"c":"STORAGE"', '"c":"CONTROL"', '"c":"SHARDING"',
    '"dbstats":1', '"collStats":"', '"listIndexes":"',
    '"ctx":"TTLMonitor"', '"logRotate":"',
)


@dataclass(frozen=True)
class FilterRules:
    """Substrings that make a line noise, in order and without repeats."""

    ignored: tuple[str, ...] = field(default=DEFAULT_IGNORED)

    @staticmethod
    def _listed(value: str) -> list[str]:
        return [part.strip() for part in value.split(",") if part.strip()]

    @classmethod
    def from_properties(cls, path: str) -> FilterRules:
        """Keys filter.ignore.patterns (replaces all), .add and .remove; values are comma-separated."""
        with open(path, encoding="utf-8") as file:
            return cls.from_mapping(parse_properties(file.read()))

    @classmethod
    def from_mapping(cls, properties: dict[str, str]) -> FilterRules:
        kept = list(DEFAULT_IGNORED)
        if properties.get("filter.ignore.patterns", "").strip():
            kept = cls._listed(properties["filter.ignore.patterns"])
        kept += cls._listed(properties.get("filter.ignore.add", ""))
        gone = set(cls._listed(properties.get("filter.ignore.remove", "")))
        return cls(tuple(dict.fromkeys(p for p in kept if p not in gone)))


def parse_properties(text: str) -> dict[str, str]:
    """Java properties: key and value parted by = or : or white space, # and ! comments, \\ continues a line."""
    found: dict[str, str] = {}
    pending = ""
    for raw in text.splitlines():
        line = pending + raw.lstrip()
        pending = ""
        if not line or line[0] in "#!":
            continue
        if (len(line) - len(line.rstrip("\\"))) % 2:
            pending = line[:-1]
            continue
        at = next((i for i, c in enumerate(line) if c in "=: \t" and (i == 0 or line[i - 1] != "\\")), len(line))
        rest = line[at:].lstrip()
        if rest[:1] in ("=", ":"):
            rest = rest[1:].lstrip()
        found[line[:at].replace("\\", "")] = rest.replace("\\\\", "\\")
    return found
