"""Settings of a workspace: defaults, a workspace file, a folder's file, the environment and the command line.

Later layers win key by key. Files are TOML; a table, key or type that is not known is an error that names it.
"""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from hashlib import sha256
from json import dumps

from strataledger.operators.mitigations import KEYWORDS
from strataledger.sources import reports as P


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Labels:
    """``[parse.ddr.labels]``: what stands before the colon."""

    depth_at_start: str = P.LABELS["depth_start"]
    depth_at_end: str = P.LABELS["depth_end"]
    progress: str = P.LABELS["progress"]
    hole_section: str = P.LABELS["section"]
    formation_at_td: str = P.LABELS["formation"]
    weight: str = P.LABELS["mud_weight"]
    ecd: str = P.LABELS["ecd"]
    bht: str = P.LABELS["bht"]
    mwd: str = P.LABELS["tool"]
    productive_time: str = P.LABELS["productive_hours"]
    non_productive_time: str = P.LABELS["lost_hours"]
    npt_code: str = P.ENTRY_LABELS["code"]
    npt_hours: str = P.ENTRY_LABELS["hours"]
    npt_depth: str = P.ENTRY_LABELS["depth"]
    npt_formation: str = P.ENTRY_LABELS["formation"]
    npt_description: str = P.ENTRY_LABELS["description"]


@dataclass(frozen=True)
class FinalSections:
    """``[parse.eowr.sections]``"""

    npt_breakdown: str = P.SECTIONS["by_code"]
    lessons: str = P.SECTIONS["lessons"]
    recommendations: str = P.SECTIONS["recommendations"]


@dataclass(frozen=True)
class IncidentSections:
    """``[parse.incident.sections]``"""

    root_cause: str = P.SECTIONS["root_cause"]
    corrective_actions: str = P.SECTIONS["actions"]


@dataclass(frozen=True)
class Ddr:
    labels: Labels = field(default_factory=Labels)


@dataclass(frozen=True)
class Eowr:
    sections: FinalSections = field(default_factory=FinalSections)


@dataclass(frozen=True)
class Incident:
    sections: IncidentSections = field(default_factory=IncidentSections)


@dataclass(frozen=True)
class Parse:
    ddr: Ddr = field(default_factory=Ddr)
    eowr: Eowr = field(default_factory=Eowr)
    incident: Incident = field(default_factory=Incident)


@dataclass(frozen=True)
class Detect:
    """``[detect.headings]``"""

    ddr: str = P.HEADINGS["ddr"]
    eowr: str = P.HEADINGS["eowr"]
    incident: str = P.HEADINGS["incident"]


@dataclass(frozen=True)
class Headings:
    headings: Detect = field(default_factory=Detect)


@dataclass(frozen=True)
class Taxonomy:
    """Spellings of codes, which must name known ones; keywords, where a list replaces the default of its code."""

    aliases: Mapping[str, str] = field(default_factory=dict)
    keywords: Mapping[str, list[str]] = field(default_factory=lambda: dict(KEYWORDS))


@dataclass(frozen=True)
class Csv:
    """Logical columns to a file's own; how its dates are written."""

    columns: Mapping[str, str] = field(default_factory=dict)
    date_format: str = ""


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 8
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Risk:
    min_lift: float = 2.0
    min_wells: int = 2
    min_support: float = 0.3
    equipment_min_ratio: float = 2.0
    equipment_min_rate: float = 0.4
    equipment_min_wells: int = 3
    max_risks: int = 8


@dataclass(frozen=True)
class Costs:
    spread_rate: float = 48_000.0


@dataclass(frozen=True)
class Workspace:
    home: str = "~/.strataledger"
    name: str = "default"


@dataclass(frozen=True)
class Settings:
    parse: Parse = field(default_factory=Parse)
    detect: Headings = field(default_factory=Headings)
    taxonomy: Taxonomy = field(default_factory=Taxonomy)
    csv: Csv = field(default_factory=Csv)
    retrieval: Retrieval = field(default_factory=Retrieval)
    risk: Risk = field(default_factory=Risk)
    costs: Costs = field(default_factory=Costs)
    workspace: Workspace = field(default_factory=Workspace)

    def template(self) -> P.Template:
        """As the parsers take it."""
        labels, own, back = asdict(self.parse.ddr.labels), dict(P.LABELS), {v: k for k, v in P.LABELS.items()}
        entry, entry_back = dict(P.ENTRY_LABELS), {v: k for k, v in P.ENTRY_LABELS.items()}
        for key, default in asdict(Labels()).items():
            if key.startswith("npt_"):
                entry[entry_back[default]] = labels[key]
            else:
                own[back[default]] = labels[key]
        final, incident = self.parse.eowr.sections, self.parse.incident.sections
        sections = {
            "by_code": final.npt_breakdown, "lessons": final.lessons, "recommendations": final.recommendations,
            "root_cause": incident.root_cause, "actions": incident.corrective_actions,
        }
        return P.Template(own, entry, sections, asdict(self.detect.headings), dict(self.taxonomy.aliases))

    def snapshot(self) -> str:
        """What parsing depends on, as canonical JSON; ``digest`` is its hash."""
        return dumps({"parse": asdict(self.parse), "detect": asdict(self.detect), "aliases": dict(self.taxonomy.aliases), "csv": asdict(self.csv)}, sort_keys=True)

    def digest(self) -> str:
        return sha256(self.snapshot().encode()).hexdigest()


# Logical columns of ledgers; environment variables and the keys that they set.
CSV_COLUMNS = ("well", "date", "code", "hours", "field", "depth", "section", "formation", "rig", "description")
ENVIRONMENT = {
    "STRATALEDGER_HOME": ("workspace", "home"),
    "STRATALEDGER_WORKSPACE": ("workspace", "name"),
    "STRATALEDGER_SPREAD_RATE": ("costs", "spread_rate"),
}


def _checked(default, given, where: str, source: str):
    """A value of the default's type; a table's keys are merged into it."""
    if is_dataclass(default):
        if not isinstance(given, Mapping):
            raise SettingsError(f"{source}: [{where}] must be a table")
        known = {f.name for f in fields(default)}
        if unknown := sorted(set(given) - known):
            raise SettingsError(f"{source}: unknown key {where + '.' if where else ''}{unknown[0]}")
        own = {f.name: getattr(default, f.name) for f in fields(default)}
        return type(default)(**own | {k: _checked(own[k], v, f"{where}.{k}".strip("."), source) for k, v in given.items()})
    if isinstance(default, Mapping):
        if not isinstance(given, Mapping):
            raise SettingsError(f"{source}: [{where}] must be a table")
        return dict(default) | {k: _listed(where, k, v, source) for k, v in given.items()}
    wanted = (int, float) if isinstance(default, float) else type(default)
    if isinstance(given, bool) or not isinstance(given, wanted):
        raise SettingsError(f"{source}: {where} must be {type(default).__name__}, not {type(given).__name__}")
    if isinstance(default, str) and not given.strip():
        raise SettingsError(f"{source}: {where} is empty")
    return float(given) if isinstance(default, float) else given


def _listed(where: str, key: str, value, source: str):
    name = f"{where}.{key}"
    if where == "taxonomy.keywords":
        if not (isinstance(value, list) and all(isinstance(v, str) and v.strip() for v in value)):
            raise SettingsError(f"{source}: {name} must be a list of words")
        if key not in P.CODES:
            raise SettingsError(f"{source}: {name} is no known code")
        return list(value)
    if not (isinstance(value, str) and value.strip()):
        raise SettingsError(f"{source}: {name} must be a text")
    if where == "taxonomy.aliases" and value not in P.CODES:
        raise SettingsError(f"{source}: {name} must be a known code, not {value}")
    if where == "csv.columns" and key not in CSV_COLUMNS:
        raise SettingsError(f"{source}: {name} is no known column")
    return value


def with_layer(settings: Settings, given: Mapping, source: str) -> Settings:
    """The settings with the keys of a layer in place of their own."""
    return _checked(settings, given, "", source)


def of_toml(text: str, source: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise SettingsError(f"{source}: {error}") from error


def of_environment(environ: Mapping[str, str]) -> dict:
    """The layer that variables make; numbers must read as such."""
    out: dict = {}
    for name, (table, key) in ENVIRONMENT.items():
        value = environ.get(name, "").strip()
        if value:
            try:
                out.setdefault(table, {})[key] = float(value) if key == "spread_rate" else value
            except ValueError as error:
                raise SettingsError(f"{name}: not a number: {value}") from error
    return out


def resolve(workspace: str = "", folder: str = "", environ: Mapping[str, str] | None = None, command: Mapping | None = None) -> Settings:
    """Command line over environment over the folder's file over the workspace's file over defaults."""
    layers = ((of_toml(workspace, "workspace file"), "workspace file"), (of_toml(folder, "folder file"), "folder file"),
              (of_environment(environ or {}), "environment"), (command or {}, "command line"))
    out = Settings()
    for given, source in layers:
        out = with_layer(out, given, source)
    return out
