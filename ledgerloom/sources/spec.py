"""What to reconcile: tables, roles of columns, fields to compare.

Rules over column names only; they read no rows and decide what the job selects.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

# Names by which amount and date columns are recognised, in order of preference.
AMOUNT_EXACT = ["invoice total", "open amount", "total amount", "net amount", "amount", "total", "invoice amount", "inv total", "inv amount", "balance", "amount due", "payment amount"]
AMOUNT_ENDS = ["total", "amount", "amt", "balance"]
AMOUNT_CONTAINS = ["total", "amount", "amt", "price", "cost", "value", "sum"]
DATE_ROLE = ["date", "dt", "dated", "invoice date", "inv date", "receive date"]
AMOUNT_ROLE = ["amount", "amt", "open amount", "invoice amount", "total", "value", "balance"]

LEFT, FULL = "left", "full"


@dataclass(frozen=True)
class BaseSpec:
    match: str
    date: str | None = None
    amount: str | None = None


@dataclass(frozen=True)
class RefSpec:
    """``file`` is the name of the file a saved spec was made with; it stands in for ``name`` when files are bound."""

    name: str
    match: str
    returns: tuple[str, ...] = ()
    file: str = ""


@dataclass(frozen=True)
class FieldSpec:
    """A field to compare: ``mappings`` gives each source's column; the base is the source ``SOA``."""

    name: str
    mappings: Mapping[str, str]
    type: str = "Text"


@dataclass(frozen=True)
class JobSpec:
    base: BaseSpec
    refs: tuple[RefSpec, ...] = ()
    fields: tuple[FieldSpec, ...] = ()
    how: str = LEFT

    def __post_init__(self) -> None:
        names = [r.name for r in self.refs]
        if len(set(names)) < len(names):
            raise ValueError(f"reference names must differ: {names}")
        if self.how not in (LEFT, FULL):
            raise ValueError(f"how is {LEFT} or {FULL}, not {self.how}")

    @property
    def key_label(self) -> str:
        return "Invoice #" if self.how == LEFT else "ID / Key"

    @property
    def base_label(self) -> str:
        return "SOA Amount" if self.how == LEFT else "Master Amount"

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> JobSpec:
        raw = json.loads(text)
        refs = tuple(RefSpec(r["name"], r["match"], tuple(r["returns"]), r.get("file", "")) for r in raw["refs"])
        fields = tuple(FieldSpec(f["name"], f["mappings"], f["type"]) for f in raw["fields"])
        return JobSpec(BaseSpec(**raw["base"]), refs, fields, raw["how"])


def _first(columns: Sequence[str], wanted: Iterable[str], test) -> str | None:
    """Preference of keywords comes before the order of columns."""
    return next((c for k in wanted for c in columns if test(c.lower().strip(), k)), None)


def amount_column(columns: Sequence[str]) -> str | None:
    """A reference's amount column: an exact name, else an ending, else a part of the name."""
    return _first(columns, AMOUNT_EXACT, str.__eq__) or _first(columns, AMOUNT_ENDS, str.endswith) or _first(columns, AMOUNT_CONTAINS, str.__contains__)


def role_column(columns: Sequence[str], keywords: Sequence[str], strategy: str = "keyword") -> str | None:
    """Base column for a role. ``keyword``: exact, then part of a name; ``first_any``: the first column with any keyword."""
    if strategy == "first_any":
        return next((c for c in columns if any(k in c.lower() for k in keywords)), None)
    return _first(columns, keywords, str.__eq__) or _first(columns, keywords, str.__contains__)


def fallback_amount(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if any(k in c.lower() for k in ("amount", "total", "balance"))), None)


def invoice_column(columns: Sequence[str]) -> str:
    for known in ("Invoice #", "ID / Key"):
        if known in columns:
            return known
    named = (c for c in columns if c.lower() == "invoice" or "invoice" in c.lower() and any(k in c.lower() for k in ("id", "num", "#")))
    return next(named, columns[0])


def with_key(columns: Sequence[str] | None, key: str) -> list[str] | None:
    """The chosen columns, with the match key even where it was not chosen."""
    return None if columns is None else list(dict.fromkeys([*columns, key]))


def return_columns(chosen: Sequence[str], available: Sequence[str], key: str, needed: Iterable[str] = (), loaded: Sequence[str] | None = None) -> tuple[str, ...]:
    """Chosen columns and those that fields need; all loaded ones if a load list exists, all others if none is left."""
    out = list(dict.fromkeys([*chosen, *(c for c in needed if c != key)]))
    if loaded:
        out = [c for c in available if c != key]
    return tuple(out or [c for c in available if c != key])


def source_names(given: Sequence[str | None]) -> list[str]:
    return [n.strip() if n and n.strip() else f"Ref{i}" for i, n in enumerate(given, 1)]


def base_key(match: str | None, keys: Mapping[str, str], base: str) -> str:
    found = match or keys.get(base)
    if not found:
        raise ValueError("the base table has no match column")
    return found


def fields_of(rows: Iterable[Mapping]) -> tuple[FieldSpec, ...]:
    """Field rows; an unnamed one takes its first column's name, one without name or column is left out."""
    out = []
    for row in rows:
        mappings = {s: c for s, c in row.get("mappings", {}).items() if c}
        label = (row.get("name") or "").strip() or next(iter(mappings.values()), "")
        if label and mappings:
            out.append(FieldSpec(label, mappings, row.get("type", "Text")))
    return tuple(out)


def auto_spec(base_columns: Sequence[str], refs: Mapping[str, Sequence[str]], keys: Mapping[str, str] | None = None, how: str = LEFT) -> JobSpec:
    """Match on the given keys, else the first columns; return every other column."""
    keys = keys or {}
    specs = []
    for ref, columns in refs.items():
        key = keys.get(ref, columns[0])
        specs.append(RefSpec(ref, key, tuple(c for c in columns if c != key) or tuple(columns)))
    base = BaseSpec(keys.get("", base_columns[0]), role_column(base_columns, DATE_ROLE), role_column(base_columns, AMOUNT_ROLE))
    return JobSpec(base, tuple(specs), how=how)


def bind(spec: JobSpec, available: Mapping[str, Sequence[str]]) -> JobSpec:
    """A saved spec for new tables: rules whose key or whole column list is gone are left out."""
    kept = []
    for ref in spec.refs:
        columns = available.get(ref.name)
        if columns is None or ref.match not in columns:
            continue
        returns = tuple(c for c in ref.returns if c in columns)
        if returns:
            kept.append(replace(ref, returns=returns))
    return JobSpec(spec.base, tuple(kept), field_list(spec, available), spec.how)


def bind_files(spec: JobSpec, files: Mapping[str, Sequence[str]], base_columns: Sequence[str] | None = None) -> tuple[JobSpec, dict[str, str]]:
    """A saved spec for today's files, given by path with their columns: (spec, path of each reference that is left).

    A reference takes the first file of its own file's name, in whatever folder that now is;
    one without such a file, or whose rule no longer fits the file, is left out as in ``bind``.
    Roles of the base that name no column of today's base are dropped.
    """
    by_name: dict[str, str] = {}
    for path in files:
        by_name.setdefault(file_name(path), path)
    paths = {r.name: by_name[r.file] for r in spec.refs if r.file in by_name}
    bound = bind(spec, {ref: files[path] for ref, path in paths.items()})
    if base_columns is not None:
        role = lambda c: c if c in base_columns else None
        bound = replace(bound, base=replace(spec.base, date=role(spec.base.date), amount=role(spec.base.amount)))
    return bound, {r.name: paths[r.name] for r in bound.refs}


def file_name(path: str) -> str:
    """The last part of a path or URL, whichever slashes it has."""
    return path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]


def field_list(spec: JobSpec, available: Mapping[str, Sequence[str]]) -> tuple[FieldSpec, ...]:
    out = []
    for f in spec.fields:
        mappings = {s: c for s, c in f.mappings.items() if s in ("SOA", "Master") or c in available.get(s, ())}
        if mappings:
            out.append(FieldSpec(f.name, mappings, f.type))
    return tuple(out)
