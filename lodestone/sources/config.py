"""Run configuration: read, merged, validated."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

from ..functions.geometry import crs_grid
from ..operators.ranking import FUSIONS, WEIGHT_NAMES

ANALYSES = ("univariate", "multivariate")
PATCHES = ("rectangle", "circle")
POLICIES = ("assume", "reproject")


def known_crs(name: str | None) -> bool:
    try:
        crs_grid(name or "")
    except ValueError:
        return False
    return True


@dataclass(frozen=True)
class Run:
    """One analysis: grids, window, ranking and validation settings.

    With crs_policy "reproject" footprints are moved from footprint_crs to grid_crs; with "assume" they are taken as they
    are. Without a window each reference gives its own: the cells that its bounds touch, within the grid; with patch "circle"
    the cells about its bounds' centre that a circle of half its larger extent needs, or one of radius cells. best_k has each variable's k by reference, and stands before ks: a case then takes one k for each variable.
    """

    name: str
    grids: dict[str, str]
    footprints: str
    window: tuple[int, int] | None = None
    stride: tuple[int, int] = (1, 1)
    analysis: str = "univariate"
    variable: str | None = None
    references: tuple[int, ...] = (1,)
    ks: tuple[int, ...] = (8,)
    fusion: str = "concat_alpha"
    alpha: float = 0.5
    weight_mode: str = "square"
    weights_over: str = "selected"
    whiten: bool = False
    top_k: int = 250
    min_cover: float = 0.5
    patch: str = "rectangle"
    radius: float | None = None
    rotation: float = 0.0
    scale: float = 1.0
    crs_policy: str = "assume"
    footprint_crs: str | None = None
    grid_crs: str | None = None
    best_k: dict[str, dict[int, int]] = field(default_factory=dict)
    output: str = "results"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        wrong = []
        checks = {
            "analysis": self.analysis in ANALYSES, "patch": self.patch in PATCHES, "crs_policy": self.crs_policy in POLICIES and (self.crs_policy != "reproject" or (known_crs(self.footprint_crs) and known_crs(self.grid_crs))),
            "best_k": not self.best_k or all(self.best_ks(r) for r in self.references),
            "fusion": self.fusion in FUSIONS, "weight_mode": self.weight_mode in WEIGHT_NAMES, "alpha": 0 <= self.alpha <= 1,
            "min_cover": 0 < self.min_cover <= 1, "top_k": self.top_k >= 1, "window": self.window is None or (len(self.window) == 2 and min(self.window) >= 1),
            "stride": len(self.stride) == 2 and min(self.stride) >= 1, "ks": bool(self.ks) and min(self.ks) >= 1, "scale": self.scale > 0,
            "grids": len(self.grids) >= (2 if self.analysis == "multivariate" else 1), "references": bool(self.references),
            "variable": self.variable is None or any(v.lower() == self.variable.lower() for v in self.grids),
            "radius": self.patch != "circle" or (self.radius or 0) > 0 or (self.window is None and self.radius is None),
            "rotation": self.patch != "circle" or (self.rotation == 0 and self.scale == 1),
        }
        wrong = [k for k, ok in checks.items() if not ok]
        if wrong:
            raise ValueError(f"run {self.name!r}: wrong or missing settings: {', '.join(wrong)}")

    def grid_path(self, variable: str) -> str:
        """Path of a variable's grid; case doesn't matter."""
        for k, p in self.grids.items():
            if k.lower() == variable.lower():
                return p
        raise KeyError(f"no grid for {variable!r}; known: {', '.join(sorted(self.grids))}")

    def resolved(self) -> dict:
        """All settings, as the run uses them."""
        return asdict(self)

    def digest(self, data: str = "") -> str:
        """Short digest of every setting that changes a case's results, and of the data's own digest where given."""
        skip = ("name", "output", "references", "ks", "best_k")
        text = json.dumps({k: v for k, v in self.resolved().items() if k not in skip}, sort_keys=True, default=str)
        return hashlib.sha256(f"{text}\n{data}".encode()).hexdigest()[:12]

    def folder(self, reference: int, k: int | tuple[int, ...], data: str = "") -> str:
        """Folder of one case's results: the same for the same settings and data, another one for others."""
        ks = "-".join(map(str, k if isinstance(k, tuple) else (k,)))
        method = self.fusion if self.analysis == "multivariate" else "components"
        return f"{self.output}/{self.name}/run={self.digest(data)}/dep={reference}/method={method}/k={ks}"

    def variables(self) -> list[str]:
        """The variables that a case ranks by."""
        if self.analysis == "multivariate":
            return list(self.grids)
        return [self.variable or next(iter(self.grids))]

    def best_ks(self, reference: int) -> tuple[int, ...]:
        """Each variable's best k for a reference; empty where one has none."""
        tables = {v.lower(): t for v, t in self.best_k.items()}
        ks = [tables.get(v.lower(), {}).get(reference) or 0 for v in self.variables()]
        return tuple(ks) if min(ks) >= 1 else ()

    def cases(self, reference: int | None = None, k: int | None = None) -> list[tuple[int, int | tuple[int, ...]]]:
        """Reference and k of every case, with either fixed where given; with best_k, k is one number a variable."""
        out = []
        for r in [reference] if reference else self.references:
            best = self.best_ks(r) if self.best_k and not k else ()
            if self.best_k and not k and not best:
                raise ValueError(f"run {self.name!r}: no best k of every variable for reference {r}")
            out += [(r, best if len(best) > 1 else best[0])] if best else [(r, n) for n in ([k] if k else self.ks)]
        return out


def read(path: str) -> dict:
    """A YAML or JSON file whose root is a mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        doc = json.loads(text)
    else:
        import yaml

        doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise ValueError(f"{path}: the root must be a mapping")
    return doc


def merge(base: dict, patch: dict) -> dict:
    """base with patch's values, mappings merged at every depth."""
    out = dict(base)
    for k, v in patch.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def absolute_paths(value, at: str = "") -> list[str]:
    """Places in a nested document that hold absolute paths."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in absolute_paths(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, (list, tuple)):
        return [p for i, v in enumerate(value) for p in absolute_paths(v, f"{at}[{i}]")]
    return [at] if isinstance(value, str) and (os.path.isabs(value) or (len(value) > 2 and value[1:3] in (":\\", ":/"))) else []


def read_best_k(path: str) -> dict[int, int]:
    """Best k by reference from a CSV with columns deposit_1based and k_pcs; of repeated references the first row counts."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = csv.DictReader(f)
        if not {"deposit_1based", "k_pcs"} <= set(rows.fieldnames or ()):
            raise ValueError(f"{path}: the columns deposit_1based and k_pcs are needed")
        out: dict[int, int] = {}
        for r in rows:
            out.setdefault(int(float(r["deposit_1based"])), int(float(r["k_pcs"])))
    return out


#: Settings that named the files of the first and second variable in older configurations (fixed values).
OLDER_PATHS = (("variable_1_file_path", "tmi_file_path"), ("variable_2_file_path", "rad_file_path"))


def older_grids(paths: dict, variables: list[str]) -> dict[str, str]:
    """Grids by variable from a configuration's paths: variable_paths, whatever the case, else the older names by place."""
    named = {str(k).upper(): v for k, v in (paths.get("variable_paths") or {}).items()}
    out = {}
    for v, older in zip(variables, OLDER_PATHS):
        found = [named[v.upper()]] if v.upper() in named else [paths[k] for k in older if k in paths]
        if found:
            out[v] = found[0]
    return out


def build(doc: dict) -> Run:
    """A validated run; settings that aren't known are an error. A variable's best_k is a mapping or the path of a CSV."""
    known = set(Run.__dataclass_fields__)
    strange = sorted(set(doc) - known)
    if strange:
        raise ValueError(f"unknown settings: {', '.join(strange)}")
    lists = ("window", "stride", "references", "ks")
    if "best_k" in doc:
        best = {v: read_best_k(t) if isinstance(t, str) else {int(r): int(k) for r, k in t.items()} for v, t in doc["best_k"].items()}
        doc = doc | {"best_k": best}
    return Run(**{k: tuple(v) if k in lists and v is not None else v for k, v in doc.items()})
