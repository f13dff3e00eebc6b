"""From a workspace's metadata to what its packages enable: profiles and target seeds.

The metadata is the JSON that the build tool prints; who runs it is the caller.  All of a
workspace's packages are few rows, so what is told of them goes to the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cfg
from ..functions.rust_lexer import COMMENT, WHITESPACE, lex
from ..operators import features, workspace
from ..sources import build, manifest


@dataclass
class Request:
    """What a user asks of a workspace's features."""

    all_features: bool = False
    no_default: bool = False
    selectors: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    target_triple: str | None = None
    host_triple: str | None = None

    @property
    def mode(self) -> str:
        return features.feature_mode(self.all_features, self.no_default, bool(self.selectors), bool(self.excluded))


@dataclass
class Prepared:
    profiles: list[tuple[str, cfg.Profile]]  # a package's folder from the root, and its profile
    targets: DataFrame | None
    diagnostics: list[tuple[str | None, str]]


def platform_holds(platform: str | None, profile: cfg.Profile, triple: str | None) -> bool | None:
    """Whether a dependency's platform fits: no platform always does, a triple by its name, a
    predicate unless it is never true."""
    if platform is None:
        return None
    text = platform.strip()
    if text.startswith("cfg(") and text.endswith(")"):
        words = [t.text for t in lex(text[4:-1]) if t.kind not in (WHITESPACE, COMMENT)]
        return profile.evaluate(cfg.parse(words), False) > 0
    return triple is None or text == triple


def relative(path: str, root: str) -> str:
    rel = os.path.relpath(os.path.realpath(path), os.path.realpath(root)).replace(os.sep, "/")
    return "" if rel == "." else rel


def prepare(spark: SparkSession, metadata: str, root: str, paths: list[str], plain: cfg.Profile, request: Request, snapshot: str = "after") -> Prepared:
    """Profiles and target seeds of the packages that ``paths`` select, by paths from ``root``."""
    meta = build.metadata(spark, metadata)
    own = meta["package"].where("own").select(F.col("name").alias("package"), "root")
    folders = {r["package"]: r["root"] for r in own.collect()}
    shown = spark.createDataFrame([(p, f, relative(f, root)) for p, f in folders.items()], "package string, folder string, root string")
    asked = spark.createDataFrame([(relative(p, root), os.path.isdir(p)) for p in paths], "path string, is_folder boolean")
    chosen = workspace.selected(shown, asked)
    platforms = [r["platform"] for r in meta["dependency"].select("platform").where("platform is not null").distinct().collect()]
    fits = spark.createDataFrame([(p, platform_holds(p, plain, request.host_triple), platform_holds(p, plain, request.target_triple or request.host_triple)) for p in platforms], "platform string, host_match boolean, target_match boolean")
    dependency = meta["dependency"].join(F.broadcast(fits), "platform", "left")
    roots = workspace.root_contexts(chosen, meta["target"])
    edges = features.matching(dependency, roots)
    reached = features.reachable(edges, roots)
    seeds, active = workspace.seeds(roots, meta["member"], edges, reached, all_features=request.all_features, no_default=request.no_default, selectors=request.selectors)
    begun = roots.unionByName(active).distinct()
    enabled = features.resolve(meta["member"], dependency, begun, seeds)
    away = workspace.excluded(request.excluded, enabled, edges, roots, reached) if request.excluded else None
    if away is not None:
        enabled = enabled.join(away, ["package", "feature"], "left_anti")
    on: dict[str, set] = {p: set() for p in folders}
    for r in enabled.select("package", "feature").distinct().collect():
        on.setdefault(r["package"], set()).add(r["feature"])
    gone: dict[str, set] = {}
    for r in away.collect() if away is not None else []:
        gone.setdefault(r["package"], set()).add(r["feature"])
    profiles = [(relative(folders[p], root), replace(plain, enabled=frozenset(on[p]), excluded=frozenset(gone.get(p, ())))) for p in folders]
    files, diagnostics = [], []
    for p, folder in folders.items():
        try:
            with open(os.path.join(folder, "Cargo.toml"), "rb") as f:
                files.append((folder, f.read()))
        except OSError as e:
            diagnostics.append((relative(folder, root), f"manifest can't be read: {e.strerror}"))
    tables = manifest.read(spark.createDataFrame(files, "root string, content binary"))
    diagnostics += [(relative(r["root"], root), r["error"]) for r in tables.where("error is not null").collect()]
    gates = workspace.target_seeds(manifest.bench_enabled(meta["target"], tables), chosen, enabled)
    rows = [(snapshot, relative(r["path"], root), r["role"], r["production"], r["test"]) for r in gates.collect()]
    targets = spark.createDataFrame(rows, "snapshot string, path string, role string, production int, test int") if rows else None
    return Prepared(profiles, targets, diagnostics)
