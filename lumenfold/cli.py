"""``python -m lumenfold.cli PATH... [--baseline REF] [--metadata FILE] [--format json]``:
metrics of source trees."""

from __future__ import annotations

import argparse
import os
import sys

from .functions import cfg


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lumenfold", description="Line, complexity and public-item counts of Rust source by build role.")
    p.add_argument("paths", nargs="+")
    p.add_argument("--baseline", metavar="REF", help="compare with one commit")
    p.add_argument("--metadata", metavar="FILE", help="the build tool's metadata of the workspace, as JSON")
    p.add_argument("--format", choices=("table", "json"), default="table")
    p.add_argument("--files", action="store_true", help="list files in tables")
    p.add_argument("--summary-only", action="store_true", help="leave files out of JSON")
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--cfg", action="append", default=[], help="a predicate that holds")
    p.add_argument("--not-cfg", action="append", default=[], help="a predicate that doesn't")
    p.add_argument("--printed-cfg", metavar="FILE", help="the predicates that the compiler prints")
    p.add_argument("--features", default="", help="enabled features, comma-separated; PACKAGE/FEATURE with metadata")
    p.add_argument("--all-features", action="store_true")
    p.add_argument("--no-default-features", action="store_true")
    p.add_argument("--exclude-features", default="", help="features that are off at the end, comma-separated")
    p.add_argument("--target", help="the target's triple")
    p.add_argument("--host", help="the host's triple")
    p.add_argument("--test-attribute", action="append", default=[])
    a = p.parse_args(argv)
    if a.summary_only and a.format != "json":
        p.error("--summary-only needs --format json")
    if a.files and a.format == "json":
        p.error("--files is for tables")
    if (a.all_features or a.no_default_features or a.exclude_features) and not a.metadata:
        p.error("features of packages need --metadata")
    norm = lambda values: frozenset("=".join(x.strip('"') for x in "".join(v.split()).split("=", 1)) for v in values)
    a.true, a.false = norm(a.cfg), norm(a.not_cfg)
    if clash := a.true & a.false:
        p.error(f"{sorted(clash)[0]} is set both ways")
    a.enabled = [f for f in a.features.split(",") if f]
    a.excluded = [f for f in a.exclude_features.split(",") if f]
    return a


def profile(a: argparse.Namespace) -> cfg.Profile:
    true, false, closed = a.true, a.false, frozenset()
    if a.printed_cfg:
        from .sources.build import compiler_cfg

        with open(a.printed_cfg, encoding="utf-8") as f:
            true, false, closed = compiler_cfg(f.read(), a.cfg, a.not_cfg)
    plain = frozenset(a.enabled) if a.enabled and not a.metadata else None
    return cfg.Profile(known_true=true, known_false=false, closed_names=closed, enabled=plain, test_attributes=frozenset(a.test_attribute))


def main(argv: list[str] | None = None) -> int:
    try:
        code = _main(argv)
        sys.stdout.flush()
        return code
    except BrokenPipeError:
        # Who reads has enough; what is left goes nowhere.
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0


def _main(argv: list[str] | None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import render, snapshot, workspace
    from .sources import revision, tree

    if a.baseline:
        revision.check_ref(a.baseline)
    spark = SparkSession.builder.appName("lumenfold").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    # Tasks find this package where the driver does.
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    root = tree.common_root(a.paths)
    files, unread = tree.load(spark, tree.discover(a.paths, hidden=a.hidden, no_ignore=a.no_ignore), root)
    before, sides = None, None
    if a.baseline:
        top = revision._git(root, "rev-parse", "--show-toplevel").decode().strip()
        tree.baseline_paths(a.paths, top, revision.tree(top, a.baseline))
        inside = workspace.relative(root, top)
        before = revision.load(spark, top, a.baseline, [inside] if inside else [])
        if inside:
            before = before.withColumn("path", F.expr(f"substring(path, {len(inside) + 2})"))
        files = files.unionByName(before)
    plain, prepared = profile(a), None
    if a.metadata:
        with open(a.metadata, encoding="utf-8") as f:
            text = f.read()
        request = workspace.Request(a.all_features, a.no_default_features, a.enabled, a.excluded, a.target, a.host)
        prepared = workspace.prepare(spark, text, root, a.paths, plain, request)
        unread = [*unread, *prepared.diagnostics]
    packages = prepared.profiles if prepared else []
    targets = prepared.targets if prepared else None
    if targets is not None and a.baseline:
        targets = targets.unionByName(targets.withColumn("snapshot", F.lit("before")))
    measure = lambda df: snapshot.measured(df, plain, packages)
    whole = snapshot.expanded(measure(files), tree.loader(spark, root, before), measure)
    tables = snapshot.report(whole, targets)
    extra = {"selection": tree.selection(a.paths, root, hidden=a.hidden, no_ignore=a.no_ignore)}
    if a.metadata:
        extra["features"] = request.mode
    if a.baseline:
        known = {"cfg": sorted(plain.known_true), "not_cfg": sorted(plain.known_false)}
        sides = {"before": revision.endpoint(root, a.baseline, known), "after": revision.endpoint(root, None, known)}
        out = snapshot.compared(tables["roles"])
        sys.stdout.write(render.comparison_json(out, a.summary_only, extra | sides) if a.format == "json" else render.comparison_table(out))
    else:
        sys.stdout.write(render.snapshot_json(tables, "after", a.summary_only, extra) if a.format == "json" else render.snapshot_table(tables, "after", a.files))
    bad = [(r["snapshot"], r["path"], r["message"]) for r in tables["diagnostics"].orderBy("snapshot", "path", "message").collect()]
    bad += [("after", path, message) for path, message in unread]
    for side, path, message in bad:
        print(f"warning: {f'{side}: ' if a.baseline else ''}{path}: {message}", file=sys.stderr)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
