"""Command line: download, build, plot. Status 2 and a line on standard error for invalid input."""

from __future__ import annotations

import argparse
import dataclasses
import sys
from pathlib import Path


#: Options by command: flags (a name without dashes is an argument) and what argparse takes of them. Names and defaults are the interface.
_FOLDER = {"type": Path, "default": Path("data")}
COMMANDS: dict[str, tuple[str, dict[str, dict]]] = {
    "build": ("build the catchments of configured projects", {
        "config": {"type": Path}, "--source": {"type": Path}, "--cache-dir": _FOLDER, "--projects": {"nargs": "+"}, "--part": {"choices": ("local", "total"), "default": "local"},
        "--include-virtual|--exclude-virtual": {"dest": "virtual", "default": None}, "--output": {"type": Path, "required": True}, "--csv-output": {"type": Path}, "--bbox-buffer": {"type": float, "default": 0.3},
    }),
    "plot": ("compare polygon layers", {
        "inputs": {"type": Path, "nargs": "+"}, "--output": {"type": Path}, "--output-dir": {"type": Path}, "--labels": {"nargs": "+"}, "--title": {},
        "--project|--by-project": {"by_project": {"action": "store_true"}}, "--id-field": {"default": "id"}, "--name-field": {"default": "name"},
        "--coordinates": {"choices": ("lonlat", "projected"), "default": "lonlat"}, "--basemap": {"choices": ("none", "terrain", "light"), "default": "none"}, "--tile-cache": {"type": Path, "default": Path("data/map_tiles")},
    }),
    "download": ("fetch and verify the configured dataset", {"--config": {"type": Path, "required": True}, "--cache-dir": _FOLDER}),
}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="headwater", description="Catchments of projects on drainage networks, and layer comparison.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (what, options) in COMMANDS.items():
        command = commands.add_parser(name, help=what)
        for flags, given in options.items():
            if "|" not in flags:
                command.add_argument(flags, **given)
                continue
            either, first, second = command.add_mutually_exclusive_group(), *flags.split("|")
            if "dest" in given:  # two values of one switch
                either.add_argument(first, action="store_true", **given)
                either.add_argument(second, action="store_false", **given)
            else:
                either.add_argument(first)
                either.add_argument(second, **given["by_project"])
    return top


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("headwater").getOrCreate()


def _download(args) -> None:
    from headwater.config import load_config
    from headwater.sources.archive import download_dataset

    d = load_config(args.config).dataset
    print(download_dataset(d.region, d.level, d.version, args.cache_dir))


def _build(args) -> None:
    from headwater.config import load_config
    from headwater.sinks import check_buffer, guard_outputs, write_bbox_rows, write_geojson

    config = load_config(args.config)
    check_buffer(args.bbox_buffer)
    if args.virtual is not None:
        config = dataclasses.replace(config, dataset=dataclasses.replace(config.dataset, include_virtual_connections=args.virtual))
    source = args.source
    if source is None:
        from headwater.sources.archive import download_dataset

        source = download_dataset(config.dataset.region, config.dataset.level, config.dataset.version, args.cache_dir)
    guard_outputs(source, args.config, args.output, args.csv_output)
    from headwater.plans.catchments import build_features, features_of

    spark = _session()
    rows, meta = build_features(spark, config, source, args.part, args.projects)
    n = write_geojson({"type": "FeatureCollection", "metadata": meta}, args.output, features_of(rows, config))
    print(f"Wrote {n} {args.part} catchments to {args.output}")
    if args.csv_output is not None:
        n = write_bbox_rows(rows, args.csv_output, args.bbox_buffer)
        print(f"Wrote {n} project summaries to {args.csv_output}")
    if n := meta["repaired_geometry_count"]:
        print(f"Repaired {n} unit shapes")


def _plot(args) -> None:
    from headwater.plans.compare import overview_path, plot_by_project, plot_comparison, report_text

    if args.by_project and (args.output_dir is None or args.output is not None):
        raise ValueError("--by-project needs --output-dir and no --output")
    if not args.by_project and (args.output is None or args.output_dir is not None):
        raise ValueError("--output is needed, and no --output-dir without --by-project")
    same = {"labels": args.labels, "id_field": args.id_field, "name_field": args.name_field, "coordinates": args.coordinates, "basemap": args.basemap, "tile_cache": args.tile_cache}
    spark = _session()
    if args.by_project:
        made = plot_by_project(spark, args.inputs, args.output_dir, **same)
        overview = overview_path(args.output_dir)
        plot_comparison(spark, args.inputs, overview, title=args.title, **same)
        print(f"Wrote {len(made) + 1} figures to {args.output_dir}")
    else:
        print(report_text(plot_comparison(spark, args.inputs, args.output, project=args.project, title=args.title, **same)))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        {"download": _download, "build": _build, "plot": _plot}[args.command](args)
    except (ValueError, OSError) as error:
        print(f"headwater: {error}", file=sys.stderr)
        return 2
    return 0
