"""Command line: ``python -m swelter <build|detect|append|summarise|inspect> --root ...``."""

from __future__ import annotations

import argparse

from swelter.params import DetectParams
from swelter.session import build_session
from swelter.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="swelter")
    sub = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--root", required=True, help="folder of the project's tables")
        p.add_argument("--tvar", choices=("tmax", "tmean"), default="tmax")
        p.add_argument("--pct", type=float, nargs="+", default=[80.0, 90.0, 95.0])
        return p

    p = job("build", "ingest daily fields, thresholds, exceedances")
    p.add_argument("--t-rasters")
    p.add_argument("--td-rasters")
    p.add_argument("--glob", default="*.zip")
    p.add_argument("--cache", help="folder of daily .npz caches")
    p.add_argument("--cache-glob", default="HI_*.npz")
    p.add_argument("--axes", help="folder of rasters with the grid of the caches")
    p.add_argument("--days", help="CSV or Parquet table of wanted days")

    p = job("detect", "heat-wave days, clusters and events")
    p.add_argument("--measure", choices=("t", "hi"), nargs="+", default=["t", "hi"])
    area = p.add_mutually_exclusive_group(required=True)
    area.add_argument("--region-area-km2", type=float)
    area.add_argument("--region-areas", help="CSV or Parquet table of areas, summed over its area column")
    for name, default in (
        ("min-area-km2", 1000.0), ("hull-gate-km2", 1000.0), ("pixel-size-km", 0.8), ("cluster-cutoff-km", 1000.0)
    ):
        p.add_argument(f"--{name}", type=float, default=default)
    for name, default in (("min-hot-cells", 90), ("min-duration", 3), ("grace-days", 1), ("tile", 256)):
        p.add_argument(f"--{name}", type=int, default=default)

    p = job("append", "exposure of admissions")
    p.add_argument("--patients", required=True)
    p.add_argument("--zips", required=True)
    p.add_argument("--zip-buffer-cells", type=int, default=1)

    p = job("summarise", "accumulated index per period")
    p.add_argument("--measure", choices=("t", "hi"), default="t")
    p.add_argument("--group-by", choices=("year", "month", "month-of-year"), default="year")
    p.add_argument("--png")
    p.add_argument("--title", default="Annual Accumulated HSCI")

    p = sub.add_parser("inspect", help="list the columns of a table")
    p.add_argument("path")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.job == "inspect":
        from swelter.sources.tables import column_listing

        print("\n".join(f"{n} {t}" for n, t in column_listing(spark.read.parquet(args.path))))
        return
    store = Store(spark, args.root, args.tvar)
    if args.job == "build":
        from swelter.plans.build import build, ingest_axes, ingest_cache, ingest_rasters, read_days

        failed = 0
        if args.t_rasters and args.td_rasters:
            failed += ingest_rasters(store, args.t_rasters, args.td_rasters, args.glob).count()
        if args.axes:
            ingest_axes(store, args.axes, args.glob)
        if args.cache:
            failed += ingest_cache(store, args.cache, args.cache_glob).count()
        if failed:
            print(f"{failed} files could not be read; {store.path('source_file')} lists them with the errors")
        build(store, args.pct, days=read_days(spark, args.days) if args.days else None)
    elif args.job == "detect":
        from swelter.plans.detect import detect, region_area

        if args.region_areas:
            args.region_area_km2 = region_area(spark, args.region_areas)
        names = DetectParams.__dataclass_fields__
        detect(store, DetectParams(**{k: v for k, v in vars(args).items() if k in names}), args.pct, args.measure)
    elif args.job == "append":
        from swelter.plans.append import append

        append(store, args.patients, args.zips, args.pct, args.zip_buffer_cells)
    else:
        from swelter.plans.summarise import summarise

        for pct in args.pct:
            summarise(store, args.measure, pct, args.group_by, args.png, args.title)


if __name__ == "__main__":
    main()
