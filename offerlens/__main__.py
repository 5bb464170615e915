"""Commands over Parquet tables: ``python -m offerlens COMMAND ...``."""

from __future__ import annotations

import argparse
import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import maturity, snapshots
from .plans import flow
from .sources import registry, shops


def _session() -> SparkSession:
    return SparkSession.builder.appName("offerlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    """Landed pages (source, url, html, status_code) to offers; sources that gave none keep their earlier ones."""
    kinds = {r["key"]: r["adapter"] for r in registry.select(registry.load(spark, a.file), a.only.split(",") if a.only else None).collect()}
    landed = spark.read.parquet(a.landed)
    known = {k: v for k, v in kinds.items() if v in shops.READERS or v == "tile_shop"}
    options = {k: {"today": F.lit(a.date).cast("date")} for k, v in known.items() if v == "aggregator"}
    found, report = shops.fetch(landed, known, **options)
    found = found.withColumn("fetched_at", F.lit(a.date).cast("timestamp"))
    if a.offers:
        found = snapshots.replace_source(spark.read.parquet(a.offers), found, report)
    report.orderBy("source").show(1000, truncate=False)
    flow.write_table(found, a.out)


def _rate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Offers and a catalog to rated, scored items; a cache answers what it still knows and learns the rest."""
    offers, catalog = spark.read.parquet(a.offers), spark.read.parquet(a.catalog)
    if "fetched_at" in offers.columns and not a.all:
        offers = snapshots.live_offers(offers, F.current_timestamp())
    if a.limit:  # for a trial run: the first items in order of their key
        keys = offers.select("dedup_key").distinct().orderBy("dedup_key").limit(int(a.limit))
        offers = offers.join(F.broadcast(keys), "dedup_key", "left_semi")
    keep = flow.tables_in(a.work)
    old = spark.read.parquet(a.cache) if a.cache else None
    if old is not None and a.rejudge:  # matches that were only similar are judged anew
        old = old.where("confidence <> 'fuzzy'")
    if old is not None and a.add_missing:  # entries without a rating are looked up again
        old = old.where("rating IS NOT NULL")
    items = flow.rate(offers, catalog, keep=keep, cache=old, refresh=a.refresh, retry_failed=a.retry_failed).items if old is not None else flow.rate(offers, catalog, keep=keep).items
    flow.write_table(flow.score(items, keep, a.marketplaces.split(",") if a.marketplaces else []), a.out)
    if old is not None:
        new = flow.cache_rows(items, F.current_timestamp())
        both = keep(snapshots.upsert(spark.read.parquet(a.cache), new.select(*old.columns), ["name_key", "vintage"]))
        flow.write_table(both, a.cache)


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rated items to a table, a dated snapshot and the changes since the last one; implausible results are refused."""
    items = spark.read.parquet(a.rated)
    previous: DataFrame | None = None
    try:
        runs = spark.read.parquet(a.snapshots)
        day = runs.where(F.col("run_date") < F.lit(a.date).cast("date")).agg(F.max("run_date")).first()[0]
        previous = runs.where(F.col("run_date") == F.lit(day)) if day else None
    except Exception as e:  # the first run has no snapshots yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if not a.force:
        snapshots.check(items, previous.where("rating IS NOT NULL").count() if previous is not None else None)
    sellers = [r[0] for r in items.select(F.explode("prices.seller")).distinct().collect()]
    flow.write_csv(flow.flat(items, sellers), a.csv)
    current = items.select(F.col("item").alias("key"), "name", F.col("best_price").alias("price"), "rating", "status")
    if previous is not None:
        print(flow.diff_markdown(snapshots.snapshot_diff(previous, current)))
    flow.write_snapshot(current, a.snapshots, a.date)


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    """All steps: fetch, rate, report."""
    a.offers, a.out, rated = "", f"{a.work}/offers", f"{a.work}/rated"
    _fetch(spark, a)
    a.offers, a.out, a.all = f"{a.work}/offers", rated, True
    _rate(spark, a)
    a.rated = rated
    _report(spark, a)


def _site(spark: SparkSession, a: argparse.Namespace) -> None:
    """The page's data: the last runs' rows as JSON; a page of a later run or with many more rows is not replaced."""
    runs = spark.read.parquet(a.snapshots)
    days = [str(r[0]) for r in runs.select("run_date").distinct().orderBy(F.desc("run_date")).limit(int(a.runs)).collect()]
    page = {d: json.loads(flow.page_json(runs.where(F.col("run_date") == F.lit(d)), {"key": "k", "name": "n", "price": "p", "rating": "r", "status": "s"})) for d in days}
    if os.path.exists(a.out):
        with open(a.out, encoding="utf-8") as f:
            old = json.load(f)
        last = max(old, default=None)
        snapshots.check_page(len(page[days[0]]) if days else 0, len(old[last]) if last else None, days[0] if days else "", last, a.force)
    part = a.out + ".new"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(page, f, ensure_ascii=False, separators=(",", ":"))
    os.replace(part, a.out)


def _maturity(spark: SparkSession, a: argparse.Namespace) -> None:
    """Drinking maturity of rated items by a region table (YAML) and its words for regions (Parquet: region, token)."""
    items = flow.enrich(spark.read.parquet(a.rated), tokens=spark.read.parquet(a.tokens), table=maturity.load(spark, a.table).drop("quality"), today=int(a.date[:4]))
    items.select("item", "name", "vintage", "maturity.code", "maturity.note", "maturity.conflict").where("code IS NOT NULL").orderBy("item").show(1000, truncate=False)


def _sources(spark: SparkSession, a: argparse.Namespace) -> None:
    registry.load(spark, a.file).orderBy("kind", "key").show(1000, truncate=False)


def _import(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ratings of an export that the cache lacks; nothing is overwritten."""
    keys = ["source", "name_key", "vintage"]
    flow.write_table(snapshots.import_missing(spark.read.parquet(a.cache), spark.read.parquet(a.export), keys), a.out)


def _export(spark: SparkSession, a: argparse.Namespace) -> None:
    """The cache's ratings, unless a previous export knows keys that would be lost."""
    rows = spark.read.parquet(a.cache)
    if a.previous and (lost := snapshots.uncovered_keys(spark.read.parquet(a.previous), rows, ["source", "name_key", "vintage"]).count()) and not a.force:
        raise snapshots.Implausible(f"{lost} ratings of the previous export are missing")
    flow.write_table(rows, a.out)


def _stats(spark: SparkSession, a: argparse.Namespace) -> None:
    snapshots.cache_stats(spark.read.parquet(a.cache), spark.read.parquet(a.offers)).show(truncate=False)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="offerlens", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run: object, *flags: str, **options: str | None) -> None:
        c = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        for f in flags:
            c.add_argument("--" + f, action="store_true")
        for o, default in options.items():
            c.add_argument("--" + o, default=default, required=default is None)
        c.set_defaults(run=run)

    today = str(datetime.date.today())
    rating = ("refresh", "retry-failed", "add-missing", "rejudge")
    command("fetch", _fetch, landed=None, file=None, only="", offers="", out=None, date=today)
    command("rate", _rate, "all", *rating, offers=None, catalog=None, work=None, out=None, cache="", limit="", marketplaces="")
    command("run", _run, "force", *rating, landed=None, file=None, only="", catalog=None, work=None, cache="", limit="", marketplaces="", csv=None, snapshots=None, date=today)
    command("site", _site, "force", snapshots=None, runs="1", out=None)
    command("maturity", _maturity, rated=None, tokens=None, table=None, date=today)
    command("report", _report, "force", rated=None, csv=None, snapshots=None, date=today)
    command("sources", _sources, file=None)
    command("ratings-import", _import, cache=None, export=None, out=None)
    command("ratings-export", _export, "force", cache=None, out=None, previous="")
    command("cache-stats", _stats, cache=None, offers=None)
    a = p.parse_args(args)
    a.run(spark or _session(), a)


if __name__ == "__main__":
    main()
