import pytest
from pyspark.sql import functions as F

from offerlens.__main__ import main
from offerlens.operators.snapshots import Implausible
from offerlens.sources import adapters


def test_rate_and_report(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    raw = spark.createDataFrame([("Rossetti Linda Bolgheri 2022 75 cl", 12.95), ("Farnese Montepulciano Casale", 9.95)], "name string, amount double")
    adapters.make_offers(raw, adapters.Shop("coop")).write.parquet(at("offers"))
    spark.createDataFrame([("e1", "Rossetti Linda Bolgheri", 2022, True, 4.2, 900, "https://r/x/w/77")], "entry_id string, name string, vintage int, rated boolean, rating double, rating_count int, url string").write.parquet(at("catalog"))
    main(["rate", "--offers", at("offers"), "--catalog", at("catalog"), "--work", at("work"), "--out", at("rated")], spark)
    for day in ("2026-01-01", "2026-01-02"):
        main(["report", "--rated", at("rated"), "--csv", at("csv"), "--snapshots", at("snaps"), "--date", day], spark)
    assert spark.read.parquet(at("snaps")).groupBy("run_date").count().count() == 2
    assert "status" in spark.read.option("sep", ";").option("header", True).csv(at("csv")).columns
    spark.read.parquet(at("rated")).limit(0).write.parquet(at("none"))
    with pytest.raises(Implausible):
        main(["report", "--rated", at("none"), "--csv", at("csv2"), "--snapshots", at("snaps"), "--date", "2026-01-03"], spark)


def test_ratings_in_and_out(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = spark.createDataFrame([("v", "a", "", 1), ("v", "b", "", 1)], "source string, name_key string, vintage string, x int")
    rows.write.parquet(at("cache"))
    rows.withColumn("x", F.lit(2)).unionByName(rows.limit(1).withColumn("name_key", F.lit("c"))).write.parquet(at("export"))
    main(["ratings-import", "--cache", at("cache"), "--export", at("export"), "--out", at("out")], spark)
    assert sorted((r["name_key"], r["x"]) for r in spark.read.parquet(at("out")).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    with pytest.raises(Implausible):
        main(["ratings-export", "--cache", at("cache"), "--previous", at("export"), "--out", at("again")], spark)
    main(["ratings-export", "--cache", at("out"), "--previous", at("export"), "--out", at("again")], spark)
