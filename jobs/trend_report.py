"""All yearly trends of a set of tidy tables as one partitioned table.

``python -m jobs.trend_report TABLES OUTPUT [--config FILE]``

The config says which columns of which files under ``TABLES`` are the papers,
their keywords, labels and affiliations; what lies in several files is joined.
``OUTPUT`` has ``item``, ``measure`` and ``value`` by ``report`` and ``year``:

* ``volume``: papers, citations and mean citations of a year;
* ``subfields``: papers, share of the year's papers and mean citations of a label;
* ``countries``: papers of a country;
* ``keywords``: papers' uses of a term, and their citations;
* ``top_cited``: citations of the year's most cited papers.

The whole output is replaced, so that a rerun over the same tables gives the
same rows and years that are no longer there go.  Papers without a year are in
no report.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from papertide.functions.text import terms
from papertide.operators import influence, trends
from papertide.operators.ingest import impact

log = logging.getLogger("jobs.trend_report")

REPORT = "item string, measure string, value double, report string, year int"


def settings(path: str | None = None) -> dict:
    return json.loads((Path(path) if path else Path(__file__).with_suffix(".json")).read_text())


def read(spark: SparkSession, tables: str, sources: list[dict]) -> DataFrame:
    """The columns of the first source, joined to those of the others by the columns that each names in ``on``."""

    def one(source: dict) -> DataFrame:
        df = spark.read.format(source.get("format", "parquet")).load(f"{tables}/{source['path']}")
        log.info("reading %d rows of %s/%s", df.count(), tables, source["path"])  # from the files' footers
        return df.selectExpr(*(f"{expression} AS `{name}`" for name, expression in source["columns"].items()))

    return reduce(lambda left, source: left.join(one(source), source["on"]), sources[1:], one(sources[0]))


def reports(papers: DataFrame, keywords: DataFrame, labels: DataFrame, affiliations: DataFrame, as_of_year: int, top_cited: int) -> dict[str, DataFrame]:
    """Wide tables with ``year``, ``item`` and a column for each measure."""
    papers = impact(papers, as_of_year)
    dated = papers.select("eid", "year", "citedby_count", "citations_per_year")
    # dealt out by paper first: distinct and join then need no shuffle of their own, and both readers of the labels share this one
    once = lambda df, column: df.select("eid", column).repartition("eid").distinct()
    long = dated.join(once(labels, "subfield"), "eid")
    aging, share = trends.citation_aging(long), trends.subfield_share(long, dated)
    where = once(affiliations, "country").join(dated, "eid").where("year IS NOT NULL")
    used = terms(keywords.select("eid", "author_keywords").join(dated, "eid"), "author_keywords").where("year IS NOT NULL")
    return {
        "volume": trends.papers_per_year(dated).withColumn("item", F.lit("all papers")),
        "subfields": share.join(aging, ["year", "subfield"], "left").select("year", F.col("subfield").alias("item"), F.coalesce("n_papers", F.lit(0)).alias("n_papers"), "share", "mean_citations"),
        "countries": influence.country_trends(where).withColumnRenamed("country", "item"),
        "keywords": used.groupBy("year", F.col("term").alias("item")).agg(F.count("*").alias("n_uses"), F.sum("citedby_count").alias("total_citations")),
        "top_cited": trends.top_cited_per_year(papers, top_cited).withColumnRenamed("title", "item"),
    }


def long_form(report: str, wide: DataFrame) -> DataFrame:
    """A row for each measure that has a value."""
    measures = [c for c in wide.columns if c not in ("year", "item")]
    values = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    rows = wide.select("year", "item", F.explode(F.array(*values)).alias("v"))
    return rows.select("item", "v.measure", "v.value", F.lit(report).alias("report"), F.col("year").cast("int").alias("year")).where("value IS NOT NULL")


def run(spark: SparkSession, tables: str, output: str, config: dict | None = None) -> None:
    """Writes all reports."""
    config = config or settings()
    given = {name: read(spark, tables, sources) for name, sources in config["tables"].items()}
    wide = reports(**given, as_of_year=config["as_of_year"], top_cited=config["top_cited"])
    rows = reduce(DataFrame.unionByName, (long_form(name, df) for name, df in wide.items()))
    written = Observation()
    rows = rows.hint("rebalance", "report", "year").observe(written, F.count("*").alias("n"))
    rows.write.mode("overwrite").partitionBy("report", "year").parquet(output)
    log.info("wrote %d rows of %d reports under %s", written.get["n"], len(wide), output)


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("tables", help="folder of the tables, also a remote one")
    args.add_argument("output")
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("trend_report").getOrCreate()
    try:
        run(spark, given.tables, given.output, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
