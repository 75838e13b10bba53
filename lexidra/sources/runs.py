"""Runs and metric tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_JSON_TYPE = "map<string,map<string,double>>"


def write_run(run: DataFrame, path: str) -> None:
    """Store ``(query_id, doc_id, score)`` as JSON lines ``{query: {doc: score}}``, many documents per line.

    A query with very many hits is written as several lines, so that no task has to hold
    the hits of a whole query; ``read_run`` merges them again.
    """
    lines = (
        run.select(
            F.col("query_id").cast("string").alias("q"),
            F.col("doc_id").cast("string").alias("d"),
            F.col("score").cast("double").alias("s"),
        )
        .withColumn("part", F.pmod(F.xxhash64("d"), F.lit(64)))
        .groupBy("q", "part")
        .agg(F.map_from_entries(F.collect_list(F.struct("d", "s"))).alias("hits"))
    )
    lines.select(F.to_json(F.create_map("q", "hits")).alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``{query: {doc: score}}`` JSON as long rows ``(query_id, doc_id, score)`` with string ids.

    The files may hold one object for all queries, on one line or indented, or an object a line.
    They are cut behind closing braces, which is behind the hits of a query, so the tasks share
    even a single line.  Where an id holds such a brace itself, lines are read whole.  Anything
    but such objects is refused when it is read.
    """
    records = spark.read.text(path, lineSep="}")
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    if records.where(quotes % 2 == 1).isEmpty():
        # What opens or goes on with the object around a query's hits.
        hits = F.regexp_replace("value", r"^[\s,{]*", "")
        texts = records.select(hits.alias("hits")).where("hits <> ''").select(F.concat(F.lit("{"), "hits", F.lit("}}")).alias("value"))
    else:
        texts = spark.read.text(path).where("trim(value) <> ''")
    nested = texts.select(F.from_json("value", RUN_JSON_TYPE, {"mode": "FAILFAST"}).alias("run"))
    return nested.select(F.explode("run").alias("query_id", "hits")).select(
        "query_id", F.explode("hits").alias("doc_id", "score")
    )


def append_metrics(metrics: DataFrame, path: str, run_tag: str, **parameters: object) -> None:
    """Append ``(metric, k, value)`` with the parameters of the run, partitioned by ``run_tag``."""
    pairs: list[Column] = []
    for name, value in sorted(parameters.items()):
        pairs += [F.lit(name), F.lit(str(value))]
    described = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    metrics.withColumn("parameters", described).withColumn("run_tag", F.lit(run_tag)).write.mode("append").partitionBy(
        "run_tag"
    ).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, k, value, parameters, run_tag)`` of all runs stored at ``path``."""
    schema = "metric string, k bigint, value double, parameters map<string,string>, run_tag string"
    return spark.read.schema(schema).parquet(path)
