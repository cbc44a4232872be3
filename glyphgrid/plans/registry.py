"""Every query of the engine, by name, with the SQL that states its result."""

from pyspark.sql import DataFrame, SparkSession

from glyphgrid.plans import catalog


def queries():
    return {name: q.build for name, q in catalog.all_queries().items()}


def oracle_sql():
    return {name: q.sql for name, q in catalog.all_queries().items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.all_queries()["o7_1_psnr"].build(spark, sf_dir)
