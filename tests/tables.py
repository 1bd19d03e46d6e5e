"""The given tables that tests read, and logs that they write."""

import uuid

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def new_log(spark, folder, table="activity_log"):
    """A log in a database of its own below ``folder``."""
    from changetrail.sources.log_table import LogTable

    database = f"test_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    return LogTable(spark, f"{database}.{table}")
