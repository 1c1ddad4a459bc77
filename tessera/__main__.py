"""Run a query over a folder of tables: python -m tessera cooc_track_topk --tables DIR --out PATH [--mode public|inference|both] [--without-external]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import queries
from tessera.sources.tables import is_complete, write_artifact

#: Rows of a mode, for queries that have labelled rows (a gold) and others.
MODES = ("both", "inference", "public")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    out.add_argument("query", choices=sorted(queries.QUERIES))
    out.add_argument("--tables", required=True, help="folder of the tables")
    out.add_argument("--out", required=True, help="artifact to write")
    out.add_argument("--mode", choices=MODES, default="both", help="public: rows with a gold; inference: rows without")
    out.add_argument("--without-external", action="store_true", help="leave rows of external counts out, the columns stay")
    out.add_argument("--overwrite", action="store_true")
    return out


def select(df, mode: str, without_external: bool):
    """Rows of a mode, by the column gold where there is one; without external counts none of kind external, and their part is 0."""
    if "gold" in df.columns and mode != "both":
        df = df.filter(F.col("gold").isNotNull() if mode == "public" else F.col("gold").isNull())
    if without_external:
        df = df.filter(F.col("kind") != "external") if "kind" in df.columns else df
        df = df.withColumn("external", F.lit(0).cast(df.schema["external"].dataType)) if "external" in df.columns else df
    return df


def main(args: list[str] | None = None) -> None:
    own = parser().parse_args(args)
    if is_complete(own.out) and not own.overwrite:
        print(f"{own.out} is complete")
        return
    spark = SparkSession.builder.appName(f"tessera {own.query}").getOrCreate()
    df = select(queries.QUERIES[own.query](spark, own.tables), own.mode, own.without_external)
    write_artifact(df, own.out, {"query": own.query, "tables": own.tables, "mode": own.mode, "external": not own.without_external})


if __name__ == "__main__":
    main()
