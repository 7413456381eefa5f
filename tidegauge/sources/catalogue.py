"""Event catalogues: JSON documents with a map of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_of(docs: DataFrame, text: str, fields: str) -> DataFrame:
    """One row for each entry of the ``events`` map: its name and the fields; what is missing is null."""
    parsed = docs.select(F.from_json(text, f"events map<string, struct<{', '.join(f'{f.strip().split()[0]}: {f.strip().split()[1]}' for f in fields.split(','))}>>").alias("d"))
    return parsed.select(F.explode("d.events").alias("name", "e")).select("name", "e.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file; the fields are those that any event has, and units (``<field>_unit``) go to the columns' metadata."""
    text = spark.read.text(path, wholetext=True)
    schema = text.select(F.schema_of_json(F.lit(text.first().value))).first()[0]  # one document
    doc = text.select(F.from_json("value", schema).alias("d")).select("d.events.*")
    entries = doc.columns
    units: dict[str, str] = {}
    frames = []
    for e in entries:
        one = doc.select(F.lit(e).alias("name"), F.col(f"`{e}`.*"))
        marks = [c for c in one.columns if c.endswith("_unit")]
        row = one.select(*[F.col(f"`{m}`") for m in marks]).first() if marks else {}
        units |= {m.removesuffix("_unit"): row[m] for m in marks if row[m]}
        frames.append(one.drop(*marks))
    from tidegauge.sources.registry import merge

    out = merge(frames, "outer")
    for c, u in units.items():
        if c in out.columns:
            out = out.withMetadata(c, {"unit": u})
    return out
