"""Spec files as a table, one row per (source, version)."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookloom.schemas import SPECS

_NULL_AND_MERGE = ("tag:yaml.org,2002:null", "tag:yaml.org,2002:merge")


def _yaml_loader():
    """YAML loader that keeps every scalar as written, so version 2.10 stays '2.10'."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading spec files needs PyYAML on the executors") from missing

    class AsWritten(yaml.SafeLoader):
        pass

    AsWritten.yaml_implicit_resolvers = {
        first: [(tag, pattern) for tag, pattern in entries if tag in _NULL_AND_MERGE]
        for first, entries in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    return lambda text: yaml.load(text, Loader=AsWritten)


def _text_map(node) -> dict[str, str]:
    return {str(k): "" if v is None else str(v) for k, v in (node or {}).items()}


def _spec_row(document: dict | None) -> dict:
    spec = document or {}
    fields = spec.get("fields") or {}
    text = lambda value: "" if value is None else str(value)
    return {
        "source": text(spec.get("source")),
        "version": text(spec.get("version")),
        "type_header": text(spec.get("type_header")),
        "type_field": text(spec.get("type_field")),
        "type_mapping": _text_map(spec.get("type_mapping")),
        "external_id_path": text(fields.get("external_id")),
        "timestamp_path": text(fields.get("timestamp")),
        "fields_data": _text_map(fields.get("data")),
        "signature_header": text(spec.get("signature_header")),
        "signature_secret_env": text(spec.get("signature_secret_env")),
        "redact_raw": text(spec.get("redact_raw")).lower() in ("true", "yes", "on", "y"),
    }


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    load = _yaml_loader()
    columns = [*SPECS.names, "_file"]
    for batch in batches:
        rows = [
            {**_spec_row(load(text)), "_file": name}
            for text, name in zip(batch["value"], batch["_file"])
        ]
        yield pd.DataFrame(rows, columns=columns)


def builtin_specs(spark: SparkSession) -> DataFrame:
    """The specs this package brings along, a local table; executors need not have its files."""
    load = _yaml_loader()
    files = sorted(
        (f for f in resources.files("hookloom").joinpath("specs").iterdir() if f.name.endswith(".yml")),
        key=lambda f: f.name,
    )
    rows = [_spec_row(load(f.read_text(encoding="utf-8"))) for f in files]
    last = {(row["source"], row["version"]): row for row in rows}
    return spark.createDataFrame([tuple(row[name] for name in SPECS.names) for row in last.values()], SPECS)


def load_spec_catalog(spark: SparkSession, path: str | None = None, recursive: bool = True) -> DataFrame:
    """Read the ``*.yml`` specs under ``path``, or the built-in ones; a later file wins over an earlier one.

    A folder is read by the executors and must be shared by them. All its subfolders count,
    or only its top level with ``recursive=False``.
    """
    if path is None:
        return builtin_specs(spark)
    files = (
        spark.read.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", "*.yml")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("value", F.col("_metadata.file_path").alias("_file"))
    )
    parsed = files.mapInPandas(_parse_files, SPECS.simpleString()[len("struct<"):-1] + ",_file string")
    last = parsed.groupBy("source", "version").agg(
        F.max_by(F.struct(*[c for c in SPECS.names if c not in ("source", "version")]), "_file").alias("s")
    )
    return last.select("source", "version", "s.*").select(*SPECS.names)
