"""Spec catalog: merge, latest versions, checks, listing and the compiled lookup."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.functions.payload import compile_path, value_at, without_null
from hookloom.functions.requests import hmac_pads
from hookloom.schemas import SPECS
from hookloom.session import MAX_BROADCAST_BYTES, localize_if_small

SPEC_KEY = ("source", "version")
SCALAR_PATHS = ("_type_path", "_external_path", "_timestamp_path")


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Union of catalogs; for one (source, version) the last catalog given wins."""
    rest = [c for c in SPECS.names if c not in SPEC_KEY]
    ranked = [c.select(*SPECS.names, F.lit(i).alias("_rank")) for i, c in enumerate(catalogs)]
    union = ranked[0]
    for more in ranked[1:]:
        union = union.unionByName(more)
    winner = F.max_by(F.struct(*rest), F.col("_rank")).alias("_spec")
    return union.groupBy(*SPEC_KEY).agg(winner).select(*SPEC_KEY, "_spec.*").select(*SPECS.names)


def latest_specs(catalog: DataFrame) -> DataFrame:
    """Highest version of each source in string order, so '2.0' beats '10.0'."""
    columns = catalog.columns
    rest = [c for c in columns if c != "source"]
    newest = F.max_by(F.struct(*rest), F.col("version")).alias("_spec")
    return catalog.groupBy("source").agg(newest).select("source", "_spec.*").select(*columns)


def validate_specs(catalog: DataFrame) -> DataFrame:
    """One row per broken rule: source, version, rule."""
    rules = {
        "source is required": _blank("source"),
        "version is required": _blank("version"),
        "type_header or type_field is required": _blank("type_header") & _blank("type_field"),
        "type_header and type_field exclude each other": ~_blank("type_header") & ~_blank("type_field"),
        "signature_header needs signature_secret_env":
            ~_blank("signature_header") & _blank("signature_secret_env"),
        "a path segment may not hold both kinds of quotes": F.exists(
            F.concat(
                F.array("type_field", "external_id_path", "timestamp_path"),
                F.coalesce(F.map_values("fields_data"), F.array().cast("array<string>")),
            ),
            lambda path: F.exists(
                F.split(F.coalesce(path, F.lit("")), r"\."), lambda step: step.contains("'") & step.contains('"')
            ),
        ),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return catalog.select("source", "version", F.explode(broken).alias("rule"))


def catalog_coverage(catalog: DataFrame) -> DataFrame:
    """Per source: number of versions, and of specs without mappings or data fields."""
    return catalog.groupBy("source").agg(
        F.count("*").alias("versions"),
        F.count_if(F.coalesce(F.size("type_mapping"), F.lit(0)) <= 0).alias("without_mapping"),
        F.count_if(F.coalesce(F.size("fields_data"), F.lit(0)) <= 0).alias("without_data"),
        F.sum(F.size("type_mapping")).alias("mappings"),
        F.sum(F.size("fields_data")).alias("data_fields"),
    )


def list_specs(catalog: DataFrame) -> DataFrame:
    return catalog.select("source", "version", "type_header", "type_field").orderBy("source", "version")


def spec_types(catalog: DataFrame) -> DataFrame:
    """Type mappings of all specs as rows."""
    return catalog.select(
        "source", "version", F.explode("type_mapping").alias("provider_type", "type")
    )


@dataclass(frozen=True)
class SpecLookup:
    """What `resolve_specs` joins and what normalization takes from the joined spec.

    ``table`` holds every spec, plus each source's latest under a NULL version. ``data``
    is the expression for all data fields over the columns it adds and ``_payload``.
    ``scalar_paths`` holds the compiled paths of a catalog small enough to be part of the
    plan; it is empty for a larger one, which takes its paths from the joined row.
    """

    table: DataFrame
    data: Column
    scalar_paths: dict[str, list[str]] = field(default_factory=dict)


def extract_fields(paths_by_spec: Mapping[tuple[str, str], Mapping[str, str]]) -> Column:
    """Every data key of a row's spec with the value at its path, NULL where there is none.

    Specs given here get literal paths, others take theirs from the row.
    """
    body = F.col("_payload")
    values = F.transform_values("_data_paths", lambda _, path: value_at(body, path))
    if paths_by_spec:
        branches = F
        for (source, version), paths in paths_by_spec.items():
            pairs = [
                part
                for key, path in paths.items()
                for part in (F.lit(key), F.try_variant_get(body, path, "variant"))
            ]
            fields = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,variant>")
            branches = branches.when((F.col("source") == source) & (F.col("version") == version), fields)
        values = branches.otherwise(values)
    return F.transform_values(values, lambda _, value: without_null(value))


# Catalogs with more data fields than this keep their paths out of the plan.
MAX_PLANNED_FIELDS = 1500


def compile_lookup(
    catalog: DataFrame,
    secrets: Mapping[str, str] | None = None,
    validate: bool = True,
    max_bytes: int = MAX_BROADCAST_BYTES,
    max_planned_fields: int = MAX_PLANNED_FIELDS,
) -> SpecLookup:
    """Compile a catalog for `resolve_specs`.

    ``secrets`` maps the names in ``signature_secret_env`` to secrets; only key pads
    derived from them enter the lookup, and no operator returns those. The table is
    broadcast when its measured size is under ``max_bytes``; otherwise the join shuffles.
    A source and version may occur once only: a second row would multiply its requests.
    `merge_catalogs` resolves repeats.
    """
    spark = catalog.sparkSession
    repeated = catalog.groupBy(*SPEC_KEY).agg(F.count("*").alias("specs")).filter("specs > 1").first()
    if repeated is not None:
        raise ValueError(f"spec {repeated['source']} {repeated['version']} is given {repeated['specs']} times")
    if validate:
        broken = validate_specs(catalog).first()
        if broken is not None:
            raise ValueError(f"spec {broken['source']} {broken['version']}: {broken['rule']}")
    pads = [(name, *hmac_pads(secret)) for name, secret in (secrets or {}).items() if secret]
    pads_table = spark.createDataFrame(
        pads, "signature_secret_env string, _inner_pad binary, _outer_pad binary"
    )

    def path(name: str) -> Column:
        return F.when(~_blank(name), compile_path(F.col(name)))

    specs = (
        catalog.join(F.broadcast(pads_table), "signature_secret_env", "left")
        .select(
            F.col("source").alias("_spec_source"),
            F.col("version"),
            F.lower("type_header").alias("_type_header"),
            path("type_field").alias("_type_path"),
            F.coalesce("type_mapping", F.create_map().cast("map<string,string>")).alias("_type_mapping"),
            path("external_id_path").alias("_external_path"),
            path("timestamp_path").alias("_timestamp_path"),
            F.transform_values(
                F.coalesce("fields_data", F.create_map().cast("map<string,string>")), lambda _, p: compile_path(p)
            ).alias("_data_paths"),
            F.when(
                ~_blank("signature_header") & ~_blank("signature_secret_env"),
                F.lower("signature_header"),
            ).alias("_signature_header"),
            "_inner_pad",
            "_outer_pad",
            F.coalesce("redact_raw", F.lit(False)).alias("_redact_raw"),
        )
    )
    newest = latest_specs(specs.withColumnRenamed("_spec_source", "source"))
    table = specs.withColumn("_match_version", F.col("version")).unionByName(
        newest.withColumnRenamed("source", "_spec_source")
        .withColumn("_match_version", F.lit(None).cast("string"))
    )
    local = localize_if_small(table, max_bytes)
    if local is None:
        return SpecLookup(table, extract_fields({}))
    columns = ["_spec_source", "version", "_data_paths", *SCALAR_PATHS]
    rows = local.where("_match_version is not null").select(*columns).collect()
    if sum(len(r["_data_paths"]) for r in rows) > max_planned_fields:
        return SpecLookup(F.broadcast(local), extract_fields({}))
    return SpecLookup(
        F.broadcast(local),
        extract_fields({(r["_spec_source"], r["version"]): r["_data_paths"] for r in rows}),
        {name: sorted({r[name] for r in rows if r[name]}) for name in SCALAR_PATHS},
    )
