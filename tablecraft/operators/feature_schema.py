"""Feature groups as Spark schemas, and conformance of a table to one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators.quality import QualityError

# The type names a declaration may use.
TYPES: dict[str, T.DataType] = {
    "INT64": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOL": T.BooleanType(),
    "BYTES": T.BinaryType(),
    "DOUBLE": T.DoubleType(),
    "DOUBLE_ARRAY": T.ArrayType(T.DoubleType()),
    "INT64_ARRAY": T.ArrayType(T.LongType()),
    "STRING_ARRAY": T.ArrayType(T.StringType()),
}


@dataclass(frozen=True)
class FeatureGroup:
    """Named features of one kind; ``schema`` gives their types and order."""

    name: str
    schema: T.StructType

    @property
    def ids(self) -> list[str]:
        return self.schema.fieldNames()

    def select(self, ids: Sequence[str]) -> FeatureGroup:
        """The group cut down to the given features, in the given order."""
        unknown = sorted(set(ids) - set(self.ids))
        if unknown:
            raise QualityError(f"features not declared in group {self.name!r}: {unknown}")
        return FeatureGroup(self.name, T.StructType([self.schema[name] for name in ids]))


@dataclass(frozen=True)
class Entity:
    """What features describe: its id column and its groups."""

    name: str
    id_column: str
    groups: Mapping[str, FeatureGroup]
    id_type: T.DataType = T.StringType()


def group(name: str, **types: str) -> FeatureGroup:
    """A group of features, each given by its declared type name."""
    fields = [T.StructField(feature, TYPES[kind]) for feature, kind in types.items()]
    return FeatureGroup(name, T.StructType(fields))


def declared_entity(document: object) -> Entity:
    """The entity that a parsed YAML or JSON document declares.

    Keys: ``entity``, ``id_column``, ``id_type`` (a string if absent) and
    ``feature_groups``, in which each group lists ``features`` with ``name`` and
    ``type``; other keys are for human readers. Every fault is reported with its
    place in the document, all faults of one document together.
    """
    faults: list[str] = []

    def entry(parent: object, key: str, place: str, otherwise: object = None) -> object:
        value = parent.get(key, otherwise) if isinstance(parent, Mapping) else None
        if value is None:
            faults.append(f"{place}{key} is missing")
        return value

    def kind(name: object, place: str) -> T.DataType:
        if name is not None and name not in TYPES:
            faults.append(f"{place} has the unknown type {name!r}")
        return TYPES.get(str(name), T.NullType())

    groups: dict[str, FeatureGroup] = {}
    bodies = entry(document, "feature_groups", "", {})
    for name in bodies or ():
        place = f"feature_groups.{name}."
        schema = T.StructType()
        for number, feature in enumerate(entry(bodies[name], "features", place, []) or ()):
            at = f"{place}features[{number}]"
            feature_name = entry(feature, "name", f"{at}.")
            if feature_name in schema.fieldNames():
                faults.append(f"{at} repeats {feature_name!r}")
            schema.add(str(feature_name), kind(entry(feature, "type", f"{at}."), at))
        groups[name] = FeatureGroup(name, schema)
    key_type = kind(entry(document, "id_type", "", "STRING"), "id_type")
    entity = Entity(entry(document, "entity", ""), entry(document, "id_column", ""), groups, key_type)
    if faults:
        raise QualityError("; ".join(faults))
    return entity


def read_entities(spark: SparkSession, directory: str) -> dict[str, Entity]:
    """The entities declared by the ``*.yaml`` files of a folder, by name.

    The folder may be on any file system that Spark reads. Two declarations of
    one entity are an error.
    """
    import yaml

    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.yaml").collect()
    found = [declared_entity(yaml.safe_load(row["value"])) for row in files]
    names = [entity.name for entity in found]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise QualityError(f"entities declared more than once: {repeated}")
    return dict(zip(names, found))


# The declared entities, their groups and feature types.
USER = Entity(
    "user",
    "user_id",
    {
        "behavioral": group(
            "behavioral",
            session_count_7d="INT64",
            session_count_30d="INT64",
            total_purchases_30d="FLOAT64",
            days_since_last_login="INT64",
            support_tickets_90d="INT64",
            avg_session_duration_s="FLOAT64",
        ),
        "demographic": group(
            "demographic", country="STRING", account_age_days="INT64", is_premium="BOOL"
        ),
    },
)
ITEM = Entity(
    "item",
    "item_id",
    {
        "catalog": group("catalog", category="STRING", price_usd="FLOAT64", stock_count="INT64"),
        "engagement": group(
            "engagement",
            view_count_7d="INT64",
            purchase_count_30d="INT64",
            conversion_rate_30d="FLOAT64",
        ),
    },
)


def require_columns(
    df: DataFrame,
    entity: Entity,
    group: FeatureGroup,
    feature_ts: str,
    entity_id: str | None = None,
) -> None:
    key = entity_id or entity.id_column
    missing = [c for c in (key, feature_ts, *group.ids) if c not in df.columns]
    if missing:
        raise QualityError(f"columns missing for group {group.name!r}: {missing}")


def conform(
    df: DataFrame,
    entity: Entity,
    group: FeatureGroup,
    feature_ts: str,
    entity_id: str | None = None,
) -> DataFrame:
    """Key, time and the declared features, cast to the declared types.

    A missing column fails here, before any job. A value that cannot be cast, an
    id included, becomes NULL; ``violations`` counts it, and also a number that
    the declared type changes (3.7 as an integer).
    """
    require_columns(df, entity, group, feature_ts, entity_id)
    key = entity_id or entity.id_column
    return df.select(
        F.col(key).try_cast(entity.id_type).alias(entity.id_column),
        F.col(feature_ts),
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in group.schema],
    )


def violations(
    df: DataFrame,
    entity: Entity,
    group: FeatureGroup,
    feature_ts: str,
    entity_id: str | None = None,
) -> DataFrame:
    """One row of counts: NULL keys, NULL times, repeated keys, failed casts."""
    key = entity_id or entity.id_column
    conformed = conform(df, entity, group, feature_ts, entity_id)
    bad_cast = F.lit(False)
    for f in group.schema:
        bad_cast = bad_cast | _spoiled(F.col(f.name), df.schema[f.name].dataType, f.dataType)
    # Rows per (id, time) first: the combine is map-side and the totals are one row.
    per_key = df.groupBy(
        F.col(key).try_cast(conformed.schema[entity.id_column].dataType).alias("_id"),
        F.col(feature_ts).alias("_ts"),
    ).agg(F.count("*").alias("n"), F.count(F.when(bad_cast, 1)).alias("bad"))
    keyed = F.col("_id").isNotNull() & F.col("_ts").isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        _total(F.col("_id").isNull(), "n").alias("null_ids"),
        _total(F.col("_ts").isNull(), "n").alias("null_times"),
        F.count(F.when(keyed & (F.col("n") > 1), 1)).alias("duplicate_keys"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_values"),
    )


def assert_conforms(
    df: DataFrame,
    entity: Entity,
    group: FeatureGroup,
    feature_ts: str,
    entity_id: str | None = None,
) -> DataFrame:
    """The conformed table, or an error listing every kind of violation."""
    counts = violations(df, entity, group, feature_ts, entity_id).first().asDict()
    counts.pop("row_count")
    found = {name: n for name, n in counts.items() if n}
    if found:
        raise QualityError(f"group {entity.name}/{group.name} violates its schema: {found}")
    return conform(df, entity, group, feature_ts, entity_id)


def _total(condition, column):
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))


def _spoiled(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Whether a value is lost, or as a number changed, by the cast."""
    cast = value.try_cast(target)
    spoiled = cast.isNull()
    if isinstance(source, T.NumericType) and isinstance(target, T.NumericType):
        spoiled = spoiled | (cast.try_cast(source) != value)
    return value.isNotNull() & F.coalesce(spoiled, F.lit(True))
