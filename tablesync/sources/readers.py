"""Open a source dataset, find a layer in it, and give it a usable schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions import geometry as G
from tablesync.functions.encodings import geojson_geometry, gml_geometry, wkt_geometry
from tablesync.functions.nearest import nearest_name
from tablesync.operators.casting import UNREADABLE
from tablesync.sources import files
from tablesync.sources.geojson import feature_texts
from tablesync.spec import LayerSpec, SyncError

FILE_FORMATS = ("parquet", "orc", "csv", "json", "text", "binaryFile", "xml", "avro", "geojson", "geojsonseq")

# File name endings by format.
ENDINGS = {
    "parquet": (".parquet",),
    "orc": (".orc",),
    "csv": (".csv", ".csv.gz"),
    "json": (".json", ".jsonl", ".ndjson"),
    "text": (".txt",),
    "binaryFile": (".bin",),
    "xml": (".xml", ".gml"),
    "avro": (".avro",),
    "geojson": (".geojson",),
    "geojsonseq": (".geojsonl", ".geojsons"),
}
#: Tasks for each core, below which rows are dealt anew ahead of Python.
TASKS_PER_CORE = 3
# What a database source needs to be read by several tasks.
SPLIT_OPTIONS = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
# Texts that Python reads, and the files whose row groups no task can cut for it.
TEXT_ENCODINGS = {"wkt": wkt_geometry, "gml": gml_geometry, "geojson": geojson_geometry}
COLUMN_FILES = ("parquet", "orc", "avro", "table")
DEFAULT_OPTIONS = {"csv": {"header": "true"}, "xml": {"attributePrefix": "", "rowTag": "row"}}


def read_source(spark: SparkSession, spec: LayerSpec, paths: list[str] | None = None) -> DataFrame:
    """The layer's source rows, or those of some of its files: lower-case names, at most one geometry column."""
    df = open_layer(spark, spec, paths)
    if spec.geometry_source:
        if spec.source_format in COLUMN_FILES and spec.geometry_source["encoding"] in TEXT_ENCODINGS:
            df = spread(spark, df)
        df = with_geometry(df, spec.geometry_source, spec.source_srid)
    return lower_names(df, spec.fid_column)


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, where the scan has too few tasks for what Python does with each row.

    Texts of geometries are stored in a small part of their size, and a row group is read by one
    task, so that millions of rows may come as one. A scan with several tasks for each core stays as it is.
    """
    wanted = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def layer_path(spark: SparkSession, spec: LayerSpec) -> str:
    """Folder or file of a layer that is made of files."""
    if spec.source_format not in FILE_FORMATS or not files.exists(spark, spec.source):
        raise SyncError(f'The files of layer "{spec.name}" cannot be listed: {spec.source}')
    layers = list_layers(spark, spec.source, spec.source_format)
    found = _find(spec.source_layer, layers)
    if found is None:
        raise SyncError(_missing_layer(spark, spec, layers, spec.source_options))
    return layers[found]


def open_layer(spark: SparkSession, spec: LayerSpec, paths: list[str] | None = None) -> DataFrame:
    options = {**DEFAULT_OPTIONS.get(spec.source_format, {}), **spec.source_options}
    if spec.source_format == "xml" and _is_file(spec):
        options = {**options, "rowTag": spec.source_layer}
    if spec.source_format == "table":
        return _open_table(spark, spec)
    if spec.source_format not in FILE_FORMATS:
        if spec.source_format == "jdbc" and options.get("numPartitions") != "1" and not SPLIT_OPTIONS <= options.keys():
            raise SyncError(
                f'Layer "{spec.name}" would read its database table in one task: set {", ".join(sorted(SPLIT_OPTIONS))},'
                " or numPartitions alone to 1 if that is meant"
            )
        reader = spark.read.format(spec.source_format).options(url=spec.source, dbtable=spec.source_layer, **options)
        return _opened(spec, reader.load)
    if not files.exists(spark, spec.source):
        raise SyncError(f'The dataset of layer "{spec.name}" cannot be opened: {spec.source}')
    layers = list_layers(spark, spec.source, spec.source_format)
    if spec.source_format == "xml" and _is_file(spec):
        # The layers of one document are its row tags; a tag that occurs nowhere gives no columns.
        layers = {spec.source_layer: spec.source} if _load(spark, "xml", spec.source, options, spec.source_schema).columns else {}
    found = _find(spec.source_layer, layers)
    if found is None:
        raise SyncError(_missing_layer(spark, spec, layers, options))
    try:
        return _load(spark, spec.source_format, paths or layers[found], options, spec.source_schema)
    except PySparkException as error:
        raise SyncError(
            f'source_layer "{spec.source_layer}" of layer "{spec.name}" exists, but cannot be read: {error}'
        ) from error


def _is_file(spec: LayerSpec) -> bool:
    return spec.source.rstrip("/").endswith(ENDINGS[spec.source_format])


def _opened(spec: LayerSpec, load) -> DataFrame:
    try:
        return load()
    except Exception as error:
        raise SyncError(f'The dataset of layer "{spec.name}" cannot be opened: {error}') from error


def _open_table(spark: SparkSession, spec: LayerSpec) -> DataFrame:
    if not spark.catalog.databaseExists(spec.source):
        raise SyncError(f'The dataset of layer "{spec.name}" cannot be opened: {spec.source}')
    layers = {t.name: f"{spec.source}.{t.name}" for t in spark.catalog.listTables(spec.source)}
    found = _find(spec.source_layer, layers)
    if found is None:
        raise SyncError(_missing_layer(spark, spec, layers, {}))
    return spark.table(layers[found])


def list_layers(spark: SparkSession, source: str, source_format: str) -> dict[str, str]:
    """Layer name -> path of a dataset folder; a single file is its own layer."""
    endings = ENDINGS[source_format]
    source = source.rstrip("/")
    entries = files.names(spark, source)
    if source.endswith(endings):
        return {_stem(source.rsplit("/", 1)[-1], endings): source}
    return {_stem(entry, endings): f"{source}/{entry}" for entry in entries if not entry.startswith(("_", "."))}


def _stem(name: str, endings: tuple[str, ...]) -> str:
    return next((name[: -len(e)] for e in endings if name.endswith(e)), name)


def _find(wanted: str, layers: Mapping[str, str]) -> str | None:
    """The layer of that name; failing that, one that differs in case only."""
    if wanted in layers:
        return wanted
    return next((name for name in layers if name.lower() == wanted.lower()), None)


def _load(
    spark: SparkSession, source_format: str, path: str | list[str], options: Mapping[str, str], schema: str | None = None
) -> DataFrame:
    """The rows of one layer. A ``schema`` (columns with types) saves the pass that finds it out."""
    names = [f.name for f in T.StructType.fromDDL(schema) if f.name != "geometry"] if schema else None
    if source_format in ("geojson", "geojsonseq"):
        if source_format == "geojson":
            # Other parts of a document hold objects, too; what is broken, or a feature but for its type, is set aside below.
            kind, parts = F.get_json_object("line", "$.type"), [F.get_json_object("line", f"$.{n}") for n in ("geometry", "properties")]
            broken = F.try_parse_json("line").isNull() | (kind.isNull() & F.coalesce(*parts).isNotNull())
            lines = feature_texts(spark, path, options).filter((kind == "Feature") | broken)
        else:
            # A record may start with the separator of JSON sequences; blank lines are none.
            line = F.btrim(F.col("value"), F.lit(" \t\r\x1e"))
            lines = spark.read.options(**options).text(path).select(line.alias("line")).filter("line <> ''")
        feature = F.from_json("line", _FEATURE)
        lines = lines.select("line", F.when(F.get_json_object("line", "$.type") == "Feature", feature).alias("feature"))
        unreadable = F.when(F.col("feature").isNull(), F.col("line")).alias(UNREADABLE)
        return _feature_columns(lines.select("feature", unreadable), names)
    reader = spark.read.format(source_format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


_FEATURE = "struct<id:string,properties:map<string,string>,geometry:string>"


def _feature_columns(features: DataFrame, columns: list[str] | None) -> DataFrame:
    """One column per property name plus the geometry as GeoJSON text.

    Names that are not given are looked for in all features; as columns, they have to come to the driver.
    """
    if columns is None:
        properties = features.select(F.explode(F.map_keys("feature.properties"))).distinct()
        columns = sorted(row[0] for row in properties.collect())
    return features.select(
        F.col("feature.id").alias("fid"),
        *[F.col("feature.properties")[name].alias(name) for name in columns if name != "fid"],
        F.col("feature.geometry").alias("geometry"),
        *[F.col(name) for name in features.columns if name == UNREADABLE],
    )


def nearest_layer(spark: SparkSession, wanted: str, candidates: list[str]) -> tuple[str, int] | None:
    """Candidate with the smallest edit distance below the cut-off; the first wins a tie."""
    best = spark.range(1).select(nearest_name(F.lit(wanted), candidates).alias("best")).first()["best"]
    return best and (best["name"], best["distance"])


def _missing_layer(spark: SparkSession, spec: LayerSpec, layers: Mapping[str, str], options: Mapping) -> str:
    unreadable = [n for n, path in layers.items() if not _readable(spark, spec.source_format, path, options)]
    message = f'Layer "{spec.name}" reads "{spec.source_layer}", which its dataset does not hold.'
    near = nearest_layer(spark, spec.source_layer, [n for n in layers if n not in unreadable])
    if near:
        message += f' The closest name there is "{near[0]}".'
    if unreadable:
        message += f" Not readable: {', '.join(sorted(unreadable))}."
    return message


def _readable(spark: SparkSession, source_format: str, path: str, options: Mapping) -> bool:
    try:
        if source_format != "table":
            _load(spark, source_format, path, options).schema
        return True
    except Exception:
        return False


# --- schema --------------------------------------------------------------------------


def lower_names(df: DataFrame, fid_column: str | None = None) -> DataFrame:
    """Lower-case column names; the feature id keeps its declared name."""
    renamed = [name if name == fid_column else name.lower() for name in df.columns]
    repeated = sorted({name for name in renamed if renamed.count(name) > 1})
    if repeated:
        raise SyncError(f"Source columns differ in case only: {', '.join(repeated)}")
    return df.toDF(*renamed)


def with_geometry(df: DataFrame, how: Mapping[str, str], srid: int | None) -> DataFrame:
    """Build the geometry column from what the format provides.

    ``how`` names an ``encoding`` (``hex``, ``wkb``, ``ewkb``, ``geojson``, ``wkt``,
    ``gml`` or ``xy``), the column(s) it is read from, and optionally a ``name``. A value that
    is no geometry counts as one that does not fit, like any other.
    """
    encoding, name = how["encoding"], how.get("name", "geometry")
    if encoding == "xy":
        used = [how["x"], how["y"]]
        x, y = (F.col(f"`{c}`").cast("string").try_cast("double") for c in used)
        built, dropped = G.geometry(G.point_wkb(x, y), srid), []
        bad = (F.col(f"`{used[0]}`").isNotNull() & x.isNull()) | (F.col(f"`{used[1]}`").isNotNull() & y.isNull())
    else:
        used = dropped = [how.get("column", name)]
        col = F.col(f"`{used[0]}`")
        builders = {
            "hex": lambda: G.geometry_from_hex(col, srid),
            "wkb": lambda: G.geometry(col, srid),
            "ewkb": lambda: G.geometry_from_ewkb(col, srid),
        }
        if encoding not in (*builders, *TEXT_ENCODINGS):
            raise SyncError(f'Unknown geometry encoding "{encoding}"')
        if encoding in TEXT_ENCODINGS:
            # A column of its own: read once, in one Python worker of a task, whole or not at all.
            df = df.withColumn("_text", TEXT_ENCODINGS[encoding](col))
            stated = G.DEGREES if encoding == "geojson" and srid is None else srid
            built = G.geometry(F.col("_text.wkb"), F.coalesce("_text.srid", F.lit(stated)))
            dropped = [*used, "_text"]
        else:
            built = builders[encoding]()
        bad = col.isNotNull() & (F.length(F.btrim(col) if encoding in ("hex", "geojson", "wkt", "gml") else col) > 0)
    if how.get("byte_order") == "mixed":
        big = F.when(F.hex(F.substring(built["wkb"], 1, 1)) == "00", built["wkb"])
        built = G.geometry(F.coalesce(G.little_endian(big), built["wkb"]), built["srid"])
    shown = F.concat_ws(" ", *[_shown(df, c) for c in used])
    df = df.withColumn("_built", built)
    if encoding not in TEXT_ENCODINGS:
        df = df.withColumn("_built", F.when(G.is_whole(F.col("_built.wkb")), F.col("_built")))
    if encoding != "xy":
        bad = bad & F.col("_built").isNull()
    earlier = [F.col(UNREADABLE)] if UNREADABLE in df.columns else []
    df = df.withColumn(UNREADABLE, F.coalesce(*earlier, F.when(bad, shown)))
    return df.drop(*dropped).withColumnRenamed("_built", name)


def _shown(df: DataFrame, name: str) -> Column:
    col = F.col(f"`{name}`")
    return F.hex(col) if isinstance(df.schema[name].dataType, T.BinaryType) else col.cast("string")
