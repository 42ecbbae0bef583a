"""Listings of audio files and folders as tables, and results as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming


def roles(files: DataFrame, song: str, name: str) -> DataFrame:
    """song, acapella, instrumental, original, note: of each role the first file by name; the note counts roles with more.
    Without an original, a single audio file of no role is taken for it."""
    d = files.withColumn("_role", naming.role(F.col(name)))
    loose = F.col("_role").isNull() & naming.is_audio(F.col(name))
    first = lambda role: F.min(F.when(F.col("_role") == role, F.col(name)))
    names = ["acapella", "instrumental", "original"]
    g = d.groupBy(song).agg(*(first(r).alias(r) for r in names), *(F.count_if(F.col("_role") == r).alias(f"_n_{r}") for r in names), F.count_if(loose).alias("_loose"), F.min(F.when(loose, F.col(name))).alias("_one"))
    assumed = F.col("original").isNull() & (F.col("_loose") == 1)
    notes = [F.when(F.col(f"_n_{r}") > 1, F.concat(F.lit(f"multi_{r}="), F.col(f"_n_{r}").cast("string"))) for r in names]
    return g.select(song, "acapella", "instrumental", F.when(assumed, F.col("_one")).otherwise(F.col("original")).alias("original"), F.concat_ws("; ", *notes, F.when(assumed, "original_assumed")).alias("note"))


def unclassified(files: DataFrame, name: str) -> DataFrame:
    """The audio files without a role."""
    return files.where(naming.is_audio(F.col(name)) & naming.role(F.col(name)).isNull())


def backup_stems(files: DataFrame, song: str, folder: str, name: str, backup: str = "backup") -> DataFrame:
    """song, acapella, instrumental from the backup folder and original from the song's own."""
    stems = roles(files.where(F.lower(folder) == backup), song, name).select(song, "acapella", "instrumental")
    root = roles(files.where(F.coalesce(F.lower(folder) != backup, F.lit(True))), song, name).select(song, "original")
    return stems.join(root, song, "full_outer")


def work_folders(folders: DataFrame, name: str, only: str | None = None, limit: int | None = None, tagged: bool = False) -> DataFrame:
    """Folders in the order of their names, without hidden ones and the backup; tagged ones only if asked for; ``only``
    keeps names that contain it, in any case; ``limit`` the first so many."""
    d = folders.where(~F.col(name).startswith(".") & (F.lower(name) != "backup"))
    d = d if tagged else d.where(naming.tag_of(F.col(name)).isNull())
    d = d if only is None else d.where(F.contains(F.lower(name), F.lit(only.lower())))
    d = d.orderBy(F.lower(name), name)
    return d if limit is None else d.limit(limit)


def trusted_beats(songs: DataFrame, beats: DataFrame, k: str, kind: str, t: str, least: int = 4) -> DataFrame:
    """songs with beats and downbeats, arrays in order; both empty where a song has fewer than ``least`` of either. kind:
    beat or downbeat. A song's beats are one recording's."""
    of = lambda what: F.sort_array(F.collect_list(F.when(F.col(kind) == what, F.col(t))))
    g = beats.groupBy(k).agg(of("beat").alias("_b"), of("downbeat").alias("_d")).where((F.size("_b") >= least) & (F.size("_d") >= least))
    none = F.array().cast("array<double>")
    return songs.join(g, k, "left").withColumns({"beats": F.coalesce("_b", none), "downbeats": F.coalesce("_d", none)}).drop("_b", "_d")


def cache_ready(entries: DataFrame, k: str, size: str, least: int = 1000, files: int = 2) -> DataFrame:
    """k, ready: whether an entry has ``files`` files of more than ``least`` bytes."""
    return entries.groupBy(k).agg((F.count_if(F.col(size) > least) >= files).alias("ready"))


def cells(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON and doubles that are not finite as null: what goes into a CSV or JSON file."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            return F.to_json(c).alias(name)
        if kind in ("double", "float"):
            return F.when(~(F.isnan(c) | F.abs(c).isin(float("inf"))), c).alias(name)
        return c.alias(name)

    return df.select(*(cell(n, k) for n, k in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    cells(df).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_json(df: DataFrame, path: str) -> None:
    cells(df).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def numbered(df: DataFrame, k: str, order: list[str]) -> DataFrame:
    """df with nr, the row's place in its key; what lists are zipped by."""
    return df.withColumn("nr", F.row_number().over(Window.partitionBy(k).orderBy(*order)))


def zipped(a: DataFrame, b: DataFrame, k: str, order: list[str]) -> DataFrame:
    """The rows of a and b (with a's key, and other columns of different names) side by side by their place in the key; the
    longer one's rest is left out."""
    return numbered(a, k, order).join(numbered(b, k, [c for c in b.columns if c != k][:1]), [k, "nr"])
