"""Catalogs: names of schemas and tables, and tables by their names. They answer; they never judge."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from parity.sources.files import read_path


class Catalogs(Protocol):
    def has_catalog(self, catalog: str) -> bool: ...

    def schemas(self, catalog: str) -> list[str]: ...

    def tables(self, catalog: str, schema: str) -> list[str]: ...

    def table(self, catalog: str, schema: str, table: str) -> DataFrame: ...


def _has(names: list[str], name: str) -> bool:
    return name.lower() in (n.lower() for n in names)


class _Lookups:
    def has_schema(self, catalog: str, schema: str) -> bool:
        return _has(self.schemas(catalog), schema)

    def has_table(self, catalog: str, schema: str, table: str) -> bool:
        return _has(self.tables(catalog, schema), table)


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


class SessionCatalogs(_Lookups):
    """The catalogs that the Spark session knows. Parts of names are quoted apart, so they may hold dots."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def has_catalog(self, catalog: str) -> bool:
        if _has([x.name for x in self.spark.catalog.listCatalogs()], catalog):
            return True
        # a catalog that is set up but not loaded yet isn't listed
        return bool(self.spark.conf.get(f"spark.sql.catalog.{catalog}", None))

    def schemas(self, catalog: str) -> list[str]:
        return sorted(r[0] for r in self.spark.sql(f"SHOW SCHEMAS IN {quoted(catalog)}").collect())

    def tables(self, catalog: str, schema: str) -> list[str]:
        rows = self.spark.sql(f"SHOW TABLES IN {quoted(catalog, schema)}").collect()
        return sorted(r["tableName"] for r in rows if not r["isTemporary"])

    def table(self, catalog: str, schema: str, table: str) -> DataFrame:
        return self.spark.table(quoted(catalog, schema, table))


class FolderCatalogs(_Lookups):
    """Folders as catalogs: root/schema/table or root/schema/table.ending for each named root."""

    def __init__(self, spark: SparkSession, roots: dict[str, str]):
        self.spark, self.roots = spark, dict(roots)

    def _list(self, path: str) -> list[tuple[str, str]]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        return sorted((p.getPath().getName(), p.getPath().toString()) for p in fs.listStatus(where) if not p.getPath().getName().startswith((".", "_")))

    def _root(self, catalog: str) -> str:
        return next(v for k, v in self.roots.items() if k.lower() == catalog.lower())

    def has_catalog(self, catalog: str) -> bool:
        return _has(list(self.roots), catalog)

    def schemas(self, catalog: str) -> list[str]:
        return [name for name, _ in self._list(self._root(catalog))]

    def _paths(self, catalog: str, schema: str) -> dict[str, str]:
        return {name.rsplit(".", 1)[0] if "." in name else name: path for name, path in self._list(f"{self._root(catalog)}/{schema}")}

    def tables(self, catalog: str, schema: str) -> list[str]:
        return sorted(self._paths(catalog, schema))

    def table(self, catalog: str, schema: str, table: str) -> DataFrame:
        return read_path(self.spark, self._paths(catalog, schema)[table])


class FrameCatalogs(_Lookups):
    """DataFrames as catalogs: {catalog: {schema: {table: DataFrame}}}. Keeps nullability, which files and session tables lose."""

    def __init__(self, frames: dict[str, dict[str, dict[str, DataFrame]]]):
        self.frames = frames

    def has_catalog(self, catalog: str) -> bool:
        return _has(list(self.frames), catalog)

    def schemas(self, catalog: str) -> list[str]:
        return sorted(self.frames[catalog])

    def tables(self, catalog: str, schema: str) -> list[str]:
        return sorted(self.frames[catalog][schema])

    def table(self, catalog: str, schema: str, table: str) -> DataFrame:
        return self.frames[catalog][schema][table]
