"""Relational tables as a source and a sink.

Reading splits the range of a key into partitions, each one query of its own, and
leaves filters and columns to the database.  Writing stages rows in a table beside the
target, as many connections as there are partitions, and then merges them by key in one
transaction, so readers see all of a write or nothing of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Database:
    """A database by its JDBC address; ``options`` are Spark's (user, password, driver)."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def _reader(self):
        return self.spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def query(self, sql: str) -> DataFrame:
        return self._reader().option("query", sql).load()

    def table(self, name: str, key: str | None = None, partitions: int = 8, fetch: int = 10_000) -> DataFrame:
        """A table's rows.  With an integer, date or timestamp ``key``, its range is split
        into partitions of equal width, nulls with the first; an empty table is one partition."""
        reader = self._reader().option("dbtable", name).option("fetchsize", fetch)
        if key:
            low, high = self.query(f"SELECT min({key}) AS lo, max({key}) AS hi FROM {name}").first()
            if low is not None:
                reader = reader.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", partitions)
        return reader.load()

    def merge(self, rows: DataFrame, name: str, keys: list[str], columns: list[str] | None = None, batch: int = 5_000) -> None:
        """Rows update those of the table with their keys, the others are added.

        Keys that rows hold twice are an error of the database, and so is what its
        constraints refuse; the table is then as it was.  Rows whose key is null are added.
        Columns of the table that rows lack keep their values, or get their defaults."""
        columns = columns or rows.columns
        staged = f"{name}_{uuid.uuid4().hex[:12]}"
        listed, own = ", ".join(map(self._q, columns)), ", ".join(map(self._q, keys))
        same = " AND ".join(f"t.{self._q(k)} = s.{self._q(k)}" for k in keys)
        rest = [c for c in columns if c not in keys]
        try:
            self._transaction([f"CREATE TABLE {staged} AS SELECT {listed} FROM {name} WITH NO DATA"])
            rows.select(*columns).write.format("jdbc").option("url", self.url).options(**self.options).option("dbtable", staged).option("batchsize", batch).mode("append").save()
            self._transaction([f"CREATE INDEX {staged}_k ON {staged} ({own})"])
            values = ", ".join(f"{self._q(c)} = (SELECT s.{self._q(c)} FROM {staged} s WHERE {same.replace('t.', name + '.')})" for c in rest)
            update = [f"UPDATE {name} SET {values} WHERE EXISTS (SELECT 1 FROM {staged} s WHERE {same.replace('t.', name + '.')})"] if rest else []
            insert = f"INSERT INTO {name} ({listed}) SELECT {listed} FROM {staged} s WHERE NOT EXISTS (SELECT 1 FROM {name} t WHERE {same})"
            known = " AND ".join(f"{self._q(k)} IS NOT NULL" for k in keys)
            twice = f"SELECT count(*) FROM (SELECT {own} FROM {staged} WHERE {known} GROUP BY {own} HAVING count(*) > 1) d"
            self._transaction([*update, insert], none_of=twice)
        finally:
            self._drop(staged)

    def execute(self, *statements: str) -> None:
        """Statements in one transaction."""
        self._transaction(list(statements))

    def _q(self, column: str) -> str:
        return f'"{column}"'

    def _connect(self):
        properties = self.spark.sparkContext._jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in self.options:
                properties.setProperty(k, self.options[k])
        return self.spark.sparkContext._jvm.java.sql.DriverManager.getConnection(self.url, properties)

    def _transaction(self, statements: list[str], none_of: str | None = None) -> None:
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            work = connection.createStatement()
            if none_of:
                found = work.executeQuery(none_of)
                found.next()
                if found.getLong(1):
                    raise ValueError("rows hold a key twice")
                found.close()
            for sql in statements:
                work.executeUpdate(sql)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _drop(self, name: str) -> None:
        connection = self._connect()
        try:
            if connection.getMetaData().getTables(None, None, name.upper(), None).next() or connection.getMetaData().getTables(None, None, name, None).next():
                connection.createStatement().executeUpdate(f"DROP TABLE {name}")
        finally:
            connection.close()
