"""The tables in a database behind JDBC: parallel loads into a staging table, then one MERGE in one transaction.

The database keeps what file tables can't: keys, foreign keys that cascade, defaults and indexes. Rows go from tasks to a
staging table of their own, which any stop leaves without effect on the stored rows and which is dropped at the end; the merge is
one statement, so readers see all of it or nothing. Two runs may merge at the same time, as the database orders them.

The statements are those of the SQL standard; DERBY and POSTGRES name the types. Only the first is tested here. An embedded
database is reached from one JVM only, so on a cluster the address has to name a server.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as M


@dataclass(frozen=True)
class Dialect:
    text: str
    time: str
    driver: str
    #: The default of times; loads give all times themselves.
    clock: str = "DEFAULT CURRENT_TIMESTAMP "


#: Its MERGE can't set a column whose default is the current time, so times have none.
DERBY = Dialect("CLOB", "TIMESTAMP", "org.apache.derby.jdbc.EmbeddedDriver", "")
POSTGRES = Dialect("TEXT", "TIMESTAMP WITH TIME ZONE", "org.postgresql.Driver")

#: Columns of the tables: name, type (a length, text, time or boolean), and what else is asked of them.
COLUMNS = {
    "feeds": (("feed_id", 100, "NOT NULL"), ("feed_type", 50, "NOT NULL"), ("feed_value", 100, "NOT NULL"), ("query", "text", "NOT NULL"), ("enabled", "boolean", "DEFAULT TRUE NOT NULL"), ("created_at", "time", "{clock}NOT NULL")),
    "articles": (
        ("article_key", 64, "NOT NULL"), ("title", "text", ""), ("url", "text", "NOT NULL"), ("source", 255, ""), ("authors", "text", "DEFAULT '[]' NOT NULL"), ("published_at", "time", ""), ("content", "text", ""),
        ("content_hash", 64, ""), ("summary", "text", ""), ("processing_status", 50, "DEFAULT 'pending' NOT NULL"), ("created_at", "time", "{clock}NOT NULL"), ("updated_at", "time", "{clock}NOT NULL"),
    ),
    "article_feeds": (("article_key", 64, "NOT NULL"), ("feed_id", 100, "NOT NULL"), ("first_seen_at", "time", "{clock}NOT NULL")),
}
KEYS = {"feeds": ("feed_id",), "articles": ("article_key",), "article_feeds": ("article_key", "feed_id")}
#: Foreign keys (table, column, referred table) and indexes (table, column).
REFERENCES = (("article_feeds", "article_key", "articles"), ("article_feeds", "feed_id", "feeds"))
INDEXES = (("articles", "processing_status"), ("articles", "published_at"), ("article_feeds", "feed_id"))


@dataclass
class Database:
    """loaders: tasks that load a staging table at the same time, at most."""

    spark: SparkSession
    url: str
    dialect: Dialect = POSTGRES
    properties: dict[str, str] = field(default_factory=dict)
    loaders: int = 16

    def __post_init__(self) -> None:
        if not self.url:
            raise ValueError("The database's address is not configured.")

    def _type(self, kind) -> str:
        return f"VARCHAR({kind})" if isinstance(kind, int) else {"text": self.dialect.text, "time": self.dialect.time, "boolean": "BOOLEAN"}[kind]

    def execute(self, statements: Iterable[str]) -> list[int]:
        """Statements in one transaction: the rows that each changes."""
        jvm = self.spark._jvm
        jvm.java.lang.Class.forName(self.dialect.driver, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        named = jvm.java.util.Properties()
        for k, v in self.properties.items():
            named.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, named)
        try:
            connection.setAutoCommit(False)
            try:
                statement = connection.createStatement()
                changed = [statement.executeUpdate(sql) for sql in statements]
                connection.commit()
                return changed
            except Exception:
                if not connection.isClosed():  # some errors end the session, and the transaction with it
                    connection.rollback()
                raise
        finally:
            connection.close()

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        try:
            self.execute([f"DELETE FROM {name} WHERE 1 = 0"])
        except Exception as e:
            if (getattr(e, "java_exception", None) is None) or not jvm.java.sql.SQLException._java_lang_class.isInstance(e.java_exception):
                raise
            if e.java_exception.getSQLState() not in ("42X05", "42P01"):
                raise
            return False
        return True

    def ddl(self, table: str) -> list[str]:
        """The statements that make a table with its keys and indexes."""
        columns = [f"{name} {self._type(kind)} {rule.format(clock=self.dialect.clock)}".rstrip() for name, kind, rule in COLUMNS[table]]
        foreign = [f"CONSTRAINT fk_{table}_{c} FOREIGN KEY ({c}) REFERENCES {other}({c}) ON DELETE CASCADE" for t, c, other in REFERENCES if t == table]
        body = ", ".join([*columns, f"PRIMARY KEY ({', '.join(KEYS[table])})", *foreign])
        return [f"CREATE TABLE {table} ({body})", *(f"CREATE INDEX idx_{t}_{c} ON {t}({c})" for t, c in INDEXES if t == table)]

    def initialise(self) -> None:
        """Make the tables that don't exist yet."""
        for table in COLUMNS:
            if not self._exists(table):
                self.execute(self.ddl(table))

    def read(self, table: str) -> DataFrame:
        """The rows of a table; articles in sixteen ranges of their keys, which are hexadecimal digests."""
        options = self.properties | {"driver": self.dialect.driver}
        if table == "feeds":
            return self._lower(self.spark.read.jdbc(self.url, table, properties=options))
        digits = "0123456789abcdef"
        ranges = [" AND ".join([*([f"article_key >= '{lo}'"] if lo != "0" else []), *([f"article_key < '{hi}'"] if hi else [])]) for lo, hi in zip(digits, [*digits[1:], ""], strict=True)]
        return self._lower(self.spark.read.jdbc(self.url, table, predicates=ranges, properties=options))

    def _lower(self, rows: DataFrame) -> DataFrame:
        rows = rows.toDF(*(c.lower() for c in rows.columns))
        return rows.withColumn("authors", F.from_json("authors", "array<string>")) if "authors" in rows.columns else rows

    def _merge(self, table: str, rows: DataFrame, update: Iterable[str]) -> int:
        """Load rows (each key once) and merge them; columns that rows don't have keep their values, or take the defaults."""
        staging, given = f"load_{uuid.uuid4().hex}", [x for x in COLUMNS[table] if x[0] in rows.columns]
        names, keys = [x[0] for x in given], KEYS[table]
        self.execute([f"CREATE TABLE {staging} ({', '.join(f'{n} {self._type(kind)}' for n, kind, _ in given)})"])
        try:
            loaded = rows.select(*(F.to_json(n).alias(n) if n == "authors" else F.col(n) for n in names))
            loaded.coalesce(self.loaders).write.mode("append").jdbc(self.url, staging, properties=self.properties | {"driver": self.dialect.driver})
            on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
            changes = ", ".join(f"{n} = s.{n}" for n in update)
            matched = f" WHEN MATCHED THEN UPDATE SET {changes}" if changes else ""
            insert = f" WHEN NOT MATCHED THEN INSERT ({', '.join(names)}) VALUES ({', '.join(f's.{n}' for n in names)})"
            return self.execute([f"MERGE INTO {table} t USING {staging} s ON {on}{matched}{insert}"])[0]
        finally:
            self.execute([f"DROP TABLE {staging}"])

    def upsert_feeds(self, feeds: DataFrame, now: Column) -> int:
        values = ["feed_type", "feed_value", "query", "enabled"]
        return self._merge("feeds", feeds.select("feed_id", *values, now.alias("created_at")), values)

    def upsert_articles(self, incoming: DataFrame, now: Column) -> int:
        """As operators.merge.upsert_articles: incoming is folded already. Gives the rows that were written."""
        rows = incoming.select("article_key", *M.UPDATED, now.alias("created_at"), now.alias("updated_at"))
        return self._merge("articles", rows, [*M.UPDATED, "updated_at"])

    def add_links(self, incoming: DataFrame) -> int:
        """As operators.merge.add_links; a link whose article or feed isn't stored fails the merge, whole."""
        first = incoming.groupBy(*KEYS["article_feeds"]).agg(F.min("first_seen_at").alias("first_seen_at"))
        return self._merge("article_feeds", first, [])
