"""The object model: classes, their tags, and where their rows are.

A class is a DataFrame with a key column and tags. A tag is either *stored* in the row, as
a column of its own (one value) or as STRUCT<present, rows: ARRAY<STRUCT<c1, c2, ...>>>
(many lines of several columns, which tells a tag without value from a missing one), or
*inverse*: the rows of another class that refer to this one, resolved as an equi-join on
the reference and never materialised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Column:
    """One column of a tag: its type (text, number, date, object) and class if an object."""

    kind: str = "text"
    cls: str | None = None


@dataclass
class Tag:
    name: str
    columns: list[Column] = field(default_factory=list)
    stored: str = "struct"  # struct | value | inverse
    source: str = ""  # column of the class, or of the referring class
    many: bool = True
    inverse: str | None = None  # name of the inverse tag, of stored references


@dataclass
class Class:
    name: str
    rows: Callable[[], DataFrame]
    key: str = "name"
    key_kind: str = "text"
    tags: dict[str, Tag] = field(default_factory=dict)
    parent: str | None = None
    filter: str | None = None  # of a subclass: a condition in the language, on its members
    parts: list[str] = field(default_factory=list)  # of a composite class
    case_sensitive: bool = False

    def tag(self, name: str) -> Tag | None:
        return self.tags.get(name.lower())

    def add(self, tag: Tag) -> None:
        self.tags[tag.name.lower()] = tag


class Model:
    def __init__(self, classes: list[Class] = ()):
        self.classes: dict[str, Class] = {}
        for c in classes:
            self.add(c)

    def add(self, c: Class) -> None:
        self.classes[c.name.lower()] = c

    def get(self, name: str) -> Class:
        c = self.classes.get(name.lower())
        if c is None:
            raise KeyError(f"no class {name!r}")
        return c

    def base(self, c: Class) -> Class:
        """The class that holds the rows of a subclass."""
        while c.parent:
            c = self.get(c.parent)
        return c

    def subclass(self, name: str, parent: str, condition: str) -> None:
        p = self.get(parent)
        self.add(Class(name, p.rows, p.key, p.key_kind, p.tags, parent=parent, filter=condition, case_sensitive=p.case_sensitive))

    def composite(self, name: str, parts: list[str]) -> None:
        first = self.get(parts[0])
        self.add(Class(name, first.rows, first.key, first.key_kind, {}, parts=parts))


#: Keys and references of the relational tables.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
REFERENCES = [
    ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("labels", "doc_id", "documents"),
]
#: Keys that no column gives: made from the whole row.
SURROGATES = {"lineitem": "l_key", "labels": "label_key", "conversations": "turn_key"}


def relational(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> Model:
    """The implicit model over Parquet tables: a table is a class, its primary key the
    object, its other columns tags of one value; a foreign key is also a tag named as the
    class it refers to, with the referring table as inverse tag."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    names = names or [*KEYS, *SURROGATES]
    model, frames = Model(), {}
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in SURROGATES:
            df = df.withColumn(SURROGATES[name], F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]), 256))
        frames[name] = df
        key = KEYS.get(name) or SURROGATES[name]
        kind_of = lambda t: "number" if isinstance(t, T.NumericType) else "timestamp" if isinstance(t, (T.TimestampNTZType, T.TimestampType)) else "text"
        c = Class(name, lambda df=df: df, key, kind_of(df.schema[key].dataType))
        for f in df.schema.fields:
            c.add(Tag(f.name, [Column(kind_of(f.dataType))], "value", f.name, many=False))
        model.add(c)
    for child, column, parent in REFERENCES:
        if child in frames and parent in frames:
            model.get(child).add(Tag(parent, [Column("object", parent)], "value", column, many=False))
            model.get(parent).add(Tag(child, [Column("object", child)], "inverse", column))
    return model
