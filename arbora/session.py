"""A session: the active set, the stack and named sets, undo, queries and their output."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.natural import order_columns
from .lang.parser import SyntaxProblem, parse
from .plans.model import Model
from .plans.planner import Planner, Value, sort_rows


@dataclass
class Result:
    """Rows of a query (distinct, lazy), the kinds of their columns, and how to print them."""

    df: DataFrame
    values: list[Value]
    order: list | None = None
    titles: dict[str, str] | None = None
    silent: bool = False
    titled: bool = False

    def ordered(self) -> DataFrame:
        return sort_rows(self.df, self.values, self.order)

    def page(self, begin: int = 1, count: int | None = None) -> DataFrame:
        df = self.ordered().offset(begin - 1)
        return df.limit(count) if count is not None else df

    def rows(self) -> Iterator[tuple]:
        for r in self.ordered().toLocalIterator():
            yield tuple(r)

    def lines(self, null: str = "NULL", quoted: bool = False) -> Iterator[str]:
        """Tab-separated text in the order of the query; a title line if asked for."""
        if self.titled:
            yield "#" + "\t".join((self.titles or {}).get(v.name, v.name) for v in self.values)
        for r in self.rows():
            yield "\t".join(null if x is None else f'"{x}"' if quoted and isinstance(x, str) else printed(x) for x in r)

    def paragraphs(self) -> Iterator[list[tuple]]:
        """Rows grouped by equal first columns, in order."""
        held: list[tuple] = []
        for r in self.rows():
            if held and held[0][0] != r[0]:
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    def sorted(self, spec: str) -> DataFrame:
        """The rows in the order of a specification like -2+4+1 (columns from 1), texts
        naturally, null smallest, then by all other columns."""
        names = [v.name for v in self.values]
        picked = [(names[int(k) - 1], sign == "-") for sign, k in re.findall(r"([+-]?)\s*(\d+)", spec)]
        picked += [(n, False) for n in names if n not in [x for x, _ in picked]]
        kinds = dict(self.df.dtypes)
        return self.df.orderBy(*[order_columns(F.col(f"`{n}`"), kinds[n], desc, nulls_first=not desc) if not desc else order_columns(F.col(f"`{n}`"), kinds[n], True, nulls_first=True) for n, desc in picked])

    def write(self, path: str, style: str = "tsv") -> None:
        df = self.ordered()
        names = [(self.titles or {}).get(v.name, v.name) for v in self.values]
        if style == "json":
            df.toDF(*names).write.mode("overwrite").json(path)
        elif style == "parquet":
            df.write.mode("overwrite").parquet(path)
        else:
            df.toDF(*names).write.mode("overwrite").option("sep", "," if style == "csv" else "\t").option("header", True).option("nullValue", "NULL").csv(path)


def printed(x) -> str:
    """A number without needless decimals, at most seven digits; other values as text."""
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else f"{x:.7g}"
    return str(x)


class Session:
    def __init__(self, spark: SparkSession, model: Model):
        self.spark, self.model = spark, model
        self.active: tuple[str | None, DataFrame] | None = None
        self.previous: tuple[str | None, DataFrame] | None = None
        self.stack: list[tuple[str | None, DataFrame]] = []
        self.named: dict[str, tuple[str | None, DataFrame]] = {}
        self.hooks = {}

    # -- queries --------------------------------------------------------------
    def query(self, text: str, **params) -> Result:
        """Run chained selects; the last one's result. `%name` and %1 are replaced."""
        for k, v in params.items():
            text = text.replace(f"%{k.lstrip('_')}", str(v))
        out = None
        for s in parse(text):
            planner = Planner(self.model, self.spark, self.active)
            df, values = planner.run(s)
            out = Result(df, values, s.order, s.titles, s.silent, bool(s.options.get("title")))
            if "o" in s.options:
                out.write(s.options["o"])
            first = values[0]
            self.set_active(first.cls if first.kind == "object" else None, df.select(F.col(f"`{first.name}`").alias("name")).where("name is not null").distinct())
        return out

    def set_active(self, cls: str | None, df: DataFrame) -> None:
        self.previous, self.active = self.active, (cls, df)

    def undo(self) -> None:
        self.active, self.previous = self.previous, self.active

    def count(self) -> int:
        return self.active[1].count() if self.active else 0

    def names(self) -> list:
        """The active set in natural order."""
        df = self.active[1]
        return [r[0] for r in df.orderBy(order_columns(F.col(df.columns[0]), dict(df.dtypes)[df.columns[0]])).toLocalIterator()]

    def subset(self, first: int, n: int) -> None:
        cls, df = self.active
        self.set_active(cls, df.orderBy(order_columns(F.col("name"), dict(df.dtypes)["name"])).offset(first - 1).limit(n))

    # -- stack and named sets -------------------------------------------------
    def push(self) -> None:
        self.stack.append(self.active)

    def pop(self) -> None:
        self.set_active(*self.stack.pop())

    def swap(self) -> None:
        top = self.stack.pop()
        self.stack.append(self.active)
        self.set_active(*top)

    def combine(self, how: str) -> None:
        """The active set and the top of the stack: and, or, xor, minus."""
        cls, top = self.stack.pop()
        self.set_active(self.active[0], set_operation(how, self.active[1], top))

    def store(self, name: str) -> None:
        self.named[name] = self.active

    def recall(self, name: str) -> None:
        self.set_active(*self.named[name])

    def clear(self, name: str) -> None:
        self.named.pop(name, None)

    def neighbours(self) -> None:
        """All objects that the active set refers to."""
        cls, df = self.active
        c, p = self.model.get(cls), Planner(self.model, self.spark)
        out = None
        for tag in c.tags.values():
            if tag.columns and tag.columns[0].kind == "object":
                e = p.edges(c, tag).join(df.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").cast("string").alias("name"))
                out = e if out is None else out.union(e)
        self.set_active(None, out.where("name is not null").distinct() if out is not None else df.limit(0))

    def grep(self, pattern: str, tables: list[tuple[str, str]] | None = None) -> DataFrame:
        """(class, name): objects whose name, or a text of theirs, matches; * and blanks
        stand for anything, and three characters are needed."""
        if len(re.sub(r"[*?\s]", "", pattern)) < 3:
            raise SyntaxProblem("three characters are needed")
        like = "(?is)" + ".*".join(re.escape(w) for w in re.split(r"[*\s]+", pattern) if w)
        out = None
        for c in self.model.classes.values():
            if c.parent or c.parts:
                continue
            df = c.rows()
            hits = [F.col(f"`{c.key}`").cast("string")]
            for t in c.tags.values():
                if t.columns and t.columns[0].kind == "text":
                    col = F.col(f"`{t.source}`") if t.stored == "value" else F.array_join(F.transform(F.col(f"`{t.source}`")["rows"], lambda x: x["c1"]), "\n") if t.stored == "struct" else None
                    hits += [col] if col is not None and (tables is None or (c.name, t.name) in tables) else []
            found = df.where(F.concat_ws("\n", *hits).rlike(like)).select(F.lit(c.name).alias("class"), F.col(f"`{c.key}`").cast("string").alias("name")).distinct()
            out = found if out is None else out.unionByName(found)
        return out

    def long_grep(self, word: str, tables: list[tuple[str, str]]) -> DataFrame:
        """(class, name) of the objects that own a text with the word: the texts of the given
        (class, tag) pairs are read whole, and a hit is that of the row they stand in."""
        like = "(?is)" + ".*".join(re.escape(w) for w in re.split(r"[*\s]+", word) if w)
        out = None
        for cls, tag in tables:
            c = self.model.get(cls)
            t = c.tag(tag)
            col = F.col(f"`{t.source}`") if t.stored == "value" else F.array_join(F.transform(F.col(f"`{t.source}`")["rows"], lambda x: x["c1"]), "\n")
            found = c.rows().where(col.rlike(like)).select(F.lit(c.name).alias("class"), F.col(f"`{c.key}`").cast("string").alias("name")).distinct()
            out = found if out is None else out.unionByName(found)
        return out

    def _tag_lines(self, cls, tag, members: DataFrame | None) -> DataFrame:
        """(name, tag, line, values) of the lines of one tag."""
        name = F.col(f"`{cls.key}`")
        if tag.stored == "inverse":
            e = Planner(self.model, self.spark).edges(cls, tag).select(F.col("src").alias("name"), F.lit(None).cast("int").alias("line"), F.array(F.col("dst").cast("string")).alias("values"))
        elif tag.stored == "value":
            e = cls.rows().where(F.col(f"`{tag.source}`").isNotNull()).select(name.alias("name"), F.lit(0).alias("line"), F.array(F.col(f"`{tag.source}`").cast("string")).alias("values"))
        else:
            cell = F.col(f"`{tag.source}`")
            rows = cls.rows().where(F.coalesce(cell["present"], F.lit(False))).select(name.alias("name"), F.posexplode_outer(cell["rows"]).alias("line", "l"))
            e = rows.select("name", "line", F.array(*[F.col("l")[f"c{i + 1}"].cast("string") for i in range(len(tag.columns))]).alias("values") if tag.columns else F.array().cast("array<string>").alias("values"))
        if members is not None:
            e = e.join(members.select(F.col(members.columns[0]).alias("name")), "name", "left_semi")
        return e.select(F.col("name").cast("string").alias("name"), F.lit(tag.name).alias("tag"), "line", "values")

    def show(self, tag: str | None = None) -> DataFrame:
        """(name, tag, line, values): the lines of the active objects, or of one tag of them."""
        name, members = self.active
        if name is None:
            raise SyntaxProblem("only objects can be shown")
        cls = self.model.get(name)
        tags = [t for t in cls.tags.values() if tag is None or t.name.lower() == tag.lower()]
        if not tags:
            raise SyntaxProblem(f"class {cls.name} has no tag {tag}")
        out = None
        for t in tags:
            e = self._tag_lines(cls, t, members)
            out = e if out is None else out.unionByName(e)
        return out

    def class_counts(self) -> DataFrame:
        """(class, n) of all stored classes."""
        out = None
        for c in self.model.classes.values():
            if not c.parent and not c.parts:
                e = c.rows().agg(F.count("*").alias("n")).select(F.lit(c.name).alias("class"), "n")
                out = e if out is None else out.unionByName(e)
        return out

    def tag_counts(self, name: str) -> DataFrame:
        """(tag, n): how many objects of a class have each tag. Stored tags are counted in one
        pass over the class."""
        cls = self.model.get(name)
        stored = [t for t in cls.tags.values() if t.stored != "inverse"]
        has = lambda t: F.col(f"`{t.source}`").isNotNull() if t.stored == "value" else F.coalesce(F.col(f"`{t.source}`")["present"], F.lit(False))
        one = cls.rows().agg(*[F.count(F.when(has(t), 1)).alias(f"n{i}") for i, t in enumerate(stored)])
        out = one.select(F.explode(F.array(*[F.struct(F.lit(t.name).alias("tag"), F.col(f"n{i}").alias("n")) for i, t in enumerate(stored)])).alias("x")).select("x.*")
        for t in cls.tags.values():
            if t.stored == "inverse":
                e = Planner(self.model, self.spark).edges(cls, t)
                out = out.unionByName(e.agg(F.count_distinct("src").alias("n")).select(F.lit(t.name).alias("tag"), "n"))
        return out

    def edit(self, text: str) -> None:
        """Apply a piece of object text to every object of the active set: `Tag value…` sets
        or adds a line, `-D Tag` deletes the tag, `-D Tag value…` one line of it."""
        name, members = self.active
        cls = self.model.base(self.model.get(name))
        flag = F.lit(True).alias("_in")
        base = cls.rows
        changes: dict[str, Column] = {}
        for raw in text.splitlines():
            parts = [a or b for a, b in re.findall(r'"((?:[^"\\]|\\.)*)"|(\S+)', raw)]
            if not parts:
                continue
            drop = parts[0].upper() == "-D"
            head, *vals = parts[1:] if drop else parts
            t = cls.tag(head)
            if t is None or t.stored == "inverse":
                raise SyntaxProblem(f"class {cls.name} stores no tag {head}")
            kind = base().schema[t.source].dataType
            old = changes.get(t.source, F.col(f"`{t.source}`"))
            if t.stored == "value":
                lit = F.lit(vals[0]).cast(kind) if vals else F.lit(None).cast(kind)
                new = (F.when(old == lit, F.lit(None)).otherwise(old) if vals else F.lit(None).cast(kind)) if drop else lit
            else:
                shape = kind["rows"].dataType.elementType
                line = F.struct(*[(F.lit(vals[i]) if i < len(vals) else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(shape.fields)])
                rows = F.coalesce(old["rows"], F.array().cast(kind["rows"].dataType))
                none = F.struct(F.lit(False).alias("present"), F.array().cast(kind["rows"].dataType).alias("rows"))
                others, held = _without(rows, line)
                if drop:
                    new = F.when(F.size(others) > 0, F.struct(F.lit(True).alias("present"), others.alias("rows"))).otherwise(none) if vals else none
                else:
                    kept = others if t.many else F.array().cast(kind["rows"].dataType)
                    new = F.struct(F.lit(True).alias("present"), (F.when(held, rows).otherwise(F.concat(kept, F.array(line))) if t.many else F.array(line)).alias("rows") if vals else rows.alias("rows"))
            changes[t.source] = new

        def rows() -> DataFrame:
            df = base()
            mark = members.select(F.col(members.columns[0]).alias("_key"), flag)
            j = df.join(mark, F.col(f"`{cls.key}`") == F.col("_key"), "left")
            return j.select(*[F.when(F.col("_in"), changes[c]).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in changes else F.col(f"`{c}`") for c in df.columns])

        for c in self.model.classes.values():
            if self.model.base(c) is cls and not c.parts:
                c.rows = rows

    def expand(self) -> None:
        """Stored sets whose names are in the active set, flattened to their members."""
        names = {r[0] for r in self.active[1].select(F.col("name").cast("string")).where(F.col("name").cast("string").isin(list(self.named))).distinct().collect()}  # among the stored ones
        picked = [self.named[n] for n in self.named if n in names]
        if not picked:
            return self.set_active(None, self.active[1].limit(0))
        out = picked[0][1]
        for _, df in picked[1:]:
            out = out.union(df.toDF(*out.columns))
        self.set_active(picked[0][0] if len({c for c, _ in picked}) == 1 else None, out.distinct())

    # -- command lines --------------------------------------------------------
    def command(self, line: str) -> Result | list | int | None:
        """One command of the shell: a select, find, follow, list, show, count, classes, tags,
        edit, expand, undo, subset, the set stack (spush spop swap sand sor sxor sminus), named sets (kstore kget kclear)."""
        words = line.split("//")[0].strip()
        if not words:
            return None
        head, _, rest = words.partition(" ")
        low, rest = head.lower(), rest.strip()
        if low in ("comment",):
            return None
        if low == "list":
            return self.names()
        if low == "count" and not rest:
            return self.count()
        if low == "undo":
            return self.undo()
        if low == "follow":
            out = self.query(f">{rest}")
            name = out.values[0].name
            out.df = out.df.where(F.col(f"`{name}`").isNotNull())
            return out
        if low in ("is",):
            return self.query(f"~ {rest}")
        if low in ("spush", "spop", "swap"):
            return {"spush": self.push, "spop": self.pop, "swap": self.swap}[low]()
        if low in ("sand", "sor", "sxor", "sminus"):
            return self.combine(low[1:])
        if low in ("kstore", "kget", "kclear"):
            return {"kstore": self.store, "kget": self.recall, "kclear": self.clear}[low](rest)
        if low == "show":
            return self.show(rest or None)
        if low == "classes":
            return self.class_counts()
        if low == "tags":
            return self.tag_counts(rest)
        if low == "edit":
            return self.edit(rest.replace(";", "\n"))
        if low == "expand":
            return self.expand()
        if low == "neighbours":
            return self.neighbours()
        if low == "subset":
            return self.subset(*map(int, rest.split()[:2]))
        if low in self.hooks:
            return self.hooks[low](self, rest)
        if low == "find":
            return self.query(words)
        return self.query(words)


def _without(rows: Column, line: Column) -> tuple[Column, Column]:
    """The lines of a tag but for one, and whether it is among them."""
    return F.filter(rows, lambda x: ~x.eqNullSafe(line)), F.exists(rows, lambda x: x.eqNullSafe(line))


def set_operation(how: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """and, or, xor, minus of two sets of names."""
    b = b.toDF(*a.columns)
    if how == "and":
        return a.intersect(b)
    if how == "or":
        return a.union(b).distinct()
    if how == "minus":
        return a.subtract(b)
    if how == "xor":
        return a.subtract(b).union(b.subtract(a))
    raise ValueError(how)


def run_script(session: Session, text: str) -> list:
    """Every line of a script, in order; what each one gave."""
    return [session.command(line) for line in text.splitlines() if line.strip()]


__all__ = ["Result", "Session", "printed", "run_script", "set_operation"]
