"""From syntax trees to DataFrames.

A query is one growing DataFrame with a row for each combination of its variables, and a
map from variables to columns. References are joined only when a tag of the object is
asked for; inverse tags are outer equi-joins; stored tags are exploded in place, once for
each variable, so that all brackets on a variable stay on one line. Conditions on tags
that were not made variables are EXISTS conditions: over an array of the row where the tag
is stored, else over a grouped set of the class's keys, joined in by key.
"""

from __future__ import annotations

import itertools
import re
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, dna
from ..functions.natural import natural_key, order_columns
from ..lang.ast import Active, Agg, Bin, Call, ClassScan, Cmp, DateLit, Decl, Isa, Method, Num, Obj, Path, Prev, Right, Select, Str, Un, Var
from .model import Class, Model, Tag

_ids = itertools.count(1)


def _sure(cond: C) -> C:
    """A comparison that is false where it is null; it remembers its bare form."""
    out = F.coalesce(cond, F.lit(False))
    out._bare = cond
    return out


def _bare(cond: C) -> C:
    """A condition for a filter, which drops rows for null as for false."""
    return cond.__dict__.get("_bare", cond)


class QueryProblem(ValueError):
    """A query that cannot be planned."""


@dataclass
class Value:
    """A column with its kind: number, text, date, timestamp, object (with class), tag."""

    col: C
    kind: str
    cls: str | None = None
    name: str = ""  # of a variable's column
    attached: str | None = None  # prefix of the object's tags in the DataFrame
    line: str | None = None  # exploded struct this value is a column of
    pos: int = 0
    tag: Tag | None = None
    owner: "Value | None" = None
    present: C | None = None  # tells presence at less cost than the column
    raw: C | None = None  # a literal in its own type, so that columns are not cast to compare


@dataclass
class Context:
    df: DataFrame
    vars: dict[str, Value] = field(default_factory=dict)
    last: str | None = None
    groups: dict = field(default_factory=dict)  # aggregates joined in, by what they are of


def _col(name: str) -> C:
    return F.col(f"`{name}`")


class Planner:
    def __init__(self, model: Model, spark, active: tuple[str | None, DataFrame] | None = None):
        self.model, self.spark, self.active = model, spark, active

    # -- queries --------------------------------------------------------------
    def run(self, s: Select) -> tuple[DataFrame, list[Value]]:
        """Distinct rows of the exports, named as they are, and the values' kinds."""
        ctx = Context(self.spark.range(1).select(F.lit(1).alias("_one")))
        self.steps(ctx, s)
        out, kinds, names = [], [], set()
        for name, e in s.exports:
            v = self.export(ctx, e)
            label = name if name.lower() not in names else f"{name}_{len(names) + 1}"
            names.add(label.lower())  # columns are told apart without case
            out.append((label, v))
        # a path among the exports can have replaced the frame: columns are resolved last
        df = ctx.df.select(*[v.col.alias(n) for n, v in out]).distinct()
        return df, [replace(v, name=n) for n, v in out]

    def steps(self, ctx: Context, s: Select) -> None:
        for step in s.steps:
            if isinstance(step, Decl):
                self.declare(ctx, step)
            else:
                cond = self.condition(ctx, step.cond)  # may join to the frame
                ctx.df = ctx.df.where(_bare(cond))

    def export(self, ctx: Context, e) -> Value:
        if isinstance(e, (Path, Right)):
            v = self.spread(ctx, e)
            return v
        return self.value(ctx, e)

    # -- generators -----------------------------------------------------------
    def declare(self, ctx: Context, d: Decl) -> None:
        v = self.spread(ctx, d.source) if d.spread else self.value(ctx, d.source)
        name = f"v{next(_ids)}"
        if v.name and v.attached:  # an object already in place
            ctx.vars[d.name] = v
        else:
            ctx.df = ctx.df.withColumn(name, v.col)
            ctx.vars[d.name] = replace(v, col=_col(name), name=name)
        ctx.last = d.name

    def class_frame(self, cls: Class) -> DataFrame:
        """Rows of a class; of a subclass, those that meet its condition."""
        if cls.parts:
            frames = [self.class_frame(self.model.get(p)) for p in cls.parts]
            keys = [f.select(_col(self.model.get(p).key).cast("string").alias(cls.key)) for f, p in zip(frames, cls.parts)]
            out = keys[0]
            for k in keys[1:]:
                out = out.unionByName(k)
            return out
        df = cls.rows()
        if cls.parent:
            df = self.class_frame(self.model.get(cls.parent))
            if cls.filter:
                ctx = Context(df.select(*[_col(c).alias(f"p.{c}") for c in df.columns]))
                me = Value(_col(f"p.{cls.key}"), "object", cls.parent, f"p.{cls.key}", "p")
                ctx.vars["_me"] = me
                from ..lang.parser import Parser

                cond = _on_member(Parser(cls.filter).expr(), self.model.get(cls.parent))
                ctx.df = ctx.df.where(self.condition(ctx, cond))
                df = ctx.df.select(*[_col(f"p.{c}").alias(c) for c in df.columns])
        return df

    def attach_class(self, ctx: Context, cls: Class, how: str = "cross", on: C | None = None, fk: str | None = None) -> str:
        """Join the rows of a class in, all columns under a new prefix. With `on`, where the
        class's key (or the reference `fk`) equals it."""
        prefix = f"o{next(_ids)}"
        df = self.class_frame(cls)
        df = df.select(*[_col(c).alias(f"{prefix}.{c}") for c in df.columns])
        if on is None:
            ctx.df = ctx.df.crossJoin(df) if ctx.vars else df.withColumn("_one", F.lit(1))
        else:
            key = _col(f"{prefix}.{fk or cls.key}")
            ctx.df = ctx.df.join(df, on(key) if callable(on) else on == key, how)
        return prefix

    def spread(self, ctx: Context, e) -> Value:
        """Make one row for each value of a source."""
        if isinstance(e, ClassScan):
            cls = self.model.get(e.cls)
            p = self.attach_class(ctx, cls)
            return Value(_col(f"{p}.{cls.key}"), "object", cls.name, f"{p}.{cls.key}", p)
        if isinstance(e, Active):
            cls_name, df = self._active()
            name = f"v{next(_ids)}"
            df = df.select(_col(df.columns[0]).alias(name))
            ctx.df = ctx.df.crossJoin(df) if ctx.vars else df.withColumn("_one", F.lit(1))
            return Value(_col(name), "object" if cls_name else "text", cls_name, name)
        if isinstance(e, Obj):
            cls = self.model.get(e.cls)
            key = self.value(ctx, e.name)
            if isinstance(e.name, (Str, Num)):
                p = self.attach_class(ctx, cls, "inner")
            else:  # names that the row gives: compared as names are
                own = lambda k: self._same_name(k, key, cls)
                p = self.attach_class(ctx, cls, "inner", own)
            if isinstance(e.name, (Str, Num)):
                ctx.df = ctx.df.where(self._same_name(_col(f"{p}.{cls.key}"), key, cls))
            return Value(_col(f"{p}.{cls.key}"), "object", cls.name, f"{p}.{cls.key}", p)
        if isinstance(e, (Path, Right)):
            return self._spread_path(ctx, e)
        return self.value(ctx, e)

    def _active(self) -> tuple[str | None, DataFrame]:
        if self.active is None:
            raise QueryProblem("there is no active set")
        return self.active

    @staticmethod
    def _same_name(a: C, name: Value, cls: Class) -> C:
        b = name.col
        if cls.key_kind == "number":
            return a == (name.raw if name.raw is not None else b if name.kind == "number" else b.try_cast("double"))
        return a == b if cls.case_sensitive else F.lower(a.cast("string")) == F.lower(b.cast("string"))

    def _object(self, ctx: Context, v: Value) -> tuple[Class, str]:
        """The class of an object and the prefix of its tags, joined in if need be."""
        if v.kind != "object" or v.cls is None:
            raise QueryProblem("tags belong to objects")
        cls = self.model.get(v.cls)
        if v.attached is None:
            v.attached = self.attach_class(ctx, self.model.base(cls), "left", v.col)
        return cls, v.attached

    def _spread_path(self, ctx: Context, e) -> Value:
        if isinstance(e, Right):
            base = self._base(ctx, e.base)
            return self._right(ctx, base, e.k)
        base = self._base(ctx, e.base)
        if e.op == "#":
            return self.value(ctx, Path(_Bound(base), "#", e.tag))
        cls, p = self._object(ctx, base)
        tag = cls.tag(e.tag)
        if tag is None:
            warnings.warn(f"class {cls.name} has no tag {e.tag}", stacklevel=2)
            return Value(F.lit(None).cast("string"), "text")
        if e.op == "=>":
            return Value(self._cell(ctx, base, tag, e.at), "text")
        if e.op == ">>":
            return self._closure(ctx, base, tag)
        return self._lines(ctx, base, tag, e.at)

    def _base(self, ctx: Context, e) -> Value:
        if isinstance(e, _Bound):
            return e.value
        if isinstance(e, Var):
            return self._var(ctx, e.name)
        if isinstance(e, Prev):
            return ctx.vars[ctx.last]
        return self.spread(ctx, e)

    def _var(self, ctx: Context, name: str) -> Value:
        if name not in ctx.vars:
            raise QueryProblem(f"no variable {name}")
        return ctx.vars[name]

    def _lines(self, ctx: Context, base: Value, tag: Tag, at: int) -> Value:
        """Outer expansion: one row for each line of the tag, null where there is none."""
        _, p = self._object(ctx, base)
        col = tag.columns[min(at, len(tag.columns)) - 1]
        if tag.stored == "value":
            return Value(_col(f"{p}.{tag.source}"), col.kind, col.cls, tag=tag)
        if tag.stored == "inverse":
            child = self.model.get(col.cls)
            c = self.attach_class(ctx, child, "left", base.col, tag.source)
            return Value(_col(f"{c}.{child.key}"), "object", child.name, f"{c}.{child.key}", c, tag=tag, present=_col(f"{c}.{tag.source}").isNotNull())
        line = f"l{next(_ids)}"
        ctx.df = ctx.df.select("*", F.explode_outer(_col(f"{p}.{tag.source}")["rows"]).alias(line))
        return self._field(line, tag, at)

    @staticmethod
    def _field(line: str, tag: Tag, at: int) -> Value:
        if at > len(tag.columns):
            return Value(F.lit(None).cast("string"), "text", line=line, pos=at, tag=tag)
        col = tag.columns[at - 1]
        return Value(_col(line)[f"c{at}"], col.kind, col.cls, line=line, pos=at, tag=tag)

    def _right(self, ctx: Context, v: Value, k: int) -> Value:
        if v.line is None:
            if v.kind != "tag" or v.owner is None:
                raise QueryProblem("brackets need a tag")
            _, p = self._object(ctx, v.owner)
            v.line = f"l{next(_ids)}"
            ctx.df = ctx.df.select("*", F.explode_outer(_col(f"{p}.{v.tag.source}")["rows"]).alias(v.line))
        return self._field(v.line, v.tag, v.pos + k)

    def _cell(self, ctx: Context, base: Value, tag: Tag, at: int) -> C:
        """All values of a tag in one cell, in object order."""
        _, p = self._object(ctx, base)
        if tag.stored == "value":
            return _col(f"{p}.{tag.source}").cast("string")
        if tag.stored == "struct":
            rows = _col(f"{p}.{tag.source}")["rows"]
            texts = F.filter(F.transform(rows, lambda x: x[f"c{at}"].cast("string")), lambda x: x.isNotNull())
            return F.when(F.size(texts) > 0, F.array_join(texts, "; "))
        child = self.model.get(tag.columns[0].cls)
        key, out = f"k{next(_ids)}", f"a{next(_ids)}"
        group = child.rows().groupBy(_col(tag.source).alias(key)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(child.key)), lambda x: x.cast("string")), "; ").alias(out))
        ctx.df = ctx.df.join(group, base.col == _col(key), "left").drop(key)
        return _col(out)

    def edges(self, cls: Class, tag: Tag) -> DataFrame:
        """(src, dst) of a tag, from the class's own rows or from those that refer to it."""
        base = self.model.base(cls)
        if tag.stored == "inverse":
            child = self.model.get(tag.columns[0].cls)
            return child.rows().select(_col(tag.source).alias("src"), _col(child.key).alias("dst")).where("src is not null")
        df = base.rows()
        if tag.stored == "value":
            return df.select(_col(base.key).alias("src"), _col(tag.source).alias("dst")).where("dst is not null")
        return df.select(_col(base.key).alias("src"), F.explode(_col(tag.source)["rows"]["c1"]).alias("dst")).where("dst is not null")

    def _closure(self, ctx: Context, base: Value, tag: Tag) -> Value:
        from ..operators.graph import closure

        cls = self.model.get(base.cls)
        col = tag.columns[0]
        if col.cls is None or self.model.base(self.model.get(col.cls)).name != self.model.base(cls).name:
            return self._lines(ctx, base, tag, 1)
        starts = ctx.df.select(base.col.alias("start")).where("start is not null").distinct()
        reach = closure(self.edges(cls, tag), starts)
        s, d = f"k{next(_ids)}", f"v{next(_ids)}"
        ctx.df = ctx.df.join(reach.select(_col("start").alias(s), _col("node").alias(d)), base.col == _col(s), "left").drop(s)
        return Value(_col(d), "object", col.cls, d)

    # -- values ---------------------------------------------------------------
    def value(self, ctx: Context, e) -> Value:
        """A single value for each row."""
        if isinstance(e, _Bound):
            return e.value
        if isinstance(e, Num):
            whole = float(e.value).is_integer() and abs(e.value) < 2**53
            return Value(F.lit(int(e.value)).cast("double") if whole else F.lit(e.value), "number", raw=F.lit(int(e.value)) if whole else None)
        if isinstance(e, Str):
            if e.bare and e.text in ctx.vars:
                return ctx.vars[e.text]
            return Value(F.lit(e.text), "text")
        if isinstance(e, DateLit):
            return Value(F.lit(e.text), "date")
        if isinstance(e, Var):
            return self._var(ctx, e.name)
        if isinstance(e, Prev):
            return ctx.vars[ctx.last]
        if isinstance(e, Method):
            v = self._base(ctx, e.base)
            if e.name == "name":
                return Value(v.col.cast("string"), "text")
            if e.name == "class":
                return Value(F.when(v.col.isNotNull(), F.lit(v.cls)), "text")
            return Value(F.lit(None).cast("string"), "text")
        if isinstance(e, Path):
            if e.op == "#":
                base = self._base(ctx, e.base)
                cls, p = self._object(ctx, base)
                tag = cls.tag(e.tag)
                if tag is None:
                    return Value(F.lit(None).cast("string"), "tag")
                return Value(F.when(self._present(ctx, base, tag), F.lit(tag.name)), "tag", tag=tag, owner=base)
            return self._spread_path(ctx, e)
        if isinstance(e, Right):
            return self._spread_path(ctx, e)
        if isinstance(e, Un) and e.op == "-":
            return Value(-self.number(ctx, e.a), "number")
        if isinstance(e, Bin) and e.op in "+-*/%^":
            a, b = self.number(ctx, e.a), self.number(ctx, e.b)
            col = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.when(b != 0, F.pmod(a, b)), "^": lambda: F.nanvl(F.power(a, b), F.lit(None).cast("double"))}[e.op]()
            return Value(col, "number")
        if isinstance(e, Agg):
            return self.aggregate(ctx, e)
        if isinstance(e, Call):
            return self.call(ctx, e)
        if isinstance(e, (Cmp, Bin, Un, Isa)):
            return Value(self.condition(ctx, e), "boolean")
        if isinstance(e, (Active, Obj, ClassScan)):
            return self.spread(ctx, e)
        raise QueryProblem(f"cannot evaluate {e!r}")

    def number(self, ctx: Context, e) -> C:
        v = self.value(ctx, e)
        if v.kind == "number":
            return v.col.cast("double")
        return F.lit(None).cast("double") if v.kind in ("tag", "timestamp") else v.col.try_cast("double")

    def _present(self, ctx: Context, base: Value, tag: Tag) -> C:
        _, p = self._object(ctx, base)
        if tag.stored == "value":
            return _col(f"{p}.{tag.source}").isNotNull()
        if tag.stored == "struct":
            return F.coalesce(_col(f"{p}.{tag.source}")["present"], F.lit(False))
        return self._counted(ctx, base, tag) > 0

    def _counted(self, ctx: Context, base: Value, tag: Tag) -> C:
        """Number of lines of a tag, never null."""
        _, p = self._object(ctx, base)
        if tag.stored == "value":
            return _col(f"{p}.{tag.source}").isNotNull().cast("long")
        if tag.stored == "struct":
            rows = _col(f"{p}.{tag.source}")["rows"]
            return F.coalesce(F.size(F.filter(rows, lambda x: x["c1"].isNotNull())), F.lit(0)).cast("long")
        child = self.model.get(tag.columns[0].cls)
        key, out = f"k{next(_ids)}", f"n{next(_ids)}"
        group = child.rows().groupBy(_col(tag.source).alias(key)).agg(F.count("*").alias(out))
        ctx.df = ctx.df.join(group, base.col == _col(key), "left").drop(key)
        return F.coalesce(_col(out), F.lit(0))

    def call(self, ctx: Context, e: Call) -> Value:
        if e.fn == "NOW":
            return Value(dates.of_timestamp(F.current_timestamp()), "date")
        if e.fn == "TODAY":
            return Value(F.date_format(F.current_date(), "yyyy-MM-dd"), "date")
        if e.fn == "ABS":
            return Value(F.abs(self.number(ctx, e.args[0])), "number")
        if e.fn.endswith("DIFF") and e.fn != "DATEDIFF":  # YEARDIFF to SECDIFF, of later and earlier date
            a, b = (self.date(ctx, x) for x in e.args[:2])
            return Value(dates.datediff(e.fn[:-4], b, a).cast("double"), "number")
        if e.fn == "DATEDIFF":
            unit = e.args[0]
            unit = unit.text if isinstance(unit, Str) else unit.name
            a, b = (self.date(ctx, x) for x in e.args[1:3])
            return Value(dates.datediff(unit, a, b).cast("double"), "number")
        of = e.args[0]
        if isinstance(of, (Active, Obj, Path)):  # made rows of once
            of = _Bound(self._base(ctx, of))
        seq = self._sequence(ctx, of)
        if e.fn == "DNA":
            if len(e.args) == 3:
                return Value(dna.fragment(seq, self.number(ctx, e.args[1]).cast("int"), self.number(ctx, e.args[2]).cast("int")), "text")
            return Value(seq, "text")
        if e.fn == "CODING":  # of coding sequences, up to the stop
            return Value(F.split(dna.translate(F.when(self._coding(ctx, of), seq)), r"\*")[0], "text")
        pep = dna.translate(seq)
        if len(e.args) == 3:
            pep = dna.peptide_fragment(pep, self.number(ctx, e.args[1]).cast("int"), self.number(ctx, e.args[2]).cast("int"))
        return Value(pep, "text")

    def _sequence(self, ctx: Context, e) -> C:
        """The bases of an object with a DNA tag, or of a text."""
        v = self._base(ctx, e) if isinstance(e, (Var, Prev, _Bound)) else self.value(ctx, e)
        if v.kind != "object":
            return F.lower(v.col.cast("string"))
        cls, p = self._object(ctx, v)
        t = cls.tag("DNA")
        if t is None:
            return F.lit(None).cast("string")
        cell = _col(f"{p}.{t.source}") if t.stored == "value" else F.get(_col(f"{p}.{t.source}")["rows"], F.lit(0))["c1"]
        if t.columns[0].cls:  # the sequence is an object of its own, whose text is its tag
            dcls = self.model.get(t.columns[0].cls)
            q = self.attach_class(ctx, dcls, "left", cell)
            text = dcls.tag("sequence")
            return F.lower(_col(f"{q}.{text.source}") if text.stored == "value" else F.get(_col(f"{q}.{text.source}")["rows"], F.lit(0))["c1"])
        return F.lower(cell)

    def _coding(self, ctx: Context, e) -> C:
        v = self._base(ctx, e) if isinstance(e, (Var, Prev, _Bound)) else None
        if v is None or v.kind != "object":
            return F.lit(True)
        cls, _ = self._object(ctx, v)
        t = cls.tag("CDS")
        return F.lit(True) if t is None else self._present(ctx, v, t)

    def date(self, ctx: Context, e) -> C:
        v = self.value(ctx, e)
        return dates.of_timestamp(v.col) if v.kind == "timestamp" else v.col.cast("string")

    # -- aggregates -----------------------------------------------------------
    def aggregate(self, ctx: Context, e: Agg) -> Value:
        if isinstance(e.of, Path) and e.of.op == "->" and isinstance(e.of.base, (Var, Prev, _Bound)):
            base = self._base(ctx, e.of.base)
            cls, p = self._object(ctx, base)
            tag = cls.tag(e.of.tag)
            if tag is None:
                warnings.warn(f"class {cls.name} has no tag {e.of.tag}", stacklevel=2)
                return Value(F.lit(0).cast("long") if e.fn == "count" else F.lit(None).cast("double"), "number")
            if e.fn == "count":
                return Value(self._counted(ctx, base, tag), "number")
            if tag.stored == "struct":
                return Value(_fold(e.fn, F.filter(F.transform(_col(f"{p}.{tag.source}")["rows"], lambda x: x[f"c{e.of.at}"].try_cast("double")), lambda x: x.isNotNull())), "number")
        sub = e.of
        if not isinstance(sub, Select):
            name = f"_a{next(_ids)}"
            sub = Select(exports=[(name, Var(name))], steps=[Decl(name, e.of, True)])
        return self._correlated(ctx, e.fn, sub, e.of)

    def _correlated(self, ctx: Context, fn: str, sub: Select, of) -> Value:
        """Decorrelated: the subquery runs once over the distinct outer values it uses,
        grouped by them, and is joined in; count is 0 where it has no rows."""
        used = [n for n in ctx.vars if n in _names(sub)]
        if not used:
            df, vals = self.run(sub)
            out = f"n{next(_ids)}"
            v = _col(df.columns[0])
            ctx.df = ctx.df.crossJoin(df.agg(_agg(fn, v, vals[0].kind).alias(out)))
            return Value(_col(out), "number" if fn not in ("min", "max", "first", "last") else vals[0].kind)
        # all aggregates of one path or subquery come from one group; unused ones are pruned
        same = (repr(of), tuple(used))
        if same not in ctx.groups:
            ctx.groups[same] = self._group(ctx, sub, used)
        out, v = ctx.groups[same]
        col = _col(f"{out}.{fn}")
        return Value(F.coalesce(col, F.lit(0)) if fn == "count" else col, "number" if fn not in ("min", "max", "first", "last") or v.kind == "number" else v.kind)

    def _group(self, ctx: Context, sub: Select, used: list[str]) -> tuple[str, Value]:
        """Join in the aggregates of a subquery, grouped by the outer values it uses."""
        keys = {n: f"k{next(_ids)}" for n in used}
        outer = ctx.df.select(*[ctx.vars[n].col.alias(k) for n, k in keys.items()]).distinct()
        inner = Context(outer, {n: replace(ctx.vars[n], col=_col(k), name=k, attached=None, line=None) for n, k in keys.items()})
        self.steps(inner, sub)
        v = self.export(inner, sub.exports[0][1])
        # a subquery's rows are distinct, like any query's, by object; values of one line each count
        rows = inner.df.select(*[_col(k) for k in keys.values()], v.col.alias("_v")).where("_v is not null")
        if v.kind == "object":
            rows = rows.distinct()
        out = f"n{next(_ids)}"
        number = _col("_v") if v.kind in ("number",) else _col("_v").try_cast("double")
        turned = bool(sub.order) and sub.order[0][1]  # the table's own order, turned round
        aggs = [_agg(fn, number if fn in ("sum", "avg", "average", "stddev") else _col("_v"), v.kind, turned).alias(f"{out}.{fn}") for fn in _AGGREGATES]
        group = rows.groupBy(*keys.values()).agg(*aggs)
        cond = None
        for n, k in keys.items():
            one = ctx.vars[n].col.eqNullSafe(_col(k))
            cond = one if cond is None else cond & one
        ctx.df = ctx.df.join(group, cond, "left").drop(*keys.values())
        return out, v

    # -- conditions -----------------------------------------------------------
    def condition(self, ctx: Context, e) -> C:
        """True or false, never null: an atom with a null is false."""
        if isinstance(e, Bin) and e.op in ("or", "xor", "and"):
            a, b = self.condition(ctx, e.a), self.condition(ctx, e.b)
            if e.op == "xor":
                return a != b
            out, bare = (a | b, _bare(a) | _bare(b)) if e.op == "or" else (a & b, _bare(a) & _bare(b))
            out._bare = bare
            return out
        if isinstance(e, Un) and e.op == "not":
            return ~self.condition(ctx, e.a)
        if isinstance(e, Isa):
            v = self._base(ctx, e.a) if isinstance(e.a, (Var, Prev)) else self.value(ctx, e.a)
            cls = self.model.get(e.cls)
            key, flag = f"k{next(_ids)}", f"f{next(_ids)}"
            members = self.class_frame(cls).select(_col(cls.key).alias(key), F.lit(True).alias(flag)).distinct()
            ctx.df = ctx.df.join(members, v.col == _col(key), "left").drop(key)
            return F.coalesce(_col(flag), F.lit(False))
        if isinstance(e, Cmp):
            return self.compare(ctx, e)
        if isinstance(e, Path) and e.op != "#" and (exists := self._exists(ctx, e, None)) is not None:
            return exists
        v = self.value(ctx, e)
        if v.kind == "boolean":
            return v.col
        if v.present is not None:
            return v.present
        if v.kind == "number" and isinstance(e, (Num, Bin, Un, Agg)):
            return F.coalesce(v.col.isNotNull() & ~F.isnan(v.col.cast("double")), F.lit(False))
        return v.col.isNotNull() & (~F.isnan(v.col.cast("double")) if v.kind == "number" else F.lit(True))

    def compare(self, ctx: Context, e: Cmp) -> C:
        for x, y, turned in ((e.a, e.b, False), (e.b, e.a, True)):
            if isinstance(x, Path) and x.op in ("->", ">>"):
                other = self.value(ctx, y)
                test = lambda v, other=other, turned=turned: self.test(e.op, other, v, e.a) if turned else self.test(e.op, v, other, e.b)
                if (exists := self._exists(ctx, x, test)) is not None:
                    return exists
        return self.test(e.op, self.value(ctx, e.a), self.value(ctx, e.b), e.b)

    def _exists(self, ctx: Context, path: Path, test) -> C | None:
        """EXISTS over the values of a tag that is no variable; None if it has one value."""
        if not isinstance(path.base, (Var, Prev, _Bound)):
            chain = f"_e{next(_ids)}"
            sub = Select(exports=[(chain, Var(chain))], steps=[Decl(chain, path, True)])
            return self._any(ctx, sub, chain, test)
        base = self._base(ctx, path.base)
        cls, p = self._object(ctx, base)
        tag = cls.tag(path.tag)
        if tag is None:
            warnings.warn(f"class {cls.name} has no tag {path.tag}", stacklevel=2)
            return F.lit(False)
        if tag.stored == "value" and path.op == "->":
            return None
        if tag.stored == "struct" and path.op == "->":
            col = tag.columns[min(path.at, len(tag.columns)) - 1]
            rows = _col(f"{p}.{tag.source}")["rows"]
            ok = lambda x: test(Value(x[f"c{path.at}"], col.kind, col.cls)) if test else x[f"c{path.at}"].isNotNull()
            return F.coalesce(F.exists(rows, ok), F.lit(False))
        if test is None and path.op == "->":
            return self._counted(ctx, base, tag) > 0
        name = f"_e{next(_ids)}"
        return self._any(ctx, Select(exports=[(name, Var(name))], steps=[Decl(name, path, True)]), name, test)

    def _any(self, ctx: Context, sub: Select, name: str, test) -> C:
        used = [n for n in ctx.vars if n in _names(sub)] or ([ctx.last] if _has_prev(sub) else [])
        keys = {n: f"k{next(_ids)}" for n in used}
        outer = ctx.df.select(*[ctx.vars[n].col.alias(k) for n, k in keys.items()]).distinct()
        inner = Context(outer, {n: replace(ctx.vars[n], col=_col(k), name=k, attached=None, line=None) for n, k in keys.items()}, ctx.last)
        self.steps(inner, sub)
        v = inner.vars[name]
        hit = inner.df.where(test(v) if test else v.col.isNotNull()).select(*keys.values()).distinct()
        flag = f"f{next(_ids)}"
        cond = None
        for n, k in keys.items():
            one = ctx.vars[n].col == _col(k)
            cond = one if cond is None else cond & one
        ctx.df = ctx.df.join(hit.withColumn(flag, F.lit(True)), cond, "left").drop(*keys.values())
        return F.coalesce(_col(flag), F.lit(False))

    def test(self, op: str, a: Value, b: Value, written=None) -> C:
        """One comparison of two single values."""
        if "timestamp" in (a.kind, b.kind) and isinstance(written, DateLit) and a.kind == "timestamp":
            return _sure(_timestamp(op, a.col, written.text))
        if a.kind in ("date", "timestamp") or b.kind in ("date", "timestamp"):
            x, y = (dates.of_timestamp(v.col) if v.kind == "timestamp" else v.col.cast("string") for v in (a, b))
            if op in ("=~", "~", ">~", "<~"):
                x, y = dates.loose(x, y)
                op = {"=~": "==", "~": "==", ">~": ">=", "<~": "<="}[op]
            return _sure(_plain(op, x, y))
        if op == "=~":
            return _sure(a.col.cast("string").rlike("(?i)" + written.text) if isinstance(written, Str) else F.regexp(a.col.cast("string"), F.concat(F.lit("(?i)"), b.col.cast("string"))))
        if op in ("~", ">~", "<~"):
            if isinstance(written, Str):
                return _sure(like(a.col.cast("string"), written))
            return _sure(F.lower(a.col.cast("string")) == F.lower(b.col.cast("string")))
        if a.kind == "number" or b.kind == "number":
            x, y = (v.raw if v.raw is not None else v.col if v.kind == "number" else v.col.try_cast("double") for v in (a, b))
            return _sure(_plain(op, x, y) & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double")) if op == "!=" else _plain(op, x, y))
        x, y = a.col.cast("string"), b.col.cast("string")
        cls = self.model.get(a.cls) if a.cls else None
        if op in ("==", "!="):
            if not (cls and cls.case_sensitive):
                x, y = F.lower(x), F.lower(y)
            return _sure(_plain(op, x, y))
        return _sure(_plain(op, natural_key(x), natural_key(y)))


@dataclass(frozen=True)
class _Bound:
    value: Value


def _plain(op: str, a: C, b: C) -> C:
    return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def _timestamp(op: str, col: C, text: str) -> C:
    """A timestamp against a date literal, as a range that can be pushed to the scan: the
    timestamp has all parts, so a shorter literal is never equal to it and lies before."""
    start = F.lit(dates.start_of(text)).cast("timestamp_ntz")
    full = len(text) == 19
    unit = {4: "YEAR", 7: "MONTH", 10: "DAY", 13: "HOUR", 16: "MINUTE", 19: "SECOND"}[len(text)]
    end = F.timestamp_add(unit, F.lit(1), start)
    if op in ("=~", "~"):
        return (col >= start) & (col < end)
    if op == ">~":
        return col >= start
    if op == "<~":
        return col < end
    if full:
        return _plain(op, col, start)
    return {"==": lambda: col.isNull() & col.isNotNull(), "!=": lambda: col.isNotNull(), ">": lambda: col >= start, ">=": lambda: col >= start, "<": lambda: col < start, "<=": lambda: col < start}[op]()


def like(col: C, p: Str) -> C:
    """Name match: * and ? anchored at both ends, without case; none in single quotes."""
    if p.exact or not re.search(r"[*?]", p.text):
        return F.lower(col) == p.text.lower()
    return col.rlike("(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p.text) + "$")


_AGGREGATES = ("count", "min", "max", "sum", "avg", "stddev", "first", "last")


def _agg(fn: str, col: C, kind: str = "number", turned: bool = False) -> C:
    """An aggregate of a subquery's values. First and last go by the order of its rows:
    natural for texts, by value for others, turned round by its order_by."""
    if fn in ("first", "last"):
        low = (fn == "first") != turned
        if kind in ("text", "tag"):
            return (F.min_by if low else F.max_by)(col, natural_key(col))
        fn = "min" if low else "max"
    return {"count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "stddev": F.stddev_pop}[fn](col)


def _fold(fn: str, arr: C) -> C:
    """An aggregate over an array of doubles."""
    n, total = F.size(arr), F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    if fn in ("min", "max"):
        return {"min": F.array_min, "max": F.array_max}[fn](arr)
    if fn == "sum":
        return F.when(n > 0, total)
    if fn == "avg":
        return F.when(n > 0, total / n)
    if fn == "stddev":
        mean = total / n
        return F.when(n > 0, F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n))
    return F.get(arr, F.lit(0)) if fn == "first" else F.get(arr, n - 1)


def _names(e) -> set[str]:
    """Variables named anywhere in a tree (bare words too: they may be variables)."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Str):
        return {e.text} if e.bare else set()
    out: set[str] = set()
    if isinstance(e, (list, tuple)):
        for x in e:
            out |= _names(x)
    elif hasattr(e, "__dataclass_fields__") and not isinstance(e, Value):
        for f in e.__dataclass_fields__:
            if f not in ("titles", "options"):
                out |= _names(getattr(e, f))
    return out


def _has_prev(e) -> bool:
    if isinstance(e, Prev):
        return True
    if isinstance(e, (list, tuple)):
        return any(_has_prev(x) for x in e)
    return hasattr(e, "__dataclass_fields__") and not isinstance(e, Value) and any(_has_prev(getattr(e, f)) for f in e.__dataclass_fields__)


def _on_member(e, cls: Class):
    """A condition written about a member of a class: its bare tag names become paths."""
    me = Var("_me")
    if isinstance(e, Str) and e.bare and cls.tag(e.text):
        return Path(me, "->", e.text)
    if isinstance(e, Agg) and isinstance(e.of, Str):
        return Agg(e.fn, Path(me, "->", e.of.text))
    if isinstance(e, Cmp):
        a = e.a if not (isinstance(e.a, Str) and e.a.bare and e.a.text.lower() in ("is", "name")) else me
        return Cmp(e.op, _on_member(a, cls), e.b)
    if isinstance(e, Bin):
        return Bin(e.op, _on_member(e.a, cls), _on_member(e.b, cls))
    if isinstance(e, Un):
        return Un(e.op, _on_member(e.a, cls))
    return e


def sort_rows(df: DataFrame, values: list[Value], order=None) -> DataFrame:
    """The default order (all columns, natural, null last), or an order_by list first."""
    names = [v.name for v in values]
    kinds = {v.name: "string" if dict(df.dtypes)[v.name] == "string" else "other" for v in values}
    spec: list[tuple[str, bool]] = []
    for what, desc in order or []:
        name = names[int(float(what)) - 1] if re.fullmatch(r"\d+(\.0*)?", what) else what
        if name in names and name not in [n for n, _ in spec]:
            spec.append((name, desc))
    spec += [(n, False) for n in names if n not in [x for x, _ in spec]]
    return df.orderBy(*[order_columns(_col(n), kinds[n], desc) for n, desc in spec])
