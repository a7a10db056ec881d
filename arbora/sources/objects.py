"""Object text: reader, writer and class models.

A model declares classes, indented lines giving tags and their columns:

    ?Person
      Papers ?Paper XREF Author
      Height UNIQUE Float
      Professor

Object text is paragraphs divided by blank lines. The first line names a class and an
object, the others a tag and its values; `-D` deletes (an object, a tag, or one value of
it), `-R` renames, `-C` and `//` comment, `!` skips a line (`!!` the paragraph), `-O` stamps
are dropped. `>name` begins a FASTA sequence. Paragraphs are read in parallel and replayed
in order by grouped aggregation: no paragraph waits for another one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import Class, Column, Model, Tag
from ..ship import ship

TYPES = {"text": "text", "int": "number", "float": "number", "longint": "number", "longfloat": "number", "datetype": "date"}
MODIFIERS = {"unique", "repeat", "xref", "coord", "sorted", "any"}
_BLANK = re.compile(r"\n[ \t\r]*\n")
_WORD = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def split_words(line: str) -> list[str]:
    """Words and quoted texts of a line; // ends it."""
    out, at = [], 0
    while at < len(line):
        if line.startswith("//", at):
            break
        m = _WORD.match(line, at)
        if m:
            word = m.group(2)
            if m.group(1) is not None:
                out.append(re.sub(r"\\(.)", r"\1", m.group(1)))
            else:
                cut = word.find("//")
                out.append(word if cut < 0 else word[:cut])
                if cut >= 0:
                    break
            at = m.end()
        else:
            at += 1
    return [w for w in out if w != ""] if '""' not in line else out


def parse_model(text: str) -> dict[str, list[Tag]]:
    """Class name to its tags. Nested tags keep the innermost name; `#Type` is its tags'
    first columns."""
    classes: dict[str, list[Tag]] = {}
    current: list[Tag] | None = None
    for raw in text.splitlines():
        words = raw.split("//")[0].split()
        if not words:
            continue
        if words[0].startswith("?") and not raw[0].isspace():
            current = classes.setdefault(words[0][1:], [])
            words = words[1:]
        if not words or current is None:
            continue
        name, columns, many, inverse, k = None, [], True, None, 0
        while k < len(words):
            w = words[k]
            low = w.lower()
            if low == "unique":
                many = many and bool(columns)
            elif low == "xref":
                k += 1
                inverse = words[k]
            elif low in MODIFIERS:
                pass
            elif w.startswith("?") and low != "?text":
                columns.append(Column("object", w[1:]))
            elif w.startswith("#"):
                columns.append(Column("text"))
            elif low.lstrip("?") in TYPES:
                columns.append(Column(TYPES[low.lstrip("?")]))
            else:
                name, columns = w, []
            k += 1
        if name:
            current.append(Tag(name, columns or [Column("text")], "struct", name, many, inverse))
    return classes


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for seq, text in zip(pdf["seq"], pdf["value"]):
            # a line of white space divides paragraphs too
            facts = [r for block in _BLANK.split(text) for r in read_block(block)]
            rows += [(seq, i, *r) for i, r in enumerate(facts)]
        yield pd.DataFrame(rows, columns=["seq", "line", "op", "class", "name", "tag", "vals"])


def read_block(block: str) -> list[tuple]:
    """(op, class, name, tag, values) of one paragraph. op: object, value, and the edits
    drop, drop_tag, drop_value, rename."""
    lines = [x for x in block.splitlines() if x.strip() and not x.lstrip().startswith("//")]
    if not lines or lines[0].startswith("!!"):
        return []
    while lines and lines[0].startswith("!"):
        lines = lines[1:]
    out = []
    if lines and lines[0].startswith(">"):
        name, seq = None, []
        for x in [*lines, ">"]:
            if x.startswith(">"):
                if name:  # a sequence of that name refers to it
                    text = "".join(seq).lower()
                    out += [("object", "DNA", name, None, []), ("value", "DNA", name, "sequence", [text])]
                    out += [("object", "Sequence", name, None, []), ("value", "Sequence", name, "DNA", [name, str(len(text))])]
                name, seq = (x[1:].split() or [None])[0], []
            else:
                seq.append(x.strip())
        return out
    head = split_words(lines[0]) if lines else []
    if not head:
        return []
    edit = head[0].upper() if head[0].startswith("-") else ""
    if edit == "-D":
        return [("drop", head[1], head[-1], None, [])] if len(head) > 2 else []
    if edit == "-R":
        return [("rename", head[1], head[-2], None, [head[-1]])] if len(head) > 3 else []
    if edit:
        return []
    cls, name = head[0], next((w for w in head[1:] if w != ":"), None)
    if name is None:
        return []
    out.append(("object", cls, name, None, []))
    if cls.lower() in ("dna", "peptide", "longtext"):
        body = lines[1:]
        text = "\n".join(body) if cls.lower() == "longtext" else "".join(x.strip() for x in body)
        return [*out, ("value", cls, name, "sequence", [text])]
    for x in lines[1:]:
        if x.startswith("!"):
            continue
        words = split_words(x)
        stamps = [i for i, w in enumerate(words) if w == "-O"]
        for i in reversed(stamps):
            del words[i : i + 2]
        if "-C" in words:
            words = words[: words.index("-C")]
        if not words:
            continue
        if words[0] == "-D":
            if len(words) > 1:
                out.append(("drop_value" if len(words) > 2 else "drop_tag", cls, name, words[1], words[2:]))
        else:
            out.append(("value", cls, name, words[0], words[1:]))
    return out


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """seq, line, op, class, name, tag, vals of an object text file (gzip is unpacked)."""
    ship(spark)
    text = spark.read.option("lineSep", "\n\n").text(path).withColumn("seq", F.monotonically_increasing_id())
    return text.mapInPandas(_facts, "seq long, line int, op string, class string, name string, tag string, vals array<string>")


def load(spark: SparkSession, model_text: str, path: str, subclasses: dict[str, tuple[str, str]] | None = None, case_sensitive: tuple[str, ...] = ()) -> Model:
    """Read a model and its objects. Names are one object whatever their case (but for
    case-sensitive classes) and keep the first spelling; references make their object and
    the inverse reference; UNIQUE tags keep the last value; repeated values count once."""
    shape = parse_model(model_text)
    shape.setdefault("DNA", []).append(Tag("sequence", [Column("text")], "struct", "sequence", False))
    by = {c.lower(): c for c in shape}
    facts = read_facts(spark, path)
    facts = facts.withColumn("class", F.lower("class")).where(F.col("class").isin(list(by)))
    exact = F.col("class").isin([c.lower() for c in case_sensitive])
    fold = lambda c: F.when(exact, F.col(c)).otherwise(F.lower(c))
    facts = facts.withColumn("at", F.struct("seq", "line"))
    w = Window.partitionBy("class", "id")
    facts = facts.withColumn("id", fold("name"))
    renamed = facts.where("op = 'rename'").select("class", "id", F.element_at("vals", 1).alias("new"), F.col("at").alias("rat"))
    facts = facts.where("op <> 'rename'").join(renamed, ["class", "id"], "left").withColumn("name", F.when(F.col("rat") > F.col("at"), F.col("new")).otherwise(F.col("name"))).withColumn("id", fold("name")).drop("new", "rat")
    # what was said before the object was last dropped does not count
    facts = facts.withColumn("gone", F.max(F.when(F.col("op") == "drop", F.col("at"))).over(w)).where("op <> 'drop' and (gone is null or at > gone)").drop("gone")
    tags = [(c.lower(), t.name.lower(), t.name, len(t.columns), t.columns[0].cls.lower() if t.columns[0].cls else None, (t.inverse or "").lower() or None, t.many) for c, ts in shape.items() for t in ts]
    known = F.broadcast(spark.createDataFrame(tags, "class string, ltag string, tagname string, width int, ref string, inverse string, many boolean"))
    values = facts.where("op <> 'object'").withColumn("ltag", F.lower("tag")).join(known, ["class", "ltag"])
    k = Window.partitionBy("class", "id", "ltag")
    values = values.withColumn("cut", F.max(F.when(F.col("op") == "drop_tag", F.col("at"))).over(k)).where("op <> 'drop_tag' and (cut is null or at > cut)")
    line = Window.partitionBy("class", "id", "ltag", F.lower(F.array_join("vals", "\x1f")))
    values = values.withColumn("vcut", F.max(F.when(F.col("op") == "drop_value", F.col("at"))).over(line)).where("op <> 'drop_value' and (vcut is null or at > vcut)").drop("cut", "vcut", "op")
    mirrored = values.where("inverse is not null and size(vals) > 0").select(F.col("ref").alias("class"), F.element_at("vals", 1).alias("name"), F.col("inverse").alias("ltag"), F.array("name").alias("vals"), "at", F.col("id").alias("other"))
    exact_ref = F.col("class").isin([c.lower() for c in case_sensitive])
    mirrored = mirrored.withColumn("id", F.when(exact_ref, F.col("name")).otherwise(F.lower("name"))).where("id <> other").drop("other").join(known, ["class", "ltag"])
    both = values.select("class", "id", "name", "ltag", "vals", "at", "tagname", "width", "ref", "many").unionByName(mirrored.select("class", "id", "name", "ltag", "vals", "at", "tagname", "width", "ref", "many"))
    named = facts.select("class", "id", "name", "at").unionByName(both.select("class", "id", "name", "at"))
    referred = both.where("ref is not null and size(vals) > 0").select(F.col("ref").alias("class"), F.element_at("vals", 1).alias("name"), "at")
    referred = referred.withColumn("id", F.when(F.col("class").isin([c.lower() for c in case_sensitive]), F.col("name")).otherwise(F.lower("name")))
    names = named.unionByName(referred.select("class", "id", "name", "at")).groupBy("class", "id").agg(F.min_by("name", "at").alias("name")).cache()
    target = names.select(F.col("class").alias("ref"), F.col("id").alias("rid"), F.col("name").alias("rname"))
    rid = F.when(F.col("ref").isin([c.lower() for c in case_sensitive]), F.element_at("vals", 1)).otherwise(F.lower(F.element_at("vals", 1)))
    both = both.withColumn("first", F.when(F.size("vals") > 0, F.element_at("vals", 1))).withColumn("rid", F.when((F.size("vals") > 0) & F.col("ref").isNotNull(), rid)).join(target, ["ref", "rid"], "left")
    both = both.withColumn("vals", F.when(F.col("rname").isNotNull(), F.concat(F.array("rname"), F.slice("vals", F.lit(2), F.size("vals")))).otherwise(F.col("vals")))
    lines = both.groupBy("class", "id", "ltag", "many", F.col("vals")).agg(F.min("at").alias("a0"), F.max("at").alias("a1"))
    per = lines.groupBy("class", "id", "ltag", "many").agg(F.sort_array(F.collect_list(F.when(F.size("vals") > 0, F.struct("a0", "a1", "vals")))).alias("l"))
    per = per.withColumn("l", F.transform(F.when(F.col("many"), F.col("l")).otherwise(F.array_sort("l", lambda x, y: F.when(x["a1"] < y["a1"], -1).when(x["a1"] > y["a1"], 1).otherwise(0))), lambda x: x["vals"]))
    model = Model()
    for cls, ts in shape.items():
        ids = names.where(F.col("class") == cls.lower())
        mine = per.where(F.col("class") == cls.lower())
        cells = mine.groupBy("id").pivot("ltag", [t.name.lower() for t in ts]).agg(F.first("l")) if ts else mine.select("id").distinct()
        df = ids.join(cells, "id", "left").select("name", *[_tag_column(F.col(f"`{t.name.lower()}`"), t).alias(t.name) for t in ts]).cache()
        c = Class(cls, lambda df=df: df, "name", "text", case_sensitive=cls in case_sensitive)
        for t in ts:
            c.add(t)
        model.add(c)
    for name, (parent, condition) in (subclasses or {}).items():
        model.subclass(name, parent, condition)
    return model


def _tag_column(lines, tag: Tag):
    def field(v, k: int, col: Column):
        x = F.get(v, F.lit(k))
        if col.kind == "number":  # floats have seven significant digits
            return F.format_string("%.6e", x.try_cast("double")).try_cast("double")
        if col.kind == "date":
            y, m, d, rest = (F.regexp_extract(x, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?(?:[_ ](.*))?$", g) for g in (1, 2, 3, 4))
            two = lambda z: F.when(z != "", F.lpad(z, 2, "0"))
            return F.when(y != "", F.concat(F.concat_ws("-", y, two(m), two(d)), F.when(rest != "", F.concat(F.lit("_"), rest)).otherwise(F.lit(""))))
        return x

    rows = F.transform(lines, lambda v: F.struct(*[field(v, k, c).alias(f"c{k + 1}") for k, c in enumerate(tag.columns)]))
    if not tag.many:
        rows = F.when(F.size(rows) > 0, F.slice(rows, -1, 1)).otherwise(rows)
    return F.struct(lines.isNotNull().alias("present"), rows.alias("rows"))


def dump(model: Model, cls: str) -> DataFrame:
    """Object text of a class, one paragraph (`value`) an object."""
    c = model.get(cls)
    df = c.rows()
    quote = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.concat(F.lit(f"{c.name} : "), quote(F.col(f"`{c.key}`").cast("string")))]
    for t in c.tags.values():
        if t.stored == "inverse":
            continue
        if t.stored == "value":
            v = F.col(f"`{t.source}`").cast("string")
            parts.append(F.when(v.isNotNull(), F.concat(F.lit(f"{t.name} "), quote(v))))
            continue
        col = F.col(f"`{t.source}`")
        texts = F.transform(col["rows"], _line_of(t, quote))
        parts.append(F.when(col["present"], F.when(F.size(col["rows"]) > 0, F.array_join(texts, "\n")).otherwise(F.lit(t.name))))
    return df.select(F.concat_ws("\n", *parts).alias("value"))


def _line_of(t: Tag, quote):
    return lambda r: F.concat_ws(" ", F.lit(t.name), *[quote(r[f"c{k + 1}"].cast("string")) for k in range(len(t.columns))])


def check(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a constraint, and those put aside."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)
