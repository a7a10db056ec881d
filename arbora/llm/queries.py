"""The registered queries of the training-data operators, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, mixing, neardup, pii, resharding, simhash, suffix_tree, toxicity, url_filter
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=0.8)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_near_counts(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_sharding, op4_decontamination, op5_minhash_near_dedup, op6_url_filter, op7_suffix_tree, op8_simhash, op9_pii, op10_html_text)}
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op5_minhash_near_dedup": f"""
with recursive w as (select doc_id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) s from w),
n as (select w.doc_id, count(s.s) n from w left join s on s.doc_id = w.doc_id group by 1),
l as (select a.doc_id a, b.doc_id b from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
    having 100 * count(*) >= 80 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))),
e as (select a, b from l union select b, a from l),
r(x, y) as (select a, b from e union select r.x, e.b from r join e on e.a = r.y),
c as (select x, min(y) m from r group by 1)
select n.doc_id, n.n n_shingles, least(n.doc_id, coalesce(c.m, n.doc_id)) component_id, n.doc_id <= coalesce(c.m, n.doc_id) kept from n left join c on c.x = n.doc_id""",
    "op6_url_filter": r"""
with recursive u as (select page_id, url, html, case when url like '%://%' then substring(url, strpos(url, '://') + 3) else '' end a from pages),
p as (select page_id, url, html, FOLD(regexp_extract(a, '^([^/?#]*)', 1)) host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(a, '^[^/?#]*([^#]*)', 1) tail from u),
k as (select url, host, path, unnest([regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1)]) link, host || tail node from p where url like '%://%'),
t as (select node u, case when link like '%://%' then link when link like '//%' then 'http:' || link when link like '/%' then 'http://' || host || link
    else 'http://' || host || regexp_replace(path, '[^/]*$', '') || link end v from (select * replace (replace(link, '&amp;', '&') as link) from k where link <> '')),
e0 as (select u, FOLD(regexp_extract(substring(v, strpos(v, '://') + 3), '^([^/?#]*)', 1)) || regexp_extract(substring(v, strpos(v, '://') + 3), '^[^/?#]*([^#]*)', 1) v from t),
e as (select u, v from e0 where u <> v union select v, u from e0 where u <> v),
r(x, y) as (select u, v from e union select u, u from e union select r.x, e.v from r join e on e.u = r.y),
said as (select y, RULE(regexp_extract(y, '^([^/?#]*)', 1), regexp_extract(y, '^[^/?#]*([^?#]*)', 1)) rule from (select distinct y from r)),
f as (select x from r join said using (y) group by x having bool_or(coalesce(rule in ('com/en/', 'net/de/', 'example.net/de/8', 'org/es/'), false)) and not bool_or(coalesce(rule = 'example.com/en/7', false))),
j as (select *, RULE(host, path) rule from p)
select page_id, coalesce(host, '') host, coalesce(path, '') path, rule, case when rule in ('com/en/', 'net/de/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow'
    when exists (select 1 from f where f.x = host || tail) then 'block' else 'allow' end verdict from j""",
}


def _rule(host: str, path: str) -> str:
    fits = lambda h, p: f"(({host}) = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    return "case " + " ".join(f"when {fits(h, p)} then '{h + p}'" for h, p, _ in rules) + " end"


def _expand(sql: str) -> str:
    """FOLD(x) and RULE(host, path) written out; their arguments hold balanced brackets."""
    for name in ("FOLD(", "RULE("):
        while (at := sql.find(name)) >= 0:
            depth, end, cuts, quote = 1, at + len(name), [], False
            while depth:
                c = sql[end]
                quote ^= c == "'"
                if not quote:
                    depth += (c == "(") - (c == ")")
                    if c == "," and depth == 1:
                        cuts.append(end)
                end += 1
            inner = sql[at + len(name) : end - 1]
            if name == "FOLD(":
                new = _FOLD.format(inner)
            else:
                k = cuts[0] - at - len(name)
                new = _rule(inner[:k].strip(), inner[k + 1 :].strip())
            sql = sql[:at] + new + sql[end:]
    return sql


ORACLE["op6_url_filter"] = _expand(ORACLE["op6_url_filter"])
