"""The thin queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .host_reputation import SUFFIXES
from .shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .additive_ann import search

    return search(_table(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(_table(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


#: Verdict and rule (host and path), as the contract fixes them.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_reputation import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair

    return repair(damaged(_table(spark, sf_dir, "conversations")))


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: A-Z to lower case only, as SQL; the driver's SQL engine has no other use for it.
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT doc_id a, doc_id b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a doc_id, min(b) component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) n FROM i WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM sized)),
doc_windows AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) k FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) items FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


_OP8_FIT = " UNION ALL ".join(
    f"SELECT page_id, {len(r)} size, '{r}' rule, '{v}' verdict FROM u WHERE (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/'):]}')" for v, r in URL_RULES
)


_OP8_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)


def _op8_strength(key: str) -> str:
    between = "(spread - t * (b / t) * (b / t) - (k - 1) * (b / t) * (1 - b / t)) / (t - squares / t)"
    return f"""(SELECT CASE WHEN t > 0 AND k > 1 AND t > squares / t AND {between} > 0 THEN least(1000.0, greatest(1.0, (b / t) * (1 - b / t) / ({between}) - 1)) ELSE 1000.0 END FROM
      (SELECT sum(bad)::DOUBLE b, sum(n)::DOUBLE t, count(*) k, sum(n::DOUBLE * n) squares, sum(bad::DOUBLE * bad / n) spread FROM (SELECT sum(n) n, sum(bad) bad FROM leveled WHERE n > 0 GROUP BY {key})))"""


_OP8 = f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path FROM r),
fit AS ({_OP8_FIT}),
best AS (SELECT page_id, arg_max(rule, size) rule, arg_max(verdict, size) verdict FROM fit GROUP BY 1),
hosts AS (SELECT host, count(verdict) n, count(*) FILTER (verdict = 'block') bad FROM u LEFT JOIN best USING (page_id) GROUP BY 1),
leveled AS (SELECT *, CASE WHEN two IN ({_OP8_SUFFIXES}) THEN two ELSE regexp_extract(host, '[^.]*$') END suffix, CASE WHEN two IN ({_OP8_SUFFIXES}) THEN regexp_extract(host, '([^.]*[.]){{0,2}}[^.]*$') ELSE two END AS domain
  FROM (SELECT *, regexp_extract(host, '([^.]*[.])?[^.]*$') two FROM hosts)),
p AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) p0, {_op8_strength("suffix")} m1, {_op8_strength("domain")} m2, {_op8_strength("host")} m3 FROM leveled),
s AS (SELECT suffix, (sum(bad) + any_value(m1) * any_value(p0)) / (sum(n) + any_value(m1)) ps FROM leveled, p GROUP BY 1),
d AS (SELECT domain, (sum(bad) + any_value(m2) * any_value(ps)) / (sum(n) + any_value(m2)) pd FROM leveled JOIN s USING (suffix), p GROUP BY 1),
h AS (SELECT host, (bad + m3 * pd) / (n + m3) mean, n + m3 total FROM leveled JOIN d USING (domain), p)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN mean - 1.64 * sqrt(mean * (1 - mean) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) verdict
FROM u LEFT JOIN best USING (page_id) JOIN h USING (host)
"""


_OP13 = f"""
WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w FROM documents),
t AS (SELECT r, lang, source, unnest(w) term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) p FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) q FROM (SELECT lang, term, sum(n) n FROM cells GROUP BY 1, 2) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(x.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT m.lang, m.source, o.source item, sum((m.p - o.p) * (m.p - o.p) // (m.p + o.p)) f FROM p m JOIN p o ON m.lang = o.lang AND m.term = o.term AND m.source <> o.source GROUP BY 1, 2, 3) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' part, term item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": _OP2, "op5_winnowing": _OP5, "op8_host_reputation": _OP8, "op13_source_divergence": _OP13}
