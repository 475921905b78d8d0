"""The same base relations in both engines: records, candidate pairs, probabilities, truth."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import blocking, decision, features, models
from tessera.sources import fixtures

#: SQL common table expressions, each with those it builds on.
RECORDS = r"""
words AS (SELECT doc_id, lang, n_chars, list_filter(string_split_regex(regexp_replace(lower(text), '[^\x00-\x7F]', 'e', 'g'), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents),
drec AS MATERIALIZED (
  SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, 1 + doc_id % 3 AS source, lang AS country, doc_id,
    array_to_string(w[1:5], ' ') AS n_core, CASE WHEN doc_id % 7 = 0 THEN array_to_string(w[12:13], ' ') ELSE '' END AS n_alias,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ltd' WHEN 2 THEN 'ltd pvt' ELSE 'inc' END AS n_legal,
    CASE WHEN doc_id % 41 = 0 THEN 'domain' WHEN doc_id % 43 = 0 THEN 'handle' ELSE 'name' END AS n_kind,
    CASE WHEN doc_id % 37 = 0 THEN 'devanagari' ELSE 'latin' END AS n_script,
    CASE WHEN doc_id % 29 = 0 THEN '' ELSE array_to_string(w[6:11], ' ') END AS a_full,
    CASE WHEN doc_id % 29 = 0 THEN '' ELSE array_to_string(w[6:10], ' ') END AS a_street,
    CASE WHEN doc_id % 29 = 0 THEN '' ELSE CAST(n_chars % 1000 AS VARCHAR) END AS a_house,
    CASE WHEN doc_id % 29 = 0 THEN '' ELSE (n_chars % 1000) || ' 0' || (n_chars % 17) END AS a_numbers,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(10000 + n_chars % 50 AS VARCHAR) END AS a_postcode,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'st' || (n_chars % 4) END AS a_state,
    doc_id % 29 = 0 AS a_empty, replace(array_to_string(w[1:5], ' '), ' ', '') AS n_compact
  FROM words),
s1 AS (SELECT * FROM drec WHERE source = 1),
pool AS (SELECT * FROM drec WHERE source <> 1)"""


def tok(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def key(c: str) -> str:
    return f"array_to_string(list_sort({tok(c)}), ' ')"


CORE = f"core AS (SELECT entity_id, country, source, unnest(list_distinct(list_filter({tok('n_core')}, lambda t: length(t) >= 3))) AS t FROM drec), tdf AS (SELECT country, t, count(*) AS df FROM core WHERE source <> 1 GROUP BY ALL)"
STOP = ", ".join(f"'{w}'" for w in text.STREET_STOP)
KEYS = f"""{CORE}, rare AS (SELECT c.entity_id, c.country, c.source, c.t, row_number() OVER (PARTITION BY c.country, c.entity_id ORDER BY coalesce(f.df, 0), c.t) AS r FROM core c LEFT JOIN tdf f ON f.country = c.country AND f.t = c.t),
keys AS MATERIALIZED (
 SELECT DISTINCT entity_id, country, source, 'A' AS kt, a_house || '|' || t AS key FROM (SELECT entity_id, country, source, a_house, unnest({tok('a_street')}) AS t FROM drec WHERE a_house <> '') WHERE length(t) >= 4 AND t NOT IN ({STOP})
 UNION SELECT entity_id, country, source, 'N1', t FROM rare WHERE r = 1
 UNION SELECT entity_id, country, source, 'N2', string_agg(t, '|' ORDER BY t) FROM rare WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2
 UNION SELECT entity_id, country, source, 'C', substr(n_compact, 1, 10) FROM drec WHERE length(n_compact) >= 6
 UNION SELECT entity_id, country, source, 'C', substr(replace(n_alias, ' ', ''), 1, 10) FROM drec WHERE length(n_alias) >= 6),
caps(kt, cap, bit) AS (VALUES ('A', 150, 1), ('N1', 200, 2), ('N2', 100, 4), ('C', 60, 8)),
capped AS (SELECT k.* FROM keys k JOIN (SELECT country, kt, key, count(*) AS n FROM keys WHERE source <> 1 GROUP BY ALL) g ON g.country = k.country AND g.kt = k.kt AND g.key = k.key JOIN caps c ON c.kt = k.kt WHERE k.source <> 1 AND g.n <= c.cap)"""
STREET = f"array_to_string(list_sort(list_distinct(list_filter({tok('a_street')}, lambda t: length(t) >= 3 AND t NOT IN ({STOP})))), ' ')"
HS = f"CASE WHEN ltrim(a_house, '0') <> '' AND {STREET} <> '' THEN ltrim(a_house, '0') || '|' || {STREET} ELSE '' END"


def skeleton_sql() -> str:
    s = "regexp_replace(lower(n_core), '[^a-z ]', '', 'g')"
    for a, b in text.SKELETON_SUBSTITUTIONS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"array_to_string((list_filter(string_split(regexp_replace({s}, '[aeiouy]', '', 'g'), ' '), lambda t: t <> ''))[1:2], '|')"
    for ch in text.SKELETON_LETTERS:
        s = f"regexp_replace({s}, '{ch}+', '{ch}', 'g')"
    return s


def branch(name: str, expr: str, cap: int, least: int, bit: int, where: str = "true") -> str:
    """A common table expression of a capped single-key retriever."""
    return f"""{name} AS (WITH k AS (SELECT entity_id, country, source, {expr} AS key FROM drec WHERE {where}), g AS (SELECT country, key FROM k WHERE source <> 1 AND length(key) >= {least} GROUP BY ALL HAVING count(*) <= {cap})
SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id, {bit} AS bit FROM k a JOIN k b ON b.country = a.country AND b.key = a.key JOIN g ON g.country = b.country AND g.key = b.key WHERE a.source = 1 AND b.source <> 1)"""


NAME_NUMBERS = f"""SELECT DISTINCT entity_id, country, source, nk || '|' || num AS key FROM (SELECT entity_id, country, source, array_to_string(list_sort(list_distinct({tok('n_core')})), ' ') AS nk, unnest(list_distinct(list_filter(list_transform(string_split(regexp_replace(a_numbers, '[/-]', ' ', 'g'), ' '), lambda t: ltrim(t, '0')), lambda t: t <> ''))) AS num FROM drec) WHERE nk <> ''"""
#: All exact-key retrievers at their own caps: base has the pairs with their bits, b_keys the typed keys' masks.
BASE = f"""{KEYS},
b_keys AS (SELECT q.entity_id AS s1_id, p.entity_id AS cand_id, bit_or(c.bit) AS kmask FROM keys q JOIN capped p ON p.country = q.country AND p.kt = q.kt AND p.key = q.key JOIN caps c ON c.kt = q.kt WHERE q.source = 1 GROUP BY ALL),
{branch("b_akey", key("a_full"), 100, 1, 8)}, {branch("b_hskey", HS, 100, 1, 16)}, {branch("b_skel", skeleton_sql(), 100, 4, 64)}, {branch("b_empty", key("n_core"), 300, 3, 256, "source = 1 OR a_empty")},
b_num AS (WITH k AS ({NAME_NUMBERS}), g AS (SELECT country, key FROM k WHERE source <> 1 GROUP BY ALL HAVING count(*) <= 50)
 SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id, 512 AS bit FROM k a JOIN k b ON b.country = a.country AND b.key = a.key JOIN g ON g.country = b.country AND g.key = b.key WHERE a.source = 1 AND b.source <> 1),
base AS MATERIALIZED (SELECT s1_id, cand_id, bit_or(bit) AS rbits FROM (SELECT s1_id, cand_id, 1 AS bit FROM b_keys UNION ALL SELECT * FROM b_akey UNION ALL SELECT * FROM b_hskey UNION ALL SELECT * FROM b_skel UNION ALL SELECT * FROM b_empty UNION ALL SELECT * FROM b_num) GROUP BY ALL)"""
PAIRS = (
    RECORDS
    + f""", {BASE},
pairs AS MATERIALIZED (
  SELECT s.entity_id AS s1_id, p.entity_id AS cand_id, s.country, p.country AS country_c, p.source AS source_c,
    {", ".join(f"s.{c} AS {c}, p.{c} AS {c}_c" for c in features.COLUMNS)}
  FROM base JOIN s1 s ON s.entity_id = base.s1_id JOIN pool p ON p.entity_id = base.cand_id),
near AS (SELECT *, 100 * (1 - levenshtein(n_core, n_core_c) / CAST(greatest(length(n_core), length(n_core_c), 1) AS DOUBLE)) AS name_sim,
    100 * (1 - levenshtein(a_full, a_full_c) / CAST(greatest(length(a_full), length(a_full_c), 1) AS DOUBLE)) AS addr_sim FROM pairs),
preds AS (SELECT s1_id, cand_id, round(0.7 * (1 - levenshtein(n_core, n_core_c) / CAST(greatest(length(n_core), length(n_core_c), 1) AS DOUBLE)) + CASE WHEN a_house = a_house_c AND a_house <> '' THEN 0.3 ELSE 0 END, 6) AS prob FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS r, lead(prob) OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS nxt FROM preds),
assigned AS (SELECT s1_id, cand_id, prob, prob - coalesce(nxt, 0) AS margin FROM ranked WHERE r = 1),
spine AS (SELECT entity_id AS s1_id, country FROM s1),
truth AS (SELECT q.s1_id, p.entity_id AS match_id FROM pool p JOIN (SELECT country, n_core, min(entity_id) AS s1_id FROM s1 WHERE n_core <> '' GROUP BY ALL) q ON p.country = q.country AND p.n_core = q.n_core),
ntrue AS (SELECT s.s1_id, s.country, count(t.match_id) AS n_true FROM spine s LEFT JOIN truth t ON t.s1_id = s.s1_id GROUP BY ALL)"""
)

F05 = "CASE WHEN {t} = 0 AND {p} = 0 THEN 1.0 WHEN {t} = 0 OR {p} = 0 OR {tp} = 0 THEN 0.0 ELSE 1.25 * ({tp} / CAST({p} AS DOUBLE)) * ({tp} / CAST({t} AS DOUBLE)) / (0.25 * ({tp} / CAST({p} AS DOUBLE)) + ({tp} / CAST({t} AS DOUBLE))) END"


def f05_sql(tp: str, t: str, p: str) -> str:
    return F05.format(tp=tp, t=t, p=p)


#: Scores of every S1 when assigned pairs of probability 0.5 or more are matches.
SCORES = PAIRS + f""",
pred AS (SELECT s1_id, cand_id AS match_id FROM assigned WHERE prob >= 0.5),
hits AS (SELECT p.s1_id, count(*) AS n_pred, count(t.match_id) AS tp FROM pred p LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.match_id = p.match_id GROUP BY ALL),
scores AS (SELECT n.s1_id, n.country, n.n_true, coalesce(h.n_pred, 0) AS n_pred, coalesce(h.tp, 0) AS tp, coalesce(h.n_pred, 0) - coalesce(h.tp, 0) AS fp, n.n_true - coalesce(h.tp, 0) AS fn,
    {f05_sql("coalesce(h.tp, 0)", "n.n_true", "coalesce(h.n_pred, 0)")} AS f05 FROM ntrue n LEFT JOIN hits h ON h.s1_id = n.s1_id)"""


class Views:
    """The base relations over one folder of tables; base pairs are those of all exact-key retrievers at their own caps."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.records = fixtures.drec(spark, sf_dir).persist()  # the normalized records, read by every retriever
        self.s1, self.pool = fixtures.split(self.records)
        self.spine = self.s1.select(F.col("entity_id").alias("s1_id"), "country")
        self.truth = fixtures.loose_truth(self.records)

    @cached_property
    def candidates(self) -> DataFrame:
        return blocking.candidates(self.s1, self.pool).select("s1_id", "cand_id").persist()

    @property
    def pairs(self) -> DataFrame:
        """Pairs with both sides' columns, and edit similarities of name and address on the scale of 100."""
        sim = lambda a, b: 100 * (1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)))
        out = features.attach(self.candidates, self.s1, self.pool)
        return out.withColumns({"name_sim": sim("n_core", "n_core_c"), "addr_sim": sim("a_full", "a_full_c")})

    @property
    def preds(self) -> DataFrame:
        return models.placeholder(self.pairs).select("s1_id", "cand_id", "prob")

    @property
    def assigned(self) -> DataFrame:
        return decision.assign_best(self.preds)

    @property
    def matches(self) -> DataFrame:
        return decision.threshold(self.assigned, 0.5)
