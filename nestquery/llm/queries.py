"""Thin queries over the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, license_scan, mixing_tree, pq_dedup, quality_mcd, secret_markov, sentencepiece_bpe, simhash_gph, shard_maglev, url_filter
from .common import table


def op1_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: (host, path, action)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    out = url_filter.judge(table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


HARD_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    hard = spark.createDataFrame(
        [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string"
    )
    turns = turns.unionByName(hard).withColumn("parts", chat_format.text_part(F.col("text")))
    read = chat_format.read_back(chat_format.format_chats(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


SHARDS = [f"shard-{i:02d}" for i in range(24)]


def op8_shard_maglev(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return shard_maglev.place(docs, F.col("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op5_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mcd.judge(docs, keep=["doc_id"]).select("doc_id", *quality_mcd.STATS, "base_failed", "kept")


def op7_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_markov.scan(docs).select("doc_id", "spans")
    count = lambda k: F.size(secret_markov.of_kind(F.col("spans"), k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_markov.as_text(secret_markov.of_kind(F.col("spans"), 0, 1, 2)), 256).alias("base_sha256"),
        secret_markov.as_text(F.col("spans")).alias("spans"),
    )


def op9_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken by the copies in the blocks that the shards drew."""
    out = mixing_tree.taken(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_gph.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_bpe.encode_decode(docs, drop_text=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_pq_dedup": op1_pq_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_quality_mcd": op5_quality_mcd,
    "op7_secret_markov": op7_secret_markov,
    "op8_shard_maglev": op8_shard_maglev,
    "op9_mixing_tree": op9_mixing_tree,
    "op6_simhash": op6_simhash,
    "op10_sentencepiece": op10_sentencepiece,
}

WORDS_SQL = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size,
                  md5('mix:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w,
             CAST(3 * source_size AS DOUBLE) AS cap FROM s),
v AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (total - before) / rest AS level FROM v),
f AS (SELECT min(cap / w) AS first FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min(level) FROM l, f WHERE level * w <= cap AND cap / w = first) * w, cap)) AS target FROM l),
u AS (SELECT source, k, sum(size) AS unit FROM d GROUP BY source, k),
a AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY k) - unit AS ahead FROM u)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * least(3, e + CASE WHEN a.ahead + a.unit / 2.0 < t.target - e * t.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS e FROM t) t ON d.source IS NOT DISTINCT FROM t.source
JOIN a ON a.source IS NOT DISTINCT FROM d.source AND a.k = d.k
"""

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS x, a AS y FROM p UNION SELECT r.x, p.b FROM r JOIN p ON p.a = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(y, vec_id) AS component_id,
       vec_id = coalesce(y, vec_id) AS kept
FROM embeddings LEFT JOIN c ON x = vec_id LEFT JOIN n ON a = vec_id
"""


def _plain_sql(path: str) -> str:
    kept = (
        f"list_reduce(list_concat([''], string_split({path}, '/')[2:]), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '')"
        f" WHEN x = '.' THEN a ELSE a || '/' || x END) || CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END"
    )
    return f"CASE WHEN contains({path}, '/.') THEN {kept} ELSE {path} END"


def _url_sql(url: str) -> tuple[str, str, str]:
    """Host, path and query of a url expression."""
    rest = f"substr({url}, instr({url}, '://') + 3)"
    has = f"coalesce(contains({url}, '://'), false)"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1)"
    return f"CASE WHEN {has} THEN {host} ELSE '' END", f"CASE WHEN {has} THEN {path} ELSE '' END", f"CASE WHEN {has} THEN {query} END"


def _op2_sql() -> str:
    q = lambda x: x.replace("'", "''")
    h, p, k = _url_sql("url")
    th, tp, tk = _url_sql("t")
    alias = lambda host, path, plain, query: f"{host} || CASE WHEN {path} = '' THEN '/' ELSE {plain} END || {query}"
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    link = lambda tag, inner: f"list_transform(regexp_extract_all(coalesce(html, ''), '{q(tag)}'), lambda g: regexp_extract(g, '{q(inner)}', 1))"
    here = "CASE WHEN path = '' THEN '/' ELSE path END"
    return f"""
WITH RECURSIVE rules(rh, rp, action) AS (VALUES {rules}),
p0 AS (SELECT page_id, {h} AS host, {p} AS path, {k} AS query, html FROM pages),
p AS (SELECT page_id, host, path, {alias("host", "path", _plain_sql("path"), "query")} AS alias, html FROM p0),
l AS (SELECT host, path, alias, regexp_replace(l, '{url_filter.AMPERSAND}', '&', 'g') AS l FROM
        (SELECT host, path, alias, unnest(list_concat({link(url_filter.CANONICAL, url_filter.HREF)}, {link(url_filter.REFRESH, url_filter.GOAL)})) AS l FROM p WHERE alias IS NOT NULL)),
r AS (SELECT host, path, alias, CASE WHEN l = '' OR l[1] = '#' THEN NULL WHEN regexp_matches(l, '{url_filter.SCHEME}//') THEN l
        WHEN regexp_matches(l, '{url_filter.SCHEME}') THEN NULL WHEN starts_with(l, '//') THEN 'http:' || l
        WHEN starts_with(l, '/') THEN 'http://' || host || l WHEN starts_with(l, '?') THEN 'http://' || host || {here} || l
        ELSE 'http://' || host || regexp_replace({here}, '[^/]*$', '') || l END AS t FROM l),
e0 AS (SELECT DISTINCT host, path, alias, {th} AS th, {tp} AS tp, {tk} AS tk FROM r WHERE t IS NOT NULL),
e AS (SELECT host, path, alias, th, CASE WHEN tp = '' THEN tp ELSE {_plain_sql("tp")} END AS tp, {alias("th", "tp", _plain_sql("tp"), "tk")} AS ta FROM e0),
g AS (SELECT alias AS a, ta AS b FROM e WHERE ta IS NOT NULL UNION SELECT ta, alias FROM e WHERE ta IS NOT NULL),
c AS (SELECT a AS x, a AS y FROM g UNION SELECT c.x, g.b FROM c JOIN g ON g.a = c.y),
n AS (SELECT host, path, alias FROM p UNION SELECT th, tp, ta FROM e),
d AS (SELECT host, path, rh || rp AS rule, action, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rh || rp DESC, action DESC) AS k
      FROM (SELECT DISTINCT host, path FROM n) n JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
m AS (SELECT x, max(action = 'block') AS b, max(action = 'allow') AS a FROM c JOIN n ON n.alias = c.y JOIN d ON d.host = n.host AND d.path = n.path AND k = 1 GROUP BY x)
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN m.b AND NOT m.a THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN d ON d.host = p.host AND d.path = p.path AND k = 1 LEFT JOIN m ON m.x = p.alias
"""


OP3_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{HARD_TEXT}'), (-7, 1, 'assistant', '{HARD_TEXT}')),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\\[|\\\\]')) + length(role) + len(regexp_extract_all(role, '[<\\[|\\\\]')) + 8 AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g
"""


def _op4_sql() -> str:
    q = lambda x: x.replace("'", "''")

    def lines(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), '{q(license_scan.COPYRIGHT_LINE)}', '', 'g')"
        for a, b in license_scan.SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(regexp_replace(s, '{q(license_scan.GAP)}', ' ', 'g'))), lambda s: s <> '')"

    whole = lambda x: f"regexp_replace(array_to_string({x}, ' '), '{license_scan.HOLDER}', '{license_scan.ANY_HOLDER}', 'g')"
    known = ", ".join(f"('{a}', '{q(t)}')" for a, t in license_scan.KNOWN)
    digests = ", ".join(f"('{a}', '{d}')" for a, d in license_scan.DIGESTS)
    return f"""
WITH k AS (SELECT kd, min(l) AS l FROM (SELECT md5({whole(lines("t"))}) AS kd, l FROM (VALUES {known}) k(l, t) UNION ALL SELECT d, l FROM (VALUES {digests}) v(l, d)) GROUP BY kd),
d0 AS (SELECT doc_id, {lines("text")} AS s FROM documents), d AS (SELECT doc_id, s, {whole("s")} AS c FROM d0),
n AS (SELECT doc_id, string_agg(DISTINCT l, ',' ORDER BY l) AS notices FROM (SELECT doc_id, unnest(s) AS s FROM d) JOIN k ON kd = md5(s) GROUP BY doc_id)
SELECT doc_id, CASE WHEN c <> '' THEN md5(c) END AS digest, l AS license, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON kd = md5(c) AND c <> '' LEFT JOIN n USING (doc_id)
"""


def _op8_sql() -> str:
    slots = ", ".join(map(str, shard_maglev.lookup_table(SHARDS).tolist()))
    return f"""
WITH d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {shard_maglev.SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, printf('shard-%02d', [{slots}][slot + 1]) AS shard FROM d
"""


ORACLES: dict[str, str] = {
    "op1_pq_dedup": OP1_SQL,
    "op2_url_filter": _op2_sql(),
    "op3_chat_format": OP3_SQL,
    "op4_license_scan": _op4_sql(),
    "op8_shard_maglev": _op8_sql(),
    "op9_mixing_tree": OP9_SQL,
}
