"""Named queries of the text operators over the driver tables, with SQL where it can say them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import decontam, mixing, packing, periodic, pii, quality, secrets, setjoin, substring, suffix, topk, toxicity, whitening
from motionlake.llm.common import documents

QUERIES: dict = {}
ORACLES: dict = {}

W = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_mixing", rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{W}')), 0) AS BIGINT) size,
  md5(coalesce('i' || doc_id, 'n') || '|' || coalesce(md5(text), 'n') || '|' || coalesce('s' || source, 'n')) code,
  row_number() OVER (PARTITION BY doc_id, source, text) - 1 place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) ss FROM d GROUP BY 1),
w AS (SELECT source, ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 w FROM s),
c AS (SELECT *, CAST(sum(ss) OVER () - coalesce(sum(3 * ss) OVER b, 0) AS BIGINT) num,
  CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) den, row_number() OVER o k FROM w
  WINDOW o AS (ORDER BY CAST(ss AS DOUBLE) / w, source NULLS LAST), b AS (ORDER BY CAST(ss AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT num fn, den fd, k fk FROM c WHERE 3 * ss * den >= num * w ORDER BY k LIMIT 1),
t AS (SELECT source, ss, CASE WHEN k < fk THEN CAST(3 * ss AS DOUBLE) ELSE CAST(fn * w AS DOUBLE) / fd END target FROM c, f),
r AS (SELECT d.doc_id, d.size, t.ss source_size, t.target, CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0 END rate,
  CAST(('0x' || substr(md5('mix|' || code || '|' || place), 1, 13)) AS BIGINT) / 4503599627370496e0 u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) target,
  CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) copies, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) taken
FROM r""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


_ASSIGN = secrets.RULES[0][2].replace("'", "''")


def _spans(kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind: the text is cut at marks set around each match, gaps and matches in turn."""
    return rf"""SELECT doc_id, '{kind}' kind, {["assign", "access", "hex"].index(kind)} place, s + 0 s, s + length(piece) e FROM (
  SELECT doc_id, i, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) s
  FROM (SELECT doc_id, r, generate_subscripts(p, 1) i, unnest(p) piece FROM (
    SELECT doc_id, row_number() OVER () r, string_split(regexp_replace(translate(coalesce(text, ''), chr(1), chr(2)), '{pattern}', chr(1) || '\0' || chr(1), 'g'), chr(1)) p FROM documents)))
  WHERE i % 2 = 0 AND {keep}"""


@query("op5_secrets", rf"""
WITH sp AS ({_spans("assign", _ASSIGN, f"length(regexp_extract(piece, '{_ASSIGN}', 2)) >= 8")}
UNION ALL {_spans("access", "AKIA[A-Z0-9]+", "length(piece) >= 16")}
UNION ALL {_spans("hex", "[0-9a-f]+", "length(piece) >= 32")}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') a, count(*) FILTER (kind = 'access') b, count(*) FILTER (kind = 'hex') c,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) j FROM sp GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) n_assign, coalesce(b, 0) n_access, coalesce(c, 0) n_hex, sha256(coalesce(j, '')) base_sha256, coalesce(j, '') spans
FROM documents d LEFT JOIN g USING (doc_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), secrets.fresh_ledger(spark))
    spans = F.coalesce("_spans", F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return (found.select("doc_id", spans.alias("s")).select("doc_id", count("assign"), count("access"), count("hex"), joined.alias("spans"))
            .withColumn("base_sha256", F.sha2("spans", 256)))


_STOP = ", ".join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS))


@query("op7_quality", rf"""
WITH t AS (SELECT doc_id, row_number() OVER () r, coalesce(text, '') text FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{W}') w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{W}')) lines FROM t),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') g FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) i FROM w WHERE len(w) >= 8)),
g2 AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT j) n FROM (SELECT r, unnest(range(i, i + 8)) j FROM g2) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) n_exclaim, CAST(len(lines) AS BIGINT) n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) n_repeat_words,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) n_stop,
  CAST(len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) AS BIGINT) n_stutter
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM m)
SELECT *, NOT base_failed AND n_words >= 20 AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 20 AND n_symbols <= 0.1 * greatest(n_words, 1)
  AND n_exclaim <= 0.3 * greatest(n_words, 1) AND (n_words < 200 OR n_stop / n_words >= 0.005) AND n_dup_lines <= 0.5 * greatest(n_lines, 1)
  AND n_stutter <= 0.3 * greatest(n_words, 1) kept FROM b""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(documents(spark, sf_dir))


@query("op6_substring", rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) i FROM w WHERE len(w) >= 13)),
x AS (SELECT doc_id, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
r AS (SELECT doc_id, list(DISTINCT j) gone FROM (SELECT doc_id, unnest(range(i, i + 13)) j FROM x) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(len(gone), 0) AS BIGINT) n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE k.kept END, '')) kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) kept FROM (SELECT w.doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM w JOIN r USING (doc_id)) u
  WHERE NOT EXISTS (SELECT 1 FROM x v WHERE v.doc_id = u.doc_id AND u.i BETWEEN v.i AND v.i + 12) GROUP BY 1) k USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir))


@query("op9_suffix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(documents(spark, sf_dir))


@query("op10_setjoin", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) - 3 AS BIGINT), 2))) i FROM w WHERE len(w) >= 1))),
n AS MATERIALIZED (SELECT doc_id, CAST(count(*) AS BIGINT) n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT x.doc_id x, y.doc_id y FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n a ON a.doc_id = x.doc_id JOIN n b ON b.doc_id = y.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT doc_id id, doc_id c FROM documents UNION SELECT l.y, c.c FROM c JOIN l ON l.x = c.id WHERE c.c < l.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, CAST((SELECT min(c) FROM c WHERE c.id = w.doc_id) AS BIGINT) component_id FROM w LEFT JOIN n USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(documents(spark, sf_dir))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op3_topk", """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.vec_id query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INT) distance
  FROM q, embeddings e WHERE q.vec_id <> e.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, distance FROM d WINDOW w AS (PARTITION BY query_id ORDER BY distance, vec_id) QUALIFY row_number() OVER w <= 10""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_by_row(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


@query("op12_periodic", rf"""
WITH t AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '{W}') w, {_CRC} h FROM documents),
u AS (SELECT *, CAST(len(w) AS BIGINT) n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END a FROM t),
v AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) p FROM u),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END w FROM v),
x AS MATERIALIZED (SELECT r, unnest(w) x, generate_subscripts(w, 1) - 1 i FROM d),
g AS (SELECT r, q, unnest(range(0, n - q, q)) i FROM (SELECT r, n, unnest(range(1, n // 4 + 1)) q FROM d WHERE n >= 6)),
m AS MATERIALIZED (SELECT g.r, q, g.i FROM g JOIN x a ON a.r = g.r AND a.i = g.i JOIN x b ON b.r = g.r AND b.i = g.i + q WHERE a.x = b.x),
c AS (SELECT DISTINCT r, q FROM (SELECT r, q, i, lead(i, 2) OVER (PARTITION BY r, q ORDER BY i) z FROM m) WHERE z = i + 2 * q),
e AS (SELECT c.r, c.q, a.i, a.i - row_number() OVER (PARTITION BY c.r, c.q ORDER BY a.i) island FROM c JOIN x a ON a.r = c.r JOIN x b ON b.r = c.r AND b.i = a.i + c.q WHERE a.x = b.x),
f AS (SELECT r, q, min(i) s, count(*) + q len FROM e GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, s, len, min(q) q FROM f GROUP BY 1, 2, 3),
k AS (SELECT r, count(*) n, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) j FROM runs GROUP BY 1),
b AS (SELECT * FROM runs WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.r = runs.r AND (o.len * runs.q > runs.len * o.q OR (o.len * runs.q = runs.len * o.q AND (o.s < runs.s OR (o.s = runs.s AND o.q < runs.q)))))),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) t FROM x SEMI JOIN k USING (r) ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT doc_id, CAST(coalesce(k.n, 0) AS BIGINT) n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.len AS BIGINT) AS length, CAST(b.q AS BIGINT) period, CAST(1000 * b.len // b.q AS BIGINT) exponent_milli,
  sha256(coalesce(k.j, '')) runs_sha256, sha256(CASE WHEN k.r IS NULL THEN array_to_string(w, ' ') ELSE kept.t END) collapsed_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN b USING (r) LEFT JOIN kept USING (r)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return periodic.digest(periodic.find(docs.select("doc_id", periodic.looped(F.col("doc_id"), F.col("text")).alias("text"))))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op13_decontam", rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, regexp_extract_all({_LOW}, '{_TOKEN}') w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) k FROM (SELECT item_id, regexp_extract_all({_LOW}, '{_TOKEN}') w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
y AS MATERIALIZED (SELECT DISTINCT item_id, CAST(k AS BIGINT) k, array_to_string(w[i:i + k - 1], ' ') g FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) i FROM b)),
x AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') g FROM (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) i FROM d, (SELECT DISTINCT k FROM y) WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT r, i, k, item_id FROM x JOIN y USING (k, g)),
n AS (SELECT r, count(DISTINCT j) n FROM (SELECT r, unnest(range(i, i + k)) j FROM h) GROUP BY 1),
s AS (SELECT r, count(*) n, string_agg(v, ',' ORDER BY v) j FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) v FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n.n, 0) AS BIGINT) n_hit, CAST(coalesce(s.n, 0) AS BIGINT) n_items, sha256(coalesce(s.j, '')) items_sha256, coalesce(n.n, 0) > 0 contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
