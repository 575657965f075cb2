"""Exact duplicates, linkage, ontologies, and vector near-duplicates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import quantized
from ..functions.text import OTHER, field_name, keyword_family, plain_text, private_paths
from ..operators import dedupe as dd
from .base import rounded, table


def _members(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    return dd.exact_groups(docs, "doc_id", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def exact_groups(spark, d):
    return _members(spark, d).select("doc_id", "digest", "group_size", F.col("least").alias("group_key"))


MEM = """dg AS (SELECT doc_id, source, lang, sha256(text) AS digest FROM documents),
mem AS (SELECT *, count(*) OVER (PARTITION BY digest) AS group_size, min(doc_id) OVER (PARTITION BY digest) AS group_key FROM dg QUALIFY group_size > 1)"""
EXACT_GROUPS = f"WITH {MEM} SELECT doc_id, digest, group_size, group_key FROM mem"


def dedupe_resolve(spark, d):
    return dd.resolved(_members(spark, d), "doc_id", "source", "lang").select("doc_id", "decision", "action", "reason")


_RES = """res AS (SELECT *, CASE WHEN min(u) OVER w <> max(u) OVER w THEN 'exclude_all_cross_user_identity_conflict' WHEN min(f) OVER w <> max(f) OVER w THEN 'exclude_all_sport_family_conflict'
  ELSE 'keep_one_within_user_family_consistent' END AS decision, k = min(k) OVER w AS canonical FROM m WINDOW w AS (PARTITION BY digest)),
out AS (SELECT k, decision, CASE WHEN decision LIKE 'keep%' AND canonical THEN 'keep_canonical' ELSE 'exclude' END AS action,
  CASE WHEN decision LIKE '%cross_user%' THEN 'exact_signal_duplicate_across_users' WHEN decision LIKE '%family_conflict' THEN 'exact_signal_duplicate_with_family_conflict'
    WHEN canonical THEN 'first_deterministic_key_within_user_and_family' ELSE 'redundant_exact_duplicate_of_kept_canonical' END AS reason FROM res)"""
DEDUPE_RESOLVE = f"WITH {MEM}, m AS (SELECT doc_id AS k, source AS u, lang AS f, digest FROM mem), {_RES} SELECT k AS doc_id, decision, action, reason FROM out"


def exact_signal(spark, d):
    """Lines with equal signal fields; users are suppliers modulo 3, so all branches of the policy occur."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_suppkey", "l_extendedprice").distinct()
    keyed = lines.withColumn(
        "key", F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.format_string("%.2f", "l_extendedprice")))
    digest = F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")).cast("binary"), 256)
    groups = dd.exact_groups(keyed.withColumn("user", F.col("l_suppkey") % 3), "key", digest)
    return dd.resolved(groups, "key", "user", "l_returnflag").groupBy("decision", "action", "reason").agg(F.count("*").alias("n"))


EXACT_SIGNAL = f"""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_suppkey, l_extendedprice FROM lineitem),
k AS (SELECT *, concat_ws('-', l_orderkey, l_partkey, l_linenumber, l_suppkey, printf('%.2f', l_extendedprice)) AS k, l_suppkey % 3 AS u, l_returnflag AS f,
  sha256(concat_ws('|', l_partkey, l_quantity::INT)) AS digest FROM l),
m AS (SELECT k, u, f, digest FROM k QUALIFY count(*) OVER (PARTITION BY digest) > 1), {_RES}
SELECT decision, action, reason, count(*) AS n FROM out GROUP BY ALL"""


def _labels(spark, d):
    p = table(spark, d, "part")
    label = F.concat_ws(" ", F.element_at(F.array(F.lit("Trail Run"), F.lit("swim"), F.lit("Virtualride"), F.lit("road"), F.lit("Natación"), F.lit("<missing>"), F.lit("MTB"), F.lit("yoga")),
                                          (F.col("p_partkey") % 8 + 1).cast("int")), F.when(F.col("p_size") % 5 == 0, F.lower("p_type")))
    return p.select("p_partkey", "p_size", "p_brand", label.alias("label"))


LABELS = """lb AS (SELECT p_partkey, p_size, p_brand, concat_ws(' ', ['Trail Run', 'swim', 'Virtualride', 'road', 'Natación', '<missing>', 'MTB', 'yoga'][(p_partkey % 8 + 1)::INT],
  CASE WHEN p_size % 5 = 0 THEN lower(p_type) END) AS label FROM part)"""


def _family_sql(label: str) -> str:
    from ..functions.text import FAMILIES, WHOLE_LABELS

    text = f"strip_accents(lower({label}))"
    cases = " ".join(f"WHEN regexp_matches({text}, '{'|'.join(words)}') THEN '{family}'" for family, words in FAMILIES.items())
    whole = " ".join(f"WHEN trim({text}) = '{k}' THEN '{v}'" for k, v in WHOLE_LABELS.items())
    return f"CASE WHEN {label} IS NULL OR {label} = '<missing>' OR trim({text}) = '' THEN '{OTHER}' {cases} {whole} ELSE '{OTHER}' END"


def keyword_families(spark, d):
    return _labels(spark, d).select("p_partkey", keyword_family(F.col("label")).alias("family"))


KEYWORD_FAMILY = f"WITH {LABELS} SELECT p_partkey, {_family_sql('label')} AS family FROM lb"


def ontology_support(spark, d):
    x = _labels(spark, d).withColumn("family", keyword_family(F.col("label")))
    return x.groupBy("label", "family").agg(F.count("*").alias("records"), F.countDistinct("p_brand").alias("users")).select(
        "*", plain_text(F.col("label")).alias("normalized"))


ONTOLOGY_SUPPORT = f"WITH {LABELS} SELECT label, {_family_sql('label')} AS family, count(*) AS records, count(DISTINCT p_brand) AS users, strip_accents(lower(label)) AS normalized FROM lb GROUP BY label"


def ontology_remap(spark, d):
    x = _labels(spark, d).withColumn("family", keyword_family(F.col("label")))
    eligible = (F.col("p_size") >= 10) & (F.col("family") != OTHER)
    return x.groupBy("family").agg(F.sum(eligible.cast("long")).alias("eligible"), F.count("*").alias("n"))


ONTOLOGY_REMAP = f"WITH {LABELS}, f AS (SELECT *, {_family_sql('label')} AS family FROM lb) SELECT family, count(*) FILTER (p_size >= 10 AND family <> '{OTHER}') AS eligible, count(*) AS n FROM f GROUP BY ALL"


def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(plain_text(F.col("text")).cast("binary"), 256).alias("digest"))


NORMALIZE_TEXT = "SELECT doc_id, sha256(strip_accents(lower(text))) AS digest FROM documents"


def band_link(spark, d):
    """Orders as files in local time; a ride is the same moment less a whole number of quarter hours."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("file"), F.col("o_orderdate").alias("local"))
    rides = o.where("file % 7 <> 0").select(
        "user", F.col("file").alias("ride"),
        F.timestamp_micros(F.unix_micros(F.col("local").cast("timestamp")) - (F.pmod("file", F.lit(57)) - 28).cast("long") * 900_000_000).alias("utc"))
    return dd.linked_by_offset(o, rides, "user", "file", "local", "ride", "utc").withColumnRenamed("file", "file_key")


BAND_LINK = """WITH o AS (SELECT o_custkey AS u, o_orderkey AS f, epoch_us(o_orderdate::TIMESTAMP) AS t FROM orders),
rd AS (SELECT u, f AS ride, t - (f % 57 - 28) * 900000000 AS utc FROM o WHERE f % 7 <> 0),
tr AS (SELECT u, ride, off, utc + off * 60000000 AS t FROM rd, (SELECT unnest(range(-840, 841, 15)) AS off)),
tm AS (SELECT u, t, count(*) AS same FROM o GROUP BY ALL),
h AS (SELECT tr.*, count(*) OVER (PARTITION BY u, ride) AS hits FROM tr JOIN tm USING (u, t)),
pt AS (SELECT u, t, bool_or(hits > 1) AS amb, count(*) FILTER (hits = 1) AS single, max(ride) FILTER (hits = 1) AS ride, arg_max(off, ride) FILTER (hits = 1) AS off FROM h GROUP BY ALL),
s AS (SELECT o.u, o.f, ride, off, CASE WHEN same > 1 THEN 'duplicate_csv_timestamp' WHEN amb THEN 'ambiguous_timestamp_match' WHEN single = 1 THEN 'linked'
  WHEN single > 1 THEN 'duplicate_metadata_match' ELSE 'unmatched_timestamp' END AS status FROM o JOIN tm USING (u, t) LEFT JOIN pt USING (u, t))
SELECT u AS "user", f AS file_key, status, CASE WHEN status = 'linked' THEN ride END AS ride, CASE WHEN status = 'linked' THEN off::INT END AS "offset" FROM s"""

TABLES, BITS, POINTS = 12, 24, 48
PLANES = np.round(dd.projections(POINTS, TABLES, BITS), 6)
#: Limits of the prefilter on profiles, and of the verification (fixed values).
PREFILTER = {"mae": 4.0, "p95": 8.0, "r": 0.98}
LIMITS = {"mae": 2.0, "p95": 4.0, "r": 0.99, "speed_mae": 1.5, "speed_r": 0.98, "altitude_mae": 5.0, "altitude_r": 0.98}
SPAN_LIMIT = 0.05


def _sides(spark, d):
    """Vectors as signals of two sources: the second repeats the first's with noise on some, other spans, other ids."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: 120 + 40 * x).alias("v"))
    e = e.withColumn("v", F.when(F.size("v") == 64, F.col("v")))
    left = e.select("vec_id", "v", (200 + F.col("vec_id") % 40).alias("span"))
    noise = F.transform("v", lambda x, i: x + F.when(F.col("vec_id") % 3 == 0, 0).when(F.col("vec_id") % 3 == 1, (F.col("vec_id") * 31 + i * 17) % 7 - 3).otherwise((F.col("vec_id") * 31 + i * 17) % 13 - 6) * 0.6)
    right = e.select("vec_id", noise.alias("v"), ((200 + F.col("vec_id") % 40) * (1 + F.col("vec_id") % 4 * 0.02)).alias("span"))
    return left, right


def _signed(df):
    from ..operators.profiles import resampled

    return dd.signatures(df.withColumn("p", resampled(F.col("v"), POINTS)), "vec_id", "p", PLANES, BITS, "span")


def lsh_signatures(spark, d):
    return _signed(_sides(spark, d)[0]).drop("span")


def _resampled_sql(v: str, points: int) -> str:
    at = f"(i * 63 / {points - 1}.0::DOUBLE)"
    return f"list_transform(range({points}), lambda i: {v}[floor({at})::INT + 1] + ({v}[least(floor({at})::INT + 2, 64)] - {v}[floor({at})::INT + 1]) * ({at} - floor({at})))"


SIDES = f"""sl AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 120 + 40 * x) AS v, (200 + vec_id % 40)::DOUBLE AS span FROM embeddings),
sr AS (SELECT vec_id, [v[j] + (CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 3 = 1 THEN (vec_id * 31 + (j - 1) * 17) % 7 - 3 ELSE (vec_id * 31 + (j - 1) * 17) % 13 - 6 END) * 0.6::DOUBLE FOR j IN range(1, 65)] AS v,
  (200 + vec_id % 40) * (1 + vec_id % 4 * 0.02::DOUBLE) AS span FROM sl)"""
_PL = f"pl AS (SELECT unnest(range({TABLES * BITS})) AS i, unnest({[[float(x) for x in row] for row in PLANES]}::DOUBLE[][]) AS p)"


def _signed_sql(name: str, side: str) -> str:
    return f"""{name}p AS (SELECT vec_id, span, {_resampled_sql('v', POINTS)} AS q FROM {side}),
{name}z AS (SELECT vec_id, span, list_transform(q, lambda x: (x - m) / sd) AS z FROM (SELECT *, list_avg(q) AS m, list_stddev_pop(q) AS sd FROM {name}p)),
{name} AS (SELECT vec_id, span, i // {BITS} AS tab, sum(CASE WHEN list_dot_product(z, p) >= 0 THEN (1 << (i % {BITS}))::BIGINT ELSE 0 END)::BIGINT AS signature FROM {name}z, pl GROUP BY ALL)"""


LSH_SIGNATURES = f'WITH {SIDES}, {_PL}, {_signed_sql("gl", "sl")} SELECT vec_id, tab::INT AS "table", signature FROM gl'


def lsh_candidates(spark, d):
    left, right = (_signed(x) for x in _sides(spark, d))
    return dd.candidate_pairs(left, right, "vec_id", "span", SPAN_LIMIT)


_CAND = f"""{SIDES}, {_PL}, {_signed_sql("gl", "sl")}, {_signed_sql("gr", "sr")},
cand AS (SELECT DISTINCT a.vec_id AS left_key, b.vec_id AS right_key FROM gl a JOIN gr b ON a.tab = b.tab AND a.signature = b.signature WHERE abs(a.span - b.span) <= {SPAN_LIMIT}::DOUBLE * greatest(a.span, b.span))"""
LSH_CANDIDATES = f"WITH {_CAND} SELECT * FROM cand"


def _with_signals(spark, d, pairs):
    left, right = _sides(spark, d)
    return pairs.join(left.select(F.col("vec_id").alias("left_key"), F.col("v").alias("a")), "left_key").join(
        right.select(F.col("vec_id").alias("right_key"), F.col("v").alias("b")), "right_key")


def _prefiltered(spark, d):
    """Candidates whose profiles agree, with their signals."""
    return dd.agreements(_with_signals(spark, d, lsh_candidates(spark, d)), [("a", "b", "", False)], POINTS, PREFILTER, keep_signals=True)


def lsh_prefilter(spark, d):
    """Candidates whose profiles agree."""
    return rounded(_prefiltered(spark, d).select("left_key", "right_key", "mae", "p95", "r"), "mae", "p95", "r")


def _agreement_sql(name: str, pairs: str, points: int) -> str:
    return f"""{name}x AS (SELECT left_key, right_key, unnest({_resampled_sql('l.v', points)}) AS x, unnest({_resampled_sql('r.v', points)}) AS y FROM {pairs} JOIN sl l ON l.vec_id = left_key JOIN sr r ON r.vec_id = right_key),
{name} AS (SELECT left_key, right_key, avg(abs(x - y)) AS mae, quantile_cont(abs(x - y), 0.95) AS p95, corr(x, y) AS r FROM {name}x GROUP BY ALL)"""


_PRE = f"""{_CAND}, {_agreement_sql("ag", "cand", POINTS)}, pre AS (SELECT * FROM ag WHERE mae <= {PREFILTER['mae']} AND p95 <= {PREFILTER['p95']} AND r >= {PREFILTER['r']})"""
LSH_PREFILTER = f"WITH {_PRE} SELECT left_key, right_key, round(mae, 6) AS mae, round(p95, 6) AS p95, round(r, 6) AS r FROM pre"

VERIFIED_POINTS = 256


def pair_verify(spark, d):
    """The best partner of every left signal by error, then 95th percentile, then correlation, with its status; speeds and altitudes stand in as
    functions of the signals, absent for some."""
    p = _prefiltered(spark, d).select("left_key", "right_key", "a", "b")
    scaled = lambda c, k, m: F.when(F.col("left_key") % m != 0, F.transform(c, lambda v: v * k))
    p = p.withColumn("sa", scaled("a", 0.5, 4)).withColumn("sb", scaled("b", 0.5, 4)).withColumn("ta", scaled("a", 2.0, 2)).withColumn("tb", scaled("b", 2.0, 2))
    v = dd.verified(p, LIMITS, VERIFIED_POINTS).select("left_key", "right_key", "mae", "p95", "r", "status")
    best = dd.best_per_key(v, "left_key", F.col("mae"), F.col("p95"), -F.col("r"), F.col("right_key"))
    return rounded(best, "mae", "p95", "r")


PAIR_VERIFY = f"""WITH {_PRE}, {_agreement_sql("vf", "pre", VERIFIED_POINTS)},
au AS (SELECT left_key, right_key, median(x) AS mx, median(y) AS my FROM vfx GROUP BY ALL),
al AS (SELECT left_key, right_key, avg(abs((x - mx) - (y - my)) * 2) AS tm FROM vfx JOIN au USING (left_key, right_key) GROUP BY ALL),
st AS (SELECT vf.*, CASE WHEN NOT (mae <= 2 AND p95 <= 4 AND r >= 0.99::DOUBLE) THEN 'screened_out_after_continuous_verification'
  WHEN (left_key % 4 <> 0 AND mae * 0.5::DOUBLE <= 1.5::DOUBLE AND r >= 0.98::DOUBLE) OR (left_key % 2 <> 0 AND tm <= 5 AND r >= 0.98::DOUBLE) THEN 'near_candidate_hr_plus_auxiliary' ELSE 'near_candidate_hr_only' END AS status
  FROM vf JOIN al USING (left_key, right_key))
SELECT left_key, right_key, round(mae, 6) AS mae, round(p95, 6) AS p95, round(r, 6) AS r, status FROM st QUALIFY row_number() OVER (PARTITION BY left_key ORDER BY mae, p95, -r, right_key) = 1"""


def signal_digest(spark, d):
    """Digests of vectors as signals with missing bins: exact, trimmed, and of profiles."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") + i) % 11 != 0, 120 + 40 * x))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("hr"), F.transform(v, lambda x: x / 2).alias("speed"))
    return dd.signal_digests(e, "vec_id", 10, ["hr", "speed"])


def profile_digest(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.sha2(F.array_join(F.transform("embedding", lambda x: quantized(x.cast("double") * 100, 2, 4).cast("string")), ",").cast("binary"), 256).alias("digest"))


PROFILE_DIGEST = "SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: round_even((x::DOUBLE * 100 + 2) / 4, 0)::INT::VARCHAR), ',')) AS digest FROM embeddings"


def pii_patterns(spark, d):
    """Texts with planted paths: which privacy patterns each matches."""
    t = table(spark, d, "conversations")
    planted = F.element_at(F.array(F.lit(" C:\\Users\\x"), F.lit(" \\\\srv\\share"), F.lit(" /home/anna/data"), F.lit(" File:///etc"), F.lit(" see C:/data/x"), F.lit(" /mnt/a/b"), F.lit(" xC:/data"), F.lit(" home/anna/x"), F.lit("")), (F.col("conv_id") % 9 + 1).cast("int"))
    return t.select("conv_id", "turn", F.array_join(private_paths(F.concat("text", planted)), ",").alias("patterns"))


PII_PATTERNS = r"""WITH t AS (SELECT conv_id, turn, text || [' C:\Users\x', ' \\srv\share', ' /home/anna/data', ' File:///etc', ' see C:/data/x', ' /mnt/a/b', ' xC:/data', ' home/anna/x', ''][(conv_id % 9 + 1)::INT] AS x FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(x, '(^|[^A-Za-z0-9_])[A-Za-z]:[\\/]') THEN 'windows_path' END, CASE WHEN regexp_matches(x, '(^|[^\\])\\\\[A-Za-z0-9_.$-]+[\\/]') THEN 'unc_path' END,
  CASE WHEN regexp_matches(x, '(^|[^A-Za-z0-9_])/(home|Users|mnt)/[A-Za-z0-9_.-]+/') THEN 'posix_home' END, CASE WHEN regexp_matches(x, '(?i)\bfile://') THEN 'file_uri' END], lambda p: p IS NOT NULL), ',') AS patterns FROM t"""


def field_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", field_name(F.concat(F.lit(" "), F.col("p_type"), F.lit(" (Size) "))).alias("field"))


FIELD_NORMALIZE = "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(' ' || p_type || ' (Size) ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS field FROM part"

def quality_actions(spark, d):
    """Documents with enough characters, less excluded copies, by language."""
    actions = dd.resolved(_members(spark, d), "doc_id", "source", "lang")
    rows = dd.with_actions(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), actions, "doc_id", F.col("n_chars") >= 200)
    return rows.groupBy("lang", "action").agg(F.count("*").alias("records"), F.sum(F.col("analysis_eligible").cast("long")).alias("eligible"))


QUALITY_ACTIONS = f"""WITH {MEM}, m AS (SELECT doc_id AS k, source AS u, lang AS f, digest FROM mem), {_RES}
SELECT lang, coalesce(action, 'not_in_duplicate_group') AS action, count(*) AS records, count(*) FILTER (n_chars >= 200 AND coalesce(action, '') <> 'exclude') AS eligible
FROM documents LEFT JOIN out ON k = doc_id GROUP BY ALL"""


PLANS = {
    "quality_actions": (quality_actions, QUALITY_ACTIONS),
    "exact_groups": (exact_groups, EXACT_GROUPS), "dedupe_resolve": (dedupe_resolve, DEDUPE_RESOLVE), "exact_signal": (exact_signal, EXACT_SIGNAL),
    "keyword_family": (keyword_families, KEYWORD_FAMILY), "ontology_support": (ontology_support, ONTOLOGY_SUPPORT), "ontology_remap": (ontology_remap, ONTOLOGY_REMAP),
    "normalize_text": (normalize_text, NORMALIZE_TEXT), "band_link": (band_link, BAND_LINK), "lsh_signatures": (lsh_signatures, LSH_SIGNATURES),
    "lsh_candidates": (lsh_candidates, LSH_CANDIDATES), "lsh_prefilter": (lsh_prefilter, LSH_PREFILTER), "signal_digest": (signal_digest, None), "pair_verify": (pair_verify, PAIR_VERIFY), "profile_digest": (profile_digest, PROFILE_DIGEST),
    "pii_patterns": (pii_patterns, PII_PATTERNS), "field_normalize": (field_normalize, FIELD_NORMALIZE),
}
