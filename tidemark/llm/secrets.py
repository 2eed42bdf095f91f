"""Secret scans: pattern spans in every text, and corpus-wide ownership of the candidates.

Base spans come from three fixed patterns.  The method adds generic key-like tokens
whose hash is held by one owner only: the candidate hashes of the whole corpus are
aggregated by distinct repositories and owners, and a candidate that several owners
hold is an example that people copy, not a credential.

All of it is native: positions come from the lengths of the pieces between matches.
Defined results: a null text is empty; a null owner or repository counts as one
owner of its own; repeated rows get the same spans; texts of any length are scanned
whole; base spans never depend on other documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Fixed values of the base scan: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Generic candidates: long tokens of key characters, with a digit and both cases.
GENERIC = ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: Matches that are walked at once.
RUN = 128
#: A candidate that so many owners or repositories hold is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 1000


def spans(text: Column, pattern: str, group: int, least: int, order: int) -> Column:
    """Array of (start, kind number, end, value) of the matches whose group has enough characters, in code points.

    Between n matches split() gives n + 1 pieces, so a match starts after the
    pieces and matches before it.  Texts without a match cost one scan.  Matches are
    walked in runs of RUN, so the spans found so far are copied once a run, not once a match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("p"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    matches = F.filter(found, lambda x: x["m"].isNotNull())
    begin = lambda at: F.struct(at.alias("at"), none.alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), lambda k: F.slice(matches, k * RUN + 1, RUN))

    def run(acc, part):
        one = F.array(F.aggregate(part, begin(acc["at"]), step))  # held in an array, so that it is walked once although it is read twice
        return F.element_at(F.transform(one, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out"))), 1)

    walked = F.aggregate(runs, begin(F.lit(0)), run, lambda acc: acc["out"])
    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, walked).otherwise(none)


def told(found: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, GENERIC)])
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """docs' doc_id, _owner, _repo and _row (a hash of the text) with `base` and `generic` arrays of spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.col("source").alias("_owner"), F.col("doc_id").alias("_repo"), F.xxhash64(text).alias("_row"), text.alias("_t"))
    for i, (name, pattern, group, least) in enumerate((*KINDS, GENERIC)):
        out = out.withColumn(f"_{name}", spans(F.col("_t"), pattern, group, least, i))
    base = F.concat(*[F.col(f"_{k[0]}") for k in KINDS])
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
    apart = lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    out = out.withColumn("base", base).withColumn("generic", F.filter(F.col("_owned"), lambda x: mixed(x) & apart(x)))
    return out.select("doc_id", "_owner", "_repo", "_row", "base", "generic")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate in found, aggregated in two steps so that no key gathers its rows."""
    each = found.select("_owner", "_repo", F.explode(F.concat("base", "generic")).alias("x"))
    hashed = each.select(F.sha2(F.col("x.value"), 256).alias("hash"), F.coalesce(F.col("_owner"), F.lit("\0")).alias("owner"), F.coalesce(F.col("_repo").cast("string"), F.lit("\0")).alias("repo"))
    per_repo = hashed.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("one").alias("repos"))
    return per_owner.groupBy("hash").agg(F.count("owner").alias("owners"), F.sum("repos").alias("repositories"))


def classify(docs: DataFrame) -> DataFrame:
    """docs' doc_id, base spans and all spans, with how many candidates look live and how many are copied examples."""
    found = cut(scan(docs), "secret-spans")
    owners = cut(ownership(found), "secret-owners")
    each = found.filter(F.size(F.concat("base", "generic")) > 0).select("doc_id", "_row", F.explode(F.concat("base", "generic")).alias("x")).withColumn("hash", F.sha2(F.col("x.value"), 256))
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") <= EXAMPLE_REPOSITORIES)
    judged = each.join(owners, "hash").withColumn("live", live)
    per = judged.groupBy("doc_id", "_row").agg(
        F.collect_set(F.when(F.col("live"), F.col("x"))).alias("live_spans"),
        F.collect_set(F.when(~F.col("live"), F.col("x"))).alias("example_spans"),
    )
    keys = [F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("f._row") == F.col("p._row")]
    joined = found.alias("f").join(per.alias("p"), reduce(lambda a, b: a & b, keys), "left")
    added = F.filter(F.coalesce(F.col("live_spans"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")), lambda x: x["kind"] == len(KINDS))
    count = lambda i: F.size(F.filter(F.col("base"), lambda x: x["kind"] == i)).cast("long")
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array())), F.lit(0)).cast("long")
    return joined.select(
        "f.doc_id", *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)], F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.concat(F.col("base"), added)).alias("spans"), n("live_spans").alias("n_live"), n("example_spans").alias("n_example"),
    )


def _spans_sql(name: str, pattern: str, group: int, least: int, order: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT k, doc_id, source, {order} AS kind, '{name}' AS name, v, (pos + list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0))::BIGINT AS s, length(m[i]) AS n
  FROM (SELECT k, doc_id, source, 0 AS pos, p, m, unnest(g) AS v, generate_subscripts(m, 1) AS i FROM (
    SELECT k, doc_id, source, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS p FROM d)) WHERE length(v) >= {least}"""


def report_sql() -> str:
    """DuckDB SQL for classify()."""
    parts = "\nUNION ALL\n".join(_spans_sql(*k, i) for i, k in enumerate((*KINDS, GENERIC)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
a AS ({parts}),
c AS (SELECT *, s + n AS e FROM a),
b AS (SELECT * FROM c WHERE kind < 3),
g AS (SELECT * FROM c WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = c.k AND b.s < c.e AND c.s < b.e)),
z AS (SELECT * FROM b UNION ALL SELECT * FROM g),
o AS (SELECT v, count(DISTINCT coalesce(source, '')) < 2 AND count(DISTINCT coalesce(doc_id, -1)) <= 1000 AS live FROM z GROUP BY v),
y AS (SELECT z.*, o.live FROM z JOIN o USING (v)),
s AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM y GROUP BY k)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example FROM d LEFT JOIN s USING (k)
"""
