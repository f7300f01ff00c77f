r"""Secret scans by multipart credential linking.

Base spans (assignments to secret names, access key ids, long hexadecimal runs) are always reported.  Further parts are
weak on their own: an assignment whose value is short, assignments to rarer names (weak), user or client names (id) and
endpoints (endpoint).  Parts become intervals; within a scope (text between blank lines) an interval join along the text
finds for each part whether who (id, access), what (assign, hex, weak) and where (endpoint) parts lie within MAX_GAP
code points.  A weak span is reported next to a who or where, an id next to a what, an endpoint next to both a who and
a what.

Positions come from the text's pieces between matches: a match starts after all earlier pieces and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "weak", "id", "endpoint")
_EQ = r"""["']?\x20*[:=]\x20*["']?"""
_NAMES, _VALUE = r"(?:password|passwd|secret|token|api_?key)", r"[A-Za-z0-9+/_.=-]+"
PATTERNS = {
    "assign": rf"(?i){_NAMES}{_EQ}{_VALUE}",
    "access": r"AKIA[A-Z0-9]{12,}",  # 16 characters; a shorter run has no later start that is long enough
    "hex": r"[0-9a-f]{32,}",
    "weak": rf"""(?i)(?:passphrase|passcode|pwd|credential|private_?key){_EQ}[^\x20\x09-\x0D"']{{4,}}""",
    "id": rf"(?i)(?:access_?key_?id|client_?id|user_?name|user_?id|login){_EQ}[A-Za-z0-9@._-]{{3,}}",
    "endpoint": rf"""(?i)(?:(?:https?|ftp|ssh|s3|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]{{4,}}|(?:host|hostname|server|endpoint){_EQ}[A-Za-z0-9.:-]{{4,}})""",
    "break": r"\n[\x20\x09\x0D]*\n",
}
#: Least characters of an assigned value: for a base span, and for a weak one.
VALUE, WEAK_VALUE = 8, 4
MAX_GAP = 240
_CODE = {k: i for i, k in enumerate(PATTERNS)}
_BREAK = _CODE["break"]


def _parts(text: Column, kind: str) -> Column:
    """array<struct<code, nth, piece, size, value>> of all matches of a kind; piece: code points since the last match."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    # zipped, so that the text is split once and not anew for each match; the last piece follows the last match
    zipped = F.filter(F.arrays_zip(found.alias("m"), F.split(text, PATTERNS[kind], -1).alias("p")), lambda z: z["m"].isNotNull())
    value = lambda m: F.length(F.regexp_extract(m, f"(?i)^{_NAMES}{_EQ}({_VALUE})$", 1)) if kind == "assign" else F.lit(VALUE)
    return F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(_CODE[kind]).alias("code"), i.alias("nth"), F.length(z["p"]).alias("piece"), F.length(z["m"]).alias("size"), value(z["m"]).alias("value")
        ),
    )

def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["code"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, found (array<struct<begin, code, end>> of all spans, by begin and KINDS), base_spans and spans (strings).

    A null text counts as empty and has no spans; rows don't depend on each other, so null or repeated ids do no harm.
    Texts of any length are read whole, in time that follows their length and n log n in their spans.  Other columns,
    whatever their names, aren't looked at; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    text, none = F.col("text"), F.expr("cast(array() as array<struct<code:int,nth:int,piece:int,size:int,value:int>>)")
    more = text.rlike("|".join(f"(?:{PATTERNS[k]})" for k in ("weak", "id", "endpoint")))
    parts = [F.when(text.rlike(PATTERNS[k]), _parts(text, k)).otherwise(none) for k in ("assign", "access", "hex")]
    any_of = F.concat(*parts)
    rows = rows.withColumn("base", any_of).withColumn("links", F.when(more | F.exists("base", lambda p: p["value"] < VALUE), F.concat(*[_parts(text, k) for k in ("weak", "id", "endpoint", "break")])).otherwise(none))
    flat = rows.select("rid", "doc_id", F.explode_outer(F.concat("base", "links")).alias("p")).select("rid", "doc_id", "p.*").repartition("rid")
    end = F.sum(F.col("piece") + F.col("size")).over(W.partitionBy("rid", "code").orderBy("nth"))
    at = flat.withColumn("end", end.cast("int")).withColumn("begin", (F.col("end") - F.col("size")).cast("int"))
    # parts that are too short even for a weak one lose their code; their rows stay, for the document's sake
    at = at.withColumn("code", F.when(F.col("value") < WEAK_VALUE, None).when((F.col("code") == 0) & (F.col("value") < VALUE), _CODE["weak"]).otherwise(F.col("code")))
    along = W.partitionBy("rid").orderBy("begin", "code", "end").rowsBetween(W.unboundedPreceding, 0)
    at = at.withColumn("scope", F.sum((F.col("code") == _BREAK).cast("int")).over(along))
    # what follows is what comes before in the reversed order: a frame up to the partition's end is summed up anew for each row
    scope, ahead = W.partitionBy("rid", "scope"), [F.col(c).desc() for c in ("begin", "code", "end")]
    past, next_ = (scope.orderBy(*o).rowsBetween(W.unboundedPreceding, -1) for o in (("begin", "code", "end"), ahead))

    def near(*kinds: str) -> Column:
        mine = F.col("code").isin(*[_CODE[k] for k in kinds])
        before, after = F.max(F.when(mine, F.col("end"))).over(past), F.min(F.when(mine, F.col("begin"))).over(next_)
        return F.coalesce(F.col("begin") - before <= MAX_GAP, F.lit(False)) | F.coalesce(after - F.col("end") <= MAX_GAP, F.lit(False))

    at = at.withColumn("who", near("id", "access")).withColumn("what", near("assign", "hex", "weak")).withColumn("where", near("endpoint"))
    code = F.col("code")
    told = (code <= _CODE["hex"]) | ((code == _CODE["weak"]) & (F.col("who") | F.col("where"))) | ((code == _CODE["id"]) & F.col("what")) | ((code == _CODE["endpoint"]) & F.col("who") & F.col("what"))
    span = F.when(told, F.struct("begin", "code", "end"))
    out = at.groupBy("rid", "doc_id").agg(*[F.count_if(code == _CODE[k]).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.array_sort(F.collect_list(span)).alias("found"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "found", _joined(F.filter("found", lambda s: s["code"] <= _CODE["hex"])).alias("base_spans"), _joined(F.col("found")).alias("spans"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _sql() -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    value = (rf"(?i)^{_NAMES}{_EQ}({_VALUE})$").replace("'", "''")
    matches = " UNION ALL ".join(f"SELECT rid, {_CODE[k]} AS code, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d" for k, p in quoted.items())
    near = {}
    for name, kinds in (("who", "id access"), ("what", "assign hex weak"), ("whr", "endpoint")):
        codes = ", ".join(str(_CODE[k]) for k in kinds.split())
        w = "OVER (PARTITION BY rid, scope ORDER BY b, code, e ROWS BETWEEN"
        near[name] = f"coalesce(b - max(CASE WHEN code IN ({codes}) THEN e END) {w} UNBOUNDED PRECEDING AND 1 PRECEDING) <= {MAX_GAP}, false) OR coalesce(min(CASE WHEN code IN ({codes}) THEN b END) {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING) - e <= {MAX_GAP}, false) AS {name}"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, code, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM ({matches}) x WHERE len(ms) > 0),
a AS (SELECT rid, CASE WHEN code = 0 THEN length(regexp_extract(m, '{value}', 1)) ELSE {VALUE} END AS v, code, sum(length(p) + length(m)) OVER (PARTITION BY rid, code ORDER BY i)::INT AS e, length(m) AS size FROM m),
b AS (SELECT rid, CASE WHEN code = 0 AND v < {VALUE} THEN {_CODE["weak"]} ELSE code END AS code, e - size AS b, e FROM a WHERE v >= {WEAK_VALUE}),
s AS (SELECT *, sum((code = {_BREAK})::INT) OVER (PARTITION BY rid ORDER BY b, code, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM b),
n AS (SELECT *, {", ".join(near.values())} FROM s),
f AS (SELECT * FROM n WHERE code <= 2 OR (code = 3 AND (who OR whr)) OR (code = 4 AND what) OR (code = 5 AND who AND what)),
g AS (SELECT rid, count(*) FILTER (code = 0) AS n_assign, count(*) FILTER (code = 1) AS n_access, count(*) FILTER (code = 2) AS n_hex,
        string_agg(({names})[code + 1] || ':' || b || ':' || e, ',' ORDER BY b, code, e) FILTER (code <= 2) AS base,
        string_agg(({names})[code + 1] || ':' || b || ':' || e, ',' ORDER BY b, code, e) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


SQL = _sql()
