"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every text version is content-addressed by the SHA-256 of its UTF-8 bytes. The ledger is a Parquet table
with one row for each scanned (blob, rule version); a scan reads only pairs that the ledger lacks, one
representative row for each blob, and findings are joined back to every path (doc_id) that holds the blob.

Rules: assign, access and hex as given; pem (private-key headers) and jwt are this operator's own. Within a
rule, matches are leftmost and non-overlapping, and only then are those that are too short dropped. Spans
are code points, end exclusive: the text between matches comes from split(), the matches from
regexp_extract_all(), and running lengths give the places.

A null text is an empty blob without findings. Repeated rows and ids, null ids too, each get their row; blobs are
scanned whoever holds them. Equal (start, kind) can't occur twice. Other columns are ignored, whatever their names. All
patterns run in linear time, and places come from running sums by chunks, so texts may be long and full of findings.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import shared_dir, table

#: kind, pattern (Java syntax), least length of the whole match, least length of group 2 (0: none).
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 12),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),  # maximal runs, so the length may stand in the pattern
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    # (Begins where no such character stands before, so that a long run is tried once; the possessive counts give nothing
    # back, which no match could use.)
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0),
)
RULE_VERSION, CHUNK = 2, 256
BASE = ("assign", "access", "hex")
_SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def _spans(text: Column, kind: str, pattern: str, least: int, least_value: int) -> Column:
    """Spans of one rule: array of (start, ord, end, kind)."""
    order = [r[0] for r in RULES].index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least_value else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("size"), F.transform(value, F.length).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind")))
        good = (x["size"] >= least) & (x["value"] >= least_value)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def placed(chunks: Column) -> Column:
        """Spans of all chunks: a chunk's own places begin where the matches and gaps before it end."""
        zero = F.lit(0).cast("bigint")
        size = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda n, x: n + x["gap"] + F.coalesce(x["size"], F.lit(0))))
        begins = F.aggregate(size, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, begins, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"]))

    # A lambda's argument is computed once, where a repeated expression would be computed for each chunk.
    cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda c: F.slice(z, c * CHUNK + 1, F.lit(CHUNK)))
    once = lambda x, f: F.transform(F.array(x), f)[0]
    return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(once(zipped, lambda z: once(cut(z), placed)))


def _joined(spans: Column) -> Column:
    one = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


def find_spans(df: DataFrame) -> DataFrame:
    """df (with a non-null text) and, for each row with a finding, findings: all spans by start, then rule order."""
    likely = F.lit(False)
    for _, pattern, _, _ in RULES:
        likely = likely | F.col("text").rlike(pattern)
    df = df.where(likely)
    every = F.concat(*(_spans(F.col("text"), *rule) for rule in RULES))
    return df.withColumn("findings", F.array_sort(every)).drop("text")


def content_address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


LEDGER_SCHEMA = f"blob binary, rule_version int, findings {_SPAN}"


def scan(docs: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at this path lacks, append to it, and give (doc_id, blob, findings) for every row.

    The append is one Parquet write; a failed run leaves no committed files, and a later run scans again.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    # row is never null, also where doc_id is; equal ones cost a second scan of the same blob at most.
    docs = docs.select("doc_id", text.alias("text"), content_address(F.col("text")).alias("blob"), F.xxhash64("doc_id").alias("row"))
    known = _ledger(spark, ledger)
    first = docs.groupBy("blob").agg(F.min("row").alias("row"))
    if known is not None:
        first = first.join(known.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    fresh = docs.join(first.hint("shuffle_hash"), ["blob", "row"], "left_semi")
    findings = find_spans(fresh.select("blob", "text")).dropDuplicates(["blob"])
    # Blobs without findings are entered too, so that they are not scanned again; narrow rows, no text.
    entered = first.select("blob").join(findings, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), "findings")
    entered.write.mode("append").parquet(ledger)
    mine = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where((F.col("rule_version") == rule_version) & F.col("findings").isNotNull()).select("blob", "findings")
    return docs.select("doc_id", "blob").join(mine, "blob", "left")


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if there else None


def new_ledger(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"ledger-{uuid.uuid4().hex}")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), new_ledger(spark))
    spans = F.coalesce("findings", F.array().cast(_SPAN))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


#: A line break that no base64 line, PEM attribute or empty line follows.
_BODY_ENDS = r"(?:\r?\n|\\[rn])(?![ \t>]*(?:[A-Za-z0-9+/=]*+|(?:Proc-Type|DEK-Info):[^\r\n\\]*+)[ \t]*(?:[\r\n\\]|$))"


def _key_size(rest: Column) -> Column:
    """Length of a private key's body at the start of `rest`: to its END line, else to the end of its base64 lines."""
    rest = F.substring_index(rest, "-----BEGIN ", 1)
    closed = F.regexp_extract(rest, r"(?s)^.*?-----END [A-Z ]{0,30}PRIVATE KEY-----", 0)
    lines = F.rtrim(F.split(rest, _BODY_ENDS, 2)[0])
    same_line = F.regexp_extract(rest, r"^[ \t]*[A-Za-z0-9+/=]{32,}", 0)
    return F.length(F.when(closed != "", closed).when(rest.rlike(r"^[ \t]*(?:[\r\n]|\\[rn])"), lines).otherwise(same_line)).cast("bigint")


def keep_secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; each found span is replaced in its text by [kind].

    A private key's header is found by the scan; its body goes with it. Overlapping spans (a hex run inside an
    assignment) merge into one replacement under the first one's kind.
    """
    names = docs.columns
    docs = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))  # own names never clash
    found = scan(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), new_ledger(spark)).where("findings IS NOT NULL").select("blob", "findings").dropDuplicates(["blob"])
    out = docs.withColumn("blob", content_address(F.col("text"))).join(found, "blob", "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        rest = F.substring(F.col("text"), (x["end"] + 1).cast("int"), F.length("text"))
        end = x["end"] + F.when(x["kind"] == "pem", _key_size(rest)).otherwise(F.lit(0).cast("bigint"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(fresh, F.concat(acc["out"], piece, F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("findings"), start, step)
    rest = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))
    out = out.withColumn("text", F.when(F.col("findings").isNull(), F.col("text")).otherwise(F.concat(done["out"], rest)))
    if "n_chars" in names:
        c = f"c{names.index('n_chars')}"
        out = out.withColumn(c, F.when(F.col("findings").isNull(), F.col(c)).otherwise(F.length("text").cast(docs.schema[c].dataType)))
    return out.select(*docs.columns).toDF(*names)


#: SQL's patterns know neither look-behind nor possessive counts: there the character before the match is its group 1.
_BEFORE = "(?<![A-Za-z0-9_-])"


def _rule_sql(order: int, kind: str, pattern: str, least: int, least_value: int) -> str:
    pattern = pattern.replace("'", "''")
    value = f"regexp_extract_all(text, '{pattern}', 2)" if least_value else "m"
    behind = pattern.startswith(_BEFORE)
    if behind:
        pattern = pattern.replace(_BEFORE, "(^|[^A-Za-z0-9_-])").replace(",}+", ",}")
    before = f"list_transform(regexp_extract_all(text, '{pattern}', 1), lambda x: length(x))" if behind else "list_transform(m, lambda x: 0)"
    return f"""SELECT doc_id, {order} AS ord, '{kind}' AS kind, (list_sum(g[1:i]) + coalesce(list_sum(z[1:i - 1]), 0) + b[i])::BIGINT AS a, (list_sum(g[1:i]) + list_sum(z[1:i]))::BIGINT AS e
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, m, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS g, list_transform(m, lambda x: length(x)) AS z,
      list_transform({value}, lambda x: length(x)) AS v, {before} AS b FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m FROM documents WHERE text IS NOT NULL)))
WHERE z[i] >= {least} AND v[i] >= {least_value}"""


SQL = f"""
WITH s AS ({" UNION ALL ".join(_rule_sql(i, *r) for i, r in enumerate(RULES))}),
t AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) AS spans, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) FILTER (ord < 3) AS base,
      count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN t USING (doc_id)
"""
