"""Secret scans over an incremental ledger of content-addressed blobs; DataFrame operations only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnspark.llm.tables import quoted
from churnspark.session import shared_folder, stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if group `group` (0: all of it) has `least` characters."""

    kind: str
    version: int
    pattern: str
    probe: str  # cheaper pattern that every text with a match contains
    group: int = 0
    least: int = 1
    sql: str = ""  # the same pattern for engines without possessive loops, if it needs another form

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: A run of too few letters never makes room for a longer one, so the least length of the last
#: two stands in their pattern; a short value of the first takes its characters all the same.
BASE = (
    Rule(
        "assign", 1,
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", group=1, least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
_64 = "[A-Za-z0-9+/]"
_GAP = r"""[ \t\r\n\\"'>,]"""
_HEAD = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_FIELD = "n?(?:Proc-Type|DEK-Info): ?[A-Z0-9a-f,-]*[A-Z0-9a-f-]"
_LAST = rf"(?:[\r\n]+[ \t>]*{_64}{{1,23}}=?=?[ \t]*(?:[\r\n]|\z))?"
#: A key with its heading: up to the END line before any other heading, whatever stands between; without
#: one, header fields and the lines of base64 that follow, the last however short. However many
#: lines there are: Java walks possessive loops without recursion, and no turn is ever taken back here.
_KEY = (
    rf"{_HEAD}(?:[^-]*+(?:-{{1,4}}+(?!-)[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}++{_FIELD})*+(?:{_GAP}++{_64}{{24,}}+=?+=?+)*+{_LAST})"
)
#: Said again with plain loops, for SQL engines whose loops never recurse.
_KEY_SQL = (
    rf"{_HEAD}(?:[^-]*(?:--?-?-?[^-]+)*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}+{_FIELD})*(?:{_GAP}+{_64 * 24}{_64}*=?=?)*{_LAST})"
)
#: Kinds beyond the base ones, whose formats are unmistakable.
MORE = (
    Rule("key_block", 3, _KEY, r"PRIVATE KEY-----", sql=_KEY_SQL),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10}"),
    Rule("host_token", 1, r"(?:gh[opsu]_|glpat-|xox[abprs]-)[A-Za-z0-9-]{20,}", r"(?:gh[opsu]_|glpat-|xox[abprs]-)"),
)
RULES = BASE + MORE
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _nothing() -> Column:
    return F.array().cast(_SPANS)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The counting matches of one rule: leftmost, not overlapping, in code points, end exclusive.

    Places come from the lengths of the matches and of the text between them. A match that does
    not count still takes its characters.
    """
    size = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    gap = F.transform(F.split(text, rule.pattern, -1), F.length)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        hit = F.array(F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )).cast(_SPANS)
        return F.struct(
            end.alias("at"), F.when(x["value"] >= rule.least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out")
        )

    walked = F.aggregate(
        F.arrays_zip(gap.alias("gap"), size.alias("size"), value.alias("value")),
        F.struct(F.lit(0).cast("long").alias("at"), _nothing().alias("out")), step, lambda acc: acc["out"],
    )
    return F.when(text.rlike(rule.probe), walked).otherwise(_nothing())


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _addressed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.drop("blob", "findings").withColumn("blob", F.unhex(F.sha2(text, 256)))


def new_ledger(spark: SparkSession) -> str:
    """Where a ledger of this session's own is kept, in the shared folder."""
    return f"{shared_folder(spark)}/blob-ledger-{uuid.uuid4().hex}"


def record(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan the blobs of `docs` by the rule versions they have not met and append what comes out to the ledger.

    Blobs are gathered by a partial aggregate, so a text that a third of the rows hold costs a row per task.
    """
    names = [rule.name for rule in rules]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = _addressed(docs, text_col).select("blob", text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = _read(docs.sparkSession, ledger)
    if seen is None:
        todo = blobs.withColumn("rules", F.array(*map(F.lit, names)))
    else:
        met = seen.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("met"))
        todo = blobs.join(met, "blob", "left").withColumn(
            "rules", F.array_except(F.array(*map(F.lit, names)), F.coalesce("met", F.array().cast("array<string>")))
        ).where(F.size("rules") > 0)
    found = F.flatten(F.array(*[
        F.when(F.array_contains("rules", rule.name), rule_spans(F.col("text"), rule, rank)).otherwise(_nothing())
        for rank, rule in enumerate(rules)
    ]))
    # the version a finding was made with is kept beside it
    versions = F.create_map(*[F.lit(x) for rule in rules for x in (rule.kind, rule.name)])
    todo.select(
        "blob", "rules", F.transform(found, lambda s: s.withField("rule", versions[s["kind"]])).alias("found")
    ).write.mode("append").parquet(ledger)


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """`docs` with `blob` (SHA-256 of the text) and `findings`, one row per row.

    The ledger at `ledger` holds, for each blob, the rule versions it was scanned with and what
    they found. A blob is read once, from any row that holds it, and only by the rule versions
    it has not met (see `record`); every row gets its blob's findings by a join on the address. Findings are
    structs of start, rank of the kind, end and kind, by start and then rank. Without `ledger` a
    fresh one is kept in the shared folder.

    Defined cases: a null text is the empty blob; repeated rows all come back; a text of any length is one
    blob, read whole; an empty table gives an empty result; input columns called blob or findings are replaced.
    """
    spark = docs.sparkSession
    ledger = ledger or new_ledger(spark)
    record(docs, ledger, rules, text_col)
    names = [rule.name for rule in rules]
    ranks = F.create_map(*[F.lit(x) for rank, rule in enumerate(rules) for x in (rule.name, rank)])
    hits = spark.read.parquet(ledger).where(F.size("found") > 0).select("blob", F.explode("found").alias("s"))
    hits = hits.where(F.col("s.rule").isin(names)).select("blob", F.struct(
        F.col("s.start").alias("start"), ranks[F.col("s.rule")].alias("rank"),
        F.col("s.end").alias("end"), F.col("s.kind").alias("kind"),
    ).alias("s"))
    # bounded by the findings of one text; a rerun that appended a blob twice adds nothing
    by_blob = stage(hits.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("findings")), "findings")
    return _addressed(docs, text_col).join(by_blob, "blob", "left").select(
        *quoted(docs.drop("blob", "findings").columns), "blob",
        F.coalesce(F.col("findings").cast(_SPANS), _nothing()).alias("findings"),
    )


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined in the order of the findings."""
    return F.concat_ws(",", F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def of_kinds(findings: Column, rules: tuple[Rule, ...]) -> Column:
    return F.filter(findings, lambda s: s["kind"].isin([rule.kind for rule in rules]))


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The scanned rows with every found place replaced by `mark`; overlapping places become one."""
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
        )

    cleaned = F.aggregate(
        "findings", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return scanned.withColumn(text_col, F.when(F.size("findings") > 0, cleaned).otherwise(text))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the digests of the findings of `documents`."""
    def one(rank: int, rule: Rule) -> str:
        pattern = (rule.sql or rule.pattern).replace("'", "''")
        return f"""
    SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank,
           list_sum(g[1:i]) + coalesce(list_sum(w[1:i-1]), 0) AS s, list_sum(g[1:i]) + list_sum(w[1:i]) AS e
    FROM (SELECT doc_id, w, v, g, unnest(range(1, len(w) + 1)) AS i FROM (
        SELECT doc_id,
               [length(x) FOR x IN regexp_extract_all(t, '{pattern}', 0)] AS w,
               [length(x) FOR x IN regexp_extract_all(t, '{pattern}', {rule.group})] AS v,
               [length(x) FOR x IN string_split_regex(t, '{pattern}')] AS g
        FROM d WHERE regexp_matches(t, '{pattern}')))
    WHERE v[i] >= {rule.least}"""
    body = "\n    UNION ALL".join(one(rank, rule) for rank, rule in enumerate(rules))
    joined = "string_agg(kind || ':' || cast(s AS bigint) || ':' || cast(e AS bigint), ',' ORDER BY s, rank)"
    counts = ", ".join(
        f"cast(coalesce(count(*) FILTER (kind = '{rule.kind}'), 0) AS bigint) AS n_{rule.kind}" for rule in BASE
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({body}),
a AS (SELECT doc_id, {counts},
             sha256(coalesce({joined} FILTER (rank < {len(BASE)}), '')) AS base_sha256, {joined} AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""
