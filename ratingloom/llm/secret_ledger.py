"""Secret scans over every version of a text, each content scanned once per rule version.

A version is a row: a path (its id) and its text. Texts are addressed by their
SHA-256. A ledger has a row for each scanned content: the rule versions it was
scanned under and the spans found. Only pairs of content and rule version that
the ledger lacks are scanned; findings then go back to every path by a join on
the address, so copies cost a hash and not a scan. All of it is DataFrame
expressions.

Rules find leftmost, non-overlapping matches in whole texts; offsets count code
points. Positions come from the lengths of the pieces between matches, summed
over the matches of one text.

Defined results: NULL is the empty text; a text without findings has counts of
zero, no spans, and the digest of the empty string; repeated rows are reported
each; rows without an id are scanned like others; columns beside the id and the
text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.llm.registry import given, query
from ratingloom.llm.scratch import Scratch, numbered


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose `group` is shorter than `least` code points are dropped.

    `hint` is a text that every match contains, if there is one. `whole` is searched
    instead of `pattern` where the secret goes on beyond what the SQL states.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: str = ""
    whole: str = ""

    @property
    def searched(self) -> str:
        return self.whole or self.pattern

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(f'{self.searched} {self.least} {self.group}'.encode()).hexdigest()[:12]}"


#: The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # the runs of [0-9a-f]+ that are long enough
)
_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: Up to the END line with no other marker between; without one, over the header lines and the runs and lines of base64
#: that follow, also where line ends are written as escapes. Possessive, so long bodies need no deep stack.
_BODY = (
    r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+"
    r"""(?:(?:[\s"',;>#*|]|\\[nrt])*+[A-Za-z0-9+/]{16,}+={0,2}+"""
    r"""|[ \t"']*+(?:\r?\n|(?:\\r)?\\n)[ \t"'>#*|]*+[A-Za-z0-9+/]++={0,2}+(?=[ \t]*+(?:[\r\n"']|\\[nr]|\z)))*+)"""
)
#: Kinds this method adds.
ADDED = (
    Rule("pem", _BEGIN, 1, hint="PRIVATE KEY-----", whole=_BEGIN + _BODY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, hint="eyJ"),
    Rule("login", r"[a-z][a-z0-9+]{1,20}://[^\s:/@]{1,80}:[^\s:/@]{3,80}@[A-Za-z0-9.-]+", 1, hint="://", whole=r"[a-z][a-z0-9+]{1,20}://[^\s:/@]+:[^\s:/@]{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE + ADDED

#: Contents with findings up to which they are sent to every task; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(rule: Rule, rank: int, text: Column, versions: Column) -> Column:
    """Of each match: kind, its number, and the lengths of the piece before it, the match and its group."""
    pattern = F.lit(rule.searched)
    pieces, whole = F.split(text, rule.searched, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    each = F.transform(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("p"), whole.alias("w"), group.alias("g")),
        lambda m, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), F.length(m["p"]).cast("bigint").alias("gap"), F.length(m["w"]).cast("bigint").alias("size"),
            (F.length(m["g"]) >= rule.least).alias("kept"),
        ),
    )
    found = text.contains(rule.hint) & text.rlike(rule.searched) if rule.hint else text.rlike(rule.searched)
    return F.when(F.array_contains(versions, rule.version) & found, each)


def scan(contents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans of the contents (blob, text, versions) that have any under the rule versions named."""
    lists = [F.coalesce(_matches(r, k, F.col("text"), F.col("versions")), F.array()) for k, r in enumerate(rules)]
    found = contents.select("blob", F.concat(*lists).alias("found")).where(F.size("found") > 0)
    one = found.select("blob", F.inline("found")).dropDuplicates(["blob", "rank", "i"])  # a row that is there twice
    before = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return (
        one.withColumn("end", end).where("kept")
        .select("blob", F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end", F.element_at(kinds, F.col("rank") + 1).alias("kind")).alias("span"))
        .groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, the smallest id that has it, and the rule versions it was not yet scanned under."""
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        return blobs.withColumn("versions", wanted)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
    todo = blobs.join(seen, "blob", "left").withColumn("versions", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    return todo.where(F.size("versions") > 0).drop("seen")


def scan_unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger rows to add: only contents and rule versions that the ledger lacks are read by a rule."""
    todo = unseen(paths, ledger, rules)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", address(F.col("text")))
    # the side with the texts streams through the join and is not sorted
    named = todo.select(F.col("doc_id").alias("first_id"), F.col("blob").alias("first_blob"), "versions").hint("shuffle_hash")
    contents = texts.join(named, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("blob") == F.col("first_blob")))
    spans = scan(contents.select("blob", "text", "versions"), rules)
    return todo.select("blob", "versions").join(spans, "blob", "left")


def paths_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and blob of every version."""
    return docs.select(F.col(id_col).alias("doc_id"), address(F.col(text_col)).alias("blob"))


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with the spans of its content under the given rules, ordered by start, then rule."""
    current = F.array(*[F.lit(r.kind) for r in rules])
    known = (
        ledger.where("size(spans) > 0").groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        .withColumn("spans", F.filter("spans", lambda s: F.array_contains(current, s["kind"])))
    )
    return paths.join(known, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")))


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as text."""
    names = [r.kind for r in BASE]
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *[F.size(of([n])).cast("bigint").alias(f"n_{n}") for n in names],
        F.sha2(_written(of(names)), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
    )


def _inside(spans: Column, text: Column) -> Column:
    """The text with every span replaced by its kind; overlapping spans become one."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    cut = lambda a, s: F.struct(
        F.when(
            s["start"] >= a["at"],
            F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")),
        ).otherwise(a["done"]).alias("done"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    return F.aggregate(spans, start, cut, lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def redacted(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` with every secret in `text` replaced by its kind, and n_chars counted anew."""
    scratch = Scratch(docs.sparkSession, "secrets")
    paths = scratch.write(paths_of(docs), "paths")
    added = scratch.write(scan_unseen(docs, paths, ledger), "ledger")
    known = (ledger.unionByName(added) if ledger is not None else added).where("size(spans) > 0").join(paths.select("blob").distinct(), "blob", "left_semi")
    hit = known.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("blob_spans")).withColumnRenamed("blob", "hit_blob")
    hit = scratch.write(hit, "hit")
    plain, name = numbered(docs)
    before = F.col(name["text"])
    both = plain.withColumn("text_blob", address(before)).join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, F.col("text_blob") == F.col("hit_blob"), "left")
    both = both.withColumn("text_after", F.when(F.col("blob_spans").isNull(), before).otherwise(_inside(F.col("blob_spans"), before)))
    out = both.withColumn(name["text"], F.col("text_after"))
    if "n_chars" in name:
        counted = F.length("text_after").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(name["n_chars"], F.when(F.col("blob_spans").isNull(), F.col(name["n_chars"])).otherwise(counted))
    return out.select(*name.values()).toDF(*docs.columns)


def _oracle() -> str:
    quoted = lambda r: r.pattern.replace("'", "''")
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{quoted(r)}') AS p, regexp_extract_all(t, '{quoted(r)}', 0) AS w, "
        f"regexp_extract_all(t, '{quoted(r)}', {r.group}) AS g FROM d"
        for k, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    written = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({found}),
u AS (SELECT doc_id, k, kind, least, p, w, g, unnest(range(1, len(w) + 1)) AS i FROM r),
s AS (SELECT doc_id, k, kind, length(w[i]) AS n, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM u WHERE length(g[i]) >= least),
c AS (SELECT doc_id, {counts}, {written} FILTER (k < {len(BASE)}) AS base, {written} AS spans FROM s GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (doc_id)"""


@query("op7_secret_ledger", _oracle())
def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = given(spark, sf_dir, "documents"), Scratch(spark, "op7")
    paths = scratch.write(paths_of(docs), "paths")
    ledger = scratch.write(scan_unseen(docs, paths, None), "ledger")
    return report(findings(paths, ledger))
