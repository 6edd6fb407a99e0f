"""Secret scans: an incremental blob ledger.

Every version of a path is addressed by the SHA-256 of its content. The ledger is a Parquet table of one row for each blob
and scan: the rule versions applied and what they found. A scan reads only blobs with a rule version that the ledger
lacks, appends one batch, and joins the findings back to every path. All work is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    least: int  # characters that the group must have, else the match is dropped
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the base kinds, in the order that breaks ties; further kinds follow them.
BASE = (
    Rule("assign", 1, "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, "[0-9a-f]+", 24),
)
MORE = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 30),
)
RULES = BASE + MORE
#: Matches of a text that are walked at a time.
STRIDE = 512
#: Tasks that the paths of one blob are dealt to.
SALTS = 16
FOUND = "array<struct<kind:string,version:int,start:int,stop:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule in code points. Positions are running sums over the pieces between the matches and the matches.

    A text without a match costs one pass. When the kind's own minimum applies to maximal runs, the pattern asks for
    that length itself, which finds the same spans and stops early on short runs.
    """
    pattern = f"{rule.pattern[:-1]}{{{rule.least - (4 if rule.kind == 'access' else 0)},}}" if rule.pattern.endswith("]+") and not rule.group and rule.kind in ("access", "hex") else rule.pattern
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sized = F.transform(hits, lambda x: F.struct(F.length(x).alias("n"), (F.length(F.regexp_extract(x, pattern, rule.group)) >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), sized, lambda g, m: F.struct(g.alias("g"), m["n"].alias("n"), m["ok"].alias("ok")))

    def walked(start: Column, some: Column) -> Column:
        """The place behind some matches, and the spans of those that count."""
        return F.aggregate(
            some,
            F.struct(start.alias("at"), none.alias("out")),
            lambda s, x: F.struct((s["at"] + x["g"] + x["n"]).alias("at"), F.when(x["ok"], F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["n"]).alias("stop"))))).otherwise(s["out"]).alias("out")),
        )

    # matches are walked in runs of STRIDE, so that arrays which grow are short in texts with very many matches
    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(STRIDE)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int>>>").alias("out"), pairs.alias("pairs")),
        lambda s, i: F.get(F.transform(F.array(walked(s["at"], F.slice(s["pairs"], i, STRIDE))), lambda w: F.struct(w["at"].alias("at"), F.concat(s["out"], F.array(w["out"])).alias("out"), s["pairs"].alias("pairs"))), F.lit(0)),
        lambda s: F.flatten(s["out"]),
    )
    tagged = F.transform(walk, lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), x["start"].alias("start"), x["stop"].alias("stop")))
    return F.when(text.rlike(pattern), tagged).otherwise(F.array().cast(FOUND))


def blob(text: Column) -> Column:
    """A null content is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger table, or None where nothing was scanned yet."""
    jvm = spark._jvm.org.apache.hadoop.fs
    if not (at := jvm.Path(path)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"blob binary, rules array<string>, found {FOUND}").parquet(path)


def scan(versions: DataFrame, path: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at `path` lacks and append it. Returns the ledger's findings: blob, found (only blobs with any, for these rules).

    Copies are merged before the shuffle, with a ledger and without, so a blob with very many paths moves once for each task
    that reads it. With a ledger present, hashes alone say which blobs lack a rule, and only those blobs' contents are
    scanned. A pair that two scans appended at once counts once.
    """
    spark = versions.sparkSession
    keys = F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col(content), F.lit(""))
    all_blobs = versions.select(blob(F.col(content)).alias("blob"), text.alias("content"))
    old = ledger(spark, path)
    if old is None:
        pending = all_blobs.groupBy("blob").agg(F.first("content").alias("content")).withColumn("rules", keys)
    else:
        known = old.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        new = all_blobs.select("blob").distinct().join(known, "blob", "left").select("blob", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
        # copies are merged first: the join then meets one row a blob, at the place where the aggregate left it
        pending = all_blobs.groupBy("blob").agg(F.first("content").alias("content")).join(new, "blob")
    none = F.array().cast(FOUND)
    found = F.concat(*[F.when(F.array_contains("rules", r.key), spans(F.col("content"), r)).otherwise(none) for r in rules])
    pending.select("blob", "rules", found.alias("found")).write.mode("append").parquet(path)
    # a rule's newest known version wins nothing here: only the asked versions count
    asked = F.filter("found", lambda x: F.concat_ws("@", x["kind"], x["version"]).isin([r.key for r in rules]))
    return ledger(spark, path).select("blob", asked.alias("found")).where(F.size("found") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))


def findings(versions: DataFrame, path: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions with `found`: its spans by start, then by the rules' order. No findings: an empty array.

    Repeated rows and paths with equal content each get the blob's findings; an empty table gives none. The column `found`
    of versions, if it has one, is replaced.
    """
    got = scan(versions, path, content, rules)
    order = F.lit(",".join(r.kind for r in rules))
    by_start = F.transform(F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.instr(F.concat(F.lit(","), order, F.lit(",")), F.concat(F.lit(","), x["kind"], F.lit(","))).alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["version"].alias("version")))), lambda x: F.struct(x["kind"].alias("kind"), x["version"].alias("version"), x["start"].alias("start"), x["stop"].alias("stop")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__kithgraph_salt")
    got = got.select(F.col("blob").alias("__kithgraph_blob"), by_start.alias("__kithgraph_found"), salts)
    # a blob's paths are dealt by the task that reads them, which a repeated task does alike
    marked = versions.drop("found").withColumn("__kithgraph_blob", blob(F.col(content))).withColumn("__kithgraph_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    joined = marked.join(got, ["__kithgraph_blob", "__kithgraph_salt"], "left")
    return joined.withColumn("found", F.coalesce("__kithgraph_found", F.array().cast(FOUND))).drop("__kithgraph_blob", "__kithgraph_salt", "__kithgraph_found")


def redact(text: Column, found: Column) -> Column:
    """The text with every found span as `[secret]`; spans that overlap become one."""
    last = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        found, last,
        lambda s, x: F.struct(
            F.when(x["stop"] <= s["at"], s["out"]).when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("[secret]"))).alias("out"),
            F.greatest(s["at"], x["stop"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) + 1)),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through one ledger in two scans: the blobs of the lower half of the hashes first, then whatever is unseen."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    common.shared_dir(spark)
    told = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    path = common.scratch(spark, "ledger")
    scan(docs.where(blob(F.col("text")) < F.unhex(F.lit("80"))), path)
    out = findings(docs, path)
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(F.concat_ws(",", F.transform(base, told)).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.transform("found", told)).alias("spans"))
